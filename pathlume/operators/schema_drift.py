"""Files whose columns drift: versioned schema fingerprints, a list of every change, and one table out of all files.

The files of a feed are read in the order of their part index. Files in a row with the same columns and logical types form one
schema version, known by a fingerprint. Each version is compared with the one before it: columns that vanished are matched with
columns that appeared by what they hold (not by what they are called), giving rename steps; the rest are added, removed and retyped
steps. The steps chain every version to one table: a row passes the rename, cast and default rules of its file.

What a column holds is summarised by counts over fixed bins (of magnitude, of value and of form), so the summary of a column is
bounded, adds up over files and rows, and is aggregated before it is shuffled. Driver and single tasks see schemas and summaries
only, never rows.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pathlume.sources.workspace import written

#: Logical type of a recorded dtype, by the start of its name in lower case; anything else is OTHER.
TYPE_PREFIXES = (("bool", "BOOL"), ("int", "INT"), ("uint", "INT"), ("float", "FLOAT"), ("double", "FLOAT"), ("object", "STRING"), ("str", "STRING"), ("category", "STRING"))
MAGNITUDE_BINS_PER_DECADE = 20
VALUE_BINS = 1024
SAME_CONTENT = 0.5
#: Between these numbers of distinct value bins, and shares of them to values, columns pass from being compared by how often each value
#: occurs to being compared by magnitude, values in common and form.
FEW_VALUES, FEW_SHARE = (32, 128), (0.4, 0.6)

_PAIR = re.compile(r'\s*[{,]?\s*"((?:[^"\\]|\\.)*)"\s*:\s*("(?:[^"\\]|\\.)*"|\[[^\[\]]*\]|true|false|null|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*(?=[,}])')
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")


def logical_type_of(dtype_name: str | None) -> str:
    name = (dtype_name or "").strip().lower()
    return next((kind for start, kind in TYPE_PREFIXES if name.startswith(start)), "OTHER")


def read_payload(text: str | None) -> tuple[dict, bool]:
    """The pairs of a JSON object and whether it was whole. Of a cut-off one, the pairs that are complete; of anything else, none."""
    if text is None:
        return {}, False
    try:
        found = json.loads(text)
        return (found, True) if isinstance(found, dict) else ({}, False)
    except ValueError:
        pass
    found, at = {}, 0
    while m := _PAIR.match(text, at):
        try:
            found[json.loads(f'"{m[1]}"')] = json.loads(m[2])
        except ValueError:
            break
        at = m.end()
    return found, False


def kind_of(value) -> str:
    if isinstance(value, bool):
        return "BOOL"
    if isinstance(value, int):
        return "INT"
    if isinstance(value, float):
        return "FLOAT"
    return "STRING" if isinstance(value, str) else "OTHER"


def canonical_text(value) -> tuple[str, float | None]:
    """A value's text, alike whatever type it is stored as, and its number where it is one."""
    if isinstance(value, bool):
        return str(int(value)), float(value)
    if isinstance(value, list):
        return "|".join("" if v is None else str(v) for v in value), None
    if isinstance(value, dict):
        return json.dumps(value, sort_keys=True), None
    if isinstance(value, str):
        text = value.strip()
        low = text.lower()
        if low in ("true", "false"):
            return ("1", 1.0) if low == "true" else ("0", 0.0)
        if not _NUMBER.fullmatch(text):
            return text, None
        value = float(text)
    number = float(value)
    return (f"{number:.15g}", number) if math.isfinite(number) else (str(number), None)


def magnitude_bin(number: float) -> int:
    """Signed logarithmic bin: values a twelfth apart share one, whatever their size."""
    size = math.log10(1 + abs(number) * 1000)
    return int(math.copysign(math.floor(size * MAGNITUDE_BINS_PER_DECADE), number))


def form_of(text: str, number: float | None) -> str:
    if number is not None:
        return f"{'-' if number < 0 else '+'}{min(len(text.partition('.')[2]), 4)}"
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", text))))


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[tuple, int] = defaultdict(int)
        for dataset, file, payload in zip(batch["dataset_name"], batch["filename"], batch["payload"]):
            for name, value in read_payload(payload)[0].items():
                if value is None or value != value:
                    continue
                text, number = canonical_text(value)
                counts[dataset, file, name, "kind", kind_of(value)] += 1
                counts[dataset, file, name, "value", str(zlib.crc32(text.encode()) % VALUE_BINS)] += 1
                form = form_of(text, number)  # the whole form, as a hash where it is long
                counts[dataset, file, name, "form", form if len(form) <= 40 else f"#{zlib.crc32(form.encode())}"] += 1
                if number is not None:
                    counts[dataset, file, name, "size", str(magnitude_bin(number))] += 1
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["dataset_name", "filename", "column_name", "view", "bin", "n"])


def content_summaries(part_rows: DataFrame) -> DataFrame:
    """Counts by file, column, view and bin. Null values and cut-off pairs count nothing."""
    rows = part_rows.select("dataset_name", "filename", "payload").dropna()
    schema = "dataset_name string, filename string, column_name string, view string, bin string, n bigint"
    return rows.mapInPandas(_summaries, schema).groupBy("dataset_name", "filename", "column_name", "view", "bin").agg(F.sum("n").alias("n"))


def ordered_files(part_files: DataFrame) -> DataFrame:
    """``dataset_name, filename, part_idx``: each file once, at its least part index; files without name or index do not exist."""
    return part_files.select("dataset_name", "filename", "part_idx").dropna().groupBy("dataset_name", "filename").agg(F.min("part_idx").alias("part_idx"))


def file_columns(part_files: DataFrame, part_columns: DataFrame, summaries: DataFrame) -> DataFrame:
    """``dataset_name, filename, part_idx, column_name, logical``: recorded columns, and of files without records those of their rows."""
    kinds = [(start, kind) for start, kind in TYPE_PREFIXES]
    name = F.lower(F.trim("dtype_name"))
    logical = F.lit("OTHER")
    for start, kind in reversed(kinds):
        logical = F.when(name.startswith(start), F.lit(kind)).otherwise(logical)
    recorded = (
        part_columns.dropna(subset=["dataset_name", "filename", "column_name"])
        .withColumn("logical", logical)
        .groupBy("dataset_name", "filename", "column_name")
        .agg(F.min("logical").alias("logical"))
    )
    seen = (
        summaries.filter("view = 'kind'")
        .groupBy("dataset_name", "filename", "column_name")
        .agg(F.max_by("bin", F.struct("n", "bin")).alias("most"), F.collect_set("bin").alias("all"))
        .select(
            "dataset_name",
            "filename",
            "column_name",
            F.when(F.size(F.array_except("all", F.array(F.lit("INT"), F.lit("FLOAT")))) == 0, F.when(F.array_contains("all", "FLOAT"), "FLOAT").otherwise("INT")).otherwise(F.col("most")).alias("logical"),
        )
        .join(recorded.select("dataset_name", "filename").distinct(), ["dataset_name", "filename"], "left_anti")
    )
    return recorded.unionByName(seen).join(ordered_files(part_files), ["dataset_name", "filename"])


def schema_versions(columns: DataFrame) -> DataFrame:
    """One row per file: its columns, fingerprint, version (1 for the first) and whether it opens the version."""
    per_file = (
        columns.groupBy("dataset_name", "part_idx", "filename")
        .agg(F.sort_array(F.collect_list(F.struct("column_name", "logical"))).alias("columns"))
        .withColumn("fingerprint", F.sha2(F.to_json("columns"), 256))
    )
    order = W.partitionBy("dataset_name").orderBy("part_idx", "filename")
    opens = F.coalesce(F.col("fingerprint") != F.lag("fingerprint").over(order), F.lit(True))
    return per_file.withColumn("opens", opens).withColumn("version", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))


def _spread(counts: dict[str, int]) -> tuple[dict[str, float], int]:
    total = sum(counts.values())
    return ({k: v / total for k, v in counts.items()} if total else {}), total


def _overlap(a: dict[str, int], b: dict[str, int]) -> float:
    p, q = _spread(a)[0], _spread(b)[0]
    return sum(min(p[k], q[k]) for k in p.keys() & q.keys())


def _chance_gap(a: dict[str, int], b: dict[str, int]) -> float:
    """1 - overlap that two samples of one distribution, of these sizes, have on average."""
    n, m = sum(a.values()), sum(b.values())
    shares = [(a.get(k, 0) + b.get(k, 0)) / (n + m) for k in a.keys() | b.keys()]
    return 0.5 * sum(math.sqrt(2 / math.pi * p * (1 - p) * (1 / n + 1 / m)) for p in shares)


def _shift(a: dict[str, int], b: dict[str, int]) -> float:
    """Mean difference of the quantiles, in decades of magnitude."""
    p, q = _spread(a)[0], _spread(b)[0]
    at = sorted({int(k) for k in (*p, *q)})
    gap = total = 0.0
    for low, high in zip(at, at[1:]):
        gap += p.get(str(low), 0) - q.get(str(low), 0)
        total += abs(gap) * (high - low)
    return total / MAGNITUDE_BINS_PER_DECADE


def _chance_shift(a: dict[str, int], b: dict[str, int]) -> float:
    """The shift, in decades, that two samples of one distribution of these sizes may well have."""
    n, m = sum(a.values()), sum(b.values())
    pooled = {int(k): a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}
    mean = sum(k * v for k, v in pooled.items()) / (n + m)
    spread = math.sqrt(sum(v * (k - mean) ** 2 for k, v in pooled.items()) / (n + m))
    return spread * math.sqrt(1 / n + 1 / m) / MAGNITUDE_BINS_PER_DECADE


def content_likeness(a: dict[str, dict[str, int]], b: dict[str, dict[str, int]], slack: float = 3.3) -> float:
    """0 to 1: how well two columns' summaries (counts by view and bin) agree. Columns without values agree with none.

    Columns of few values agree when their shares differ by no more than ``slack`` times what two samples differ by on average.
    """
    n, m = sum(a.get("value", {}).values()), sum(b.get("value", {}).values())
    if not n or not m:
        return 0.0
    numeric = [sum(x.get("size", {}).values()) / k for x, k in ((a, n), (b, m))]
    if max(numeric) > 0.5 and min(numeric) < 0.9:
        return 0.0
    alike = _overlap(a["value"], b["value"])
    by_share = alike if 1 - alike <= max(0.1, slack * _chance_gap(a["value"], b["value"])) else 0.5 * alike
    if min(numeric) >= 0.9:
        by_size = math.exp(-max(0.0, _shift(a["size"], b["size"]) - _chance_shift(a["size"], b["size"])) / 0.2) * (0.5 + 0.5 * _overlap(a["form"], b["form"]))
    else:
        by_size = max(alike, 0.9 * _overlap(a["form"], b["form"]))
    few = min(_fewness(len(x["value"]), k) for x, k in ((a, n), (b, m)))
    return few * by_share + (1 - few) * by_size


def _fewness(bins: int, values: int) -> float:
    """1 for a column of few distinct values, 0 for one of many, and between them in between."""
    if bins <= 2:
        return 1.0
    falling = lambda x, ends: min(1.0, max(0.0, (ends[1] - x) / (ends[1] - ends[0])))
    return falling(bins, FEW_VALUES) * falling(bins / values, FEW_SHARE)


def match_renames(gone: dict[str, dict], come: dict[str, dict], least: float = SAME_CONTENT) -> dict[str, str]:
    """New name by old name: the best agreeing pairs first, each name once, ties by name. Names that differ in spelling only get more slack."""
    bare = lambda name: re.sub(r"[\W_]", "", name).lower()
    scored = sorted(((-content_likeness(a, b, 5 if bare(old) == bare(new) else 3.3), old, new) for old, a in gone.items() for new, b in come.items()))
    pairs: dict[str, str] = {}
    for score, old, new in scored:
        if -score >= least and old not in pairs and new not in pairs.values():
            pairs[old] = new
    return pairs


def _steps(group: pd.DataFrame) -> pd.DataFrame:
    """The steps of one version of one feed, from the columns of the version and of the one before it with their summaries."""
    first = group.iloc[0]
    sides: dict[str, dict[str, dict]] = {"old": {}, "new": {}}
    for side, name, views in zip(group["side"], group["column_name"], group["views"]):
        found: dict[str, dict[str, int]] = defaultdict(dict)
        for v in views if views is not None else ():
            found[v["view"]][v["bin"]] = v["n"]
        sides[side][name] = found
    types = {(s, c): t for s, c, t in zip(group["side"], group["column_name"], group["logical"])}
    old, new = sides["old"], sides["new"]
    pairs = match_renames({c: v for c, v in old.items() if c not in new}, {c: v for c, v in new.items() if c not in old})
    out = [("renamed", a, b) for a, b in pairs.items()]
    out += [("removed", c, "") for c in old if c not in new and c not in pairs]
    out += [("added", "", c) for c in new if c not in old and c not in pairs.values()]
    out += [("retyped", a, b) for a, b in {**pairs, **{c: c for c in old if c in new}}.items() if types["old", a] != types["new", b]]
    return pd.DataFrame([(first["dataset_name"], first["filename"], int(first["version"]), *x) for x in out], columns=["dataset_name", "filename", "version", "change", "old_name", "new_name"])


def migration_steps(versions: DataFrame, summaries: DataFrame) -> DataFrame:
    """``dataset_name, filename, version, change, old_name, new_name`` of every version but a feed's first, at the file that opens it.

    A column is summarised over its whole stay (all files in a row that have its name), so that short files are matched by more than
    their own rows. A group of the last step holds the columns of two versions.
    """
    order = W.partitionBy("dataset_name").orderBy("part_idx", "filename")
    placed = versions.withColumn("place", F.row_number().over(order))
    columns = placed.select("dataset_name", "filename", "version", "place", F.explode("columns").alias("c")).select("dataset_name", "filename", "version", "place", "c.column_name", "c.logical")
    by_name = W.partitionBy("dataset_name", "column_name").orderBy("place")
    stays = columns.withColumn("stay", F.col("place") - F.row_number().over(by_name))
    views = (
        stays.join(summaries.filter("view != 'kind'"), ["dataset_name", "filename", "column_name"])
        .groupBy("dataset_name", "column_name", "stay", "view", "bin")
        .agg(F.sum("n").alias("n"))
        .groupBy("dataset_name", "column_name", "stay")
        .agg(F.collect_list(F.struct("view", "bin", "n")).alias("views"))
    )
    opening = placed.filter("opens and version > 1").select("dataset_name", F.col("filename").alias("opened_by"), F.col("version").alias("opened"), "place")
    here = stays.join(opening, ["dataset_name", "place"]).withColumn("side", F.lit("new"))
    before = stays.join(opening.withColumn("place", F.col("place") - 1), ["dataset_name", "place"]).withColumn("side", F.lit("old"))
    sides = here.unionByName(before).select("dataset_name", F.col("opened_by").alias("filename"), F.col("opened").alias("version"), "side", "column_name", "logical", "stay")
    # only columns that came or went need their content: the others look for no stay
    both = W.partitionBy("dataset_name", "filename", "column_name")
    sides = sides.withColumn("stay", F.when(F.count(F.lit(1)).over(both) == 1, F.col("stay")))
    schema = "dataset_name string, filename string, version int, change string, old_name string, new_name string"
    return sides.join(views, ["dataset_name", "column_name", "stay"], "left").drop("stay").groupBy("dataset_name", "filename").applyInPandas(_steps, schema)


def wider(kinds: set[str]) -> str:
    """The logical type that holds all of ``kinds``."""
    if len(kinds) == 1:
        return next(iter(kinds))
    if kinds <= {"INT", "FLOAT"}:
        return "FLOAT"
    return "INT" if kinds <= {"BOOL", "INT"} else "FLOAT" if kinds <= {"BOOL", "INT", "FLOAT"} else "STRING"


def _rules(group: pd.DataFrame) -> pd.DataFrame:
    """Chain the steps of one feed: for every version the table's column of each of its columns. Rows: one per version."""
    group = group.sort_values("version")
    slots: list[dict] = []  # a table column: its last name and the types it had
    now: dict[str, int] = {}
    per_version: list[tuple[int, dict[str, int]]] = []
    for version, columns, steps in zip(group["version"], group["columns"], group["steps"]):
        names = [(c["column_name"], c["logical"]) for c in columns]
        renamed = {s["new_name"]: s["old_name"] for s in (steps if steps is not None else ()) if s["change"] == "renamed"}
        then: dict[str, int] = {}
        for name, kind in names:
            slot = now.get(renamed.get(name, name))
            if slot is None or slot in then.values():
                # a name that comes back takes up its old column unless that one is in use
                slot = next((i for i, s in enumerate(slots) if s["name"] == name and i not in now.values() and i not in then.values()), None)
            if slot is None:
                slots.append({"name": name, "kinds": set()})
                slot = len(slots) - 1
            slots[slot]["kinds"].add(kind)
            slots[slot]["name"] = name
            then[name] = slot
        now = then
        per_version.append((int(version), then))
    taken: dict[str, int] = defaultdict(int)
    titles = []
    for s in slots:
        taken[s["name"]] += 1
        titles.append(s["name"] if taken[s["name"]] == 1 else f"{s['name']}#{taken[s['name']]}")
    table = [{"column_name": t, "logical": wider(s["kinds"])} for t, s in zip(titles, slots)]
    rows = [(group["dataset_name"].iloc[0], v, [{"source": n, "target": titles[i], "logical": table[i]["logical"]} for n, i in sorted(m.items())], table) for v, m in per_version]
    return pd.DataFrame(rows, columns=["dataset_name", "version", "rules", "table"])


def migration_rules(versions: DataFrame, steps: DataFrame) -> DataFrame:
    """``dataset_name, version, rules, table``: where each column of a version goes, and all columns of the feed's table.

    A group holds the versions of one feed, which are as many as its schema changes.
    """
    gathered = steps.groupBy("dataset_name", "version").agg(F.collect_list(F.struct("change", "old_name", "new_name")).alias("steps"))
    opening = versions.filter("opens").select("dataset_name", "version", "columns").join(gathered, ["dataset_name", "version"], "left")
    schema = "dataset_name string, version int, rules array<struct<source:string,target:string,logical:string>>, table array<struct<column_name:string,logical:string>>"
    return opening.groupBy("dataset_name").applyInPandas(_rules, schema)


_WHOLE = re.compile(r"[+-]?\d+")


def cast_value(value, kind: str):
    """A value under a logical type; None where it has none. A fraction is no INT, and a whole number keeps all its figures."""
    if value is None or value != value:
        return None
    text, number = canonical_text(value)
    if kind == "BOOL":
        return None if number not in (0.0, 1.0) else bool(number)
    if kind == "INT":
        if isinstance(value, int):
            return int(value)
        if isinstance(value, str) and _WHOLE.fullmatch(value.strip()):
            return int(value.strip())
        return int(number) if number is not None and number.is_integer() else None
    if kind == "FLOAT":
        return number
    if kind == "STRING":
        return value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else text if isinstance(value, (float, list, dict)) else str(value)
    return value


def _routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        records, whole, failed = [], [], []
        for payload, rules, table in zip(batch["payload"], batch["rules"], batch["table"]):
            found, complete = read_payload(payload)
            record = {t["column_name"]: None for t in table}
            lost = []
            for rule in rules:
                value = found.get(rule["source"])
                record[rule["target"]] = cast = cast_value(value, rule["logical"])
                if cast is None and value is not None and value == value:
                    lost.append(rule["target"])
            records.append(json.dumps(record, sort_keys=True, ensure_ascii=False))
            whole.append(complete)
            failed.append(sorted(lost))
        yield batch[["dataset_name", "filename", "version", "row_no"]].assign(record=records, whole=whole, failed=failed)


def one_table(part_rows: DataFrame, versions: DataFrame, rules: DataFrame) -> DataFrame:
    """Every stored row of a listed file under the columns of its feed's table: ``dataset_name, filename, version, row_no, record,
    whole, failed``.

    ``record`` is a JSON object with all columns of the table, null by default. Rows stored twice come out once; of cut-off payloads
    the complete pairs are kept and ``whole`` is false. ``failed`` names the columns whose value has no form under the column's type and
    is null for that.
    """
    per_file = versions.select("dataset_name", "filename", "version").join(rules, ["dataset_name", "version"])
    distinct = part_rows.select("dataset_name", "filename", "row_no", "payload").distinct()
    schema = "dataset_name string, filename string, version int, row_no int, record string, whole boolean, failed array<string>"
    return distinct.join(per_file, ["dataset_name", "filename"]).mapInPandas(_routed, schema)


#: Logical types as Spark types; lists and objects stay JSON text.
SPARK_TYPES = {"INT": "bigint", "FLOAT": "double", "BOOL": "boolean", "STRING": "string", "OTHER": "string"}


def typed_cells(table: DataFrame, rules: DataFrame) -> DataFrame:
    """The values of ``one_table`` in long form, one row per row and column of its feed's table (null ones too), each in the column of its
    type: ``dataset_name, filename, row_no, column_name, logical, int_value, float_value, bool_value, text_value``."""
    columns = rules.groupBy("dataset_name").agg(F.first("table").alias("table"))
    cells = table.select("dataset_name", "filename", "row_no", F.from_json("record", "map<string,string>").alias("m")).join(columns, "dataset_name").select("dataset_name", "filename", "row_no", "m", F.explode("table").alias("c"))
    value, kind = F.col("m")[F.col("c.column_name")], F.col("c.logical")
    of = lambda logical, name: F.when(kind.isin(*logical), value.try_cast(SPARK_TYPES[logical[0]])).alias(name)
    return cells.select("dataset_name", "filename", "row_no", F.col("c.column_name").alias("column_name"), kind.alias("logical"), of(["INT"], "int_value"), of(["FLOAT"], "float_value"), of(["BOOL"], "bool_value"), of(["STRING", "OTHER"], "text_value"))


class SchemaDrift:
    """The whole operator over one set of feeds. Summaries and versions are written to the shared folder once and used by all parts."""

    def __init__(self, part_files: DataFrame, part_columns: DataFrame, part_rows: DataFrame):
        self.part_rows = part_rows
        self.summaries = written(content_summaries(part_rows), "drift-summaries")
        self.versions = written(schema_versions(file_columns(part_files, part_columns, self.summaries)), "drift-versions")

    def steps(self) -> DataFrame:
        return migration_steps(self.versions, self.summaries)

    def rules(self) -> DataFrame:
        return migration_rules(self.versions, self.steps())

    def table(self) -> DataFrame:
        return one_table(self.part_rows, self.versions, self.rules())

    def cells(self) -> DataFrame:
        """The one table in long form with typed values."""
        rules = self.rules()
        return typed_cells(one_table(self.part_rows, self.versions, rules), rules)

    def feed(self, dataset_name: str) -> DataFrame:
        """One feed's rows as a table with typed columns after ``filename`` and ``row_no``; columns that would clash with these get ``#``.
        A feed without files has these two only."""
        rows = self.rules().filter(F.col("dataset_name") == dataset_name).select("table").limit(1).collect()  # as many entries as columns
        table = [(c["column_name"], SPARK_TYPES[c["logical"]]) for c in rows[0]["table"]] if rows else []
        kind = T.StructType([T.StructField(name, T._parse_datatype_string(of)) for name, of in table])
        records = self.table().filter(F.col("dataset_name") == dataset_name).select("filename", "row_no", F.from_json("record", kind).alias("r"))
        taken = {"filename", "row_no"}
        return records.select("filename", "row_no", *(F.col("r").getField(name).alias(f"{name}#" if name in taken else name) for name, _ in table))
