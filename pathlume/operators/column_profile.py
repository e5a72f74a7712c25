"""Profiles of every column of large Parquet tables, load by load, from footers and dictionaries.

A load is the set of rows with one value of the load column. Row groups are the units of work:

1. The footers of all files are read by tasks. For a row group that holds one load, the footer's null count is that load's exact null
   count (floating columns excepted, as NaN counts as null here) and its extrema are exact where the writer marks them valid.
2. A chunk whose footer says it is all null, or constant and without nulls, needs nothing more: it is not read. Other chunks are
   decoded once, text columns through their dictionaries, so each distinct value of a chunk is looked at once with its number of rows.
3. Chunks give partial counts: rows, nulls, extrema, and the hash of each distinct value with its count. Partials are merged by key;
   hashes of one load and column meet in one place, which makes distinct counts exact (up to a 64-bit collision).

The merged counts are folded into bounded histograms by value, magnitude, length and form, on which loads are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pathlume.sources.workspace import written

PARTIAL = "column_id int, load_no bigint, view int, bin bigint, n bigint, lo double, hi double"
#: Views of a partial count: all rows, nulls, extrema only, one distinct value, and the bins of magnitude, length and form.
ROWS, NULLS, EXTREMA, VALUE, SIZE, LENGTH, FORM = range(7)
#: Views of the merged counts only: distinct values by how often a load has them, and rows by how many loads have their value.
OFTEN, SHARED = 7, 8
#: From so many loads on, a value counts as one of the column's.
SHARED_LOADS = 3
VALUE_BINS = 1024
#: Stands for a missing load number within a task.
NO_LOAD = np.iinfo(np.int64).min
BINS_PER_DOUBLING = 4


@dataclass(frozen=True)
class ProfiledColumn:
    dataset_name: str
    column_name: str
    kind: str  # INT, FLOAT, BOOL or STRING


def logical_kind(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "BOOL"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INT"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "FLOAT"
    if isinstance(kind, T.StringType):
        return "STRING"
    raise ValueError(f"a column of type {kind.simpleString()} is not profiled")


def magnitude_bins(numbers: np.ndarray) -> np.ndarray:
    """Signed logarithmic bins, four to each doubling; 0 for zero."""
    size = np.abs(numbers.astype(np.float64))
    with np.errstate(divide="ignore"):
        power = np.floor(np.log2(np.where(size > 0, size, 1.0)) * BINS_PER_DOUBLING).astype(np.int64) + 5000
    return np.where(size > 0, np.sign(numbers).astype(np.int64) * power, 0)


def length_bin(length: int) -> int:
    """Exact up to 24, then in steps of a quarter doubling."""
    return length if length <= 24 else 24 + int(math.log2(length / 24) * 4)


def form_bin(text: str) -> int:
    """Which kinds of characters a text has: a bit each for lower, upper, digit, inner blank, outer blank, other ASCII, beyond ASCII."""
    bits = 0
    for c in text:
        if c.islower():
            bits |= 1
        elif c.isupper():
            bits |= 2
        elif c.isdigit():
            bits |= 4
        elif c.isspace():
            bits |= 8
        elif c < "\x80":
            bits |= 32
        if c >= "\x80":
            bits |= 64
    return bits | (16 if text[:1].isspace() or text[-1:].isspace() else 0)


#: Settings of the Hadoop client for object storage and the arguments of the reader they stand for.
_STORE_SETTINGS = {"fs.s3a.access.key": "access_key", "fs.s3a.secret.key": "secret_key", "fs.s3a.session.token": "session_token", "fs.s3a.endpoint": "endpoint_override", "fs.s3a.endpoint.region": "region"}


def store_options(spark: SparkSession) -> dict[str, str]:
    """What the session's Hadoop settings say about object storage, for the readers of row groups."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return {name: value for key, name in _STORE_SETTINGS.items() if (value := conf.get(key))}


def _file_system(path: str, options: dict[str, str]):
    """File system and inner path. Names of object storage that Spark uses (s3a, s3n) are those of pyarrow's s3."""
    import pyarrow.fs as pafs

    scheme, _, rest = path.partition("://")
    if scheme in ("s3", "s3a", "s3n"):
        return pafs.S3FileSystem(**options), unquote(rest)
    return pafs.FileSystem.from_uri(path)


def _open(path: str, options: dict[str, str] | None = None, text_columns: tuple[str, ...] = ()):
    import pyarrow.parquet as pq

    system, inner = _file_system(path, options or {})
    return pq.ParquetFile(system.open_input_file(inner), read_dictionary=list(text_columns))


class _Opened:
    """The file opened last: row groups of one file that follow each other read its footer once."""

    def __init__(self, options: dict[str, str]):
        self.options, self.key, self.file = options, None, None

    def __call__(self, path: str, text_columns: tuple[str, ...] = ()):
        if self.key != (path, text_columns):
            self.key, self.file = (path, text_columns), _open(path, self.options, text_columns)
        return self.file


def _footer_units(batches: Iterator[pd.DataFrame], options: dict[str, str]) -> Iterator[pd.DataFrame]:
    """One row per row group."""
    for batch in batches:
        found = []
        for dataset, path in zip(batch["dataset_name"], batch["path"]):
            meta = _open(path, options).metadata
            found += [(dataset, path, g, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
        yield pd.DataFrame(found, columns=["dataset_name", "path", "row_group", "n_rows"])


class _Chunk:
    """One column of one row group: its footer statistics and, where they do not do, its values."""

    def __init__(self, file, row_group: int, index: int, name: str, kind: str):
        self.file, self.row_group, self.name, self.kind = file, row_group, name, kind
        meta = file.metadata.row_group(row_group)
        self.rows = meta.num_rows
        stats = meta.column(index).statistics
        self.nulls = stats.null_count if stats is not None and stats.has_null_count else None
        self.extrema = (stats.min, stats.max) if stats is not None and stats.has_min_max and stats.min == stats.min and stats.max == stats.max else None

    def exact_nulls(self) -> int | None:
        """The footer's null count where it is the count of values that count as null."""
        return self.nulls if self.kind != "FLOAT" or self.nulls == self.rows else None

    def constant(self) -> bool:
        """All values known from the footer: every one null, or none null and the extrema equal. Text extrema may be cut, so not text."""
        if self.nulls == self.rows:
            return True
        return self.kind in ("INT", "BOOL") and self.nulls == 0 and self.extrema is not None and self.extrema[0] == self.extrema[1]

    def values(self):
        """(codes, distinct values): the code of each row, -1 for null, into the chunk's distinct values."""
        if self.constant():
            return (np.full(self.rows, -1), np.array([])) if self.nulls == self.rows else (np.zeros(self.rows, dtype=np.int64), np.array([self.extrema[0]]))
        column = self.file.read_row_group(self.row_group, columns=[self.name])[self.name].combine_chunks()
        if hasattr(column, "dictionary"):
            distinct = np.array(column.dictionary.to_pylist(), dtype=object)
            return column.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), distinct
        encoded = column.dictionary_encode()
        distinct = encoded.dictionary.to_numpy(zero_copy_only=False)
        codes = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if self.kind == "FLOAT" and len(distinct):
            codes = np.where(np.append(np.isnan(distinct), False)[codes], -1, codes)
        return codes, distinct


def _counted(column_id: int, kind: str, loads: np.ndarray, codes: np.ndarray, distinct: np.ndarray) -> Iterator[pd.DataFrame]:
    """Partial counts of a chunk by load: one distinct value each, and the bins derived from them."""
    there = codes >= 0
    if not there.any():
        return
    pairs = pd.DataFrame({"load_no": loads[there], "code": codes[there]}).value_counts(sort=False).rename("n").reset_index()
    used, at = np.unique(pairs["code"].to_numpy(), return_inverse=True)
    values = distinct[used]
    text = kind == "STRING"
    whole = kind == "INT"  # whole numbers as such: above 2**53 neighbours are one as floating numbers
    hashes = pd.util.hash_array(values.astype(object) if text else values.astype(np.int64) if whole else values.astype(np.float64) + 0.0).view(np.int64)
    base = pairs[["load_no", "n"]].assign(column_id=column_id, lo=np.nan, hi=np.nan)
    yield base.assign(view=VALUE, bin=hashes[at])
    if text:
        bins = {LENGTH: np.array([length_bin(len(v)) for v in values]), FORM: np.array([form_bin(v) for v in values])}
    elif kind == "BOOL":
        bins = {}
    else:
        bins = {SIZE: magnitude_bins(values)}
    for view, of in bins.items():
        yield base.assign(view=view, bin=of[at]).groupby(["column_id", "load_no", "view", "bin"], as_index=False).agg({"n": "sum", "lo": "min", "hi": "max"})
    if kind in ("INT", "FLOAT"):
        numbers = pd.Series(values.astype(np.float64)[at])
        ends = numbers.groupby(pairs["load_no"]).agg(["min", "max"]).reset_index()
        yield pd.DataFrame({"column_id": column_id, "load_no": ends["load_no"], "view": EXTREMA, "bin": 0, "n": 0, "lo": ends["min"], "hi": ends["max"]})


def _partials_of(path: str, row_group: int, columns: list[tuple[int, str, str]], load_column: str, opened: _Opened | None = None) -> Iterator[pd.DataFrame]:
    file = (opened or _Opened({}))(path, tuple(name for _, name, kind in columns if kind == "STRING"))
    places = {file.metadata.schema.column(i).path: i for i in range(file.metadata.num_columns)}
    load = _Chunk(file, row_group, places[load_column], load_column, "INT")
    one_load = load.nulls == 0 and load.extrema is not None and load.extrema[0] == load.extrema[1]
    codes, distinct = load.values()
    loads = np.append(distinct.astype(np.int64), NO_LOAD)[codes]
    number, rows = np.unique(loads, return_counts=True)
    for column_id, name, kind in columns:
        chunk = _Chunk(file, row_group, places[name], name, kind)
        row = {"column_id": column_id, "bin": 0, "lo": np.nan, "hi": np.nan}
        yield pd.DataFrame({**row, "load_no": number, "view": ROWS, "n": rows})
        exact = chunk.exact_nulls() if one_load else None
        if exact is not None:
            yield pd.DataFrame({**row, "load_no": number, "view": NULLS, "n": [exact]})
        if one_load and chunk.extrema is not None and kind in ("INT", "FLOAT"):
            yield pd.DataFrame({**row, "load_no": number, "view": EXTREMA, "n": [0], "lo": [float(chunk.extrema[0])], "hi": [float(chunk.extrema[1])]})
        codes, distinct = chunk.values()
        if exact is None:
            empty_in, empty = np.unique(loads[codes < 0], return_counts=True)
            yield pd.DataFrame({**row, "load_no": empty_in, "view": NULLS, "n": empty})
        yield from _counted(column_id, kind, loads, codes, distinct)


def chunk_partials(spark: SparkSession, tables: dict[str, DataFrame], columns: list[ProfiledColumn], load_column: str = "load_no") -> DataFrame:
    """Partial counts of all row groups. Tables must be plain Parquet reads; files come from their listing."""
    files = [(name, path) for name, table in tables.items() for path in table.inputFiles()]
    wanted: dict[str, list[tuple[int, str, str]]] = {}
    for i, c in enumerate(columns):
        wanted.setdefault(c.dataset_name, []).append((i, c.column_name, c.kind))
    cores, options = spark.sparkContext.defaultParallelism, store_options(spark)
    listed = spark.createDataFrame(files, "dataset_name string, path string")
    units = listed.repartition(max(cores, len(files) // 64)).mapInPandas(lambda batches: _footer_units(batches, options), "dataset_name string, path string, row_group int, n_rows bigint")

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["column_id", "load_no", "view", "bin", "n", "lo", "hi"]
        opened = _Opened(options)
        for batch in batches:
            for dataset, path, row_group, n_rows in zip(batch["dataset_name"], batch["path"], batch["row_group"], batch["n_rows"]):
                if n_rows:
                    for part in _partials_of(path, row_group, wanted.get(dataset, []), load_column, opened):
                        yield part[names].assign(load_no=part["load_no"].astype("Int64").mask(part["load_no"] == NO_LOAD))

    return units.repartition(max(3 * cores, len(files)), "path", "row_group").sortWithinPartitions("path", "row_group").mapInPandas(partials, PARTIAL)


def load_histograms(partials: DataFrame) -> DataFrame:
    """``column_id, load_no, view, bin, n, n_distinct, lo, hi``: partials merged, distinct values folded into ``VALUE_BINS`` bins, and by how
    often they occur in the load: exact up to 32 times, then in steps of a quarter doubling; and rows by
    whether their value is in one load, two or more, from the exact hashes."""
    merged = partials.groupBy("column_id", "load_no", "view", "bin").agg(F.sum("n").alias("n"), F.min(F.nanvl("lo", F.lit(None))).alias("lo"), F.max(F.nanvl("hi", F.lit(None))).alias("hi"))
    views = lambda **of: F.array(*(F.struct(F.lit(v).alias("view"), b.cast("bigint").alias("bin")) for v, b in of.values()))
    often = F.when(F.col("n") <= 32, F.col("n")).otherwise(F.floor(F.log2(F.col("n").cast("double")) * BINS_PER_DOUBLING) + 12)
    of_value = views(a=(VALUE, F.pmod(F.col("bin"), F.lit(VALUE_BINS))), b=(OFTEN, often), c=(SHARED, F.least(F.col("loads"), F.lit(SHARED_LOADS))))
    return (
        merged.withColumn("loads", F.count("load_no").over(W.partitionBy("column_id", "view", "bin")))
        .withColumn("x", F.explode(F.when(F.col("view") == VALUE, of_value).otherwise(F.array(F.struct("view", "bin")))))
        .select("column_id", "load_no", "x.view", "x.bin", "n", "lo", "hi")
        .groupBy("column_id", "load_no", "view", "bin")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )


def load_profiles(histograms: DataFrame) -> DataFrame:
    """One row per column and load: rows, nulls, distinct values, extrema. Rows without a load number come as one with a null."""
    of = lambda view, value: F.coalesce(F.sum(F.when(F.col("view") == view, value)), F.lit(0))
    return histograms.groupBy("column_id", "load_no").agg(
        of(ROWS, F.col("n")).alias("n_rows"),
        of(NULLS, F.col("n")).alias("n_null"),
        of(VALUE, F.col("n_distinct")).alias("n_distinct"),
        F.min("lo").alias("numeric_min"),
        F.max("hi").alias("numeric_max"),
    )


# --- comparison of loads -------------------------------------------------------------------------------------------------------

#: A load departs where the part of its rows (or non-null values) that lies elsewhere than in the other loads exceeds chance by this.
LEAST_DEPARTURE = 0.08
#: ... and stands out from what the undamaged loads of the column show by so many robust deviations.
DEVIATIONS = 6.0
MAGNITUDE_GROUPS = 12
COMMON_SHARE, SPIKE_SHARE, SPIKE_ROWS = 0.01, 0.08, 8
NULL_RATE, DISTINCT_RATIO = 101, 102


def signals(histograms: DataFrame) -> DataFrame:
    """``column_id, view, load_no, bin, n, of``: what loads are compared on, in few bins.

    Value, length and form bins stay where they are common over all loads or a spike in one, the rest become one bin. Magnitude bins
    are grouped into ``MAGNITUDE_GROUPS`` of about equal share. The rows whose value few other loads have stay apart from the others, so a
    tail of rare values that is replaced by another shows. The null rate is a view of two bins; the distinct ratio has ``n``
    distinct values with ``of`` rows by how often they occur. The result has some tens of rows a load, column and view.
    """
    histograms = histograms.filter(F.col("load_no").isNotNull())  # rows without a load belong to none
    binned = histograms.filter(F.col("view").isin(VALUE, SIZE, LENGTH, FORM, SHARED)).select("column_id", "view", "load_no", "bin", "n")
    share = binned.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("column_id", "view", "load_no")))
    loads = share.groupBy("column_id", "view").agg(F.count_distinct("load_no").alias("loads"))
    per_bin = (
        share.groupBy("column_id", "view", "bin")
        .agg(F.sum("share").alias("total"), F.max(F.when(F.col("n") >= SPIKE_ROWS, F.col("share"))).alias("spike"))
        .join(loads, ["column_id", "view"])
        .withColumn("mean", F.col("total") / F.col("loads"))
    )
    below = F.sum("mean").over(W.partitionBy("column_id", "view").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("mean") / 2
    kept = (F.col("mean") >= COMMON_SHARE) | (F.coalesce(F.col("spike"), F.lit(0.0)) >= SPIKE_SHARE)
    into = F.when(F.col("view") == SIZE, F.floor(below * MAGNITUDE_GROUPS)).when(F.col("view") == SHARED, F.col("bin")).otherwise(F.when(kept, F.col("bin")).otherwise(F.lit(-1_000_000)))
    grouped = binned.join(per_bin.select("column_id", "view", "bin", into.cast("bigint").alias("into")), ["column_id", "view", "bin"])
    mixes = grouped.groupBy("column_id", "view", "load_no", F.col("into").alias("bin")).agg(F.sum("n").alias("n")).withColumn("of", F.lit(None).cast("bigint"))
    profile = load_profiles(histograms)
    filled = F.col("n_rows") - F.col("n_null")
    nulls = profile.select("column_id", F.lit(NULL_RATE).alias("view"), "load_no", F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("bin"), F.col("n_null").alias("n")), F.struct(F.lit(1).cast("bigint").alias("bin"), filled.alias("n")))).alias("x")).select(
        "column_id", "view", "load_no", "x.bin", "x.n", F.lit(None).cast("bigint").alias("of")
    )
    distinct = histograms.filter(F.col("view") == OFTEN).select("column_id", F.lit(DISTINCT_RATIO).alias("view"), "load_no", "bin", F.col("n_distinct").alias("n"), F.col("n").alias("of"))
    return mixes.unionByName(nulls).unionByName(distinct)


def departures(counts: pd.DataFrame) -> pd.Series:
    """By load (index), by how much it departs, for loads that do. ``counts``: loads by bins.

    The distance of a load's shares from the mean shares of the other loads (half the summed differences: the part of its rows that
    lies elsewhere), less what sampling gives on average, is compared with the loads' own scatter. Loads found to depart are left out
    of the mean and the scatter, and all are compared once more. Fewer than three loads have no norm to depart from.
    """
    total = counts.sum(axis=1)
    there = total > 0
    if there.sum() < 3:
        return pd.Series(dtype=float)
    share = counts[there].div(total[there], axis=0)
    usual = pd.Series(True, index=share.index)
    excess = limit = None
    for _ in range(4):
        mean = share[usual].mean()
        mean = mean / mean.sum()
        own = np.where(usual, usual.sum() / max(1, usual.sum() - 1), 1.0)  # a usual load is part of the mean itself
        distance = 0.5 * (share - mean).abs().sum(axis=1) * own
        chance = 0.5 * np.sqrt(2 * np.outer(1 / total[there], mean * (1 - mean)) / np.pi).sum(axis=1)
        excess = distance - chance
        middle = excess[usual].median()
        limit = max(LEAST_DEPARTURE, middle + DEVIATIONS * 1.4826 * (excess[usual] - middle).abs().median())
        now = excess <= limit
        if now.sum() < max(2, len(now) // 2):  # no majority to compare with
            now = excess <= excess.median()
        if (now == usual).all():
            break
        usual = now
    return excess[excess > limit]


def equal_size_departures(often: pd.DataFrame) -> pd.Series:
    """The same for the share of distinct values among non-null ones, for every load whatever its number of values. ``often``: ``load_no, n, of``, the numbers of distinct values that occur
    about equally often in a load and of their rows.

    Two loads are compared at the size of the smaller one: the larger is thinned to it in expectation. A load's departure is the median
    difference to the others; that of a small load must also exceed its chance.
    """
    loads = [(load, g["n"].to_numpy(dtype=float), g["of"].to_numpy(dtype=float)) for load, g in often[often["of"] > 0].groupby("load_no")]
    if len(loads) < 3:
        return pd.Series(dtype=float)
    size = np.array([of.sum() for _, _, of in loads])
    at = np.minimum.outer(size, size)
    ratio = np.stack([(n * (1 - (1 - np.minimum(at[k] / size[k], 1.0))[:, None] ** (of / n))).sum(axis=1) / at[k] for k, (_, n, of) in enumerate(loads)])
    apart = ratio - ratio.T
    np.fill_diagonal(apart, np.nan)
    off = np.abs(np.nanmedian(apart, axis=1))
    np.fill_diagonal(at, np.nan)
    others = np.clip(np.nanmedian(np.where(np.isnan(apart), np.nan, ratio.T), axis=1), 0.0, 1.0)
    chance = 3 * np.sqrt(np.maximum(others * (1 - others), 1 / size) / np.nanmedian(at, axis=1))
    limit = np.maximum(max(0.1, DEVIATIONS * 1.4826 * float(np.median(off))), chance)
    return pd.Series(off, index=[load for load, _, _ in loads])[off > limit]


def _judged(group: pd.DataFrame) -> pd.DataFrame:
    view = int(group["view"].iloc[0])
    if view == DISTINCT_RATIO:
        found = equal_size_departures(group)
    else:
        found = departures(group.pivot_table(index="load_no", columns="bin", values="n", aggfunc="sum", fill_value=0))
    return pd.DataFrame({"column_id": int(group["column_id"].iloc[0]), "load_no": found.index.astype("int64"), "view": view, "departure": found.to_numpy(dtype=float)})


def departing_loads(histograms: DataFrame) -> DataFrame:
    """``column_id, load_no, view, departure`` of loads that depart from the column's other loads. A group holds one column and view:
    some tens of counts a load."""
    return signals(histograms).groupBy("column_id", "view").applyInPandas(_judged, "column_id int, load_no bigint, view int, departure double")


def latest_records(records: DataFrame) -> DataFrame:
    """The recorded attributes with the latest ``registered_at`` of each dataset, load and column."""
    last = W.partitionBy("dataset_name", "load_no", "column_name").orderBy(F.col("registered_at").desc_nulls_last())
    return records.dropna(subset=["dataset_name", "load_no", "column_name"]).withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")


def disagreeing_records(profiles: DataFrame, records: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``dataset_name, load_no, column_name`` of latest records that do not agree with ``profiles`` (which name their columns and have
    ``kind``). BOOL columns and loads without a record are no case; NaN counts as null; a missing value disagrees with a present one."""
    no_nan = lambda name: F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    kept = latest_records(records).select("dataset_name", "load_no", "column_name", no_nan("numeric_min").alias("r_min"), no_nan("numeric_max").alias("r_max"), no_nan("cat_unique_ratio").alias("r_ratio"))
    ratio = F.when(F.col("n_rows") > 0, F.col("n_distinct") / F.col("n_rows"))

    def differs(recorded, actual):
        far = F.abs(recorded - actual) > F.lit(tolerance) * F.greatest(F.abs(actual), F.abs(recorded))
        return F.when(recorded.isNull() | actual.isNull(), recorded.isNull() != actual.isNull()).otherwise(far)

    numeric = differs(F.col("r_min"), F.col("numeric_min")) | differs(F.col("r_max"), F.col("numeric_max"))
    wrong = F.when(F.col("kind").isin("INT", "FLOAT"), numeric).when(F.col("kind") == "STRING", differs(F.col("r_ratio"), ratio)).otherwise(F.lit(False))
    return profiles.join(kept, ["dataset_name", "load_no", "column_name"]).filter(wrong).select("dataset_name", "load_no", "column_name")


class TableProfiles:
    """Profiles of some columns of some tables by load. The merged histograms are written to the shared folder once: some hundred
    rows a load and column, whatever the number of rows."""

    def __init__(self, tables: dict[str, DataFrame], columns: dict[str, list[str]], load_column: str = "load_no"):
        self.columns = [ProfiledColumn(t, c, logical_kind(tables[t].schema[c].dataType)) for t, names in columns.items() for c in names]
        spark = next(iter(tables.values())).sparkSession
        self.spark = spark
        self.histograms = written(load_histograms(chunk_partials(spark, tables, self.columns, load_column)), "profiles")
        self._agree_with(tables)

    def _agree_with(self, tables: dict[str, DataFrame]) -> None:
        """Fail where the row groups read are not all of a table as Spark reads it (files that changed since they were listed)."""
        profiled = {r[0]: r[1] for r in self.histograms.filter(F.col("view") == ROWS).groupBy("column_id").agg(F.sum("n")).collect()}
        for name, table in tables.items():
            rows = table.count()
            for i, c in enumerate(self.columns):
                if c.dataset_name == name and profiled.get(i, 0) != rows:
                    raise RuntimeError(f"{name}.{c.column_name}: {profiled.get(i, 0)} rows were profiled of {rows}")

    def _named(self, df: DataFrame) -> DataFrame:
        names = self.spark.createDataFrame([(i, c.dataset_name, c.column_name, c.kind) for i, c in enumerate(self.columns)], "column_id int, dataset_name string, column_name string, kind string")
        return df.join(F.broadcast(names), "column_id").drop("column_id")

    def profiles(self) -> DataFrame:
        return self._named(load_profiles(self.histograms))

    def departures(self) -> DataFrame:
        return self._named(departing_loads(self.histograms)).drop("kind")
