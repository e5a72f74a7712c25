"""How far groups get in ordered sequences of steps.

Step 0 is reached at the earliest row that meets it; step i at the earliest row that meets it strictly later than step i - 1 was reached.

Per group this is a chain of minima over one window: one scan and one exchange. Where a table has more rows than one task should hold
(``heavy_rows``), groups of more rows than that go another way: a step is one partial minimum over all their rows, after which the few
times found, one a group, are joined with the rows for the next step. Their rows are spread over tasks for everything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from pathlume.functions.normalize import EPOCH, col
from pathlume.functions.predicates import row_predicate
from pathlume.operators.hot_keys import Measure

#: Rows of one group that one task may hold, and how many groups are taken the other way at most (beyond it the largest).
DEFAULT_HEAVY_ROWS = 2_000_000
MOST_HEAVY = 10_000
DEFAULT_SPREAD = 64


def reach_columns(df: DataFrame, keys: list[str], time: str, steps: list[Column], prefix: str) -> tuple[DataFrame, list[str]]:
    """``df`` with the times at which the steps are reached within the key, as window minima; and the names of these columns."""
    window = W.partitionBy(*(col(k) for k in keys))
    names: list[str] = []
    for i, step in enumerate(steps):
        due = step & (col(time) > col(names[-1])) if names else step
        df = df.withColumn(f"{prefix}{i}", F.min(F.when(due, col(time))).over(window))
        names.append(f"{prefix}{i}")
    return df, names


def heavy_groups(rows: DataFrame, group: str, heavy_rows: int) -> DataFrame | None:
    """Groups of more than ``heavy_rows`` rows, as a table of one column ``__heavy``; None where there are none.

    A table with no more rows than that in all has none, which a count tells that reads no column of unfiltered Parquet. Otherwise one
    partial count finds them. At most ``MOST_HEAVY`` come to the driver: the limit rises with the table where more could.
    """
    total = rows.count()
    if total <= heavy_rows:
        return None
    limit = max(heavy_rows, total // MOST_HEAVY)
    counts = rows.groupBy(col(group).alias("__heavy")).agg(F.count(F.lit(1)).alias("__n"))
    found = counts.filter(F.col("__heavy").isNotNull() & (F.col("__n") > limit)).select("__heavy").collect()
    return rows.sparkSession.createDataFrame(found, T.StructType([T.StructField("__heavy", rows.schema[group].dataType)])) if found else None


def heavy_reach(rows: DataFrame, group: str, time: str, heavy: DataFrame, sequences: dict[str, list[Column]]) -> DataFrame:
    """``__heavy`` and ``__reached_<name>``: steps reached by heavy group and sequence. One job a step, of partial minima: nothing but they,
    at most ``MOST_HEAVY`` rows, is shuffled or sent to the driver."""
    spark = rows.sparkSession
    own = rows.join(F.broadcast(heavy), col(group) == F.col("__heavy"))
    kind = rows.schema[time].dataType
    names = list(sequences)
    keys = [r[0] for r in heavy.collect()]
    reached = {k: [0] * len(names) for k in keys}
    last: dict = {k: [None] * len(names) for k in keys}
    shape = T.StructType([T.StructField("__at", heavy.schema["__heavy"].dataType), *(T.StructField(f"__l{i}", kind) for i in range(len(names)))])
    for step in range(max(map(len, sequences.values()))):
        open_ = [i for i, n in enumerate(names) if step < len(sequences[n])]
        here = own
        if step:
            here = own.join(F.broadcast(spark.createDataFrame([(k, *last[k]) for k in keys], shape)), F.col("__heavy") == F.col("__at"))
        due = {i: sequences[names[i]][step] & (col(time) > F.col(f"__l{i}")) if step else sequences[names[i]][step] for i in open_}
        found = {r[0]: r for r in here.groupBy("__heavy").agg(*(F.min(F.when(d, col(time))).alias(f"m{i}") for i, d in due.items())).collect()}
        for k in keys:
            for i in range(len(names)):
                last[k][i] = found[k][f"m{i}"] if i in due and k in found else None
                if last[k][i] is not None:
                    reached[k][i] = step + 1
    fields = [heavy.schema["__heavy"], *(T.StructField(f"__reached_{n}", T.IntegerType()) for n in names)]
    return spark.createDataFrame([(k, *reached[k]) for k in keys], T.StructType(fields))


def sequence_reach(
    df: DataFrame,
    group: str,
    time: str,
    sequences: dict[str, list[dict]],
    measures: list[Measure] = (),
    heavy_rows: int | None = DEFAULT_HEAVY_ROWS,
    spread: int = DEFAULT_SPREAD,
) -> DataFrame:
    """One row per group: for each named sequence (a list of expanded steps) the number of steps reached, from 0; and the measures of
    all its rows, from the same shuffle.

    ``df`` must have no NaN in the columns used. Rows without a group are left out; rows without a time reach nothing. Ties in time and
    repeated rows count as one instant. ``heavy_rows=None`` saves the count of rows where no group is known to be large.
    """
    clock = "__time"
    # numbers in place of timestamps, which go to the driver and back
    stamped = df.schema[time].dataType.typeName().startswith("timestamp")
    at = F.timestamp_diff("MICROSECOND", F.lit(EPOCH), col(time).cast("timestamp_ntz")) if stamped else col(time)
    flags = {f"__s{i}_{j}": row_predicate(step) for i, steps in enumerate(sequences.values()) for j, step in enumerate(steps)}
    inputs = {f"__v{i}": m.value for i, m in enumerate(measures) if m.value is not None}
    rows = df.filter(col(group).isNotNull()).select(col(group).alias("__group"), at.alias(clock), *(p.alias(n) for n, p in (flags | inputs).items()))
    carried = [Measure(m.name, m.kind, None if m.value is None else col(f"__v{i}")) for i, m in enumerate(measures)]
    heavy = heavy_groups(df.withColumnRenamed(group, "__group"), "__group", heavy_rows) if heavy_rows is not None else None
    marks = {name: [col(f"__s{i}_{j}") for j in range(len(steps))] for i, (name, steps) in enumerate(sequences.items())}
    keys = ["__group"]
    if heavy is not None:
        known = heavy_reach(rows, "__group", clock, heavy, marks)
        own = F.pmod(F.xxhash64(clock, *(col(n) for n in flags)), F.lit(spread))
        rows = rows.join(F.broadcast(heavy), F.col("__group") == F.col("__heavy"), "left").withColumn("__part", F.when(F.col("__heavy").isNotNull(), own).otherwise(F.lit(0))).drop("__heavy")
        keys.append("__part")
    reached: dict[str, Column] = {}
    for i, (name, steps) in enumerate(marks.items()):
        rows, names = reach_columns(rows, keys, clock, steps, f"__m{i}_")
        # a chain never reaches a step after one it missed
        reached[name] = F.max(sum((col(n).isNotNull().cast("int") for n in names), F.lit(0)))
    per_part = rows.groupBy(*keys).agg(*(c.alias(n) for n, c in reached.items()), *(m.partial() for m in carried))
    if heavy is not None:
        merged = per_part.groupBy("__group").agg(*(F.max(col(n)).alias(n) for n in reached), *(m.merged() for m in carried))
        both = merged.join(F.broadcast(known), F.col("__group") == F.col("__heavy"), "left")
        per_part = both.select("__group", *(F.coalesce(col(f"__reached_{n}"), col(n)).alias(n) for n in reached), *(col(m.name) for m in carried))
    return per_part.withColumnRenamed("__group", group)
