"""Frequent values of columns with too many distinct values to hold: iceberg multi-hash filtering.

1. Every counting value is hashed by several independent hashes into coarse buckets, which are counted exactly. That is ``hashes *
   buckets`` counters a column, however many distinct values there are; the number of buckets follows from the share asked for.
2. A value with at least the threshold number of rows puts at least that number into each of its buckets, so only values all of whose
   buckets reach the threshold survive. At most ``1 / min_share`` buckets of a hash can reach it.
3. The survivors are counted exactly and cut at the threshold: no false value remains and none is missed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlume.sources.workspace import written

DEFAULT_HASHES = 3
BUCKETS_PER_VALUE, MOST_BUCKETS = 64, 1 << 20
#: Reached buckets are broadcast where at most so many (of some 20 bytes) can be; otherwise they are joined as Spark sees fit.
MOST_BROADCAST = 400_000


def buckets_for(min_share: float) -> int:
    """Several times as many buckets as values can reach the share, so that few others share one; a power of two, bounded."""
    return min(MOST_BUCKETS, 1 << max(10, math.ceil(math.log2(BUCKETS_PER_VALUE / min_share))))


def candidate_bound(min_share: float) -> int:
    """The most buckets of one hash, and so the most values of a column, that can reach the threshold."""
    return math.floor(1 / min_share)


def _buckets(item: Column, hashes: int, buckets: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(1_000_003 * (i + 1)), item), F.lit(buckets)).cast("int") for i in range(hashes)]


def _threshold(total: Column, min_share: float) -> Column:
    return F.ceil(total * F.lit(min_share) - F.lit(1e-9))


def _free(name: str, taken: tuple[str, ...]) -> str:
    while name in taken:
        name += "_"
    return name


def frequent_items(items: DataFrame, min_share: float = 0.01, hashes: int = DEFAULT_HASHES, buckets: int | None = None, column: str = "column_name", item: str = "item") -> DataFrame:
    """Values with at least ``min_share`` of the non-null values of their column.

    ``items`` is in long form: ``column`` (what is counted apart; few distinct values) and ``item``. Null items and null columns do not
    count. Gives ``column, item, n_rows, n_total, share``; values at the threshold exactly are kept, ties all stay, and an empty table
    gives no rows. Other columns of ``items`` are not read. ``items`` is read twice, the counters of the buckets are written once.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be above 0 and at most 1")
    buckets = buckets_for(min_share) if buckets is None else buckets
    if hashes < 1 or buckets < 1:
        raise ValueError("hashes and buckets must be at least 1")
    if clash := {column, item} & {"n_rows", "n_total", "share"}:
        raise ValueError(f"columns may not be named {', '.join(sorted(clash))}")
    h, b = _free("__h", (column, item)), _free("__b", (column, item))
    counting = items.select(F.col(f"`{column}`"), F.col(f"`{item}`")).filter(F.col(f"`{column}`").isNotNull() & F.col(f"`{item}`").isNotNull())
    each = F.array(*(F.struct(F.lit(i).alias("h"), x.alias("b")) for i, x in enumerate(_buckets(F.col(f"`{item}`"), hashes, buckets))))
    coarse = written(
        counting.select(F.col(f"`{column}`"), F.explode(each).alias("__at")).groupBy(F.col(f"`{column}`"), F.col("__at.h").alias(h), F.col("__at.b").alias(b)).agg(F.count(F.lit(1)).alias("n_rows")),
        "frequent-buckets",
    )
    totals = coarse.filter(F.col(h) == 0).groupBy(F.col(f"`{column}`")).agg(F.sum("n_rows").alias("n_total"))
    reached = coarse.join(F.broadcast(totals), column).filter(F.col("n_rows") >= _threshold(F.col("n_total"), min_share))
    small = min(buckets, candidate_bound(min_share)) <= MOST_BROADCAST
    survivors = counting.withColumns({f"{b}{i}": x for i, x in enumerate(_buckets(F.col(f"`{item}`"), hashes, buckets))})
    for i in range(hashes):
        own = reached.filter(F.col(h) == i).select(F.col(f"`{column}`"), F.col(b).alias(f"{b}{i}"))
        survivors = survivors.join(F.broadcast(own) if small else own, [column, f"{b}{i}"], "left_semi")
    exact = survivors.groupBy(F.col(f"`{column}`"), F.col(f"`{item}`")).agg(F.count(F.lit(1)).alias("n_rows")).join(F.broadcast(totals), column)
    return exact.filter(F.col("n_rows") >= _threshold(F.col("n_total"), min_share)).withColumn("share", F.col("n_rows") / F.col("n_total")).select(F.col(f"`{column}`"), F.col(f"`{item}`"), "n_rows", "n_total", "share")


def top_items(items: DataFrame, k: int = 10, hashes: int = DEFAULT_HASHES, column: str = "column_name", item: str = "item", step: float = 32.0) -> DataFrame:
    """The ``k`` most frequent values of each column, as ``frequent_items`` gives them with their ``rank``; of equal ones those first in order.

    All values with at least some share are found exactly; where they are fewer than ``k``, the share is lowered by ``step`` and the columns
    still short are read again, until it is below one row. A column with fewer than ``k`` values gives all of them.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = items.sparkSession
    schema = T.StructType([*(T.StructField(c, items.schema[c].dataType) for c in (column, item)), T.StructField("n_rows", T.LongType()), T.StructField("n_total", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    share, short = 1.0 / (2 * k), None
    out = spark.createDataFrame([], schema)
    order = W.partitionBy(F.col(f"`{column}`")).orderBy(F.col("n_rows").desc(), F.col(f"`{item}`"))
    while True:
        left = items if short is None else items.filter(F.col(f"`{column}`").isin(short))
        ranked = frequent_items(left, share, hashes, None, column, item).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = written(ranked, "frequent-top")
        have = {r[0]: (r[1], r[2]) for r in found.groupBy(F.col(f"`{column}`")).agg(F.count(F.lit(1)), F.max("n_total")).collect()}
        columns = short if short is not None else [r[0] for r in items.filter(F.col(f"`{column}`").isNotNull() & F.col(f"`{item}`").isNotNull()).select(F.col(f"`{column}`")).distinct().collect()]
        done = [c for c in columns if c in have and (have[c][0] == k or share * have[c][1] <= 1)]
        if done:
            out = out.unionByName(found.filter(F.col(f"`{column}`").isin(done)))
        short = [c for c in columns if c not in done]
        if not short:
            return out
        share /= step
