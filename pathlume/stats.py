"""Statistics of jobs from a long table of metrics: ``source, metric, value`` and label columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlume.functions.normalize import col, nan_to_null

PERCENTILES = (0.25, 0.5, 0.75, 0.95, 0.99)
FEW, MANY = 20, 100
METRICS = "source string, metric string, value double"


def metrics_table(spark: SparkSession, rows: list[tuple[str, str, float]]) -> DataFrame:
    return spark.createDataFrame(rows, METRICS)


def percentile_name(p: float) -> str:
    return f"p{p * 100:g}"


def timing_summary(df: DataFrame, value: str, by: list[str] = (), accuracy: int | None = None) -> DataFrame:
    """``n, min, mean, max`` and percentiles of a numeric column, in all or by other columns. They are exact (linear between ranks), for
    which a task holds the distinct values of a group; with an ``accuracy`` (10,000 say) they are values whose rank is off by at most
    one in so many, from summaries of bounded size.

    With fewer than 20 values only the median is given, with fewer than 100 no 99th percentile; the others are null. NaN and null do
    not count.
    """
    x = nan_to_null(df).select(*(col(b) for b in by), col(value).cast("double").alias("__x"))
    found = x.groupBy(*(col(b) for b in by)).agg(F.count("__x").alias("n"), F.min("__x").alias("min"), F.avg("__x").alias("mean"), F.max("__x").alias("max"), (F.percentile("__x", F.array(*map(F.lit, PERCENTILES))) if accuracy is None else F.percentile_approx("__x", list(PERCENTILES), accuracy)).alias("__p"))

    def allowed(p: float):
        enough = F.lit(True) if p == 0.5 else F.col("n") >= (MANY if p >= 0.99 else FEW)
        return F.when(enough, F.col("__p")[PERCENTILES.index(p)]).alias(percentile_name(p))

    return found.select(*(col(b) for b in by), "n", "min", "mean", "max", *(allowed(p) for p in PERCENTILES))


def completions(df: DataFrame, seconds: str, width: float = 0.25) -> DataFrame:
    """``until, n``: how many values fall into each slot of ``width``, named by its end (a value at an end belongs to the slot before)."""
    slot = F.ceil(col(seconds) / F.lit(width)) * F.lit(width)
    return nan_to_null(df).filter(col(seconds).isNotNull()).groupBy(slot.alias("until")).agg(F.count(F.lit(1)).alias("n"))


def job_statistics(metrics: DataFrame, failed: str = "failed") -> dict:
    """Totals of a job: scanned rows and groups, tasks and failed tasks (distinct sources), cached and read parts, timings by metric."""
    one = metrics.agg(
        F.sum(F.when(F.col("metric") == "scanned_rows", F.col("value"))).alias("rows"),
        F.sum(F.when(F.col("metric") == "scanned_groups", F.col("value"))).alias("groups"),
        F.count_distinct("source").alias("tasks"),
        F.count_distinct(F.when((F.col("metric") == failed) & (F.col("value") > 0), F.col("source"))).alias("failed"),
        F.count_if((F.col("metric") == "from_cache") & (F.col("value") > 0)).alias("cached"),
        F.count_if((F.col("metric") == "from_cache") & (F.col("value") <= 0)).alias("read"),
    ).first()
    timings = {r["metric"]: {k: r[k] for k in r.asDict() if k != "metric" and r[k] is not None} for r in timing_summary(metrics.filter(F.col("metric").endswith("seconds")), "value", ["metric"]).collect()}
    return {
        "scannedRows": int(one["rows"] or 0),
        "scannedGroups": int(one["groups"] or 0),
        "totalTasks": one["tasks"],
        "failedTasks": one["failed"],
        "cache": {"diskCache": one["cached"], "source": one["read"]},
        "timingSeconds": timings,
        "cost": None,
    }


def run_metrics(spark: SparkSession, request: str, seconds: dict[str, float], scanned: dict[str, int], tasks: dict[str, int]) -> DataFrame:
    """The figures of one run in long form, for ``write_rows``."""
    found = {**{f"{k}_seconds": v for k, v in seconds.items()}, **{f"scanned_{k}": v for k, v in scanned.items()}, **{f"tasks_{k}": v for k, v in tasks.items()}}
    return metrics_table(spark, [(request, k, float(v)) for k, v in found.items()])
