"""Per-key results where a few keys hold most rows: two-stage salted aggregation.

1. The rows a key holds are counted with map-side combination; keys with at least ``heavy_share`` of the keyed rows are heavy. There
   are at most ``1 / heavy_share`` of them, which bounds what reaches the driver.
2. Every row of a heavy key gets one of ``salts`` salts; rows of other keys get salt 0. Partial results are computed per (key, salt).
3. The partials of a key are merged.

The salt is a hash of the row's own values rather than a random number: it spreads rows alike, and a task that runs again after an
executor was lost gives every row the salt it had before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlume.functions.normalize import col
from pathlume.sources.workspace import written

DEFAULT_HEAVY_SHARE = 0.01
DEFAULT_SALTS = 32


@dataclass(frozen=True)
class Measure:
    """One per-key result: ``kind`` is count, count_if, sum, min or max, and ``value`` the expression over a row (None: every row)."""

    name: str
    kind: str
    value: Column | None = None

    def partial(self) -> Column:
        if self.kind == "count":
            return (F.count(F.lit(1)) if self.value is None else F.count(self.value)).alias(self.name)
        if self.kind == "count_if":
            return F.count_if(self.value).alias(self.name)
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](self.value).alias(self.name)

    def merged(self) -> Column:
        merge = {"count": F.sum, "count_if": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[self.kind]
        return merge(col(self.name)).alias(self.name)


def heavy_keys(df: DataFrame, keys: list[str], heavy_share: float = DEFAULT_HEAVY_SHARE) -> list[tuple]:
    """Keys (without null parts) with at least ``heavy_share`` of all rows; at most ``1 / heavy_share`` come to the driver.

    An empty table has none.
    """
    if not 0 < heavy_share <= 1:
        raise ValueError("heavy_share must be above 0 and at most 1")
    counts = written(df.dropna(subset=keys).groupBy(*(col(k) for k in keys)).agg(F.count(F.lit(1)).alias("__n")), "key-counts")  # the rows are read once
    total = counts.agg(F.sum("__n")).first()[0]
    if not total:
        return []
    return [tuple(r[:-1]) for r in counts.filter(F.col("__n") >= F.lit(heavy_share * total)).collect()]


def salted_aggregate(
    df: DataFrame,
    keys: list[str],
    measures: list[Measure],
    heavy: list[tuple] | None = None,
    heavy_share: float = DEFAULT_HEAVY_SHARE,
    salts: int = DEFAULT_SALTS,
    salt_from: list[str] | None = None,
) -> DataFrame:
    """One row per key (null keys form no group) with the measures.

    ``salt_from`` names the columns whose hash gives the salt, by default all. Ties, repeated rows and extra columns have no effect
    beyond being rows; an empty table gives no rows. ``heavy`` may be given where the heavy keys are known.
    """
    if salts < 1:
        raise ValueError("salts must be at least 1")
    clash = {m.name for m in measures} & set(keys)
    if clash:
        raise ValueError(f"measures and keys share names: {', '.join(sorted(clash))}")
    heavy = heavy_keys(df, keys, heavy_share) if heavy is None else heavy
    present = df.dropna(subset=keys)
    salt_name = "__salt"
    while salt_name in df.columns:
        salt_name += "_"
    if heavy:
        is_heavy = (
            col(keys[0]).isin([h[0] for h in heavy])
            if len(keys) == 1
            else F.struct(*(col(k) for k in keys)).isin([F.struct(*(F.lit(v) for v in h)) for h in heavy])
        )
        spread = F.pmod(F.xxhash64(*(col(c) for c in (salt_from or df.columns) if not df.schema[c].dataType.typeName() in ("map", "variant"))), F.lit(salts)).cast("int")
        salt = F.when(is_heavy, spread).otherwise(F.lit(0))
    else:
        salt = F.lit(0)
    partial = present.groupBy(*(col(k) for k in keys), salt.alias(salt_name)).agg(*(m.partial() for m in measures))
    return partial.groupBy(*(col(k) for k in keys)).agg(*(m.merged() for m in measures))
