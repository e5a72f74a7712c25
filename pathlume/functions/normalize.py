"""Column expressions that bring values to one form."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = datetime.datetime(1970, 1, 1)
FLOATS = (T.FloatType, T.DoubleType)


def quoted(name: str) -> str:
    """A column name as a reference, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def without_nan(column: Column, kind: T.DataType) -> Column:
    """NaN as null for floating columns; other columns as they are."""
    return F.when(~F.isnan(column), column) if isinstance(kind, FLOATS) else column


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATS)]
    return df.select(*(without_nan(col(f.name), f.dataType).alias(f.name) if f.name in floats else col(f.name) for f in df.schema.fields)) if floats else df


def blank_free(column: Column) -> Column:
    """Leading and trailing blanks and tabs removed, lower-cased; empty becomes null."""
    return F.nullif(F.lower(F.btrim(column, F.lit(" \t"))), F.lit(""))


def epoch_ms(column: Column, kind: T.DataType, scale: float = 1.0) -> Column:
    """Epoch milliseconds of a numeric time (times ``scale``, rounded) or of a timestamp; null where it has none."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_diff("MILLISECOND", F.lit(EPOCH), column.cast("timestamp_ntz"))
    value = without_nan(column, kind)
    if isinstance(kind, FLOATS) or scale != 1.0:
        return F.round(value * F.lit(float(scale))).try_cast("bigint")
    return value.cast("bigint")
