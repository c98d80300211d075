"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_datetime(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.VarcharType, T.CharType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c)]


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"column {name!r} is not in the table")


def require_numeric(df: DataFrame, name: str) -> None:
    require_column(df, name)
    if not is_numeric(df, name):
        raise ValueError(f"column {name!r} is not numeric ({df.schema[name].dataType.simpleString()})")


def quoted(name: str) -> Column:
    """Column by exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def double(name: str) -> Column:
    return quoted(name).cast("double")


def finite(c: Column) -> Column:
    """NaN and the infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clip_keep_null(c: Column, low: Column, high: Column) -> Column:
    """Clip to [low, high]; ``greatest``/``least`` alone would replace nulls."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness as pandas gives it: null below 3 values, 0 for a constant."""
    n = F.count(c).cast("double")
    raw = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, F.lit(None).cast("double")).when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(finite(raw))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis: null below 4 values, 0 for a constant."""
    n = F.count(c).cast("double")
    raw = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n < 4, F.lit(None).cast("double")).when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(finite(raw))


def fingerprint(columns: Iterable[Column]) -> list[Column]:
    """Two 64-bit hashes of a value list (128 bits together).

    Used where only equality counts, so that long texts and wide rows are not
    shuffled.  Null flags are hashed too, because ``xxhash64`` skips nulls.
    At 10^12 distinct values the odds of any collision are about 10^-15.
    """
    parts: list[Column] = []
    for c in columns:
        parts += [c, c.isNull()]
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2")]


def micros(c: Column, dtype: T.DataType) -> Column:
    """Microseconds since the epoch of a date or timestamp (wall clock read as UTC)."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    return F.unix_micros(c.cast("timestamp_ntz").cast("timestamp"))
