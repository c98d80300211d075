"""Cleaning steps.  Every function returns a new, lazy DataFrame.

Statistics skip nulls and come from one-row aggregates attached as scalar
subqueries, so no row moves for them.  Steps that depend on row order take
``order_by`` (and optionally ``partition_by``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import clip_keep_null, double, is_numeric, quoted, require_column, require_numeric
from .blocks import TASK_ROWS, positions, running_last
from .lookups import code_lookup
from .quantiles import quantiles

MAX_CATEGORIES = 1_000


def impute(
    df: DataFrame,
    column: str,
    strategy: str = "mean",
    fill_value: object = None,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Fill the nulls of a column: mean, median, mode, ffill, bfill or val."""
    require_column(df, column)
    c = quoted(column)
    if strategy in ("mean", "median"):
        require_numeric(df, column)
        if strategy == "mean":
            fill = df.agg(F.avg(double(column))).scalar()
        else:
            fill = quantiles(df, [column], [0.5])[column][0]
        return df.withColumn(column, F.coalesce(double(column), fill))
    if strategy == "mode":
        counts = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        top = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v")))).scalar()
        return df.withColumn(column, F.coalesce(c, top))
    if strategy in ("ffill", "bfill"):
        if not order_by:
            raise ValueError(f"{strategy} needs order_by: a table has no row order of its own")
        return running_last(
            df, column, c, order_by, partition_by, descending=strategy == "bfill", task_rows=task_rows
        ).select(*[quoted(name) for name in df.columns])
    if strategy == "val":
        return df.withColumn(column, F.coalesce(c, _typed(df, column, fill_value)))
    raise ValueError(f"unknown imputation strategy {strategy!r}")


def _typed(df: DataFrame, column: str, value: object) -> Column:
    """A literal of the column's type; a value of another kind is an error, not a silent skip."""
    if value is None:
        raise ValueError("fill_value is required")
    dtype = df.schema[column].dataType
    if is_numeric(df, column):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"fill_value {value!r} is not a number but {column!r} is numeric")
        if isinstance(value, float) and not value.is_integer():
            return F.lit(value).cast("double")
        return F.lit(value).cast(dtype)
    if dtype.simpleString() == "string" and not isinstance(value, str):
        raise ValueError(f"fill_value {value!r} is not text but {column!r} is")
    return F.lit(value).cast(dtype)


def drop_missing(df: DataFrame, column: str | None = None) -> DataFrame:
    """Drop rows that are null in one column, or in any column."""
    if column is None:
        return df.na.drop()
    require_column(df, column)
    return df.where(quoted(column).isNotNull())


def drop_column(df: DataFrame, column: str) -> DataFrame:
    require_column(df, column)
    return df.select(*[quoted(c) for c in df.columns if c != column])


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One row per distinct row (copies are equal, so it does not matter which)."""
    return df.dropDuplicates()


def handle_outliers(
    df: DataFrame, column: str, method: str = "iqr", action: str = "drop", threshold: float = 3.0
) -> DataFrame:
    """Drop or cap values beyond ``threshold`` IQRs from the quartiles or standard deviations from the mean."""
    require_numeric(df, column)
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unknown outlier method {method!r}")
    if action not in ("drop", "cap"):
        raise ValueError(f"unknown outlier action {action!r}")
    x = double(column)
    if method == "iqr":
        q1, q3 = quantiles(df, [column], [0.25, 0.75])[column]
        low, high = q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1)
        if action == "drop":
            return df.where(x.isNull() | x.between(low, high))
        return df.withColumn(column, clip_keep_null(x, low, high))
    s = df.agg(F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))).scalar()
    mean, std = s["mean"], s["std"]
    if action == "drop":
        return df.where(x.isNull() | (std == 0) | (F.abs((x - mean) / std) <= threshold))
    capped = clip_keep_null(x, mean - threshold * std, mean + threshold * std)
    return df.withColumn(column, F.when(std == 0, x).otherwise(capped))


def encode(
    df: DataFrame,
    column: str,
    method: str = "label",
    order: Sequence[object] | None = None,
    order_by: Sequence[str] = (),
    max_categories: int = MAX_CATEGORIES,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Label codes by first appearance, one-hot columns, or positions in a given order."""
    require_column(df, column)
    if method == "label":
        if not order_by:
            raise ValueError("label encoding needs order_by: codes follow first appearance")
        first = (
            df.where(quoted(column).isNotNull())
            .groupBy(quoted(column).alias("value"))
            .agg(F.min(F.struct(*[quoted(c) for c in order_by])).alias("first"))
        )
        codes = positions(first, "code", ["first"], task_rows=task_rows)
        codes = codes.select("value", (F.col("code") - 1).alias("code"))
        return code_lookup(df, column, codes, column, -1)
    if method == "onehot":
        return _one_hot(df, column, max_categories)
    if method == "ordinal":
        if not order:
            raise ValueError("ordinal encoding needs the list of categories in order")
        dtype = df.schema[column].dataType
        pairs = []
        for value, place in {v: i for i, v in enumerate(order)}.items():
            pairs += [F.lit(value).cast(dtype), F.lit(place).cast("bigint")]
        place = F.try_element_at(F.create_map(*pairs), quoted(column))
        return df.withColumn(column, F.coalesce(place, F.lit(-1).cast("bigint")))
    raise ValueError(f"unknown encoding {method!r}")


def _one_hot(df: DataFrame, column: str, max_categories: int) -> DataFrame:
    """Indicator columns in sorted value order, appended; their names need the values, hence the bounded collect."""
    found = df.select(quoted(column).alias("v")).where("v IS NOT NULL").distinct().limit(max_categories + 1).collect()
    if len(found) > max_categories:
        raise ValueError(f"{column!r} has more than {max_categories} distinct values")
    values = sorted(r["v"] for r in found)
    kept = [quoted(c) for c in df.columns if c != column]
    flags = [
        F.coalesce(quoted(column) == F.lit(v), F.lit(False)).cast("int").cast("bigint").alias(f"{column}_{v}")
        for v in values
    ]
    return df.select(*kept, *flags)


def scale(df: DataFrame, column: str, method: str = "standard") -> DataFrame:
    """Standard, min-max or robust scaling; unchanged where the divisor is not positive."""
    require_numeric(df, column)
    x = double(column)
    if method == "standard":
        s = df.agg(F.struct(F.avg(x).alias("a"), F.stddev_samp(x).alias("b"))).scalar()
        centre, spread = s["a"], s["b"]
    elif method == "minmax":
        s = df.agg(F.struct(F.min(x).alias("a"), (F.max(x) - F.min(x)).alias("b"))).scalar()
        centre, spread = s["a"], s["b"]
    elif method == "robust":
        q1, centre, q3 = quantiles(df, [column], [0.25, 0.5, 0.75])[column]
        spread = q3 - q1
    else:
        raise ValueError(f"unknown scaling {method!r}")
    return df.withColumn(column, F.when(spread > 0, (x - centre) / spread).otherwise(x))


def filter_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Keep rows inside [low, high]; rows with a null stay."""
    require_numeric(df, column)
    return df.where(quoted(column).isNull() | quoted(column).between(F.lit(low), F.lit(high)))


def reindex(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly the given columns (name -> type) in that order; absent ones become null."""
    return df.select(
        *[
            (quoted(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c)
            for c, t in columns.items()
        ]
    )
