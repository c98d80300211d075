"""Descriptive statistics, value frequencies and correlations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import (
    double,
    fingerprint,
    finite,
    numeric_columns,
    quoted,
    require_column,
    require_numeric,
    sample_kurtosis,
    sample_skewness,
)
from .blocks import TASK_ROWS, cut_lineage, running_totals
from .lookups import BROADCAST_BYTES
from .quantiles import quantiles

STATISTICS = [
    "mean", "median", "mode", "variance", "std", "min", "max", "range",
    "q25", "q50", "q75", "skewness", "kurtosis",
]


def name_rows(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """One row per name, in a single ``column`` column."""
    return spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("column"))


def unpivot(df: DataFrame, columns: Sequence[str], cast: str) -> DataFrame:
    """Long form (column, value) of the given columns, nulls left out."""
    wide = df.select(*[quoted(c).cast(cast).alias(c) for c in columns])
    return wide.unpivot([], [quoted(c) for c in columns], "column", "value").where("value IS NOT NULL")


def value_counts(df: DataFrame, columns: Sequence[str], cast: str = "string") -> DataFrame:
    """(column, value, n) of all given columns in one shuffle, combined map-side."""
    return unpivot(df, columns, cast).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def numeric_value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of numeric columns with doubles as values.

    Whole numbers are counted as such first, so ids beyond 2**53 stay distinct.
    """
    whole = [c for c in columns if isinstance(df.schema[c].dataType, T.IntegralType)]
    rest = [c for c in columns if c not in whole]
    parts = [value_counts(df, names, cast) for names, cast in ((whole, "bigint"), (rest, "double")) if names]
    parts = [p.withColumn("value", F.col("value").cast("double")) for p in parts]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, distinct_count) of non-null values, from 128-bit value fingerprints.

    One shuffle for all columns whatever their types, and of 16 bytes per
    distinct value instead of whole texts.
    """
    columns = list(df.columns if columns is None else columns)
    hashed = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), quoted(c).isNull().alias("missing"), *fingerprint([quoted(c)]))
                    for c in columns
                ]
            )
        ).alias("v")
    ).select("v.*")
    distinct = hashed.where("NOT missing").groupBy("column", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    found = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    names = name_rows(df.sparkSession, columns)
    return names.join(F.broadcast(found), "column", "left").select(
        "column", F.coalesce("distinct_count", F.lit(0)).cast("bigint").alias("distinct_count")
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mode, distinct_count) of numeric columns; the smallest of the tied values."""
    return (
        numeric_value_counts(df, columns)
        .groupBy("column")
        .agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
            F.count(F.lit(1)).alias("distinct_count"),
        )
    )


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
    """One row per numeric column with mean, quantiles, spread and shape.

    The moments of all columns are one map-side combined aggregate over the
    long form (short generated code whatever the number of columns), exact
    quantiles come from ``quantiles``, and mode and distinct count from value
    counts, so no task holds all distinct values of a column.
    """
    columns = list(numeric_columns(df) if columns is None else columns)
    for c in columns:
        require_numeric(df, c)
    quarters = quantiles(df, columns, [0.25, 0.5, 0.75], rows)
    v = F.col("value")
    figures = (
        unpivot(df, columns, "double")
        .groupBy("column")
        .agg(
            F.count(v).alias("n"),
            finite(F.avg(v)).alias("mean"),
            finite(F.var_samp(v)).alias("variance"),
            finite(F.stddev_samp(v)).alias("std"),
            finite(F.min(v)).alias("min"),
            finite(F.max(v)).alias("max"),
            sample_skewness(v).alias("skewness"),
            sample_kurtosis(v).alias("kurtosis"),
        )
    )
    cells = [
        F.struct(F.lit(c).alias("column"), *[q.alias(k) for k, q in zip(("q25", "q50", "q75"), quarters[c])])
        for c in columns
    ]
    names = df.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*cells)).alias("s")).select("s.*")
    wide = names.join(F.broadcast(figures), "column", "left")
    return wide.join(F.broadcast(modes(df, columns)), "column", "left").select(
        "column",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        "mean",
        F.col("q50").alias("median"),
        "mode",
        "variance",
        "std",
        "min",
        "max",
        finite(F.col("max") - F.col("min")).alias("range"),
        "q25",
        "q50",
        "q75",
        "skewness",
        "kurtosis",
        F.coalesce("distinct_count", F.lit(0)).cast("bigint").alias("distinct_count"),
    )


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n), every category of every column."""
    for c in columns:
        require_column(df, c)
    return value_counts(df, columns)


def describe_categorical(df: DataFrame, columns: Sequence[str], rows: int | None = None) -> DataFrame:
    """Distinct count, share of distinct values, top category and its count per column.

    Equal counts are settled by the smaller value.
    """
    for c in columns:
        require_column(df, c)
    counts = value_counts(df, columns)
    top = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_values"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_category"),
        F.max("n").alias("top_category_count"),
    )
    total = df.agg(F.count(F.lit(1))).scalar() if rows is None else F.lit(rows)
    names = name_rows(df.sparkSession, columns)
    return names.join(F.broadcast(top), "column", "left").select(
        "column",
        F.coalesce("unique_values", F.lit(0)).cast("bigint").alias("unique_values"),
        F.when(total > 0, F.coalesce("unique_values", F.lit(0)) / total).otherwise(F.lit(0.0)).alias("cardinality_ratio"),
        "top_category",
        F.coalesce("top_category_count", F.lit(0)).cast("bigint").alias("top_category_count"),
    )


AGGREGATED = 16
"""Up to this many columns, all pairs are one aggregate; wider tables add up products of centred blocks of rows, with equal results."""


def pearson(df: DataFrame, columns: Sequence[str] | None = None, listwise: bool = True) -> DataFrame:
    """Long correlation matrix (column_a, column_b, coefficient), null where a column is constant.

    ``listwise`` first drops rows with a null in any of the columns; otherwise
    each pair uses the rows where both are present.  Empty below two columns;
    pairs with fewer than two rows are left out.
    """
    columns = list(numeric_columns(df) if columns is None else columns)
    for c in columns:
        require_numeric(df, c)
    spark = df.sparkSession
    if len(columns) < 2:
        return spark.createDataFrame([], "column_a string, column_b string, coefficient double")
    values = df.select(*[double(c).alias(f"c{i}") for i, c in enumerate(columns)])
    if len(columns) > AGGREGATED:
        return _products(values, columns, listwise)
    return _pairs(values.na.drop() if listwise else values, columns, listwise)


def _correlation(a: Column, b: Column, whole: bool) -> Column:
    """Over the rows where both are present; null if either does not vary (by its ends, as sums of squares only nearly cancel)."""
    x, y = (a, b) if whole else (F.when(b.isNotNull(), a), F.when(a.isNotNull(), b))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, finite(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))))


def _pairs(values: DataFrame, columns: Sequence[str], whole: bool = True) -> DataFrame:
    """All pairs of columns c0..cd, ``whole`` if no cell is null; both halves of the matrix in the output."""
    d = len(columns)
    made = []
    for i in range(d):
        for j in range(i, d):
            a, b = F.col(f"c{i}"), F.col(f"c{j}")
            n = F.count_if(a.isNotNull() & b.isNotNull())
            made.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), n.alias("n"), _correlation(a, b, whole).alias("r")))
    upper = values.agg(F.array(*made).alias("m")).select(F.explode("m").alias("p")).select("p.*").where("n >= 2")
    names = F.array(*[F.lit(c) for c in columns])
    both = upper.select(
        F.explode(
            F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", "r"))).otherwise(
                F.array(F.struct("i", "j", "r"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("r")))
            )
        ).alias("p")
    )
    return both.select(
        F.get(names, F.col("p.i")).alias("column_a"),
        F.get(names, F.col("p.j")).alias("column_b"),
        F.col("p.r").alias("coefficient"),
    )


def _products(values: DataFrame, columns: Sequence[str], listwise: bool = True) -> DataFrame:
    """The same for wide tables: sums over blocks of rows of products of values less their column's mean.

    Each task sends columns x columns numbers, whatever its rows; ``listwise`` leaves out rows with a null,
    otherwise a null leaves the other pairs alone.
    """
    d = len(columns)
    center = values.agg(F.array(*[F.avg(f"c{i}") for i in range(d)]).alias("m")).first()["m"]
    means = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in center])

    def add_up(batches):
        n, s, q, c = (np.zeros((d, d)) for _ in range(4))
        low, high = np.full((d, d), np.inf), np.full((d, d), -np.inf)
        for frame in batches:
            x = frame.to_numpy(float)
            there = ~np.isnan(x)
            if listwise:
                x = x[there.all(axis=1)]
                there = np.ones(x.shape, bool)
            if not len(x):
                continue
            for j in range(d):
                own = np.where(there[:, j : j + 1] & there, x, np.nan)
                low[:, j] = np.fmin(low[:, j], np.fmin.reduce(own, axis=0))
                high[:, j] = np.fmax(high[:, j], np.fmax.reduce(own, axis=0))
            x = np.where(there, x - means, 0.0)
            there = there.astype(float)
            n, s, q, c = n + there.T @ there, s + x.T @ there, q + (x * x).T @ there, c + x.T @ x
        i, j = np.indices((d, d)).reshape(2, -1)
        yield pd.DataFrame({"i": i, "j": j, "n": n.ravel(), "s": s.ravel(), "q": q.ravel(), "c": c.ravel(), "low": low.ravel(), "high": high.ravel()})

    parts = values.mapInPandas(add_up, "i int, j int, n double, s double, q double, c double, low double, high double")
    sums = parts.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in ("n", "s", "q", "c")], (F.min("low") < F.max("high")).alias("moves"))
    other = sums.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("t"), F.col("q").alias("u"), F.col("moves").alias("turns"))
    both = sums.join(F.broadcast(other), ["i", "j"]).where("n >= 2")  # columns x columns rows
    left, right = F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("u") - F.col("t") * F.col("t") / F.col("n")
    r = F.try_divide(F.col("c") - F.col("s") * F.col("t") / F.col("n"), F.sqrt(left) * F.sqrt(right))
    names = F.array(*[F.lit(c) for c in columns])
    return both.select(
        F.get(names, F.col("i")).alias("column_a"),
        F.get(names, F.col("j")).alias("column_b"),
        F.when(F.col("moves") & F.col("turns"), finite(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))).alias("coefficient"),
    )


def average_ranks(df: DataFrame, columns: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """(column, value, n, rank): tie-averaged rank of every distinct value.

    Ranks come from value counts, so a value held by a third of the rows is
    one row here, and running totals over the values give the rest.
    """
    counts = numeric_value_counts(df, columns)
    totals = running_totals(counts, {"upto": F.col("n")}, ["value"], ["column"], task_rows=task_rows)
    return totals.withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2.0).drop("upto")


HOT_SHARE = 1_000
"""A value of more than one row in so many is looked up without a shuffle; there are fewer than this a column."""

LOOKUP_ROWS = 1_000_000
"""Cells a task of the shuffled lookup gets on average."""


def _shuffled_ranks(ranked: DataFrame, ranks: DataFrame, wide: Sequence[int], rows: int) -> DataFrame:
    """Ranks ``c{i}`` for the columns ``v{i}`` in ``wide``, whose rank tables are too large for a broadcast.

    Rows go long over these columns only; values of many rows meet their ranks by broadcast, so no task
    of the join gets all rows of one value, and one regrouping by number makes rows again.
    """
    rest = [c for c in ranked.columns if c.startswith("c")]
    numbered = cut_lineage(ranked.withColumn("_row", F.monotonically_increasing_id()))
    none = F.lit(None).cast("double")
    # what is known of a row travels with its first cell
    cells = [
        F.struct(F.lit(f"v{i}").alias("column"), F.col(f"v{i}").alias("value"), *[(F.col(c) if k == 0 else none).alias(c) for c in rest])
        for k, i in enumerate(wide)
    ]
    long = numbered.select("_row", F.explode(F.array(*cells)).alias("c")).select("_row", "c.*")
    tasks = max(int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * len(wide) // LOOKUP_ROWS))
    often = F.col("n") > F.lit(rows // HOT_SHARE)
    hot = ranks.where(often).select("column", "value", F.col("rank").alias("hot"))
    met = long.join(F.broadcast(hot), ["column", "value"], "left")
    seldom = met.where("hot IS NULL").drop("hot").repartition(tasks, "column", "value")
    found = seldom.join(ranks.where(~often).select("column", "value", "rank").repartition(tasks, "column", "value"), ["column", "value"])
    found = found.unionByName(met.where("hot IS NOT NULL").withColumnRenamed("hot", "rank"))
    if len(wide) == 1:
        return found.select(*rest, F.col("rank").alias(f"c{wide[0]}"))
    own = [F.max(F.when(F.col("column") == f"v{i}", F.col("rank"))).alias(f"c{i}") for i in wide]
    return found.repartition(tasks, "_row").groupBy("_row").agg(*[F.max(c).alias(c) for c in rest], *own).drop("_row")


def spearman(df: DataFrame, columns: Sequence[str] | None = None, task_rows: int = TASK_ROWS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rank correlation matrix in the form of :func:`pearson`, listwise nulls dropped.

    Ranks of measured small size are looked up column by column without a
    shuffle; only columns whose ranks are beyond it together go through a shuffled lookup.
    """
    columns = list(numeric_columns(df) if columns is None else columns)
    for c in columns:
        require_numeric(df, c)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, coefficient double")
    values = df.select(*[double(c).alias(f"v{i}") for i, c in enumerate(columns)]).na.drop()
    ranks = cut_lineage(average_ranks(values, values.columns, task_rows).select("column", "value", "n", "rank"))
    sizes = {r["column"]: (r["values"], r["rows"]) for r in ranks.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows")).collect()}
    ranked, left, wide = values, limit, []
    for c in sorted(sizes, key=lambda c: (sizes[c][0], c)):
        i = int(c[1:])
        left -= 32 * sizes[c][0]
        if left < 0:
            wide.append(i)
            continue
        one = ranks.where(F.col("column") == c).select(F.col("value").alias(f"k{i}"), F.col("rank").alias(f"c{i}"))
        ranked = ranked.join(F.broadcast(one), F.col(c) == F.col(f"k{i}")).drop(f"k{i}", c)
    if wide:
        ranked = _shuffled_ranks(ranked, ranks, wide, max(n for _, n in sizes.values()))
    elif not sizes:
        ranked = values.select(*[F.col(c).alias(f"c{c[1:]}") for c in values.columns])
    return _pairs(ranked, columns) if len(columns) <= AGGREGATED else _products(ranked.select(*[f"c{i}" for i in range(len(columns))]), columns)


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Both matrices in one long table (method, column_a, column_b, coefficient)."""
    a = pearson(df, columns).withColumn("method", F.lit("pearson"))
    b = spearman(df, columns).withColumn("method", F.lit("spearman"))
    return a.unionByName(b).select("method", "column_a", "column_b", "coefficient")


def daily_mean(df: DataFrame, date_column: str, value_column: str) -> DataFrame:
    """(date, value): mean per calendar day, rows with a missing part left out."""
    day = F.date_format(quoted(date_column), "yyyy-MM-dd")
    return (
        df.where(quoted(date_column).isNotNull() & quoted(value_column).isNotNull())
        .groupBy(day.alias("date"))
        .agg(F.avg(double(value_column)).alias("value"))
    )
