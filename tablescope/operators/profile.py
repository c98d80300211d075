"""Table profile: sizes, missing cells, duplicates, distinct counts, kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import fingerprint, is_string, quoted
from .kinds import classify, of_kind, suggest_target
from .stats import describe_numeric, distinct_counts

# Bytes of the fixed-width types.
_WIDTHS = {
    T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
    T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
}


def table_shape(df: DataFrame) -> DataFrame:
    """(rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, null_count, null_percentage), one aggregate for all columns."""
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_count")) for i, c in enumerate(df.columns)]
    )
    return one.select("rows", F.explode(cells).alias("c")).select(
        "c.column",
        "c.null_count",
        F.when(F.col("rows") > 0, F.col("c.null_count") / F.col("rows") * 100).otherwise(F.lit(0.0)).alias("null_percentage"),
    )


def duplicate_counts(df: DataFrame) -> DataFrame:
    """(rows, distinct_rows, duplicate_rows); null equals null.

    Rows are compared by 128-bit fingerprints, so the shuffle carries 24 bytes
    per distinct row whatever the table's width, and copies collapse map-side.
    """
    marks = df.select(*fingerprint([quoted(c) for c in df.columns])).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return marks.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
    ).withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows"))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with exactly one distinct non-null value: min equals max, no distinct count."""
    one = df.agg(*[(F.min(quoted(c)) == F.max(quoted(c))).alias(f"k{i}") for i, c in enumerate(df.columns)])
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"k{i}"), F.lit(False)).alias("constant"))
            for i, c in enumerate(df.columns)
        ]
    )
    return one.select(F.explode(cells).alias("c")).where("c.constant").select("c.column")


def approx_bytes(df: DataFrame) -> DataFrame:
    """Size of the values: text bytes plus the fixed widths of the rest."""
    cells = [
        F.coalesce(F.octet_length(quoted(f.name)), F.lit(0))
        if is_string(df, f.name)
        else F.lit(_WIDTHS.get(type(f.dataType), 8))
        for f in df.schema.fields
    ]
    return df.agg(F.coalesce(F.sum(sum(cells, F.lit(0)).cast("bigint")), F.lit(0)).alias("approx_bytes"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: kind, type, nulls, distinct values and, for numbers, moments and quantiles."""
    rows = df.count()
    numbers = [c for c in df.columns if isinstance(df.schema[c].dataType, T.NumericType)]
    others = [c for c in df.columns if c not in numbers]
    # one row per column
    distinct = {r["column"]: r["distinct_count"] for r in distinct_counts(df, others).collect()} if others else {}
    kinds = classify(df, "full", rows, distinct=distinct)
    facts = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                F.lit(k).alias("kind"),
                F.lit(distinct.get(c)).cast("bigint").alias("_distinct"),
            )
            for i, (c, k) in enumerate(kinds.items())
        ]
    )
    base = df.sparkSession.range(0, 1, 1, 1).select(F.explode(facts).alias("f")).select("f.*")
    out = base.join(F.broadcast(null_counts(df)), "column")
    if numbers:
        out = out.join(F.broadcast(describe_numeric(df, numbers, rows).drop("n")), "column", "left")
        out = out.withColumn("distinct_count", F.coalesce("_distinct", "distinct_count")).drop("_distinct")
    else:
        out = out.withColumnRenamed("_distinct", "distinct_count")
    return out.withColumn("cardinality_ratio", F.col("distinct_count") / F.greatest(F.lit(rows), F.lit(1)))


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicates, size, column lists, suggested target."""
    kinds = classify(df, "full")
    names = lambda *k: F.array(*[F.lit(c) for c in of_kind(kinds, *k)]).cast("array<string>")
    missing = null_counts(df).agg(F.sum("null_count").alias("missing_values")).scalar()
    return duplicate_counts(df).select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        missing.alias("missing_values"),
        "duplicate_rows",
        approx_bytes(df).scalar().alias("approx_bytes"),
        names("numerical").alias("numerical_columns"),
        names("categorical").alias("categorical_columns"),
        names("boolean").alias("boolean_columns"),
        names("datetime").alias("date_columns"),
        names("text").alias("text_columns"),
        F.lit(suggest_target(df.columns)).alias("target_suggestion"),
    )
