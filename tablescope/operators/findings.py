"""Health score, messages and findings over a table's profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import double, sample_skewness
from .kinds import classify, of_kind, suggest_target
from .profile import constant_columns, duplicate_counts, null_counts
from .quantiles import quantiles
from .stats import pearson

# Thresholds of the score and of the findings.
MISSING_CAP = 30
DUPLICATE_CAP = 15
OUTLIER_CAP = 10
OUTLIER_FREE_SHARE = 5
FENCE = 1.5
THIN_TABLE = 10
DEEP_TABLE = 100
THIN_PENALTY = 10
COLLINEAR = 0.85
STRONG = 0.6
SKEWED = 2.0

# What the score's parts are reported as (kind, condition, message).
MESSAGES = [
    ("warning", "empty", "Dataset is empty."),
    ("recommendation", "empty", "Upload a valid CSV/Excel file."),
    ("strength", "no_missing", "No missing values detected."),
    ("warning", "missing", "Missing values occupy %.1f%% of total cells."),
    ("recommendation", "missing", "Apply Imputation (Mean, Median, or Mode) to clean missing values."),
    ("strength", "no_duplicates", "No duplicate rows found."),
    ("warning", "duplicates", "Duplicate rows account for %.1f%% of the dataset."),
    ("recommendation", "duplicates", "Remove duplicate rows using the duplicate removal action."),
    ("warning", "outliers", "Significant outliers detected in numerical columns (%.1f%% of values)."),
    ("recommendation", "outliers", "Handle outliers using IQR/Z-score clipping or dropping."),
    ("strength", "no_outliers", "Numerical data is free of extreme outliers."),
    ("warning", "text", "High-cardinality text columns detected: %s."),
    ("recommendation", "text", "Consider dropping ID or unique text columns to improve model performance."),
    ("warning", "thin", "Low row-to-column ratio (fewer than 10 rows per column). Highly vulnerable to overfitting."),
    ("recommendation", "thin", "Collect more data rows or drop non-essential features/columns."),
    ("strength", "deep", "High row-to-column ratio, providing strong support for statistical models."),
]


def outlier_share(df: DataFrame, columns: Sequence[str], rows: int | None = None) -> DataFrame:
    """One row (outliers, cells): values beyond the 1.5 IQR fences over all non-null numeric cells.

    Fences of all columns come from one aggregate, the counts from a second.
    """
    if not columns:
        zero = F.lit(0).cast("bigint")
        return df.sparkSession.range(0, 1, 1, 1).select(zero.alias("outliers"), zero.alias("cells"))
    q = quantiles(df, columns, [0.25, 0.75], rows)
    outside, cells = [], []
    for c in columns:
        q1, q3 = q[c]
        x = double(c)
        beyond = (x < q1 - FENCE * (q3 - q1)) | (x > q3 + FENCE * (q3 - q1))
        outside.append(F.count_if(beyond))
        cells.append(F.count(x))
    return df.agg(sum(outside[1:], outside[0]).alias("outliers"), sum(cells[1:], cells[0]).alias("cells"))


def health_inputs(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """One row with everything the score and its messages are made of."""
    rows = df.count()
    kinds = classify(df, "full", rows) if kinds is None else kinds
    missing = null_counts(df).agg(F.coalesce(F.sum("null_count"), F.lit(0)).alias("m")).scalar()
    shares = outlier_share(df, of_kind(kinds, "numerical"), rows)
    texts = F.array(*[F.lit(c) for c in of_kind(kinds, "text")]).cast("array<string>")
    size = F.col("rows") * F.col("columns")
    return (
        shares.withColumns(
            {
                "rows": F.lit(rows).cast("bigint"),
                "columns": F.lit(len(df.columns)).cast("bigint"),
                "missing": missing,
                "duplicates": duplicate_counts(df).select("duplicate_rows").scalar(),
                "text_columns": texts,
            }
        )
        .withColumn("missing_pct", F.when(size > 0, F.col("missing") / size * 100))
        .withColumn("duplicate_pct", F.when(F.col("rows") > 0, F.col("duplicates") / F.col("rows") * 100).otherwise(F.lit(0.0)))
        .withColumn("outlier_pct", F.when(F.col("cells") > 0, F.col("outliers") / F.col("cells") * 100))
        .withColumn("depth", F.when(F.col("columns") > 0, F.col("rows") / F.col("columns")))
        .withColumn("score", _score(size))
    )


def _score(size: Column) -> Column:
    off_missing = F.least(F.lit(MISSING_CAP), F.floor("missing_pct"))
    off_duplicates = F.least(F.lit(DUPLICATE_CAP), F.floor("duplicate_pct"))
    off_outliers = F.when(
        F.col("outlier_pct") > OUTLIER_FREE_SHARE,
        F.least(F.lit(OUTLIER_CAP), F.floor((F.col("outlier_pct") - OUTLIER_FREE_SHARE) * 0.5)),
    ).otherwise(F.lit(0))
    off_thin = F.when(F.col("depth") < THIN_TABLE, F.lit(THIN_PENALTY)).otherwise(F.lit(0))
    left = F.lit(100) - off_missing - off_duplicates - off_outliers - off_thin
    return F.when(size == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), left))).cast("bigint")


def health(df: DataFrame) -> DataFrame:
    """One row: score 0 to 100 with the shares behind it."""
    return health_inputs(df).select("score", "rows", "columns", "missing", "duplicates", "outliers", "cells")


def health_messages(df: DataFrame) -> DataFrame:
    """(kind, code, message) rows: strengths, warnings and recommendations that apply."""
    empty = (F.col("rows") * F.col("columns")) == 0
    some = ~empty
    conditions = {
        "empty": empty,
        "no_missing": some & (F.col("missing") == 0),
        "missing": some & (F.col("missing") > 0),
        "no_duplicates": some & (F.col("duplicates") == 0),
        "duplicates": some & (F.col("duplicates") > 0),
        "outliers": some & (F.col("outlier_pct") > OUTLIER_FREE_SHARE),
        "no_outliers": some & (F.col("outlier_pct") == 0),
        "text": some & (F.size("text_columns") > 0),
        "thin": some & (F.col("depth") < THIN_TABLE),
        "deep": some & (F.col("depth") > DEEP_TABLE),
    }
    listed = F.array_join(F.slice("text_columns", 1, 3), ", ")
    figures = {"missing": F.col("missing_pct"), "duplicates": F.col("duplicate_pct"), "outliers": F.col("outlier_pct"), "text": listed}
    rules = []
    for kind, condition, message in MESSAGES:
        text = F.format_string(message, figures[condition]) if "%" in message else F.lit(message)
        rules.append((kind, condition.removeprefix("no_"), conditions[condition], text))
    return rule_rows(health_inputs(df), rules)


def rule_rows(one: DataFrame, rules: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """(kind, code, message) for every rule whose condition holds on the one-row input."""
    rows = F.array(
        *[
            F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"), text.alias("message")))
            for kind, code, when, text in rules
        ]
    )
    return one.select(F.explode(rows).alias("r")).where("r IS NOT NULL").select("r.*")


def strong_pairs(df: DataFrame, columns: Sequence[str], above: float, listwise: bool = True) -> DataFrame:
    """(column_a, column_b, coefficient) with |r| above the limit, each pair once in column order."""
    place = {c: i for i, c in enumerate(columns)}
    order = F.create_map(*[x for c, i in place.items() for x in (F.lit(c), F.lit(i))]) if columns else None
    if len(columns) < 2:
        return pearson(df, columns, listwise)
    a, b = F.try_element_at(order, F.col("column_a")), F.try_element_at(order, F.col("column_b"))
    return (
        pearson(df, columns, listwise)
        .where((a < b) & (F.abs("coefficient") > above))
        .withColumns({"position_a": a, "position_b": b})
    )


def skewness_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(position, column, skewness), one aggregate."""
    one = df.agg(*[sample_skewness(double(c)).alias(f"s{i}") for i, c in enumerate(columns)])
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"s{i}").alias("skewness"))
            for i, c in enumerate(columns)
        ]
    )
    return one.select(F.explode(cells).alias("c")).select("c.*")


def most_skewed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The column with the largest |skewness|; the first of equals."""
    ranked = skewness_by_column(df, columns).where("skewness IS NOT NULL")
    return ranked.agg(
        F.max_by(F.struct("column", "skewness"), F.struct(F.abs("skewness"), -F.col("position"))).alias("m")
    ).select("m.column", F.abs("m.skewness").alias("abs_skewness"))


def findings(df: DataFrame) -> DataFrame:
    """(kind, code, title, message, action): collinear pairs, extreme skew, target hint, constant columns."""
    kinds = classify(df, "full")
    numbers = of_kind(kinds, "numerical")
    target = suggest_target(df.columns)
    target_kind = kinds.get(target, "unknown")
    task = "classification" if target_kind in ("categorical", "boolean") else "regression"

    def finding(rows: DataFrame, kind: str, code: str, title: str, message: Column, action: str) -> DataFrame:
        fixed = {"kind": kind, "code": code, "title": title}
        return rows.select(*[F.lit(v).alias(k) for k, v in fixed.items()], message.alias("message"), F.lit(action).alias("action"))

    parts = []
    if len(numbers) >= 2:
        named = F.format_string("%s and %s (%.2f)", "column_a", "column_b", F.abs("coefficient"))
        pairs = F.sort_array(F.collect_list(F.struct("position_a", "position_b", named.alias("text")))).alias("p")
        listed = strong_pairs(df, numbers, COLLINEAR).agg(pairs).where(F.size("p") > 0)
        first = F.array_join(F.transform(F.slice("p", 1, 3), lambda x: x["text"]), ", ")
        message = F.concat(F.lit("These columns move together: "), first, F.lit("."))
        parts.append(finding(listed, "warning", "collinear", "Columns that repeat each other", message, "Keep one column of each pair."))
    if numbers:
        message = F.format_string("The skewness of '%s' is %.2f in size.", "column", "abs_skewness")
        skewed = most_skewed(df, numbers).where(F.col("abs_skewness") > SKEWED)
        parts.append(finding(skewed, "info", "skewed", "A column with a long tail", message, "Try a logarithm or power of it."))
    if target is not None:
        message = F.lit(f"'{target}', a column of kind {target_kind}, may be the one to predict.")
        one = df.sparkSession.range(0, 1, 1, 1)
        parts.append(finding(one, "success", "target", "A likely target", message, f"Train a {task} model on it."))
    place = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    named = F.sort_array(F.collect_list(F.struct(F.element_at(place, F.col("column")).alias("i"), "column"))).alias("c")
    constant = constant_columns(df).agg(named).where(F.size("c") > 0)
    message = F.concat(F.lit("Always the same: "), F.array_join(F.transform("c", lambda x: x["column"]), ", "), F.lit("."))
    parts.append(finding(constant, "warning", "constant", "Columns that never vary", message, "Leave them out of models."))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
