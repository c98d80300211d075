"""Chart-ready aggregates: each function returns the few rows a chart draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import double, finite, is_datetime, quoted, require_column, require_numeric
from .blocks import TASK_ROWS, running_totals
from .quantiles import quantiles
from .sampling import sample_rows
from .stats import daily_mean

# Sizes of the drawn samples and axes.
BINS = 10
RESIDUAL_BINS = 15
OUTLIER_POINTS = 100
SCATTER_POINTS = 500
PIE_SLICES = 5
BARS = 10
LINE_POINTS = 100
CURVE_POINTS = 100


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, bin_name, low, high, count), equal widths, last bin closed on the right, empty bins kept.

    A constant column gets the range value - 0.5 to value + 0.5.
    """
    require_numeric(df, column)
    values = df.select(finite(double(column)).alias("x")).where("x IS NOT NULL")
    flat = F.min("x") == F.max("x")
    edges = values.agg(
        F.struct(
            F.when(flat, F.min("x") - 0.5).otherwise(F.min("x")).alias("lo"),
            F.when(flat, F.max("x") + 0.5).otherwise(F.max("x")).alias("hi"),
        )
    ).scalar()
    lo, hi = edges["lo"], edges["hi"]
    width = (hi - lo) / bins
    guess = F.least(F.floor((F.col("x") - lo) * bins / (hi - lo)).cast("bigint"), F.lit(bins - 1))
    # the division may land one bin off at an edge; compare with the edges themselves
    settled = (
        F.when(F.col("x") < lo + F.col("g") * width, F.col("g") - 1)
        .when((F.col("g") < bins - 1) & (F.col("x") >= lo + (F.col("g") + 1) * width), F.col("g") + 1)
        .otherwise(F.col("g"))
    )
    counts = (
        values.withColumn("g", guess).groupBy(settled.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    )
    # at most ``bins`` rows
    axis = df.sparkSession.range(0, bins, 1, 1).select(F.col("id").alias("bin"))
    low = lo + F.col("bin") * width
    high = F.when(F.col("bin") == bins - 1, hi).otherwise(lo + (F.col("bin") + 1) * width)
    return (
        axis.join(F.broadcast(counts), "bin", "left")
        .select("bin", low.alias("low"), high.alias("high"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
        .where(F.col("low").isNotNull())
        .withColumn("bin_name", F.format_string("%.2f - %.2f", "low", "high"))
    )


def box_plot(df: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """One row: whisker ends (extremes of the non-outliers), quartiles, median, number of outliers."""
    require_numeric(df, column)
    x = double(column)
    q1, q2, q3 = quantiles(df, [column], [0.25, 0.5, 0.75], rows)[column]
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = F.when(x.between(low, high), x)
    return df.agg(
        F.coalesce(F.min(inside), F.min(x)).alias("min"),
        F.coalesce(F.max(inside), F.max(x)).alias("max"),
        F.count_if((x < low) | (x > high)).alias("outlier_count"),
    ).select("min", q1.alias("q1"), q2.alias("median"), q3.alias("q3"), "max", "outlier_count")


def outliers(df: DataFrame, column: str, key: Sequence[str] | None = None, points: int | None = OUTLIER_POINTS, seed: int = 42) -> DataFrame:
    """Values beyond 1.5 IQRs from the quartiles: all of them, or a seeded sample of ``points``."""
    require_numeric(df, column)
    x = double(column)
    q1, q3 = quantiles(df, [column], [0.25, 0.75])[column]
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    beyond = df.where((x < low) | (x > high))
    if points is not None:
        if not key:
            raise ValueError("a sample of outliers needs the key columns it is drawn by")
        beyond = sample_rows(beyond, points, key, seed)
    return beyond.select(*[quoted(k) for k in key or ()], x.alias("value"))


def scatter(df: DataFrame, x: str, y: str, key: Sequence[str], points: int = SCATTER_POINTS, seed: int = 42) -> DataFrame:
    """(x, y) of rows with both present, a seeded sample of ``points`` rows."""
    require_numeric(df, x)
    require_numeric(df, y)
    both = df.where(quoted(x).isNotNull() & quoted(y).isNotNull())
    return sample_rows(both, points, key, seed).select(double(x).alias("x"), double(y).alias("y"))


def _counts(df: DataFrame, column: str) -> DataFrame:
    require_column(df, column)
    value = quoted(column).cast("string")
    return (
        df.where(quoted(column).isNotNull())
        .groupBy(value.alias("category"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def bar(df: DataFrame, column: str, bars: int = BARS) -> DataFrame:
    """The most frequent categories; equal counts by value."""
    return _counts(df, column).orderBy(F.desc("count"), "category").limit(bars)


def pie(df: DataFrame, column: str, slices: int = PIE_SLICES) -> DataFrame:
    """Top categories with their share of non-null rows, the rest as one "Other" slice.

    ``is_rest`` keeps that slice apart from a real category of the same name.
    """
    counts = _counts(df, column)
    top = counts.orderBy(F.desc("count"), "category").limit(slices)
    total = counts.agg(F.sum("count").alias("total"))
    rest = total.withColumn("count", F.col("total") - top.agg(F.sum("count")).scalar()).where("count > 0")
    share = (F.col("count") / total.scalar() * 100).alias("percentage")
    named = top.select(F.col("category").alias("name"), F.col("count").alias("value"), share, F.lit(False).alias("is_rest"))
    other = rest.select(F.lit("Other").alias("name"), F.col("count").alias("value"), share, F.lit(True).alias("is_rest"))
    return named.unionByName(other)


def line(df: DataFrame, date_column: str, value_column: str, points: int = LINE_POINTS) -> DataFrame:
    """Mean per day in date order, every k-th day when there are more than ``points``.

    A text date column must parse throughout, otherwise the result is empty.
    """
    require_column(df, date_column)
    require_numeric(df, value_column)
    if not is_datetime(df, date_column):
        text = quoted(date_column)
        used = text.isNotNull() & quoted(value_column).isNotNull()
        bad = df.agg(F.count_if(used & text.try_cast("timestamp").isNull())).scalar()
        df = df.withColumn(date_column, text.try_cast("timestamp")).where(bad == 0)
    days = daily_mean(df, date_column, value_column)
    # one row per calendar day, so a single ordered window is bounded by the calendar
    numbered = days.withColumns(
        {"rn": F.row_number().over(W.orderBy("date")), "n": F.count(F.lit(1)).over(W.partitionBy())}
    )
    step = F.when(F.col("n") > points, F.floor(F.col("n") / points)).otherwise(F.lit(1))
    return numbered.where((F.col("rn") - 1) % step == 0).select("date", "value")


def residual_points(scored: DataFrame, actual: str, predicted: str, key: Sequence[str], points: int = SCATTER_POINTS, seed: int = 42) -> DataFrame:
    """(actual, predicted, residual) of a seeded sample."""
    rows = sample_rows(scored, points, key, seed)
    a, p = double(actual), double(predicted)
    return rows.select(a.alias("actual"), p.alias("predicted"), (a - p).alias("residual"))


def residual_histogram(scored: DataFrame, actual: str, predicted: str, bins: int = RESIDUAL_BINS) -> DataFrame:
    """Histogram of the residuals of all scored rows."""
    return histogram(scored.select((double(actual) - double(predicted)).alias("residual")), "residual", bins)


def score_groups(scored: DataFrame, label: str, score: str, positive: object = 1) -> DataFrame:
    """(score, pos, neg) per distinct score: the table ROC and AUC are computed from."""
    hit = quoted(label) == F.lit(positive)
    return (
        scored.where(quoted(label).isNotNull() & quoted(score).isNotNull())
        .groupBy(double(score).alias("score"))
        .agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    )


def roc_curve(
    scored: DataFrame, label: str, score: str, positive: object = 1, points: int = CURVE_POINTS, task_rows: int = TASK_ROWS
) -> DataFrame:
    """(position, fpr, tpr): the curve from (0, 0), thresholds in descending score.

    Thresholds in the middle of a straight run add nothing and are dropped;
    when more than ``points`` remain every k-th is kept, and (1, 1) is added at
    the end.  Empty unless both classes occur.
    """
    groups = score_groups(scored, label, score, positive)
    totals = groups.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    run = running_totals(
        groups,
        {"tp": F.col("pos"), "fp": F.col("neg"), "at": F.lit(1).cast("bigint")},
        ["score"],
        descending=True,
        task_rows=task_rows,
    )
    following = run.select((F.col("at") - 1).alias("at"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"))
    corners = (
        run.join(following, "at", "left")
        .where(
            (F.col("at") == 1)
            | F.col("next_pos").isNull()
            | (F.col("pos") != F.col("next_pos"))
            | (F.col("neg") != F.col("next_neg"))
        )
        .select("at", "tp", "fp")
    )
    origin = scored.sparkSession.range(0, 1, 1, 1).select(
        F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp")
    )
    all_points = corners.unionByName(origin)
    placed = running_totals(all_points, {"position": F.lit(1).cast("bigint")}, ["at"], task_rows=task_rows)
    n = all_points.agg(F.count(F.lit(1))).scalar()
    step = F.when(n > points, F.floor(n / points)).otherwise(F.lit(1))
    kept = placed.where(((F.col("position") - 1) % step == 0) & (totals["p"] > 0) & (totals["n"] > 0)).select(
        "position", (F.col("fp") / totals["n"]).alias("fpr"), (F.col("tp") / totals["p"]).alias("tpr")
    )
    last = groups.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).where("p > 0 AND n > 0")
    end = last.select((n + 1).cast("bigint").alias("position"), F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"))
    return kept.unionByName(end)
