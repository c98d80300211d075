"""Time-series checks for many series at once, keyed by columns.

A series is all rows of one key (or the whole table without keys).  Everything
starts from the counts per (key, timestamp), so repeated timestamps are one
row from the first shuffle on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import double, is_datetime, is_numeric, is_string, micros, quoted
from .blocks import TASK_ROWS, group_sizes, positions, rolling, running_last, running_totals
from .calendars import Calendar, code_of, recognized, shapes, weekday_of_month_length
from .lookups import broadcast_if_small

# Detection thresholds, frequency ladder and target words.
MIN_ROWS = 10
PROBE_MINIMUM = 5
PROBE_SHARE = 0.8
TARGET_WORDS = ["sales", "revenue", "count", "demand", "temp", "value", "price", "amount"]
TREND_ROWS = 12
DAY = 86_400_000_000
HOUR = 3_600_000_000
MINUTE = 60_000_000
SECOND = 1_000_000
RUN = 4096
"""Calendar points in a range."""


def find_date_column(df: DataFrame) -> str | None:
    """First date or timestamp column; else the first text column most of whose values parse as dates (one aggregate over all rows)."""
    for c in df.columns:
        if is_datetime(df, c):
            return c
    texts = [c for c in df.columns if is_string(df, c)]
    if not texts:
        return None
    counts = [F.struct(F.count(quoted(c)).alias("n"), F.count(quoted(c).try_cast("timestamp")).alias("ok")) for c in texts]
    row = df.agg(F.array(*counts).alias("c")).first()["c"]
    return next((c for c, x in zip(texts, row) if x["n"] > PROBE_MINIMUM and x["ok"] / x["n"] > PROBE_SHARE), None)


def target_candidates(df: DataFrame, date_column: str | None) -> list[str]:
    """Numeric columns that are not constant (one aggregate of minima and maxima)."""
    numbers = [c for c in df.columns if c != date_column and is_numeric(df, c)]
    if not numbers:
        return []
    row = df.agg(*[(F.min(quoted(c)) < F.max(quoted(c))).alias(f"v{i}") for i, c in enumerate(numbers)]).first()
    return [c for i, c in enumerate(numbers) if row[f"v{i}"]]


def suggest_series_target(candidates: Sequence[str]) -> str | None:
    for c in candidates:
        if any(w in c.lower() for w in TARGET_WORDS):
            return c
    return candidates[0] if candidates else None


def instants(df: DataFrame, date_column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, us, n): how often each instant occurs; text is parsed, unparsable dates are left out."""
    c = quoted(date_column)
    dtype = df.schema[date_column].dataType
    if isinstance(dtype, T.StringType):
        c, dtype = c.try_cast("timestamp"), T.TimestampType()
    return (
        df.select(*[quoted(k) for k in keys], micros(c, dtype).alias("us"))
        .where("us IS NOT NULL")
        .groupBy(*[quoted(k) for k in keys], "us")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def deltas(counted: DataFrame, keys: Sequence[str] = (), task_rows: int = TASK_ROWS) -> DataFrame:
    """(keys, delta, w): differences to the previous row in microseconds and how often each occurs.

    Repeats of an instant are differences of zero.
    """
    part = [quoted(k) for k in keys]
    stepped = running_last(counted, "before", F.col("us"), ["us"], keys, include_current=False, task_rows=task_rows)
    both = stepped.select(
        *part,
        F.explode(
            F.array(
                F.struct((F.col("us") - F.col("before")).alias("delta"), F.lit(1).cast("bigint").alias("w")),
                F.struct(F.lit(0).cast("bigint").alias("delta"), (F.col("n") - 1).alias("w")),
            )
        ).alias("d"),
    ).select(*part, "d.*")
    return both.where("delta IS NOT NULL AND w > 0").groupBy(*part, "delta").agg(F.sum("w").alias("w"))


def weighted_median(df: DataFrame, value: str, weight: str, keys: Sequence[str] = (), task_rows: int = TASK_ROWS) -> DataFrame:
    """(keys, median) with linear interpolation, rows being distinct (keys, value) with a weight."""
    part = [quoted(k) for k in keys]
    _, largest = group_sizes(df, keys)
    if largest <= task_rows:
        return df.groupBy(*part).agg(F.percentile(quoted(value), F.lit(0.5), quoted(weight)).alias("median"))
    up = running_totals(df, {"up": quoted(weight)}, [value], keys, task_rows=task_rows)
    both = running_totals(up, {"down": quoted(weight)}, [value], keys, descending=True, task_rows=task_rows)
    total = F.col("up") + F.col("down") - quoted(weight)
    start = F.col("up") - quoted(weight)
    low, high = F.floor((total - 1) / 2), F.ceil((total - 1) / 2)
    holds = lambda r: (start <= r) & (r < F.col("up"))
    picked = both.groupBy(*part).agg(
        F.max(F.when(holds(low), quoted(value))).alias("a"), F.max(F.when(holds(high), quoted(value))).alias("b")
    )
    return picked.select(*part, ((F.col("a") + F.col("b")) / 2.0).alias("median"))


def frequency_code(median: Column) -> Column:
    """Ladder code of a median difference in microseconds."""
    days = F.floor(median / DAY)
    seconds = F.floor((median - days * DAY) / SECOND)
    return (
        F.when(median.isNull(), F.lit(None).cast("string"))
        .when(days >= 360, "YE")
        .when(days >= 28, "ME")
        .when(days >= 7, "W")
        .when(days >= 1, "D")
        .when(seconds >= 3600, "h")
        .when(seconds >= 60, "min")
        .otherwise("s")
    )


def calendar_length(first: Column, last: Column, code: Column) -> Column:
    """Number of calendar points of a ladder code from first to last (microseconds).

    Weeks end on Sunday, months on their last day, years on 31 December, at
    the time of day of the first point.
    """
    out = F.lit(None).cast("bigint")
    for known in ("s", "min", "h", "D", "W", "ME", "YE"):
        out = F.when(code == known, Calendar.parse(known).length(first, last)).otherwise(out)
    return out


def frequencies(df: DataFrame, date_column: str, keys: Sequence[str] = (), task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per series: rows, instants, first and last, median difference, frequency, gaps.

    ``code`` is the calendar all instants fit (``calendars.recognized``), put together from ``frequency``, ``multiple``
    and ``anchor``; where none fits, the ladder's code of the median difference, without a multiple.
    """
    part = [quoted(k) for k in keys]
    counted = instants(df, date_column, keys)
    facts = shapes(counted, keys, task_rows)
    medians = weighted_median(deltas(counted, keys, task_rows), "delta", "w", keys, task_rows)
    if keys:
        out = facts.join(medians, list(keys), "left")
    else:
        out = facts.withColumn("median", medians.select("median").scalar())
    found = F.col("found")
    ladder = frequency_code(F.col("median"))
    first, last = F.col("first_us"), F.col("last_us")
    length = (
        F.when(found["base"] == "WOM", weekday_of_month_length(first, last, F.col("week_least"), F.col("weekday_least")))
        .when(found.isNotNull(), F.col("instants"))
        .otherwise(calendar_length(first, last, ladder))
    )
    return (
        out.withColumn("found", recognized())
        .withColumn("frequency", F.coalesce(found["base"], ladder))
        .withColumn("code", F.coalesce(code_of(found), ladder))
        .withColumn("multiple", found["multiple"].cast("double"))
        .withColumn("anchor", found["anchor"])
        .withColumn("calendar", length)
        .withColumn("missing", F.greatest(F.lit(0), F.col("calendar") - F.col("instants")))
        .withColumn(
            "missing_pct", F.when(F.col("calendar") > 0, F.col("missing") / F.col("calendar") * 100).otherwise(F.lit(0.0))
        )
        .withColumn("has_duplicates", F.col("rows") > F.col("instants"))
        .select(
            *part,
            "rows",
            "instants",
            F.timestamp_micros("first_us").alias("first_at"),
            F.timestamp_micros("last_us").alias("last_at"),
            (F.col("median") / SECOND).alias("median_seconds"),
            "frequency",
            "multiple",
            "anchor",
            "code",
            "calendar",
            "missing",
            "missing_pct",
            "has_duplicates",
        )
    )


def missing_timestamps(df: DataFrame, date_column: str, frequency: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ts): points of a calendar (any code of ``calendars``) at which a series has no row.

    Points are made in ranges of ``RUN``, dealt to tasks by series and range, so one long calendar is many small pieces.
    A range learns by number which of its points are taken, so points themselves are never shuffled.
    """
    part = [quoted(k) for k in keys]
    calendar = Calendar.parse(frequency)
    present = instants(df, date_column, keys).drop("n")
    spans = present.groupBy(*part).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    place = (calendar.length(F.col("first_us"), F.col("us")) - 1).cast("bigint")
    met = present.join(broadcast_if_small(spans), list(keys)) if keys else present.crossJoin(F.broadcast(spans))  # without keys one row
    taken = (
        met.withColumn("i", place)
        .where((F.col("i") >= 0) & (calendar.point(F.col("first_us"), F.col("i")) == F.col("us")))
        .groupBy(*part, F.floor(F.col("i") / RUN).alias("hi"))
        .agg(F.collect_list("i").alias("taken"))
    )
    ranges = (
        spans.withColumn("n", calendar.length(F.col("first_us"), F.col("last_us")))
        .where("n > 0")
        .withColumn("hi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RUN))))
    )
    last = F.least(F.col("n").cast("bigint"), (F.col("hi") + 1) * RUN) - 1
    whole = F.sequence(F.col("hi") * RUN, last)
    free = F.when(F.col("taken").isNull(), whole).otherwise(F.array_except(whole, F.col("taken")))
    points = ranges.join(taken, [*keys, "hi"], "left").select(*part, "first_us", F.explode(free).alias("i"))
    return points.select(*part, F.timestamp_micros(calendar.point(F.col("first_us"), F.col("i"))).alias("ts"))


def detect_series(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per series: is it fit for forecasting, and what stands against it."""
    spark = df.sparkSession
    date_column = find_date_column(df)
    candidates = [c for c in target_candidates(df, date_column) if c not in keys]
    suggested = suggest_series_target(candidates)
    part = [quoted(k) for k in keys]
    sizes = df.groupBy(*part).agg(
        F.count(F.lit(1)).alias("total"),
        (F.count(quoted(date_column).try_cast("timestamp") if date_column and is_string(df, date_column) else quoted(date_column)) if date_column else F.lit(0)).alias("dated"),
    )
    if date_column is None:
        base = sizes.withColumns(
            {
                "frequency": F.lit(None).cast("string"),
                "missing": F.lit(0).cast("bigint"),
                "missing_pct": F.lit(0.0),
                "has_duplicates": F.lit(False),
            }
        )
    else:
        facts = frequencies(df, date_column, keys).select(*part, F.col("code").alias("frequency"), "missing", "missing_pct", "has_duplicates")
        if keys:
            base = sizes.join(facts, list(keys), "left")
        else:
            # one row each
            base = sizes.withColumns({c: facts.select(c).scalar() for c in facts.columns})
    few = F.col("total") < MIN_ROWS
    undated = F.lit(date_column is None)
    warnings = F.array_compact(
        F.array(
            F.when(few, F.lit("Fewer than 10 rows are too short to forecast.")),
            F.when(~few & undated, F.lit("No column holds dates.")),
            F.when(
                ~few & ~undated & (F.col("dated") < F.col("total")),
                F.lit(f"Some rows have no usable date in '{date_column}'."),
            ),
            F.when(~few & F.col("has_duplicates"), F.lit("Some timestamps occur more than once.")),
            F.when(
                ~few & (F.col("missing") > 0),
                F.format_string("%d expected timestamps are absent (%.1f%%).", "missing", "missing_pct"),
            ),
            F.when(
                ~few & ~undated & F.lit(not candidates), F.lit("There is no number to forecast.")
            ),
        )
    )
    ok = ~few & ~undated & F.lit(bool(candidates))
    return base.select(
        *part,
        F.col("total").alias("rows"),
        ok.alias("is_feasible"),
        F.when(~few, F.lit(date_column)).alias("datetime_column"),
        F.when(~few, F.col("frequency")).alias("frequency"),
        F.when(few, F.lit(0)).otherwise(F.coalesce("missing", F.lit(0))).cast("bigint").alias("missing_timestamps"),
        F.when(few, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(c) for c in candidates]).cast("array<string>")).alias("target_candidates"),
        F.when(ok, F.lit(suggested)).alias("suggested_target"),
        warnings.alias("warnings"),
    )


def period_of(c: Column, frequency: str) -> Column:
    """The calendar point a timestamp belongs to: its second, minute, hour or day, the Sunday ending
    its week, the last day of its month, 31 December of its year."""
    units = {"s": "second", "min": "minute", "h": "hour", "D": "day"}
    if frequency in units:
        return F.date_trunc(units[frequency], c)
    if frequency == "W":
        return (F.date_trunc("week", c) + F.expr("INTERVAL 6 DAYS")).cast("timestamp")
    if frequency == "ME":
        return F.last_day(c).cast("timestamp")
    if frequency == "YE":
        return F.make_date(F.year(c), F.lit(12), F.lit(31)).cast("timestamp")
    return F.timestamp_micros(Calendar.parse(frequency).period(F.unix_micros(c)))


def resample(df: DataFrame, date_column: str, value_column: str, frequency: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ts, y): mean per key and calendar point; the only shuffle of raw rows, combined map-side."""
    c = quoted(date_column)
    stamp = c.try_cast("timestamp") if is_string(df, date_column) else c.cast("timestamp")
    return (
        df.select(*[quoted(k) for k in keys], stamp.alias("_at"), double(value_column).alias("_y"))
        .where("_at IS NOT NULL AND _y IS NOT NULL")
        .groupBy(*[quoted(k) for k in keys], period_of(F.col("_at"), frequency).alias("ts"))
        .agg(F.avg("_y").alias("y"))
    )


def split_point(n: Column, ratio: float) -> Column:
    """Rows in the training part."""
    cut = F.floor(n * ratio)
    return F.when(cut < 5, F.greatest(F.lit(1), n - 2)).otherwise(cut).cast("bigint")


def chronological_split(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), ratio: float = 0.8, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Add ``position`` and ``is_train``: the first rows of each series train, the rest test."""
    part = [quoted(k) for k in keys]
    placed = positions(df, "position", order, keys, task_rows=task_rows)
    if keys:
        sizes = broadcast_if_small(df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")))
        placed = placed.join(sizes, list(keys))
        n = F.col("_n")
    else:
        n = df.agg(F.count(F.lit(1))).scalar()
    return placed.withColumn("is_train", F.col("position") <= split_point(n, ratio)).drop("_n")


def forecast_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mae, rmse, mape, smape); percentages over points whose actual is not zero, 0 if there are none."""
    y, p = double(actual), double(predicted)
    nonzero = y != 0
    mape = F.avg(F.when(nonzero, F.abs((y - p) / y))) * 100
    smape = F.avg(F.when(nonzero, 2 * F.abs(y - p) / (F.abs(y) + F.abs(p)))) * 100
    return (
        df.where(y.isNotNull() & p.isNotNull())
        .groupBy(*[quoted(k) for k in keys])
        .agg(
            F.avg(F.abs(y - p)).alias("mae"),
            F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
            F.coalesce(mape, F.lit(0.0)).alias("mape"),
            F.coalesce(smape, F.lit(0.0)).alias("smape"),
        )
    )


def future_calendar(df: DataFrame, ts: str, frequency: str, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, step, ts): the next ``horizon`` calendar points after the last one of each series."""
    part = [quoted(k) for k in keys]
    last = df.groupBy(*part).agg(F.max(quoted(ts).cast("timestamp")).alias("_last"))
    # the calendar's first point at or after the last timestamp, and whether that is the timestamp itself
    calendar = Calendar.parse(frequency)
    us = F.unix_micros("_last")
    start = calendar.point(us, F.lit(0).cast("bigint"))
    step = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(horizon).cast("bigint")))
    ahead = calendar.point(us, F.when(start == us, F.col("step")).otherwise(F.col("step") - 1))
    return last.where("_last IS NOT NULL").select("*", step.alias("step")).select(*part, "step", F.timestamp_micros(ahead).alias("ts"))


def trend(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), task_rows: int = TASK_ROWS) -> DataFrame:
    """Add ``trend``: mean of the last twelve rows of the series, fewer at its start."""
    return rolling(df, "trend", F.avg(double(value)), TREND_ROWS, order, keys, task_rows=task_rows)
