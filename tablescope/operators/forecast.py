"""Forecasts for many series: Spark resamples and groups, a small kernel fits series of one length together."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import quoted
from ..functions.solvers import arima_many, smooth_many
from .blocks import spread_groups
from .calendars import Calendar
from .series import forecast_metrics, resample, trend

# Algorithm names, and the names reported when a simpler one had to do.
ALGORITHMS = ["holt_winters", "arima", "sarima", "prophet"]
FALLBACKS = {
    "arima": "arima_fallback_es",
    "sarima": "sarima_fallback_arima",
    "holt_winters": "holt_winters_simple",
}


def _fit(y: np.ndarray, steps: int, algorithm: str, period: int) -> tuple[str, np.ndarray, np.ndarray]:
    """(method used, forecasts, standard errors per step) of (series, time); falls back when the series are too short."""
    n = y.shape[1]
    if algorithm == "sarima":
        if period > 1 and n >= 2 * period + 4:
            mean, se, _ = arima_many(y, steps, period)
            return "sarima", mean, se
        method, mean, se = _fit(y, steps, "arima", period)
        return FALLBACKS["sarima"] if method == "arima" else method, mean, se
    if algorithm == "arima":
        if n >= 5:
            mean, se, _ = arima_many(y, steps)
            return "arima", mean, se
        return FALLBACKS["arima"], *_smoothed(y, steps, 1)
    if period > 1 and n >= 2 * period:
        return "holt_winters", *_smoothed(y, steps, period)
    return FALLBACKS["holt_winters"], *_smoothed(y, steps, 1)


def _smoothed(y: np.ndarray, steps: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    fitted, ahead = smooth_many(y, steps, period)
    rmse = np.sqrt(np.ascontiguousarray((y - fitted) ** 2).mean(axis=1))
    return ahead, rmse[:, None] * np.sqrt(np.arange(1, steps + 1))


def fit_series(
    series: DataFrame,
    keys: Sequence[str],
    algorithm: str = "holt_winters",
    horizon: int = 30,
    level: float = 0.95,
    period: int = 7,
    train_ratio: float = 0.8,
) -> DataFrame:
    """Fit every series of (keys, ts, y), one row per calendar point at most; a task fits series of one length together.

    Rows: ``residual`` (test part: ts, actual, predicted, residual) and
    ``forecast`` (step, predicted, lower, upper), each with ``method_used``.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown forecasting algorithm {algorithm!r}")
    name = "holt_winters" if algorithm == "prophet" else algorithm
    z = NormalDist().inv_cdf(0.5 + level / 2)
    key_fields = [series.schema[k] for k in keys]
    out = T.StructType(
        [T.StructField(f.name, f.dataType) for f in key_fields]
        + [
            T.StructField("kind", T.StringType()),
            T.StructField("step", T.LongType()),
            T.StructField("ts", T.TimestampType()),
            T.StructField("actual", T.DoubleType()),
            T.StructField("predicted", T.DoubleType()),
            T.StructField("lower", T.DoubleType()),
            T.StructField("upper", T.DoubleType()),
            T.StructField("residual", T.DoubleType()),
            T.StructField("method_used", T.StringType()),
        ]
    )
    schema = to_arrow_schema(out)

    def many(batches):
        for batch in batches:
            lengths = pc.list_value_length(batch["_y"]).to_numpy()
            for n in np.unique(lengths):
                yield alike(batch.take(pa.array(np.flatnonzero(lengths == n))), int(n))

    def alike(batch: pa.RecordBatch, n: int) -> pa.RecordBatch:
        """Rows of all series of one length: the test part of each, then its forecast."""
        size = batch.num_rows
        y = batch["_y"].flatten().to_numpy(zero_copy_only=False).reshape(size, n)
        cut = int(n * train_ratio)
        if cut < 5:
            cut = max(1, n - 2)
        method, tested, _ = _fit(y[:, :cut], n - cut, name, period)
        _, ahead, se = _fit(y, horizon, name, period)
        ahead, se = (np.broadcast_to(x, (size, horizon)) for x in (ahead, se))
        rows = np.arange(size)[:, None] * n
        test, future = np.arange(cut, n), np.full(horizon, n - 1)
        places = np.concatenate([rows + test, rows + future], axis=1).ravel()
        none = np.full((size, n - cut), np.nan)
        later = np.full((size, horizon), np.nan)

        def column(left: np.ndarray, right: np.ndarray) -> pa.Array:
            """Test part and forecast beside each other; not a number is null, as the columns have nothing else to say."""
            return pa.array(np.concatenate([left, right], axis=1).ravel(), from_pandas=True)

        per = n - cut + horizon
        columns = [batch[f"_k{i}"].take(pa.array(np.repeat(np.arange(size), per))) for i in range(len(keys))]
        columns += [
            pa.array(np.tile(np.repeat(["residual", "forecast"], [n - cut, horizon]), size)),
            pa.array(np.tile(np.concatenate([np.arange(1, n - cut + 1), np.arange(1, horizon + 1)]), size)),
            batch["_ts"].flatten().take(pa.array(places)),
            column(y[:, cut:], later),
            column(tested, ahead),
            column(none, ahead - z * se),
            column(none, ahead + z * se),
            column(y[:, cut:] - tested, later),
            pa.array([method] * (size * per)),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    points = F.array_sort(F.collect_list(F.struct("ts", "y")))
    whole = series.groupBy(*[quoted(k) for k in keys]).agg(points.alias("_points")).select(
        *[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.transform("_points", lambda p: p["ts"].cast("timestamp")).alias("_ts"),
        F.transform("_points", lambda p: p["y"].cast("double")).alias("_y"),
    )
    return spread_groups(whole, [f"_k{i}" for i in range(len(keys))]).mapInArrow(many, out)


def forecast(
    df: DataFrame,
    date_column: str,
    value_column: str,
    keys: Sequence[str] = (),
    algorithm: str = "holt_winters",
    horizon: int = 30,
    level: float = 0.95,
    period: int = 7,
    train_ratio: float = 0.8,
    frequency: str = "D",
) -> DataFrame:
    """Resample, fit and project every series.

    Long rows (keys, kind, step, ts, actual, predicted, lower, upper, residual,
    trend, method_used) with kinds historical, residual and forecast.
    """
    series = resample(df, date_column, value_column, frequency, keys)
    used = list(keys)
    if not keys:
        # one series over the whole table: at most one row per calendar point
        series, used = series.withColumn("_all", F.lit(1)), ["_all"]
    fitted = fit_series(series, used, algorithm, horizon, level, period, train_ratio)
    moved = F.timestamp_micros(Calendar.parse(frequency).point(F.unix_micros("ts"), F.col("step")))
    fitted = fitted.withColumn("ts", F.when(F.col("kind") == "forecast", moved).otherwise(F.col("ts")))
    fitted = fitted.withColumn("trend", F.lit(None).cast("double"))
    history = trend(series, "y", ["ts"], used).select(
        *[quoted(k) for k in used],
        F.lit("historical").alias("kind"),
        F.lit(None).cast("bigint").alias("step"),
        "ts",
        F.col("y").alias("actual"),
        "trend",
    )
    columns = [*used, "kind", "step", "ts", "actual", "predicted", "lower", "upper", "residual", "trend", "method_used"]
    out = fitted.unionByName(history, allowMissingColumns=True).select(*columns)
    return out if keys else out.drop("_all")


def holdout_metrics(forecasted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, method_used, mae, rmse, mape, smape) of the test part."""
    rows = forecasted.where("kind = 'residual'")
    return forecast_metrics(rows, "actual", "predicted", [*keys, "method_used"])
