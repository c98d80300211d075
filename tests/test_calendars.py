"""Calendars against pandas: recognition, counts, points, gaps."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pandas.tseries.frequencies import infer_freq
from pyspark.sql import functions as F

from tablescope.operators import calendars, series
from tablescope.operators.calendars import Calendar

CODES = ["D", "3D", "h", "15min", "90s", "B", "W-SUN", "2W-THU", "MS", "ME", "2ME", "BMS", "BME", "QS-JAN", "QS-FEB", "QE-DEC", "QE-MAR", "2QE-NOV",
         "BQS-OCT", "BQE-DEC", "YS-JAN", "YS-JUL", "YE-DEC", "YE-FEB", "BYS-JAN", "BYE-DEC", "WOM-3THU", "WOM-1MON", "250ms"]
SPANS = [("2023-01-01", "2024-12-31"), ("2024-02-29", "2026-07-03"), ("2021-05-01 06:30", "2023-10-31 05:00"), ("2024-06-08", "2024-06-09"), ("1969-11-15", "1970-03-02")]


def made(code, start, n):
    return pd.date_range(start, periods=n, freq=code)


@pytest.fixture(scope="module")
def all_series(spark):
    rows, want = [], {}
    rng = np.random.default_rng(3)
    for code in CODES:
        for start in ("2022-01-01", "2023-03-17 09:15", "1968-11-30"):
            name = f"{code}@{start}"
            points = made(code, start, 30)
            rows += [(name, p.to_pydatetime()) for p in rng.permutation(points.to_numpy()).astype("datetime64[us]").astype(object) for p in [pd.Timestamp(p)]]
            want[name] = points
    holes = {
        "holes": made("B", "2024-01-01", 60).delete([7, 20]),
        "wom with holes": made("WOM-2TUE", "2023-01-01", 24).delete([3, 4, 9]),
        "irregular": pd.DatetimeIndex(sorted(rng.integers(0, 10**6, 40).astype("datetime64[m]").astype("datetime64[us]"))).unique(),
        "two": made("D", "2024-01-01", 2),
        "office": pd.date_range("2024-01-01", periods=80, freq="bh"),
        "long steps": pd.date_range("2024-01-01", periods=12, freq="YS").insert(12, pd.Timestamp("2050-01-01")),
    }
    for name, points in holes.items():
        rows += [(name, p.to_pydatetime()) for p in points]
        want[name] = points
    return spark.createDataFrame(rows, "name string, at timestamp").repartition(3), want


def expected(points):
    """Frequency code and gaps as pandas gives them: inferred, else by the median step."""
    code = infer_freq(points) if len(points) >= 3 else None
    if code is None:
        step = pd.Series(points).diff().dropna().median()
        days, seconds = step.days, step.seconds
        code = "YE" if days >= 360 else "ME" if days >= 28 else "W" if days >= 7 else "D" if days >= 1 else "h" if seconds >= 3600 else "min" if seconds >= 60 else "s"
    return code, max(0, len(pd.date_range(points.min(), points.max(), freq=code)) - len(points))


def test_recognized_as_pandas_does(all_series):
    df, want = all_series
    got = {r["name"]: (r["code"], r["missing"]) for r in series.frequencies(df, "at", ["name"]).collect()}
    assert got == {name: expected(points) for name, points in want.items()}


def test_repeated_instants_and_blocks(spark, all_series):
    df, want = all_series
    twice = df.unionByName(df.where("name like 'MS@%'").groupBy("name").agg(F.min("at").alias("at")))
    got = {r["name"]: r["code"] for r in series.frequencies(twice, "at", ["name"], task_rows=5).collect()}
    assert got == {name: "ME" if name.startswith("MS@") else expected(points)[0] for name, points in want.items()}


@pytest.mark.parametrize("code", CODES)
def test_points_and_counts(spark, code):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    df = spark.createDataFrame(SPANS, "a string, b string")
    calendar = Calendar.parse(code)
    if calendar.base in ("ms", "s"):
        df = df.withColumn("b", F.expr("cast(cast(a as timestamp) + interval 3 minutes as string)"))
    for r in df.select("a", "b", calendar.length(us("a"), us("b")).alias("n"), F.array(*[calendar.point(us("a"), F.lit(i).cast("bigint")) for i in range(5)]).alias("p")).collect():
        points = pd.date_range(r["a"], r["b"], freq=code)
        assert r["n"] == len(points), (code, r)
        ahead = pd.date_range(r["a"], periods=5, freq=code).astype("datetime64[us]").astype("int64").tolist()
        assert r["p"] == ahead, (code, r["a"])


def test_periods(spark):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i, hours=7) for i in range(800)]
    df = spark.createDataFrame([(d,) for d in days], "at timestamp")
    for code, want in {"QE-DEC": lambda s: s.dt.to_period("Q").dt.end_time.dt.normalize(), "MS": lambda s: s.dt.to_period("M").dt.start_time,
                       "QE-JAN": lambda s: s.dt.to_period("Q-JAN").dt.end_time.dt.normalize(), "W-WED": lambda s: s.dt.to_period("W-WED").dt.end_time.dt.normalize()}.items():
        got = df.select("at", F.timestamp_micros(Calendar.parse(code).period(F.unix_micros("at"))).alias("p")).toPandas()
        assert (got["p"] == want(got["at"])).all(), code


def test_gaps_of_any_calendar(spark):
    points = made("B", "2024-01-01", 60)
    df = spark.createDataFrame([(p.to_pydatetime(),) for i, p in enumerate(points) if i not in (7, 20)], "at timestamp")
    got = sorted(r["ts"] for r in series.missing_timestamps(df, "at", "B").collect())
    assert got == [points[7].to_pydatetime(), points[20].to_pydatetime()]
    ahead = [r["ts"] for r in series.future_calendar(df, "at", "BQE-DEC", 3).orderBy("step").collect()]
    assert ahead == [p.to_pydatetime() for p in pd.date_range(points[-1], periods=3, freq="BQE-DEC")]


@pytest.mark.parametrize("code", ["X", "0D", "W-JAN", "QE-MON", "WOM-5MON", "bh"])
def test_unknown_codes(code):
    with pytest.raises(ValueError):
        Calendar.parse(code)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_missing_points_are_not_shuffled(spark, keys, monkeypatch):
    """Ranges know which of their points are taken; instants off the calendar take none."""
    monkeypatch.setattr(series, "RUN", 4)
    start = dt.datetime(2024, 1, 1)
    days = {"a": [0, 1, 2, 9, 10, 23], "b": [3], "c": [5, 16]}
    rows = [(k, start + dt.timedelta(days=d)) for k, at in days.items() for d in at]
    rows += [("a", start + dt.timedelta(days=4, hours=7)), ("a", start), ("c", None)]
    df = spark.createDataFrame(rows, "k string, at timestamp")
    made = series.missing_timestamps(df, "at", "D", keys)
    assert "LeftAnti" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((*[r[k] for k in keys], (r["ts"] - start).days) for r in made.collect())
    have = days if keys else {None: sum(days.values(), [])}
    assert got == sorted((*([k] if keys else []), d) for k, at in have.items() for d in range(min(at), max(at) + 1) if d not in at)
