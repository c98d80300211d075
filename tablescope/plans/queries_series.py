"""Time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators import forecast, series
from ..sources.tables import Tables
from .registry import query
from .shared import rounded, rsql

_DAILY = """daily AS (SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS y FROM events GROUP BY 1, 2)"""


def _day(name: str, c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(name)


def daily(t: Tables) -> DataFrame:
    return series.resample(t.events, "ts", "value", "D", ["event_type"])


def _ladder(median: str) -> str:
    """SQL of the frequency ladder over microseconds."""
    return f"""CASE WHEN {median} IS NULL THEN NULL WHEN {median} >= 360 * 86400e6 THEN 'YE' WHEN {median} >= 28 * 86400e6 THEN 'ME'
      WHEN {median} >= 7 * 86400e6 THEN 'W' WHEN {median} >= 86400e6 THEN 'D' WHEN {median} >= 3600e6 THEN 'h'
      WHEN {median} >= 60e6 THEN 'min' ELSE 's' END"""


def _frequency_sql(keys: list[str], source: str) -> str:
    """``source`` gives the keys and a timestamp ``moment``."""
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""WITH src AS ({source}),
  d AS (SELECT {k}moment, epoch_us(moment) - epoch_us(lag(moment) OVER ({part}ORDER BY moment)) AS delta FROM src),
  m AS (SELECT {k}count(*) AS rows, count(DISTINCT moment) AS instants, min(moment) AS lo, max(moment) AS hi,
               quantile_cont(delta::DOUBLE, 0.5) AS med FROM d {group}),
  f AS (SELECT *, {_ladder('med')} AS frequency FROM m),
  c AS (SELECT *, CASE frequency WHEN 'h' THEN (epoch_us(hi) - epoch_us(lo)) // 3600000000 + 1
                 WHEN 'min' THEN (epoch_us(hi) - epoch_us(lo)) // 60000000 + 1
                 WHEN 's' THEN (epoch_us(hi) - epoch_us(lo)) // 1000000 + 1
                 WHEN 'D' THEN (epoch_us(hi) - epoch_us(lo)) // 86400000000 + 1 END AS calendar FROM f)
  SELECT {k}rows, instants, {rsql('med / 1e6')} AS median_seconds, frequency, calendar,
         greatest(0, calendar - instants) AS missing, {rsql('greatest(0, calendar - instants) * 100.0 / calendar')} AS missing_pct,
         rows > instants AS has_duplicates FROM c"""


def _facts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys, "rows", "instants", rounded("median_seconds").alias("median_seconds"), "frequency", "calendar", "missing",
        rounded("missing_pct").alias("missing_pct"), "has_duplicates",
    )


@query("frequency_by_type", _frequency_sql(["event_type"], "SELECT event_type, ts AS moment FROM events"))
def frequency_by_type(t: Tables) -> DataFrame:
    return _facts(series.frequencies(t.events, "ts", ["event_type"]), ["event_type"])


@query("frequency_by_user", _frequency_sql(["user_id"], "SELECT user_id, ts AS moment FROM events"))
def frequency_by_user(t: Tables) -> DataFrame:
    return _facts(series.frequencies(t.events, "ts", ["user_id"]), ["user_id"])


@query("frequency_orders", _frequency_sql([], "SELECT o_orderdate AS moment FROM orders"))
def frequency_orders(t: Tables) -> DataFrame:
    """Many orders share a day, so the median difference is zero."""
    return _facts(series.frequencies(t.orders, "o_orderdate"), [])


def _calendar_sql(key: str, source: str) -> str:
    """Calendar of each series: ``source`` gives the key and distinct days ``moment``."""
    position = """CASE WHEN ends THEN 'ME' WHEN business_ends THEN 'BME' WHEN starts THEN 'MS' WHEN business_starts THEN 'BMS' END"""
    months = "['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC']"
    days = "['MON','TUE','WED','THU','FRI','SAT','SUN']"
    return f"""WITH src AS ({source}),
  d AS (SELECT {key}, moment, isodow(moment) - 1 AS wd, day(moment) AS dom, day(last_day(moment)) - day(moment) AS rest,
        (moment::DATE - lag(moment::DATE) OVER w) AS delta, year(moment) - lag(year(moment)) OVER w AS dy,
        year(moment) * 12 + month(moment) - lag(year(moment) * 12 + month(moment)) OVER w AS dm FROM src WINDOW w AS (PARTITION BY {key} ORDER BY moment)),
  m AS (SELECT {key}, count(*) AS instants, min(moment)::DATE AS lo, max(moment)::DATE AS hi, quantile_cont(delta::DOUBLE, 0.5) AS med,
        min(delta) AS least, max(delta) AS most, count(DISTINCT dy) AS nys, min(dy) AS y, count(DISTINCT dm) AS nms, min(dm) AS mo, count(DISTINCT month(moment)) AS nm,
        bool_and(dom = 1) AS starts, bool_and(dom = 1 OR (dom <= 3 AND wd = 0)) AS business_starts, bool_and(rest = 0) AS ends,
        bool_and(rest = 0 OR (rest < 3 AND wd = 4)) AS business_ends, coalesce(bool_and((wd = 0 AND delta = 3) OR (wd BETWEEN 1 AND 4 AND delta = 1)), false) AS working,
        count(DISTINCT wd) AS nwd, count(DISTINCT CASE WHEN dom <= 28 THEN (dom - 1) // 7 END) AS nwk, min(wd) AS wd, min(CASE WHEN dom <= 28 THEN (dom - 1) // 7 END) AS wk
        FROM d GROUP BY {key}),
  p AS (SELECT *, {position} AS pos FROM m),
  c AS (SELECT *, CASE WHEN instants < 3 THEN NULL
      WHEN pos IS NOT NULL AND nys = 1 AND y >= 1 AND nm = 1 THEN CASE WHEN y > 1 THEN y::VARCHAR ELSE '' END || replace(pos, 'M', 'Y') || '-' || {months}[month(lo)]
      WHEN pos IS NOT NULL AND nms = 1 AND mo % 3 = 0 THEN CASE WHEN mo > 3 THEN (mo // 3)::VARCHAR ELSE '' END || replace(pos, 'M', 'Q') || '-' || ['DEC','OCT','NOV'][month(lo) % 3 + 1]
      WHEN pos IS NOT NULL AND nms = 1 AND mo >= 1 THEN CASE WHEN mo > 1 THEN mo::VARCHAR ELSE '' END || pos
      WHEN least = most AND least % 7 = 0 THEN CASE WHEN least > 7 THEN (least // 7)::VARCHAR ELSE '' END || 'W-' || {days}[wd + 1]
      WHEN least = most THEN CASE WHEN least > 1 THEN least::VARCHAR ELSE '' END || 'D'
      WHEN working AND least = 1 AND most = 3 THEN 'B'
      WHEN nwd = 1 AND nwk = 1 THEN 'WOM-' || (wk + 1) || {days}[wd + 1] END AS fit FROM p),
  l AS (SELECT *, {_ladder('med * 86400e6')} AS ladder FROM c),
  n AS (SELECT *, CASE WHEN fit LIKE 'WOM%' THEN (SELECT count(*) FROM generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY) g(x) WHERE isodow(x) - 1 = wd AND (day(x) - 1) // 7 = wk)
      WHEN fit IS NOT NULL THEN instants WHEN ladder = 'D' THEN hi - lo + 1
      WHEN ladder = 'W' THEN (SELECT count(*) FROM generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY) g(x) WHERE isodow(x) = 7)
      WHEN ladder = 'ME' THEN datediff('month', lo, hi) + (hi = last_day(hi))::INT
      WHEN ladder = 'YE' THEN year(hi) - year(lo) + (month(hi) = 12 AND day(hi) = 31)::INT END AS calendar FROM l)
  SELECT {key}, instants, coalesce(fit, ladder) AS code, calendar::BIGINT AS calendar, greatest(0, calendar - instants)::BIGINT AS missing FROM n"""


def _calendar(made: DataFrame, key: str) -> DataFrame:
    return series.frequencies(made, "ts", [key]).select(key, "instants", "code", "calendar", "missing")


@query(
    "frequency_business_days",
    _calendar_sql("user_id", "SELECT DISTINCT user_id, date_trunc('day', ts) - INTERVAL 1 DAY * greatest(isodow(ts) - 5, 0) AS moment FROM events"),
)
def frequency_business_days(t: Tables) -> DataFrame:
    """Users' mean values by business day, weekends added to Friday."""
    return _calendar(series.resample(t.events, "ts", "value", "B", ["user_id"]), "user_id")


@query(
    "frequency_quarters",
    _calendar_sql("o_orderpriority", "SELECT DISTINCT o_orderpriority, last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::TIMESTAMP AS moment FROM orders"),
)
def frequency_quarters(t: Tables) -> DataFrame:
    return _calendar(series.resample(t.orders, "o_orderdate", "o_totalprice", "QE-DEC", ["o_orderpriority"]), "o_orderpriority")


@query(
    "frequency_month_starts",
    _calendar_sql("o_custkey", "SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS moment FROM orders"),
)
def frequency_month_starts(t: Tables) -> DataFrame:
    """Customers' months: few have all of them, some every second or third, most no calendar."""
    return _calendar(series.resample(t.orders, "o_orderdate", "o_totalprice", "MS", ["o_custkey"]), "o_custkey")


@query(
    "missing_business_days",
    """WITH src AS (SELECT DISTINCT user_id, (date_trunc('day', ts) - INTERVAL 1 DAY * greatest(isodow(ts) - 5, 0))::DATE AS d FROM events),
  spans AS (SELECT user_id, min(d) AS lo, max(d) AS hi FROM src GROUP BY user_id)
  SELECT user_id, strftime(x, '%Y-%m-%d') AS day FROM (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS x FROM spans) p
  WHERE isodow(x) < 6 AND NOT EXISTS (SELECT 1 FROM src WHERE src.user_id = p.user_id AND src.d = p.x)""",
)
def missing_business_days(t: Tables) -> DataFrame:
    made = series.resample(t.events, "ts", "value", "B", ["user_id"])
    return series.missing_timestamps(made, "ts", "B", ["user_id"]).select("user_id", _day("day", "ts"))


@query(
    "frequency_by_customer",
    """WITH d AS (SELECT o_custkey, o_orderdate, epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate)) AS delta FROM orders),
  m AS (SELECT o_custkey, count(*) AS rows, quantile_cont(delta::DOUBLE, 0.5) AS med FROM d GROUP BY 1)
  SELECT o_custkey, rows, """
    + _ladder("med")
    + " AS frequency FROM m",
)
def frequency_by_customer(t: Tables) -> DataFrame:
    return series.frequencies(t.orders, "o_orderdate", ["o_custkey"]).select("o_custkey", "rows", "frequency")


@query(
    "missing_days",
    """WITH s AS (SELECT o_orderpriority AS p, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1),
  c AS (SELECT p, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM s)
  SELECT p AS o_orderpriority, strftime(d, '%Y-%m-%d') AS day FROM c
  WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = p AND o_orderdate = d)""",
)
def missing_days(t: Tables) -> DataFrame:
    return series.missing_timestamps(t.orders, "o_orderdate", "D", ["o_orderpriority"]).select(
        "o_orderpriority", _day("day", "ts")
    )


@query(
    "missing_sundays",
    """WITH s AS (SELECT o_custkey AS k, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1),
  c AS (SELECT k, unnest(generate_series(lo + to_days(CAST((7 - dayofweek(lo)) % 7 AS INTEGER)), hi, INTERVAL 7 DAY)) AS d FROM s)
  SELECT k AS o_custkey, strftime(d, '%Y-%m-%d') AS day FROM c
  WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = k AND o_orderdate = d)""",
)
def missing_sundays(t: Tables) -> DataFrame:
    return series.missing_timestamps(t.orders, "o_orderdate", "W", ["o_custkey"]).select("o_custkey", _day("day", "ts"))


@query(
    "missing_month_ends",
    """WITH s AS (SELECT o_custkey AS k, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1),
  c AS (SELECT k, hi, last_day(m)::TIMESTAMP AS d FROM (SELECT k, hi, unnest(generate_series(date_trunc('month', lo)::TIMESTAMP, hi, INTERVAL 1 MONTH)) AS m FROM s))
  SELECT k AS o_custkey, strftime(d, '%Y-%m-%d') AS day FROM c
  WHERE d <= hi AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = k AND o_orderdate = d)""",
)
def missing_month_ends(t: Tables) -> DataFrame:
    return series.missing_timestamps(t.orders, "o_orderdate", "ME", ["o_custkey"]).select("o_custkey", _day("day", "ts"))


@query(
    "detect_series",
    """SELECT event_type, count(*) AS rows, true AS is_feasible, 'ts' AS datetime_column,
       'event_id,user_id,value' AS target_candidates, 'value' AS suggested_target FROM events GROUP BY event_type HAVING count(*) >= 10""",
)
def detect_series(t: Tables) -> DataFrame:
    found = series.detect_series(t.events, ["event_type"])
    return found.select(
        "event_type", "rows", "is_feasible", "datetime_column",
        F.array_join("target_candidates", ",").alias("target_candidates"), "suggested_target",
    )


@query(
    "detect_without_dates",
    """SELECT p_type, count(*) AS rows, false AS is_feasible,
       CASE WHEN count(*) < 10 THEN 'Fewer than 10 rows are too short to forecast.'
            ELSE 'No column holds dates.' END AS warning FROM part GROUP BY p_type""",
)
def detect_without_dates(t: Tables) -> DataFrame:
    found = series.detect_series(t.part, ["p_type"])
    return found.select("p_type", "rows", "is_feasible", F.array_join("warnings", "|").alias("warning"))


@query("resample_daily", f"WITH {_DAILY} SELECT event_type, strftime(day, '%Y-%m-%d') AS day, {rsql('y')} AS y FROM daily")
def resample_daily(t: Tables) -> DataFrame:
    return daily(t).select("event_type", _day("day", "ts"), rounded("y").alias("y"))


@query(
    "resample_weekly",
    f"""SELECT o_orderpriority, strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS day, {rsql('avg(o_totalprice)')} AS y
        FROM orders GROUP BY 1, 2""",
)
def resample_weekly(t: Tables) -> DataFrame:
    made = series.resample(t.orders, "o_orderdate", "o_totalprice", "W", ["o_orderpriority"])
    return made.select("o_orderpriority", _day("day", "ts"), rounded("y").alias("y"))


@query(
    "resample_monthly",
    f"""SELECT o_orderpriority, strftime(last_day(o_orderdate), '%Y-%m-%d') AS day, {rsql('avg(o_totalprice)')} AS y
        FROM orders GROUP BY 1, 2""",
)
def resample_monthly(t: Tables) -> DataFrame:
    made = series.resample(t.orders, "o_orderdate", "o_totalprice", "ME", ["o_orderpriority"])
    return made.select("o_orderpriority", _day("day", "ts"), rounded("y").alias("y"))


@query(
    "trend",
    f"""WITH {_DAILY} SELECT event_type, strftime(day, '%Y-%m-%d') AS day,
        {rsql('avg(y) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)')} AS trend FROM daily""",
)
def trend(t: Tables) -> DataFrame:
    return series.trend(daily(t), "y", ["ts"], ["event_type"]).select(
        "event_type", _day("day", "ts"), rounded("trend").alias("trend")
    )


@query(
    "trend_events",
    f"""SELECT event_id, {rsql('avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)')} AS trend FROM events""",
)
def trend_events(t: Tables) -> DataFrame:
    """Over the raw rows, no key: numbered chunks with borrowed rows, no task holding the whole table."""
    return series.trend(t.events.select("event_id", "ts", "value"), "value", ["ts", "event_id"], task_rows=0).select(
        "event_id", rounded("trend").alias("trend")
    )


@query(
    "chronological_split",
    """WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position,
                         count(*) OVER (PARTITION BY user_id) AS n FROM events),
  s AS (SELECT *, CASE WHEN floor(n * 0.8) < 5 THEN greatest(1, n - 2) ELSE floor(n * 0.8) END AS cut FROM r)
  SELECT event_id, user_id, position, position <= cut AS is_train FROM s""",
)
def chronological_split(t: Tables) -> DataFrame:
    return series.chronological_split(t.events, ["ts", "event_id"], ["user_id"]).select(
        "event_id", "user_id", "position", "is_train"
    )


@query(
    "chronological_split_all",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position, count(*) OVER () AS n FROM events)
  SELECT event_id, position, position <= CASE WHEN floor(n * 0.8) < 5 THEN greatest(1, n - 2) ELSE floor(n * 0.8) END AS is_train FROM r""",
)
def chronological_split_all(t: Tables) -> DataFrame:
    return series.chronological_split(t.events, ["ts", "event_id"], task_rows=0).select("event_id", "position", "is_train")


def naive_predictions(t: Tables) -> DataFrame:
    """The value of the day before as the prediction; one row per day and type."""
    before = W.partitionBy("event_type").orderBy("ts")
    return daily(t).withColumn("predicted", F.lag("y").over(before))


@query(
    "forecast_metrics",
    f"""WITH {_DAILY}, p AS (SELECT event_type, y, lag(y) OVER (PARTITION BY event_type ORDER BY day) AS q FROM daily)
  SELECT event_type, {rsql('avg(abs(y - q))')} AS mae, {rsql('sqrt(avg((y - q) * (y - q)))')} AS rmse,
         {rsql('coalesce(avg(abs((y - q) / y)) FILTER (y <> 0) * 100, 0)')} AS mape,
         {rsql('coalesce(avg(2 * abs(y - q) / (abs(y) + abs(q))) FILTER (y <> 0) * 100, 0)')} AS smape
  FROM p WHERE q IS NOT NULL GROUP BY event_type""",
)
def forecast_metrics(t: Tables) -> DataFrame:
    made = series.forecast_metrics(naive_predictions(t), "y", "predicted", ["event_type"])
    return made.select("event_type", *[rounded(c).alias(c) for c in ("mae", "rmse", "mape", "smape")])


@query(
    "future_days",
    """SELECT user_id, step, strftime(max(ts) + to_days(step::INTEGER), '%Y-%m-%d %H:%M:%S.%f') AS at
       FROM events, (SELECT unnest(range(1, 15)) AS step) GROUP BY user_id, step""",
)
def future_days(t: Tables) -> DataFrame:
    made = series.future_calendar(t.events, "ts", "D", 14, ["user_id"])
    return made.select("user_id", "step", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query(
    "future_month_ends",
    """WITH s AS (SELECT o_custkey, max(o_orderdate) AS hi FROM orders GROUP BY 1),
  k AS (SELECT o_custkey, step, last_day((date_trunc('month', hi) + to_months((step - CASE WHEN last_day(hi) = hi::DATE THEN 0 ELSE 1 END)::INTEGER))::DATE) AS d
        FROM s, (SELECT unnest(range(1, 7)) AS step))
  SELECT o_custkey, step, strftime(d, '%Y-%m-%d') AS day FROM k""",
)
def future_month_ends(t: Tables) -> DataFrame:
    made = series.future_calendar(t.orders, "o_orderdate", "ME", 6, ["o_custkey"])
    return made.select("o_custkey", "step", _day("day", "ts"))


def _forecast(t: Tables, algorithm: str) -> DataFrame:
    return forecast.forecast(t.events, "ts", "value", ["user_id"], algorithm, horizon=14, period=7)


@query("forecast_holt_winters")
def forecast_holt_winters(t: Tables) -> DataFrame:
    return _forecast(t, "holt_winters")


@query("forecast_arima")
def forecast_arima(t: Tables) -> DataFrame:
    return _forecast(t, "arima")


@query("forecast_sarima")
def forecast_sarima(t: Tables) -> DataFrame:
    return _forecast(t, "sarima")


@query("forecast_monthly")
def forecast_monthly(t: Tables) -> DataFrame:
    return forecast.forecast(t.orders, "o_orderdate", "o_totalprice", ["o_orderpriority"], "holt_winters", 6, period=12, frequency="ME")


@query("forecast_by_priority")
def forecast_by_priority(t: Tables) -> DataFrame:
    """Weekly prices: a series has a row per week, whatever its orders."""
    return forecast.forecast(t.orders, "o_orderdate", "o_totalprice", ["o_orderpriority"], "arima", 5, frequency="W")


@query("forecast_errors")
def forecast_errors(t: Tables) -> DataFrame:
    return forecast.holdout_metrics(_forecast(t, "holt_winters"), ["user_id"])


@query(
    "residual_rows",
    f"""WITH {_DAILY}, r AS (SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY event_type) AS n,
        lag(y) OVER w AS q FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day))
  SELECT event_type, strftime(day, '%Y-%m-%d') AS day, {rsql('y')} AS actual, {rsql('q')} AS predicted, {rsql('y - q')} AS residual
  FROM r WHERE position > CASE WHEN floor(n * 0.8) < 5 THEN greatest(1, n - 2) ELSE floor(n * 0.8) END""",
)
def residual_rows(t: Tables) -> DataFrame:
    parted = series.chronological_split(naive_predictions(t), ["ts"], ["event_type"]).where(~F.col("is_train"))
    return parted.select(
        "event_type", _day("day", "ts"), rounded("y").alias("actual"), rounded("predicted").alias("predicted"),
        rounded(F.col("y") - F.col("predicted")).alias("residual"),
    )
