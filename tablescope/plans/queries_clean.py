"""Cleaning steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import clean
from ..sources.tables import Tables
from .registry import query
from .shared import EVENTS_WITH_GAPS, VISITS, events_with_gaps, rounded, rsql, visits
from .steps import apply_steps, undo

_GAPPY = f"WITH {EVENTS_WITH_GAPS}"


def _values(df: DataFrame) -> DataFrame:
    return df.select("event_id", rounded("value").alias("value"))


@query(
    "impute_mean",
    f"{_GAPPY} SELECT event_id, {rsql('coalesce(value, (SELECT avg(value) FROM gappy))')} AS value FROM gappy",
)
def impute_mean(t: Tables) -> DataFrame:
    return _values(clean.impute(events_with_gaps(t), "value", "mean"))


@query(
    "impute_median",
    f"{_GAPPY} SELECT event_id, {rsql('coalesce(value, (SELECT quantile_cont(value, 0.5) FROM gappy))')} AS value FROM gappy",
)
def impute_median(t: Tables) -> DataFrame:
    return _values(clean.impute(events_with_gaps(t), "value", "median"))


@query(
    "impute_mode",
    f"""{_GAPPY} SELECT event_id, coalesce(value, (SELECT value FROM gappy WHERE value IS NOT NULL
        GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)) AS value FROM gappy""",
)
def impute_mode(t: Tables) -> DataFrame:
    return clean.impute(events_with_gaps(t), "value", "mode").select("event_id", "value")


@query("impute_constant", f"{_GAPPY} SELECT event_id, coalesce(value, -1) AS value FROM gappy")
def impute_constant(t: Tables) -> DataFrame:
    return clean.impute(events_with_gaps(t), "value", "val", -1).select("event_id", "value")


@query(
    "forward_fill_by_user",
    f"""{_GAPPY} SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM gappy""",
)
def forward_fill_by_user(t: Tables) -> DataFrame:
    filled = clean.impute(events_with_gaps(t), "value", "ffill", order_by=["ts", "event_id"], partition_by=["user_id"])
    return filled.select("event_id", "value")


@query(
    "backward_fill_by_user",
    f"""{_GAPPY} SELECT event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM gappy""",
)
def backward_fill_by_user(t: Tables) -> DataFrame:
    filled = clean.impute(events_with_gaps(t), "value", "bfill", order_by=["ts", "event_id"], partition_by=["user_id"])
    return filled.select("event_id", "value")


@query(
    "forward_fill",
    f"""{_GAPPY} SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM gappy""",
)
def forward_fill(t: Tables) -> DataFrame:
    """No key: always in blocks, so that no task sees the whole table."""
    filled = clean.impute(events_with_gaps(t), "value", "ffill", order_by=["event_id"], task_rows=0)
    return filled.select("event_id", "value")


@query(
    "backward_fill",
    f"""{_GAPPY} SELECT event_id, first_value(value IGNORE NULLS) OVER (ORDER BY event_id
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM gappy""",
)
def backward_fill(t: Tables) -> DataFrame:
    filled = clean.impute(events_with_gaps(t), "value", "bfill", order_by=["event_id"], task_rows=0)
    return filled.select("event_id", "value")


@query("drop_missing_rows", f"{_GAPPY} SELECT event_id, user_id, value FROM gappy WHERE value IS NOT NULL")
def drop_missing_rows(t: Tables) -> DataFrame:
    return clean.drop_missing(events_with_gaps(t), "value").select("event_id", "user_id", "value")


@query(
    "drop_missing_any",
    f"WITH {VISITS} SELECT * FROM visits WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL",
)
def drop_missing_any(t: Tables) -> DataFrame:
    return clean.drop_missing(visits(t))


@query("drop_column", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def drop_column(t: Tables) -> DataFrame:
    return clean.drop_column(t.supplier, "s_nationkey")


@query("remove_duplicates", f"WITH {VISITS} SELECT DISTINCT user_id, event_type, value FROM visits")
def remove_duplicates(t: Tables) -> DataFrame:
    return clean.remove_duplicates(visits(t))


@query("filter_range", f"{_GAPPY} SELECT event_id, value FROM gappy WHERE value IS NULL OR value BETWEEN 10 AND 80")
def filter_range(t: Tables) -> DataFrame:
    return clean.filter_range(events_with_gaps(t), "value", 10, 80).select("event_id", "value")


_FENCES = "fences AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM gappy)"
_SPREAD = "spread AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM gappy)"


@query(
    "outlier_iqr_drop",
    f"""{_GAPPY}, {_FENCES} SELECT event_id, value FROM gappy, fences
        WHERE value IS NULL OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
)
def outlier_iqr_drop(t: Tables) -> DataFrame:
    return clean.handle_outliers(events_with_gaps(t), "value", "iqr", "drop", 1.5).select("event_id", "value")


@query(
    "outlier_iqr_cap",
    f"""{_GAPPY}, {_FENCES} SELECT event_id, CASE WHEN value IS NOT NULL THEN
        {rsql('least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1))')} END AS value FROM gappy, fences""",
)
def outlier_iqr_cap(t: Tables) -> DataFrame:
    return _values(clean.handle_outliers(events_with_gaps(t), "value", "iqr", "cap", 1.5))


@query(
    "outlier_iqr_default",
    """WITH fences AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
       SELECT count(*) AS kept, count(DISTINCT l_orderkey) AS orders FROM lineitem, fences
       WHERE l_extendedprice IS NULL OR l_extendedprice BETWEEN q1 - 3.0 * (q3 - q1) AND q3 + 3.0 * (q3 - q1)""",
)
def outlier_iqr_default(t: Tables) -> DataFrame:
    kept = clean.handle_outliers(t.lineitem, "l_extendedprice")
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.count_distinct("l_orderkey").alias("orders"))


@query(
    "outlier_zscore_drop",
    f"{_GAPPY}, {_SPREAD} SELECT event_id, value FROM gappy, spread WHERE value IS NULL OR s = 0 OR abs((value - m) / s) <= 2",
)
def outlier_zscore_drop(t: Tables) -> DataFrame:
    return clean.handle_outliers(events_with_gaps(t), "value", "zscore", "drop", 2.0).select("event_id", "value")


@query(
    "outlier_zscore_cap",
    f"""{_GAPPY}, {_SPREAD} SELECT event_id, CASE WHEN value IS NOT NULL THEN
        {rsql('least(greatest(value, m - 2 * s), m + 2 * s)')} END AS value FROM gappy, spread""",
)
def outlier_zscore_cap(t: Tables) -> DataFrame:
    return _values(clean.handle_outliers(events_with_gaps(t), "value", "zscore", "cap", 2.0))


@query(
    "label_encode",
    """WITH first AS (SELECT o_orderpriority AS v, min(o_orderkey) AS k FROM orders GROUP BY 1),
       codes AS (SELECT v, row_number() OVER (ORDER BY k) - 1 AS code FROM first)
       SELECT o_orderkey, coalesce(code, -1) AS o_orderpriority FROM orders LEFT JOIN codes ON v = o_orderpriority""",
)
def label_encode(t: Tables) -> DataFrame:
    coded = clean.encode(t.orders, "o_orderpriority", "label", order_by=["o_orderkey"])
    return coded.select("o_orderkey", "o_orderpriority")


@query(
    "label_encode_missing",
    f"""{_GAPPY}, first AS (SELECT value AS v, min(event_id) AS k FROM gappy WHERE value IS NOT NULL GROUP BY 1),
       codes AS (SELECT v, row_number() OVER (ORDER BY k) - 1 AS code FROM first)
       SELECT event_id, coalesce(code, -1) AS value FROM gappy LEFT JOIN codes ON v = value""",
)
def label_encode_missing(t: Tables) -> DataFrame:
    """Thousands of values, and missing cells coded -1."""
    return clean.encode(events_with_gaps(t), "value", "label", order_by=["event_id"]).select("event_id", "value")


@query(
    "one_hot_encode",
    "SELECT event_id, "
    + ", ".join(
        f"(event_type = '{v}')::INT::BIGINT AS event_type_{v}" for v in ("click", "error", "purchase", "signup", "view")
    )
    + " FROM events",
)
def one_hot_encode(t: Tables) -> DataFrame:
    return clean.encode(t.events.select("event_id", "event_type"), "event_type", "onehot")


@query(
    "ordinal_encode",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END::BIGINT AS o_orderstatus FROM orders""",
)
def ordinal_encode(t: Tables) -> DataFrame:
    return clean.encode(t.orders, "o_orderstatus", "ordinal", ["F", "O"]).select("o_orderkey", "o_orderstatus")


@query(
    "scale_standard",
    f"""{_GAPPY}, {_SPREAD} SELECT event_id, CASE WHEN s > 0 THEN {rsql('(value - m) / s', 6)} ELSE value END AS value
        FROM gappy, spread""",
)
def scale_standard(t: Tables) -> DataFrame:
    return clean.scale(events_with_gaps(t), "value", "standard").select("event_id", rounded("value", 6).alias("value"))


@query(
    "scale_minmax",
    f"""{_GAPPY}, ends AS (SELECT min(value) AS lo, max(value) AS hi FROM gappy)
        SELECT event_id, CASE WHEN hi > lo THEN {rsql('(value - lo) / (hi - lo)', 6)} ELSE value END AS value FROM gappy, ends""",
)
def scale_minmax(t: Tables) -> DataFrame:
    return clean.scale(events_with_gaps(t), "value", "minmax").select("event_id", rounded("value", 6).alias("value"))


@query(
    "scale_robust",
    f"""{_GAPPY}, {_FENCES}, mid AS (SELECT quantile_cont(value, 0.5) AS q2 FROM gappy)
        SELECT event_id, CASE WHEN q3 > q1 THEN {rsql('(value - q2) / (q3 - q1)', 6)} ELSE value END AS value
        FROM gappy, fences, mid""",
)
def scale_robust(t: Tables) -> DataFrame:
    return clean.scale(events_with_gaps(t), "value", "robust").select("event_id", rounded("value", 6).alias("value"))


STEPS = [
    {"opType": "impute_missing", "params": {"column": "value", "strategy": "median"}},
    {"opType": "handle_outliers", "params": {"column": "value", "method": "iqr", "action": "cap", "threshold": 1.5}},
    {"opType": "scale_column", "params": {"column": "value", "method": "minmax"}},
    {"opType": "encode_column", "params": {"column": "event_type", "method": "ordinal", "order": ["view", "click", "purchase"]}},
    {"opType": "drop_column", "params": {"column": "props"}},
]

_REPLAY = f"""{_GAPPY},
  a AS (SELECT event_id, event_type, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM gappy)) AS value FROM gappy),
  f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM a),
  b AS (SELECT event_id, event_type, least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS value FROM a, f)"""


@query(
    "clean_replay",
    f"""{_REPLAY}, e AS (SELECT min(value) AS lo, max(value) AS hi FROM b)
  SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END::BIGINT AS event_type,
         {rsql('(value - lo) / (hi - lo)', 6)} AS value FROM b, e""",
)
def clean_replay(t: Tables) -> DataFrame:
    done = apply_steps(events_with_gaps(t), STEPS)
    return done.select("event_id", "event_type", rounded("value", 6).alias("value"))


@query("clean_undo", f"{_REPLAY} SELECT event_id, event_type, {rsql('value', 6)} AS value FROM b")
def clean_undo(t: Tables) -> DataFrame:
    """Three steps taken back one after another."""
    raw, steps = events_with_gaps(t), STEPS
    for _ in range(3):
        done, steps = undo(raw, steps)
    return done.select("event_id", "event_type", rounded("value", 6).alias("value"))
