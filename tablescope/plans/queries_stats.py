"""Descriptive statistics and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluate, stats
from ..sources.tables import Tables
from .registry import query
from .shared import EVENTS_WITH_GAPS, events_with_gaps, rounded, rsql

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(table: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS n, {rsql(f'avg({c})')} AS mean, "
            f"{rsql(f'quantile_cont({c}, 0.5)')} AS median, "
            f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, "
            f"{rsql(f'var_samp({c})', 2)} AS variance, {rsql(f'stddev_samp({c})')} AS std, min({c}) AS min, max({c}) AS max, "
            f"{rsql(f'max({c}) - min({c})')} AS range, {rsql(f'quantile_cont({c}, 0.25)')} AS q25, "
            f"{rsql(f'quantile_cont({c}, 0.5)')} AS q50, {rsql(f'quantile_cont({c}, 0.75)')} AS q75, "
            f"{rsql(f'skewness({c})')} AS skewness, {rsql(f'kurtosis({c})')} AS kurtosis FROM {table}"
        )
    return " UNION ALL ".join(parts)


def _tidy(df: DataFrame) -> DataFrame:
    digits = {"variance": 2}
    done = [c for c in df.columns if c not in ("column", "n", "mode", "min", "max", "distinct_count")]
    return df.drop("distinct_count").withColumns({c: rounded(c, digits.get(c, 4)) for c in done})


@query("describe_numeric", _describe_sql("lineitem", _MEASURES))
def describe_numeric(t: Tables) -> DataFrame:
    return _tidy(stats.describe_numeric(t.lineitem, _MEASURES))


@query("describe_missing", f"WITH {EVENTS_WITH_GAPS} " + _describe_sql("gappy", ["value"]))
def describe_missing(t: Tables) -> DataFrame:
    return _tidy(stats.describe_numeric(events_with_gaps(t), ["value"]))


@query(
    "describe_categorical",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_values,
            {rsql(f'count(DISTINCT {c}) * 1.0 / count(*)', 8)} AS cardinality_ratio,
            (SELECT {c} FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_category,
            (SELECT count(*) FROM orders GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS top_category_count FROM orders"""
        for c in ("o_orderpriority", "o_orderstatus")
    ),
)
def describe_categorical(t: Tables) -> DataFrame:
    out = stats.describe_categorical(t.orders, ["o_orderpriority", "o_orderstatus"])
    return out.withColumn("cardinality_ratio", rounded("cardinality_ratio", 8))


@query(
    "frequencies",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM part GROUP BY 2" for c in ("p_brand", "p_type", "p_name")
    ),
)
def frequencies(t: Tables) -> DataFrame:
    return stats.frequencies(t.part, ["p_brand", "p_type", "p_name"])


def _matrix_sql(prefix: str, table: str, columns: dict[str, str]) -> str:
    return prefix + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {rsql(f'corr({x}, {y})', 6)} AS coefficient FROM {table}"
        for a, x in columns.items()
        for b, y in columns.items()
    )


@query("pearson", _matrix_sql("", "lineitem", {c: c for c in _MEASURES}))
def pearson(t: Tables) -> DataFrame:
    return stats.pearson(t.lineitem, _MEASURES).withColumn("coefficient", rounded("coefficient", 6))


@query(
    "pearson_listwise",
    _matrix_sql(
        f"WITH {EVENTS_WITH_GAPS}, whole AS (SELECT event_id, user_id, value FROM gappy WHERE value IS NOT NULL) ",
        "whole",
        {"event_id": "event_id", "user_id": "user_id", "value": "value"},
    ),
)
def pearson_listwise(t: Tables) -> DataFrame:
    out = stats.pearson(events_with_gaps(t), ["event_id", "user_id", "value"])
    return out.withColumn("coefficient", rounded("coefficient", 6))


_RANKS = "WITH ranks AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in _MEASURES
) + " FROM lineitem) "


@query("spearman", _matrix_sql(_RANKS, "ranks", {c: f"r_{c}" for c in _MEASURES}))
def spearman(t: Tables) -> DataFrame:
    return stats.spearman(t.lineitem, _MEASURES).withColumn("coefficient", rounded("coefficient", 6))


_FIXED = ["l_quantity", "l_extendedprice", "fixed"]
_GONE = 'WITH held AS (SELECT l_quantity, l_extendedprice, 5::DOUBLE AS fixed FROM lineitem) '


def _varied_sql(prefix: str, table: str, columns: dict[str, str]) -> str:
    """As above, null where a column does not vary; one pass for any number of columns."""
    cells = ", ".join(
        f"{{'column_a': '{a}', 'column_b': '{b}', 'coefficient': {rsql(f'covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)', 6)}}}"
        for a, x in columns.items()
        for b, y in columns.items()
    )
    return f"{prefix} SELECT p.* FROM (SELECT unnest([{cells}]) AS p FROM {table})"


def _with_constant(t: Tables) -> DataFrame:
    return t.lineitem.select("l_quantity", "l_extendedprice", F.lit(5.0).alias("fixed"))


@query("pearson_constant", _varied_sql(_GONE, "held", {c: c for c in _FIXED}))
def pearson_constant(t: Tables) -> DataFrame:
    return stats.pearson(_with_constant(t)).withColumn("coefficient", rounded("coefficient", 6))


@query(
    "spearman_constant",
    _varied_sql(
        _GONE + ", ranks AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in _FIXED) + " FROM held)",
        "ranks",
        {c: f"r_{c}" for c in _FIXED},
    ),
)
def spearman_constant(t: Tables) -> DataFrame:
    return stats.spearman(_with_constant(t)).withColumn("coefficient", rounded("coefficient", 6))


_WIDE = {f"w{k}": f"(l_quantity * {k % 7 + 1} + l_extendedprice * {k / 1000} + l_linenumber * {k * k % 11})" for k in range(39)}


@query(
    "pearson_wide",
    _varied_sql(
        "WITH wide AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _WIDE.items()) + ", 1::DOUBLE AS fixed FROM lineitem)", "wide", {c: c for c in [*_WIDE, "fixed"]}
    ),
)
def pearson_wide(t: Tables) -> DataFrame:
    wide = t.lineitem.select(*[F.expr(e).alias(c) for c, e in _WIDE.items()], F.lit(1.0).alias("fixed"))
    return stats.pearson(wide).withColumn("coefficient", rounded("coefficient", 6))


@query(
    "average_ranks",
    """SELECT 'o_totalprice' AS "column", o_totalprice AS value, count(*) AS n,
       (SELECT count(*) FROM orders i WHERE i.o_totalprice < o.o_totalprice) + (count(*) + 1) / 2.0::DOUBLE AS rank
       FROM orders o GROUP BY o_totalprice
       UNION ALL
       SELECT 'o_custkey', o_custkey::DOUBLE, count(*),
       (SELECT count(*) FROM orders i WHERE i.o_custkey < o.o_custkey) + (count(*) + 1) / 2.0::DOUBLE FROM orders o GROUP BY o_custkey""",
)
def average_ranks(t: Tables) -> DataFrame:
    return stats.average_ranks(t.orders, ["o_totalprice", "o_custkey"])


@query(
    "daily_mean",
    f"""SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, {rsql('avg(o_totalprice)')} AS value FROM orders GROUP BY 1""",
)
def daily_mean(t: Tables) -> DataFrame:
    return stats.daily_mean(t.orders, "o_orderdate", "o_totalprice").withColumn("value", rounded("value"))


@query("cluster_sizes", "SELECT label AS cluster, count(*) AS count FROM embeddings GROUP BY 1")
def cluster_sizes(t: Tables) -> DataFrame:
    return evaluate.cluster_sizes(t.embeddings, "label")
