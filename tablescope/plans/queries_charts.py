"""Chart aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import charts, sampling
from ..sources.tables import Tables
from .registry import query
from .shared import EVENTS_WITH_GAPS, events_with_gaps, rounded, rsql


def histogram_sql(source: str, bins: int) -> str:
    """``source`` is a query giving column x."""
    return f"""WITH v AS ({source}), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
      w AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM e),
      g AS (SELECT x, least(floor((x - lo) * {bins} / (hi - lo))::BIGINT, {bins - 1}) AS g FROM v, w WHERE x IS NOT NULL),
      s AS (SELECT CASE WHEN x < lo + g * ((hi - lo) / {bins}) THEN g - 1
                        WHEN g < {bins - 1} AND x >= lo + (g + 1) * ((hi - lo) / {bins}) THEN g + 1 ELSE g END AS bin FROM g, w),
      c AS (SELECT bin, count(*) AS n FROM s GROUP BY bin)
      SELECT b.bin, {rsql(f'lo + b.bin * ((hi - lo) / {bins})')} AS low,
             {rsql(f'CASE WHEN b.bin = {bins - 1} THEN hi ELSE lo + (b.bin + 1) * ((hi - lo) / {bins}) END')} AS high,
             coalesce(n, 0)::BIGINT AS count
      FROM (SELECT unnest(range({bins})) AS bin) b LEFT JOIN c ON b.bin = c.bin, w"""


def _bins(df: DataFrame) -> DataFrame:
    return df.select("bin", rounded("low").alias("low"), rounded("high").alias("high"), "count")


@query("histogram", histogram_sql("SELECT l_extendedprice AS x FROM lineitem", 10))
def histogram(t: Tables) -> DataFrame:
    return _bins(charts.histogram(t.lineitem, "l_extendedprice"))


@query("histogram_missing", histogram_sql(f"WITH {EVENTS_WITH_GAPS} SELECT value AS x FROM gappy", 25))
def histogram_missing(t: Tables) -> DataFrame:
    return _bins(charts.histogram(events_with_gaps(t), "value", 25))


@query("histogram_integers", histogram_sql("SELECT p_size::DOUBLE AS x FROM part", 7))
def histogram_integers(t: Tables) -> DataFrame:
    return _bins(charts.histogram(t.part, "p_size", 7))


_BOX = f"""q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM gappy),
  f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


@query(
    "box_plot",
    f"""WITH {EVENTS_WITH_GAPS}, {_BOX}
      SELECT min(value) FILTER (value BETWEEN lo AND hi) AS min, {rsql('any_value(q1)')} AS q1, {rsql('any_value(q2)')} AS median,
             {rsql('any_value(q3)')} AS q3, max(value) FILTER (value BETWEEN lo AND hi) AS max,
             count(*) FILTER (value < lo OR value > hi) AS outlier_count FROM gappy, f""",
)
def box_plot(t: Tables) -> DataFrame:
    out = charts.box_plot(events_with_gaps(t), "value")
    return out.withColumns({c: rounded(c) for c in ("q1", "median", "q3")})


@query(
    "outliers_all",
    f"WITH {EVENTS_WITH_GAPS}, {_BOX} SELECT event_id, value FROM gappy, f WHERE value < lo OR value > hi",
)
def outliers_all(t: Tables) -> DataFrame:
    return charts.outliers(events_with_gaps(t), "value", ["event_id"], points=None)


@query("outliers_sample")
def outliers_sample(t: Tables) -> DataFrame:
    return charts.outliers(t.events, "value", ["event_id"])


@query("scatter_sample")
def scatter_sample(t: Tables) -> DataFrame:
    return charts.scatter(t.lineitem, "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("sample_size", "SELECT least(500, count(*)) AS n, least(500, count(*)) AS distinct_n FROM orders")
def sample_size(t: Tables) -> DataFrame:
    """A seeded sample has exactly the wanted number of different rows."""
    rows = sampling.sample_rows(t.orders, 500, ["o_orderkey"])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("distinct_n"))


@query(
    "pie",
    f"""WITH c AS (SELECT p_name AS name, count(*) AS value FROM part GROUP BY 1),
      r AS (SELECT *, row_number() OVER (ORDER BY value DESC, name) AS rn, sum(value) OVER () AS total FROM c)
      SELECT CASE WHEN rn <= 5 THEN name ELSE 'Other' END AS name, sum(value)::BIGINT AS value,
             {rsql('sum(value) * 100.0 / any_value(total)')} AS percentage, rn > 5 AS is_rest
      FROM r GROUP BY 1, 4""",
)
def pie(t: Tables) -> DataFrame:
    return charts.pie(t.part, "p_name").withColumn("percentage", rounded("percentage"))


@query("bar", "SELECT p_brand AS category, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def bar(t: Tables) -> DataFrame:
    return charts.bar(t.part, "p_brand")


@query(
    "line",
    f"""WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, avg(o_totalprice) AS value FROM orders GROUP BY 1),
      r AS (SELECT *, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM d)
      SELECT date, {rsql('value')} AS value FROM r
      WHERE (rn - 1) % (CASE WHEN n > 100 THEN floor(n / 100.0)::BIGINT ELSE 1 END) = 0""",
)
def line(t: Tables) -> DataFrame:
    return charts.line(t.orders, "o_orderdate", "o_totalprice").withColumn("value", rounded("value"))


@query("line_unparsable", "SELECT NULL::VARCHAR AS date, NULL::DOUBLE AS value WHERE false")
def line_unparsable(t: Tables) -> DataFrame:
    """A text column that is no date gives no line."""
    return charts.line(t.events, "props", "value")


def scored_lines(t: Tables) -> DataFrame:
    """Prices with a crude prediction: 2000 per unit, discounted."""
    guess = F.col("l_quantity") * 2000 * (1 - F.col("l_discount"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("actual"), guess.alias("predicted")
    )


SCORED_LINES = """scored AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS actual,
  l_quantity * 2000 * (1 - l_discount) AS predicted FROM lineitem)"""


@query("residual_histogram", histogram_sql(f"WITH {SCORED_LINES} SELECT actual - predicted AS x FROM scored", 15))
def residual_histogram(t: Tables) -> DataFrame:
    return _bins(charts.residual_histogram(scored_lines(t), "actual", "predicted"))


@query("residual_points")
def residual_points(t: Tables) -> DataFrame:
    return charts.residual_points(scored_lines(t), "actual", "predicted", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def judged_documents(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")


@query(
    "roc_curve",
    f"""WITH s AS (SELECT quality, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id)),
      g AS (SELECT score, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM s GROUP BY 1),
      r AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, row_number() OVER w AS spot,
                   lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, sum(pos) OVER () AS p, sum(neg) OVER () AS n
            FROM g WINDOW w AS (ORDER BY score DESC)),
      k AS (SELECT spot, tp, fp, p, n FROM r WHERE spot = 1 OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg
            UNION ALL SELECT 0, 0, 0, max(p), max(n) FROM r),
      o AS (SELECT *, row_number() OVER (ORDER BY spot) AS position, count(*) OVER () AS m FROM k)
      SELECT position, {rsql('fp / n', 8)} AS fpr, {rsql('tp / p', 8)} AS tpr FROM o
      WHERE (position - 1) % (CASE WHEN m > 100 THEN floor(m / 100.0)::BIGINT ELSE 1 END) = 0
      UNION ALL SELECT max(m) + 1, 1.0, 1.0 FROM o""",
)
def roc_curve(t: Tables) -> DataFrame:
    out = charts.roc_curve(judged_documents(t), "quality", "n_chars")
    return out.select("position", rounded("fpr", 8).alias("fpr"), rounded("tpr", 8).alias("tpr"))
