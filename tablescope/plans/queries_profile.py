"""Scans, kinds, profile."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import clean, kinds, lookups, profile, stats
from ..operators.blocks import shared_folder
from ..functions.columns import finite
from ..sources.tables import Tables, read_table, write_table
from .registry import query
from .shared import CHARGES, EVENTS_WITH_GAPS, VISITS, charges, events_with_gaps, rounded, rsql, visits


@query("scan_customer", "SELECT * FROM customer")
def scan_customer(t: Tables) -> DataFrame:
    return read_table(t.spark, f"{t.folder}/customer.parquet")


# Types of the lineitem columns: (name, Spark type, kind, numeric)
_LINEITEM = [
    ("l_orderkey", "bigint", True), ("l_partkey", "bigint", True), ("l_suppkey", "bigint", True),
    ("l_linenumber", "int", True), ("l_quantity", "double", True), ("l_extendedprice", "double", True),
    ("l_discount", "double", True), ("l_tax", "double", True), ("l_returnflag", "string", False),
    ("l_linestatus", "string", False), ("l_shipdate", "timestamp_ntz", False),
]


def _profile_row(position: int, name: str, dtype: str, numeric: bool) -> str:
    few = f"count(DISTINCT {name}) < 20 OR count(DISTINCT {name}) < 0.05 * count(*)"
    if numeric:
        kind = f"CASE WHEN min({name}) = 0 AND max({name}) = 1 AND count(DISTINCT {name}) = 2 THEN 'boolean' ELSE 'numerical' END"
        x = f"{name}::DOUBLE"
        figures = (
            f"{rsql(f'avg({x})')} AS mean, {rsql(f'quantile_cont({x}, 0.5)')} AS median, "
            f"(SELECT {name}::DOUBLE FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, "
            f"{rsql(f'stddev_samp({x})')} AS std, min({x}) AS min, max({x}) AS max, "
            f"{rsql(f'skewness({x})')} AS skewness, {rsql(f'kurtosis({x})')} AS kurtosis"
        )
    else:
        kind = "'datetime'" if dtype.startswith("timestamp") else f"CASE WHEN {few} THEN 'categorical' ELSE 'text' END"
        figures = ", ".join(
            f"NULL::DOUBLE AS {c}" for c in ("mean", "median", "mode", "std", "min", "max", "skewness", "kurtosis")
        )
    return (
        f"SELECT {position} AS position, '{name}' AS \"column\", '{dtype}' AS data_type, {kind} AS kind, "
        f"count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS distinct_count, {figures} FROM lineitem"
    )


@query(
    "profile_lineitem",
    " UNION ALL ".join(_profile_row(i, *c) for i, c in enumerate(_LINEITEM)),
)
def profile_lineitem(t: Tables) -> DataFrame:
    return profile.profile(t.lineitem).select(
        "position", "column", "data_type", "kind", "null_count", "distinct_count",
        rounded("mean").alias("mean"), rounded("median").alias("median"), "mode", rounded("std").alias("std"),
        "min", "max", rounded("skewness").alias("skewness"), rounded("kurtosis").alias("kurtosis"),
    )


def _kind_sql(table: str, columns: dict[str, str]) -> str:
    """Full-classifier kind per column; ``columns`` maps a name to number, text or time."""
    words = "('true','false','0','1','0.0','1.0','yes','no','y','n')"
    parts = []
    for i, (c, sort) in enumerate(columns.items()):
        two = f"count(DISTINCT {c}) = 2 AND bool_and(lower({c}::VARCHAR) IN {words})"
        if sort == "time":
            kind = "'datetime'"
        elif sort == "number":
            kind = f"CASE WHEN {two} THEN 'boolean' ELSE 'numerical' END"
        else:
            kind = (
                f"CASE WHEN {two} THEN 'boolean' WHEN count(DISTINCT {c}) < 20 OR count(DISTINCT {c}) < 0.05 * count(*) "
                "THEN 'categorical' ELSE 'text' END"
            )
        parts.append(f"SELECT {i} AS position, '{c}' AS \"column\", {kind} AS kind FROM {table}")
    return " UNION ALL ".join(parts)


@query("kinds_labels", _kind_sql("labels", {"doc_id": "number", "quality": "number", "toxic": "number"}))
def kinds_labels(t: Tables) -> DataFrame:
    return kinds.kinds_table(t.labels)


@query(
    "kinds_documents",
    _kind_sql("documents", {"doc_id": "number", "text": "text", "lang": "text", "source": "text", "n_chars": "number"}),
)
def kinds_documents(t: Tables) -> DataFrame:
    return kinds.kinds_table(t.documents)


@query(
    "kinds_answers",
    "WITH answers AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'Yes' ELSE 'no' END AS large, p_name, p_type,"
    " CASE WHEN p_size > 10 THEN 'Y' ELSE 'maybe' END AS fits FROM part) "
    + _kind_sql("answers", {"p_partkey": "number", "large": "text", "p_name": "text", "p_type": "text", "fits": "text"}),
)
def kinds_answers(t: Tables) -> DataFrame:
    answers = t.part.select(
        "p_partkey",
        F.when(F.col("p_size") > 25, "Yes").otherwise("no").alias("large"),
        "p_name",
        "p_type",
        F.when(F.col("p_size") > 10, "Y").otherwise("maybe").alias("fits"),
    )
    return kinds.kinds_table(answers)


@query(
    "kinds_basic",
    """SELECT (row_number() OVER ()) - 1 AS position, column_name AS "column",
       CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numerical'
            WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'datetime'
            ELSE 'categorical' END AS kind
       FROM (DESCRIBE orders)""",
)
def kinds_basic(t: Tables) -> DataFrame:
    return kinds.kinds_table(t.orders, "basic").withColumn("position", F.col("position").cast("bigint"))


@query(
    "coerce_dates",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_date, 'timestamp' AS event_date_type,
              props AS start_time, 'string' AS start_time_type FROM events""",
)
def coerce_dates(t: Tables) -> DataFrame:
    """A text column that parses becomes a timestamp, one that does not stays text."""
    texts = t.events.select("event_id", F.col("ts").cast("string").alias("event_date"), F.col("props").alias("start_time"))
    out = kinds.coerce_dates(texts)
    types = dict(out.dtypes)
    return out.select(
        "event_id",
        F.date_format("event_date", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_date"),
        F.lit(types["event_date"]).alias("event_date_type"),
        "start_time",
        F.lit(types["start_time"]).alias("start_time_type"),
    )


@query(
    "kinds_of_texts",
    """WITH texts AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_date, props AS start_time, event_type FROM events)
  SELECT * FROM (SELECT 0::BIGINT AS position, 'event_id' AS "column", 'numerical' AS kind
    UNION ALL SELECT 1, 'event_date', CASE WHEN count(event_date) = count(try_cast(event_date AS TIMESTAMP)) THEN 'datetime' ELSE 'categorical' END FROM texts
    UNION ALL SELECT 2, 'start_time', CASE WHEN count(start_time) = count(try_cast(start_time AS TIMESTAMP)) THEN 'datetime' ELSE 'categorical' END FROM texts
    UNION ALL SELECT 3, 'event_type', 'categorical')""",
)
def kinds_of_texts(t: Tables) -> DataFrame:
    """Kinds of a table whose dates are text: all its rows decide."""
    texts = t.events.select("event_id", F.col("ts").cast("string").alias("event_date"), F.col("props").alias("start_time"), "event_type")
    return kinds.kinds_table(kinds.coerce_dates(texts), "basic").withColumn("position", F.col("position").cast("bigint"))


@query(
    "describe_unclean",
    f"""SELECT count(*) - count(v) AS missing, {rsql('avg(v)')} AS mean, min(v) AS low, max(v) AS high
  FROM (SELECT CASE WHEN l_quantity > 3 THEN l_extendedprice END AS v FROM lineitem)""",
)
def describe_unclean(t: Tables) -> DataFrame:
    """Statistics of a column with NaN and infinities, which count as missing once read."""
    odd = [float("nan"), float("inf"), float("-inf")]
    price = F.col("l_extendedprice")
    for i, v in enumerate(odd, 1):
        price = F.when(F.col("l_quantity") == i, F.lit(v)).otherwise(price)
    path = f"{shared_folder(t.spark)}/tablescope/{uuid.uuid4().hex}"
    write_table(t.lineitem.select(price.alias("price")), path)
    v = finite(F.col("price"))
    made = read_table(t.spark, path)
    return made.agg(F.count_if(v.isNull()).alias("missing"), rounded(F.avg(v)).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))


_TARGET = """(WITH words(word, i) AS (VALUES ('target', 0), ('label', 1), ('price', 2), ('class', 3), ('outcome', 4),
    ('revenue', 5), ('sales', 6), ('churn', 7), ('status', 8)),
  names AS (SELECT column_name AS c, row_number() OVER () AS p FROM (DESCRIBE orders))
  SELECT c FROM words JOIN names ON contains(lower(c), word) ORDER BY i, p LIMIT 1)"""


@query(
    "summary_orders",
    f"""SELECT count(*) AS rows, 6::BIGINT AS columns,
          (count(*) - count(o_orderkey)) + (count(*) - count(o_custkey)) + (count(*) - count(o_orderstatus))
          + (count(*) - count(o_totalprice)) + (count(*) - count(o_orderdate)) + (count(*) - count(o_orderpriority)) AS missing_values,
          count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicate_rows,
          sum(strlen(o_orderstatus) + strlen(o_orderpriority) + 32)::BIGINT AS approx_bytes,
          {_TARGET} AS target_suggestion,
          'o_orderkey,o_custkey,o_totalprice' AS numerical_columns FROM orders""",
)
def summary_orders(t: Tables) -> DataFrame:
    return profile.summary(t.orders).select(
        "rows", "columns", "missing_values", "duplicate_rows", "approx_bytes", "target_suggestion",
        F.array_join("numerical_columns", ",").alias("numerical_columns"),
    )


def _null_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
        f"{rsql(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_percentage FROM {table}"
        for c in columns
    )


@query(
    "null_counts",
    f"WITH {EVENTS_WITH_GAPS} " + _null_sql("gappy", ["event_id", "ts", "user_id", "event_type", "value", "props"]),
)
def null_counts(t: Tables) -> DataFrame:
    return profile.null_counts(events_with_gaps(t)).withColumn("null_percentage", rounded("null_percentage"))


@query(
    "duplicate_rows",
    f"""WITH {VISITS} SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM visits)) AS distinct_rows,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM visits)) AS duplicate_rows FROM visits""",
)
def duplicate_rows(t: Tables) -> DataFrame:
    return profile.duplicate_counts(visits(t))


@query(
    "duplicate_documents",
    """SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_rows FROM documents""",
)
def duplicate_documents(t: Tables) -> DataFrame:
    return profile.duplicate_counts(t.documents.select("text", "lang"))


@query(
    "distinct_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM documents"
        for c in ("doc_id", "text", "lang", "source", "n_chars")
    ),
)
def distinct_counts(t: Tables) -> DataFrame:
    return stats.distinct_counts(t.documents)


@query(
    "constant_columns",
    f"WITH {CHARGES} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\" FROM charges HAVING count(DISTINCT {c}) = 1"
        for c in ("l_quantity", "l_extendedprice", "net", "charge", "weight", "l_returnflag", "currency")
    ),
)
def constant_columns(t: Tables) -> DataFrame:
    return profile.constant_columns(charges(t))


@query("approx_bytes", "SELECT sum(strlen(url) + strlen(html) + 8)::BIGINT AS approx_bytes FROM pages")
def approx_bytes(t: Tables) -> DataFrame:
    return profile.approx_bytes(t.pages)


@query(
    "reindex_columns",
    "SELECT c_mktsegment, c_custkey, NULL::VARCHAR AS c_phone, c_acctbal FROM customer",
)
def reindex_columns(t: Tables) -> DataFrame:
    return clean.reindex(
        t.customer, {"c_mktsegment": "string", "c_custkey": "bigint", "c_phone": "string", "c_acctbal": "double"}
    )


@query(
    "newest_order_per_customer",
    """SELECT o_custkey, max(o_orderkey) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders o
       WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)
       GROUP BY o_custkey, o_orderdate""",
)
def newest_order_per_customer(t: Tables) -> DataFrame:
    newest = lookups.latest_per_group(
        t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]
    )
    return newest.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "owned_lines",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus FROM lineitem
       WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = l_linestatus)""",
)
def owned_lines(t: Tables) -> DataFrame:
    """Lines whose (order, status) pair exists among the orders."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    return lookups.owned_rows(lines, t.orders, [("l_orderkey", "o_orderkey"), ("l_linestatus", "o_orderstatus")])


@query(
    "order_lookup",
    """SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey""",
)
def order_lookup(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey")
    named = lookups.attach(orders, t.customer.select("c_custkey", "c_name", "c_nationkey"), "o_custkey", "c_custkey")
    return lookups.attach(named, t.nation.select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey").select(
        "o_orderkey", "c_name", "n_name"
    )


@query(
    "top_orders",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20",
)
def top_orders(t: Tables) -> DataFrame:
    """The newest twenty."""
    return lookups.top_rows(t.orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], 20).select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


@query("csv_round_trip", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_extendedprice, l_returnflag, 9007199254740993 + l_orderkey AS wide, 'a, \"b\"' || chr(10) || l_linestatus AS note FROM lineitem")
def csv_round_trip(t: Tables) -> DataFrame:
    """Lines written as CSV and read back without a schema: ids beyond doubles, quotes and line ends inside cells."""
    made = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
        (F.lit(9007199254740993) + F.col("l_orderkey")).alias("wide"), F.concat(F.lit('a, "b"\n'), "l_linestatus").alias("note"),
    )
    path = f"{shared_folder(t.spark)}/tablescope/{uuid.uuid4().hex}"
    write_table(made, path, "csv")
    return read_table(t.spark, path, "csv")
