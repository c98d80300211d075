"""Tables and rounding that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import Tables


def _nudge(digits: int) -> float:
    """Far below the last digit kept: moves exact halves, which engines settle differently, off the edge."""
    return 2.71828 * 10.0 ** -(digits + 3)


def rounded(c: Column | str, digits: int = 4) -> Column:
    """Rounded, and never negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(_nudge(digits)), digits) + F.lit(0.0)


def rsql(expression: str, digits: int = 4) -> str:
    """The same in SQL."""
    return f"(round(({expression}) + {_nudge(digits):.5e}, {digits}) + 0e0)"


def events_with_gaps(t: Tables) -> DataFrame:
    """Events whose value is missing for errors and for pageless views: about a quarter of the cells."""
    keep = (F.col("event_type") != "error") & ~((F.col("event_type") == "view") & (F.col("value") < 20))
    return t.events.withColumn("value", F.when(keep, F.col("value")))


EVENTS_WITH_GAPS = """gappy AS (
  SELECT event_id, ts, user_id, event_type, props,
         CASE WHEN event_type <> 'error' AND NOT (event_type = 'view' AND value < 20) THEN value END AS value
  FROM events)"""


def charges(t: Tables) -> DataFrame:
    """Line items with two columns that nearly repeat the price, and a constant one."""
    price = F.col("l_extendedprice")
    return t.lineitem.select(
        "l_quantity",
        price.alias("l_extendedprice"),
        (price * (1 - F.col("l_discount"))).alias("net"),
        (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"),
        F.exp(F.col("l_quantity") / 8).alias("weight"),
        "l_returnflag",
        F.lit("EUR").alias("currency"),
    )


CHARGES = """charges AS (
  SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
         exp(l_quantity / 8) AS weight, l_returnflag, 'EUR' AS currency
  FROM lineitem)"""


def visits(t: Tables) -> DataFrame:
    """Three columns of the events, with repeated rows and missing values."""
    return events_with_gaps(t).select("user_id", "event_type", F.round("value").alias("value"))


VISITS = f"""{EVENTS_WITH_GAPS}, visits AS (SELECT user_id, event_type, round(value) AS value FROM gappy)"""
