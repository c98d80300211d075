"""What a column is: two classifiers, chosen by the caller.

``basic``  numerical / datetime / categorical, from the types alone
``full``   datetime, boolean, numerical, categorical, text, from types and values
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import is_datetime, is_numeric, is_string, quoted
from .stats import distinct_counts

# Words and numbers of the kind rules.
DATE_WORDS = ["date", "time", "timestamp"]
BOOLEAN_WORDS = ["true", "false", "0", "1", "0.0", "1.0", "yes", "no", "y", "n"]
TARGET_WORDS = ["target", "label", "price", "class", "outcome", "revenue", "sales", "churn", "status"]
FEW_DISTINCT = 20
FEW_DISTINCT_SHARE = 0.05


def _date_named(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_string(df, c) and any(w in c.lower() for w in DATE_WORDS)]


def parsable_dates(df: DataFrame) -> list[str]:
    """Text columns with a date-like name whose every non-null value parses as a timestamp."""
    named = _date_named(df)
    if not named:
        return []
    bad = df.agg(
        *[
            F.count_if(quoted(c).isNotNull() & quoted(c).try_cast("timestamp").isNull()).alias(f"b{i}")
            for i, c in enumerate(named)
        ]
    ).first()
    return [c for i, c in enumerate(named) if bad[f"b{i}"] == 0]


def coerce_dates(df: DataFrame) -> DataFrame:
    """Turn the parsable date columns into timestamps, all values of a column or none."""
    found = parsable_dates(df)
    return df.withColumns({c: quoted(c).try_cast("timestamp") for c in found}) if found else df


def classify(
    df: DataFrame,
    mode: str = "full",
    rows: int | None = None,
    approx: bool = False,
    distinct: dict[str, int] | None = None,
) -> dict[str, str]:
    """Kind of every column.  Runs a few one-row aggregates; nothing per row reaches the driver.

    ``approx`` counts distinct texts with a sketch, for the categorical versus
    text decision only; ``distinct`` hands over counts that are already known.
    """
    dates = set(parsable_dates(df))
    kinds: dict[str, str] = {}
    for c in df.columns:
        if is_datetime(df, c) or c in dates:
            kinds[c] = "datetime"
        elif mode == "basic":
            numeric = is_numeric(df, c) or isinstance(df.schema[c].dataType, T.BooleanType)
            kinds[c] = "numerical" if numeric else "categorical"
        elif isinstance(df.schema[c].dataType, T.BooleanType):
            kinds[c] = "boolean"
    if mode == "basic":
        return kinds
    if mode != "full":
        raise ValueError(f"unknown classifier {mode!r}")
    rest = [c for c in df.columns if c not in kinds]
    if not rest:
        return {c: kinds[c] for c in df.columns}
    two = _two_valued(df, rest)
    texts = []
    for c in rest:
        if c in two:
            kinds[c] = "boolean"
        elif is_numeric(df, c):
            kinds[c] = "numerical"
        else:
            texts.append(c)
    if texts:
        rows = df.count() if rows is None else rows
        if distinct is not None:
            distinct = {c: distinct[c] for c in texts}
        elif approx:
            one = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(texts)]).first()
            distinct = {c: one[f"d{i}"] for i, c in enumerate(texts)}
        else:
            distinct = {r["column"]: r["distinct_count"] for r in distinct_counts(df, texts).collect()}
        for c in texts:
            few = distinct[c] < FEW_DISTINCT or (rows > 0 and distinct[c] / rows < FEW_DISTINCT_SHARE)
            kinds[c] = "categorical" if few else "text"
    return {c: kinds[c] for c in df.columns}


def _two_valued(df: DataFrame, columns: list[str]) -> set[str]:
    """Columns with exactly two distinct values, both boolean words.

    No distinct count is needed: a numeric column qualifies when it holds 0 and
    1 and nothing else.  Only text columns made of such words throughout get a
    second look; the spellings of ten words are few enough for a set.
    """
    checks = []
    for i, c in enumerate(columns):
        v = quoted(c)
        if is_numeric(df, c):
            checks += [F.count_if(v == 0).alias(f"a{i}"), F.count_if(v == 1).alias(f"b{i}"), F.count(v).alias(f"n{i}")]
        else:
            word = F.lower(v.cast("string")).isin(BOOLEAN_WORDS)
            checks += [F.count_if(word).alias(f"a{i}"), F.lit(0).alias(f"b{i}"), F.count(v).alias(f"n{i}")]
    row = df.agg(*checks).first()
    found, texts = set(), []
    for i, c in enumerate(columns):
        a, b, n = row[f"a{i}"], row[f"b{i}"], row[f"n{i}"]
        if is_numeric(df, c):
            if a and b and a + b == n:
                found.add(c)
        elif n and a == n:
            texts.append(c)
    if texts:
        sets = df.agg(*[F.size(F.collect_set(quoted(c).cast("string"))).alias(f"k{i}") for i, c in enumerate(texts)]).first()
        found |= {c for i, c in enumerate(texts) if sets[f"k{i}"] == 2}
    return found


def kinds_table(df: DataFrame, mode: str = "full") -> DataFrame:
    """(position, column, kind) rows."""
    kinds = classify(df, mode)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(k).alias("kind")) for i, (c, k) in enumerate(kinds.items())]
    return df.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def of_kind(kinds: dict[str, str], *wanted: str) -> list[str]:
    return [c for c, k in kinds.items() if k in wanted]


def suggest_target(columns: list[str]) -> str | None:
    """First keyword found in a column name, keywords in order; else the last column."""
    for word in TARGET_WORDS:
        for c in columns:
            if word in c.lower():
                return c
    return columns[-1] if columns else None
