"""Joins and lookups against metadata-like tables, newest rows, top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import is_string, quoted

BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the table's size: text bytes plus 16 per cell."""
    text = [F.coalesce(F.octet_length(quoted(c)), F.lit(0)) for c in df.columns if is_string(df, c)]
    each = sum(text, F.lit(16 * len(df.columns))).cast("bigint")
    return int(df.agg(F.coalesce(F.sum(each), F.lit(0)).alias("b")).first()["b"])


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when the measured size allows it; a shuffled join otherwise."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def code_lookup(
    df: DataFrame, column: str, codes: DataFrame, out: str, default: int, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Replace ``column`` by its code from ``codes(value, code)``, ``default`` where null.

    So are values without a code.  Small code tables are broadcast.  Large ones
    are joined by shuffle, where adaptive execution splits a hot value; null
    cells take no part in that join, so they cannot pile up in one task.
    """
    hit = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    keep = [F.coalesce(F.col("_code"), F.lit(default)).cast("bigint").alias(out) if c == column else quoted(c) for c in df.columns]
    same = quoted(column) == F.col("_value")
    if measured_bytes(hit) <= limit:
        return df.join(F.broadcast(hit), same, "left").select(*keep)
    known = df.where(quoted(column).isNotNull()).join(hit, same, "left").select(*keep)
    unknown = df.where(quoted(column).isNull()).withColumn("_code", F.lit(None).cast("bigint")).select(*keep)
    return known.unionByName(unknown)


def latest_per_group(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The newest row per key by the given columns; partial maxima first, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[quoted(c) for c in rest]), F.struct(*[quoted(c) for c in newest]))
    picked = df.groupBy(*[quoted(k) for k in keys]).agg(best.alias("_row"))
    return picked.select(*[quoted(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])


def owned_rows(df: DataFrame, owners: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose (id, owner) pair exists in ``owners`` (semi join)."""
    pairs = broadcast_if_small(owners.select(*[quoted(r).alias(f"_o{i}") for i, (_, r) in enumerate(on)]).distinct())
    match = None
    for i, (left, _) in enumerate(on):
        same = quoted(left) == F.col(f"_o{i}")
        match = same if match is None else match & same
    return df.join(pairs, match, "left_semi")


def attach(df: DataFrame, details: DataFrame, left: str, right: str) -> DataFrame:
    """Inner lookup by id; the details side is broadcast only when measured small."""
    return df.join(broadcast_if_small(details), quoted(left) == quoted(right), "inner")


def top_rows(df: DataFrame, by: Sequence[Column], n: int = 20) -> DataFrame:
    """First ``n`` rows of an order (a top-k report; no full sort)."""
    return df.orderBy(*by).limit(n)
