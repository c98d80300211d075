"""Seeded sampling and exact splits, by hash order.

Every row gets a 52-bit hash of its key and the seed.  A sample of ``n`` rows is
the ``n`` smallest hashes (top-k, no sort of the table); a split is a cut at the
exact order statistic of the hash, found by scans of the key alone.  Both are
the same on every run and whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import quoted
from .blocks import cut_lineage, positions
from .lookups import broadcast_if_small
from .quantiles import DIRECT_ROWS, order_statistics

_BITS = (1 << 52) - 1


def hash_order(key: Sequence[str], seed: int) -> Column:
    """52-bit hash, exact as a double."""
    return F.xxhash64(F.lit(seed), *[quoted(k) for k in key]).bitwiseAND(F.lit(_BITS))


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement."""
    return df.orderBy(hash_order(key, seed), *[quoted(k) for k in key]).limit(n)


def split(
    df: DataFrame,
    key: Sequence[str],
    test_fraction: float = 0.2,
    seed: int = 42,
    label: str | None = None,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Add ``is_test``: exactly ceil(fraction * rows) test rows, per label value when stratified.

    With ``label`` each class gives its rounded share, the largest remainders
    taking what is left; a class too small to be on both sides falls back to
    the plain split.  ``key`` must identify a row.
    """
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must be between 0 and 1")
    marked = df.withColumn("_h", hash_order(key, seed))
    if label is not None:
        cuts = _class_cuts(marked, label, key, test_fraction)
        if cuts is not None:
            joined = marked.join(cuts, quoted(label).eqNullSafe(F.col("_v")), "left")
            rank = F.struct(F.col("_h"), *[quoted(k) for k in key])
            return joined.withColumn("is_test", F.coalesce(rank <= F.col("_cut"), F.lit(False))).drop("_h", "_v", "_cut")
    rows = df.count()
    wanted = -int(-rows * test_fraction // 1)
    found = order_statistics(marked, {"h": (F.col("_h"), lambda _: [wanted - 1])}, direct_rows)["h"][1]
    cut = found.get(wanted - 1)
    hit = F.lit(False) if cut is None else _below(marked, cut, wanted, key)
    return marked.withColumn("is_test", hit).drop("_h")


def _below(marked: DataFrame, cut: int, wanted: int, key: Sequence[str]) -> Column:
    """Rows up to the cut; when several share the cut's hash, the key settles which of them."""
    row = marked.agg(F.count_if(F.col("_h") < cut).alias("less"), F.count_if(F.col("_h") == cut).alias("same")).first()
    take = wanted - row["less"]
    if take >= row["same"]:
        return F.col("_h") <= cut
    rank = F.struct(*[quoted(k) for k in key])
    last = marked.where(F.col("_h") == cut).orderBy(rank).limit(take).agg(F.max(rank)).scalar()
    return (F.col("_h") < cut) | ((F.col("_h") == cut) & (rank <= last))


def _class_cuts(marked: DataFrame, label: str, key: Sequence[str], fraction: float) -> DataFrame | None:
    """(_v, _cut): the last test row of each class in hash order; None when stratifying is impossible.

    Shares sum to ceil(fraction * rows): each class gets its part rounded down, and those with the largest
    remainders one more.  Only labels, hashes and keys are sorted; a class too large for a task is numbered in blocks, and
    the jobs are as many for a thousand classes as for two.
    """
    rank = F.struct(F.col("_h"), *[quoted(k) for k in key])
    narrow = marked.select(quoted(label).alias("_v"), rank.alias("_r"))
    sizes = cut_lineage(narrow.groupBy("_v").agg(F.count(F.lit(1)).alias("n")))
    facts = sizes.agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.count(F.lit(1)).alias("classes")).first()
    total, classes = facts["total"] or 0, facts["classes"]
    wanted = -int(-total * fraction // 1)
    if not classes or facts["least"] < 2 or wanted < classes or total - wanted < classes:
        return None
    product = F.col("n").cast("decimal(38,0)") * F.lit(wanted)
    shared = sizes.select("_v", F.expr(f"cast(n as decimal(38,0)) * {wanted} div {total}").alias("floor"), (-(product % F.lit(total))).alias("_rest"), F.col("_v").cast("string").alias("_name"))
    missing = wanted - shared.agg(F.sum("floor")).first()[0]
    ranked = positions(shared, "_place", ["_rest", "_name"])
    shares = broadcast_if_small(ranked.select(F.col("_v").alias("_w"), (F.col("floor") + (F.col("_place") <= missing).cast("int")).alias("_share")))
    numbered = positions(narrow, "_n", ["_r"], ["_v"])
    last = numbered.join(shares, F.col("_v").eqNullSafe(F.col("_w")) & (F.col("_n") == F.col("_share")))
    return broadcast_if_small(cut_lineage(last.select("_v", F.col("_r").alias("_cut"))))
