"""Running values over an order, safe for one hot key or no key at all.

A window over one key is one task.  When the largest key is small that is the
best plan.  When it is not (or when there is no key), the rows are sorted into
range partitions on (keys, order) - so a hot key spreads over as many blocks as
it needs - and written once to the shared folder, which fixes the block of
every row even if an executor is lost.  The window then runs per (block, key),
and what a block must know of earlier blocks is one carry row for the key that
straddles its left edge: at most one row per block, hence safe to broadcast.

``order`` must be a total order inside each key.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import quoted

TASK_ROWS = 2_000_000
"""Largest group one task may hold; larger ones are split into blocks."""

BLOCK_ROWS = 1_000_000
"""Target rows per block on the split path: what one task sorts, whatever the table's size."""

BLOCK = "_block"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="tablescope-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table."""
    path = f"{shared_folder(df.sparkSession)}/tablescope/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition by key into a fixed number of tasks, for grouped Python work.

    Adaptive execution merges partitions by their bytes; groups that are small
    but slow to work on would then all end up in one task.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *[quoted(k) for k in keys])


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows, rows of the largest key), from a map-side combined count."""
    row = (
        df.groupBy(*[quoted(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
        .first()
    )
    return int(row["rows"]), int(row["largest"])


def _ordering(order: Sequence[str], descending: bool) -> list[Column]:
    return [quoted(c).desc() if descending else quoted(c).asc() for c in order]


def _into_blocks(df: DataFrame, keys: Sequence[str], ordering: list[Column], rows: int, block_rows: int) -> DataFrame:
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(wanted, -(-rows // block_rows))
    ranged = df.repartitionByRange(parts, *[quoted(k) for k in keys], *ordering)
    return cut_lineage(ranged.withColumn(BLOCK, F.spark_partition_id()))


def _join_carry(blocks: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join the carry rows (at most one per block) on (block, keys)."""
    renamed = carry.select(
        F.col(BLOCK).alias("_cb"),
        *[quoted(k).alias(f"_ck{i}") for i, k in enumerate(keys)],
        *[c for c in carry.columns if c.startswith("_carry")],
    )
    same = [F.col(BLOCK) == F.col("_cb")] + [quoted(k).eqNullSafe(F.col(f"_ck{i}")) for i, k in enumerate(keys)]
    return blocks.join(F.broadcast(renamed), reduce(lambda a, b: a & b, same), "left").drop(
        "_cb", *[f"_ck{i}" for i in range(len(keys))]
    )


def running_totals(
    df: DataFrame,
    totals: dict[str, Column],
    order: Sequence[str],
    keys: Sequence[str] = (),
    descending: bool = False,
    task_rows: int = TASK_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add inclusive running sums of the given expressions, per key, in order."""
    ordering = _ordering(order, descending)
    part = [quoted(k) for k in keys]
    rows, largest = group_sizes(df, keys)
    if largest <= task_rows:
        w = W.partitionBy(*part).orderBy(*ordering).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(e).over(w) for name, e in totals.items()})
    blocks = _into_blocks(df, keys, ordering, rows, block_rows)
    inside = W.partitionBy(BLOCK, *part).orderBy(*ordering).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*part).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carry = blocks.groupBy(*part, BLOCK).agg(*[F.sum(e).alias(f"_s{i}") for i, e in enumerate(totals.values())])
    carry = carry.withColumns(
        {f"_carry{i}": F.sum(f"_s{i}").over(before) for i in range(len(totals))} | {"_n": F.count(F.lit(1)).over(before)}
    ).where("_n > 0")
    local = blocks.withColumns({name: F.sum(e).over(inside) for name, e in totals.items()})
    joined = _join_carry(local, carry, keys)
    final = {
        name: F.when(F.col(f"_carry{i}").isNull(), quoted(name)).otherwise(
            F.col(f"_carry{i}") + F.coalesce(quoted(name), F.lit(0))
        )
        for i, name in enumerate(totals)
    }
    return joined.withColumns(final).drop(BLOCK, *[f"_carry{i}" for i in range(len(totals))])


def positions(df: DataFrame, name: str, order: Sequence[str], keys: Sequence[str] = (), **options) -> DataFrame:
    """1-based row number per key in the given order."""
    return running_totals(df, {name: F.lit(1).cast("bigint")}, order, keys, **options)


def running_last(
    df: DataFrame,
    name: str,
    value: Column,
    order: Sequence[str],
    keys: Sequence[str] = (),
    include_current: bool = True,
    descending: bool = False,
    task_rows: int = TASK_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the last non-null ``value`` up to this row (or up to the row before it), per key, in order."""
    ordering = _ordering(order, descending)
    part = [quoted(k) for k in keys]
    end = 0 if include_current else -1
    rows, largest = group_sizes(df, keys)
    if largest <= task_rows:
        w = W.partitionBy(*part).orderBy(*ordering).rowsBetween(W.unboundedPreceding, end)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    blocks = _into_blocks(df.withColumn("_value", value), keys, ordering, rows, block_rows)
    inside = W.partitionBy(BLOCK, *part).orderBy(*ordering).rowsBetween(W.unboundedPreceding, end)
    before = W.partitionBy(*part).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    rank = F.struct(*[quoted(c) for c in order])
    newest = F.min_by if descending else F.max_by
    carry = (
        blocks.groupBy(*part, BLOCK)
        .agg(newest(F.col("_value"), F.when(F.col("_value").isNotNull(), rank)).alias("_end"))
        .withColumn("_carry", F.last("_end", ignorenulls=True).over(before))
        .where(F.col("_carry").isNotNull())
    )
    local = blocks.withColumn(name, F.last("_value", ignorenulls=True).over(inside))
    out = _join_carry(local, carry, keys).withColumn(name, F.coalesce(quoted(name), F.col("_carry")))
    return out.drop(BLOCK, "_carry", "_value")


def rolling(
    df: DataFrame,
    name: str,
    aggregate: Column,
    length: int,
    order: Sequence[str],
    keys: Sequence[str] = (),
    task_rows: int = TASK_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add an aggregate over the last ``length`` rows per key, this row included.

    For a large key the rows are numbered, cut into numbered chunks, and the
    last ``length - 1`` rows of each chunk are lent to the next one.
    """
    part = [quoted(k) for k in keys]
    _, largest = group_sizes(df, keys)
    if largest <= task_rows:
        w = W.partitionBy(*part).orderBy(*[quoted(c) for c in order]).rowsBetween(-(length - 1), 0)
        return df.withColumn(name, aggregate.over(w))
    chunk = max(block_rows, length)
    placed = positions(df, "_pos", order, keys, task_rows=task_rows, block_rows=block_rows)
    own = F.floor((F.col("_pos") - 1) / chunk)
    lent = (F.col("_pos") - 1) % chunk >= chunk - (length - 1)
    copies = placed.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.when(lent, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    w = W.partitionBy("_chunk", *part).orderBy("_pos").rowsBetween(-(length - 1), 0)
    return copies.withColumn(name, aggregate.over(w)).where("_chunk = _own").drop("_pos", "_own", "_chunk")
