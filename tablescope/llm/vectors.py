"""Near-duplicate vectors by exact comparison of blocks.

1. Equal vectors of one label are one node with a weight.
2. Nodes are sorted by label and the signs of random projections, so that like vectors are close, and cut into blocks
   of a bounded number of rows and bytes.
3. Every block is compared with itself, then with every other block of its label, unless the angles of both from
   their means leave no room for a link.  Links are counted, not listed.  A comparison adds to the graph only the edges that join what it has not joined yet.
4. Components come from these edges.

Every pair of vectors of one label that bounds do not rule out is compared, so no link is missed; the work grows with the square of a label's
number of distinct vectors, the memory of a task does not grow.  Cosines are taken in double precision from the
components as given; single precision only rules out pairs that are clearly on one side of the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import cut_lineage, spread_groups
from .graph import components

ROWS = 4096
"""Nodes per block at most."""
BYTES = 8 << 20
"""Bytes of the vectors of a block at most; a single longer vector is a block of its own."""
CHUNK = 512
"""Nodes compared with a block at a time."""


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of unit length in double precision; all have one dimension."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(kind: str):
    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grp, low, high, raw = [], [], [], [], []
            lists, labels = batch.column(2), batch.column(1).to_pylist()
            for i, label in enumerate(labels):
                own = lists[i]
                if label is None or not own.is_valid or own.values.null_count or not len(own.values):
                    continue
                x = own.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0
                wide = x.astype(float)
                if not np.isfinite(wide).all() or not np.linalg.norm(wide) > 0 or not np.isfinite(np.linalg.norm(wide)):
                    continue
                data = x.tobytes()
                rows.append(i)
                grp.append(f"{label}|{len(x)}")
                low.append(xxhash.xxh64_intdigest(data, 1) - (1 << 63))
                high.append(xxhash.xxh64_intdigest(data, 2) - (1 << 63))
                raw.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(grp, pa.string()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(raw, pa.binary())],
                names=["id", "grp", "low", "high", "raw"],
            )

    return valid


def _codes(kind: str):
    """Nodes with the signs of 62 random projections as a number."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(3).to_pylist()
            size = np.array([len(x) for x in raw])
            code = np.zeros(len(raw), np.int64)
            for length in np.unique(size):
                own = np.flatnonzero(size == length)
                x = _units([raw[i] for i in own], kind)
                plane = np.random.default_rng(1000).standard_normal((x.shape[1], 62))
                code[own] = ((x @ plane) > 0) @ (1 << np.arange(61, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=["grp", "rep", "w", "raw", "code"])

    return codes


def _cut(rows: int):
    """Sorted nodes with a number of their block; a block has one label and lies in one partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, last, n, size = TaskContext.get().partitionId() << 32, None, 0, 0
        for batch in batches:
            out = []
            for grp, raw in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if n and (grp != last or n >= rows or size + len(raw) > BYTES):
                    block, n, size = block + 1, 0, 0
                last, n, size = grp, n + 1, size + len(raw)
                out.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.int64())], names=["grp", "rep", "w", "raw", "block"])

    return cut


def _near(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosines of the rows of ``a`` and ``b`` reach ``least``; pairs close to it are settled in double precision."""
    sims = a.astype(np.float32) @ b.astype(np.float32).T
    near = sims >= least
    slack = (a.shape[1] + 8) * 2.0**-22
    i, j = np.nonzero(np.abs(sims - least) <= slack)
    for at in range(0, len(i), 1 << 14):
        x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        near[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= least
    return near


def _compare(units: np.ndarray, a: np.ndarray, b: np.ndarray, rep: np.ndarray, w: np.ndarray, part: np.ndarray, least: float):
    """Links of rows ``a`` with rows ``b`` (the same rows, or none in common): (number of links by weight of each row,
    edges (row, row) that join parts not joined before).  ``part`` (parts by number) is joined in place."""
    n, edges, same = np.zeros(len(rep), np.int64), [], a is b
    for at in range(0, len(a), CHUNK):
        own = a[at : at + CHUNK]
        near = _near(units[own], units[b], least)
        near &= rep[own][:, None] != rep[b][None, :]
        i, j = np.nonzero(near)
        n[own] += np.bincount(i, w[b[j]], len(own)).astype(np.int64)
        if not same:
            n[b] += np.bincount(j, w[own[i]], len(b)).astype(np.int64)
        for i in np.flatnonzero((near & (part[own][:, None] != part[b][None, :])).any(axis=1)):
            row, cols = own[i], b[near[i]]
            found, first = np.unique(part[cols], return_index=True)
            other = found != part[row]
            if other.any():
                edges += [(row, cols[f]) for f in first[other]]
                part[np.isin(part, found[other])] = part[row]
    return n, edges


def _within(kind: str, least: float):
    """A block to its nodes with their links inside it and ``part``, the smallest node reachable inside it; the first
    row has the block's mean direction and the largest angle from it."""

    def within(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rep, w = table["rep"].to_numpy(), table["w"].to_numpy()
        units = _units(table["raw"].to_pylist(), kind)
        rows, part = np.arange(len(rep)), np.arange(len(rep))
        n, _ = _compare(units, rows, rows, rep, w, part, least)
        low = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(low, part, rep)
        mean = units.sum(axis=0)
        mean = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-6 else units[0]
        angle = float(np.arccos(np.clip((units @ mean).min(), -1, 1)))
        none = [None] * (len(rep) - 1)
        return pa.table(
            {"grp": table["grp"], "block": table["block"], "rep": rep, "w": w, "raw": table["raw"], "n": n, "part": low[part],
             "mean": pa.array([mean.tolist(), *none], pa.list_(pa.float64())), "angle": pa.array([angle, *none], pa.float64())}
        )

    return within


def _across(kind: str, least: float):
    """Two blocks to (rep, n, null), their links across, and (rep, 0, other), edges that join their parts."""

    def across(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rep, w, block = table["rep"].to_numpy(), table["w"].to_numpy(), table["block"].to_numpy()
        units = _units(table["raw"].to_pylist(), kind)
        _, part = np.unique(table["part"].to_numpy(), return_inverse=True)
        a, b = (np.flatnonzero(block == k.as_py()) for k in key)
        n, edges = _compare(units, a, b, rep, w, part, least)
        some = np.flatnonzero(n)
        x, y = np.array(edges, np.int64).reshape(-1, 2).T
        other = pa.array([*[None] * len(some), *rep[y].tolist()], pa.int64())
        return pa.table({"rep": np.concatenate([rep[some], rep[x]]), "n": np.concatenate([n[some], np.zeros(len(x), np.int64)]), "other": other})

    return across


def _blocks(nodes: DataFrame, kind: str, least: float, rows: int) -> DataFrame:
    """Nodes (grp, rep, w, raw) with their blocks and what ``_within`` adds."""
    parts = max(8, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    coded = nodes.select("grp", "rep", "w", "raw").mapInArrow(_codes(kind), "grp string, rep bigint, w bigint, raw binary, code bigint")
    ordered = coded.repartitionByRange(parts, "grp", "code", "rep").sortWithinPartitions("grp", "code", "rep")
    cut = ordered.mapInArrow(_cut(rows), "grp string, rep bigint, w bigint, raw binary, block bigint")
    form = "grp string, block bigint, rep bigint, w bigint, raw binary, n bigint, part bigint, mean array<double>, angle double"
    return cut_lineage(spread_groups(cut, ["block"]).groupBy("block").applyInArrow(_within(kind, least), form))


def _pairs(blocks: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of blocks of one label between which the angles from their means leave room for a link."""
    left = blocks.select("grp", F.col("block").alias("a"), F.col("mean").alias("mean_a"), F.col("angle").alias("angle_a"))
    right = blocks.select("grp", F.col("block").alias("b"), F.col("mean").alias("mean_b"), F.col("angle").alias("angle_b"))
    cosine = F.aggregate(F.zip_with("mean_a", "mean_b", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    reach = float(np.arccos(np.clip(least, -1, 1))) + 1e-6
    return left.join(right, "grp").where("a < b").where(apart <= F.col("angle_a") + F.col("angle_b") + reach).select("a", "b")


def linked_vectors(
    vectors: DataFrame, least: float = 0.93, key: str = "vec_id", label: str = "label", embedding: str = "embedding", rows_per_block: int = ROWS
) -> DataFrame:
    """Per row: key, n_links (other rows linked directly), component_id (smallest key reachable) and kept.

    Rows are linked when their labels are equal and not null and the cosine of their vectors is at least ``least``.
    Null, zero and empty vectors and those with null or non-finite components link with nothing, as do vectors of
    another dimension; a row without a key is no node: it has no links, a null component_id, and is kept.
    Repeated rows are nodes of their own with one key, linked with each other.  An empty table gives an empty
    result; other columns are not read.
    """
    kind = "<f4" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "<f8"
    read = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("v"))
    rows = cut_lineage(read.where("id is not null").mapInArrow(_valid(kind), "id bigint, grp string, low bigint, high bigint, raw binary"))
    nodes = cut_lineage(
        rows.groupBy("grp", "low", "high").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("raw").alias("raw"))
    )
    placed = _blocks(nodes, kind, least, rows_per_block)
    sides = _pairs(placed.where("mean is not null"), least).withColumn("block", F.explode(F.array("a", "b")))
    both = sides.join(placed.select("block", "rep", "w", "raw", "part"), "block")
    met = cut_lineage(spread_groups(both, ["a", "b"]).groupBy("a", "b").applyInArrow(_across(kind, least), "rep bigint, n bigint, other bigint"))
    joins = met.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    edges = placed.where("rep <> part").select(F.col("rep").alias("a"), F.col("part").alias("b")).unionByName(joins)
    roots = cut_lineage(components(edges))
    counts = placed.select("rep", "n").unionByName(met.where("other is null").select("rep", "n")).groupBy("rep").agg(F.sum("n").alias("n"))
    per_node = (
        nodes.select("grp", "low", "high", "rep", "w")
        .join(counts, "rep", "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select("grp", "low", "high", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    )
    of_row = rows.select("id", "grp", "low", "high").join(per_node, ["grp", "low", "high"]).select("id", "n_links", "root").distinct()
    component = F.coalesce("root", "id")
    out = read.select("id").join(of_row, "id", "left")
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
