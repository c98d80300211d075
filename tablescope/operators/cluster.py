"""Density clusters and nearest-neighbour labels without pairing all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import double, quoted, require_numeric
from .blocks import cut_lineage, positions, spread_groups
from .evaluate import knn_votes
from .sampling import sample_rows

MAX_DIMENSIONS = 4
CELL_ROWS = 20_000
"""Rows of one side a task compares at a time; larger cells are cut by hash."""
PIVOTS = 256
NEIGHBOURS = 5


def dbscan(df: DataFrame, key: str, columns: Sequence[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(key, cluster): density clusters over up to four numeric columns, -1 for noise.

    Clusters are numbered by their smallest core key; a border row belongs to
    the first cluster that reaches it.  ``key`` identifies a row; rows with a
    missing coordinate are left out.

    Copies of a point are one weighted point.  Cells are so small that two
    points of a cell are always neighbours, hence a cell with ``min_samples``
    rows is core throughout and its points are never compared with each other.
    Only points of thinner cells are compared with their neighbour cells, a
    bounded number per cell, and two full cells are linked by comparing the
    bounding boxes of ever smaller parts of them.
    """
    d = len(columns)
    if not 1 <= d <= MAX_DIMENSIONS:
        raise ValueError(f"dbscan takes 1 to {MAX_DIMENSIONS} columns; reduce the dimensions first")
    for c in columns:
        require_numeric(df, c)
    x = [f"x{j}" for j in range(d)]
    cell = [f"c{j}" for j in range(d)]
    side = eps / sqrt(d) * (1 - 1e-12)
    rows = df.select(quoted(key).alias("key"), *[double(c).alias(n) for c, n in zip(columns, x)]).na.drop(subset=x)
    points = rows.groupBy(*x).agg(F.min("key").alias("pid"), F.count(F.lit(1)).alias("w"))
    points = points.withColumns({c: F.floor(F.col(n) / side) for c, n in zip(cell, x)})
    points = cut_lineage(points)
    cells = points.groupBy(*cell).agg(F.sum("w").alias("cw"), F.count(F.lit(1)).alias("size"))
    cells = cut_lineage(cells.withColumn("salts", F.ceil(F.col("size") / CELL_ROWS)))
    full = F.col("cw") >= min_samples
    placed = points.join(cells, cell).withColumn("salt", F.pmod(F.xxhash64("pid"), F.col("salts")))
    placed = cut_lineage(placed.withColumn("full", full).drop("cw", "size"))

    near = cut_lineage(_near_pairs(placed, cells, x, cell, eps))
    weights = near.groupBy("pid").agg(F.sum("other_w").alias("around"))
    thin_core = weights.where(F.col("around") >= min_samples).select("pid")
    core = placed.where("full").unionByName(placed.where(~F.col("full")).join(thin_core, "pid", "left_semi"))
    core = cut_lineage(core.select("pid", "full", *x, *cell))

    nodes = cut_lineage(core.groupBy(*cell).agg(F.min("pid").alias("node"), F.max("full").alias("full")))
    node_of = core.join(nodes.drop("full"), cell).select("pid", "node")
    touching = near.join(node_of.withColumnRenamed("node", "a"), "pid").join(
        node_of.select(F.col("pid").alias("other"), F.col("node").alias("b")), "other"
    )
    links = touching.where("a <> b").select("a", "b").distinct()
    links = links.unionByName(_link_full_cells(core, nodes, x, cell, side, eps))
    labels = _components(nodes.select("node"), links)

    owner = node_of.join(labels, "node").select("pid", "label")
    reached = near.join(owner.withColumnRenamed("pid", "other"), "other").groupBy("pid").agg(F.min("label").alias("label"))
    border = reached.join(owner, "pid", "left_anti")
    labelled = owner.unionByName(border.select("pid", "label"))
    numbers = positions(labels.select("label").distinct(), "number", ["label"])
    labelled = labelled.join(numbers, "label").select("pid", (F.col("number") - 1).cast("int").alias("cluster"))
    by_point = points.join(labelled, "pid", "left").select(*x, "cluster")
    return rows.join(by_point, x).select(F.col("key").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _offsets(d: int) -> list[tuple[int, ...]]:
    reach = ceil(sqrt(d))
    return list(product(range(-reach, reach + 1), repeat=d))


def _shifted(df: DataFrame, cell: Sequence[str], offsets: Sequence[tuple[int, ...]], into: str) -> DataFrame:
    """One row per offset with the shifted cell in ``into``0, ``into``1, ..."""
    moves = F.array(*[F.array(*[F.lit(o).cast("bigint") for o in move]) for move in offsets])
    out = df.withColumn("_move", F.explode(moves))
    return out.withColumns({f"{into}{j}": F.col(c) + F.get("_move", F.lit(j)) for j, c in enumerate(cell)}).drop("_move")


def _squared(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda s, t: s + t, [(p - q) * (p - q) for p, q in zip(a, b)])


def _near_pairs(placed: DataFrame, cells: DataFrame, x: Sequence[str], cell: Sequence[str], eps: float) -> DataFrame:
    """(pid, other, other_w): for points of thin cells, all points within ``eps``, themselves included.

    A thin cell has fewer than ``min_samples`` points, so every point meets a
    bounded number of them; large neighbour cells are cut by salt.
    """
    d = len(x)
    thin = placed.where(~F.col("full")).select("pid", *x, *cell)
    asked = _shifted(thin, cell, _offsets(d), "n").select("pid", *[F.col(v).alias(f"p{v}") for v in x], *[f"n{j}" for j in range(d)])
    there = cells.select(*[F.col(c).alias(f"n{j}") for j, c in enumerate(cell)], "salts")
    names = [f"n{j}" for j in range(d)]
    asked = asked.join(there, names).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    others = placed.select(
        F.col("pid").alias("other"), F.col("w").alias("other_w"), "salt", *x, *[F.col(c).alias(n) for c, n in zip(cell, names)]
    )
    pairs = asked.drop("salts").join(others, [*names, "salt"])
    close = _squared([F.col(f"p{v}") for v in x], [F.col(v) for v in x]) <= eps * eps
    return pairs.where(close).select("pid", "other", "other_w")


def _link_full_cells(
    core: DataFrame, nodes: DataFrame, x: Sequence[str], cell: Sequence[str], side: float, eps: float
) -> DataFrame:
    """(a, b): full cells that hold two points within ``eps`` of each other, exactly.

    Boxes around the points of two cells settle most pairs: too far apart, or
    near throughout.  The rest are cut into parts, pair by pair of parts, until
    every pair is settled; boxes of single points are always settled.
    """
    spark = core.sparkSession
    d = len(x)
    full_nodes = nodes.where("full").select("node", *cell)
    half = [o for o in _offsets(d) if o > (0,) * d]
    asked = _shifted(full_nodes.withColumnRenamed("node", "a"), cell, half, "n").select("a", *[f"n{j}" for j in range(d)])
    pairs = asked.join(
        full_nodes.select(F.col("node").alias("b"), *[F.col(c).alias(f"n{j}") for j, c in enumerate(cell)]),
        [f"n{j}" for j in range(d)],
    ).select("a", "b")
    open_pairs = cut_lineage(
        pairs.withColumns({"sa": F.array().cast("array<bigint>"), "sb": F.array().cast("array<bigint>")})
    )
    members = core.where("full").join(full_nodes, list(cell)).select("node", *x)
    links = spark.createDataFrame([], pairs.schema)
    level = 0
    while not open_pairs.isEmpty():
        # parts of a cell at this level, inside the part named by ``parent``
        part = F.array(*[F.floor(F.col(v) / side * float(4**level)) for v in x])
        parent = F.array(*[F.floor(F.col(v) / side * float(4 ** (level - 1))) for v in x]) if level > 1 else F.array().cast("array<bigint>")
        involved = open_pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("sa").alias("parent")), F.struct(F.col("b").alias("node"), F.col("sb").alias("parent")))).alias("s")).select("s.*").distinct()
        boxes = (
            members.withColumns({"parent": parent, "part": part if level else F.array().cast("array<bigint>")})
            .join(involved, ["node", "parent"], "left_semi")
            .groupBy("node", "parent", "part")
            .agg(*[f(v).alias(f"{n}{v}") for v in x for n, f in (("lo_", F.min), ("hi_", F.max))])
        )

        def sided(tag: str) -> DataFrame:
            return boxes.select(
                F.col("node").alias(tag), F.col("parent").alias(f"s{tag}"), F.col("part").alias(f"part_{tag}"),
                *[F.col(f"{n}{v}").alias(f"{tag}_{n}{v}") for v in x for n in ("lo_", "hi_")],
            )

        met = open_pairs.join(sided("a"), ["a", "sa"]).join(sided("b"), ["b", "sb"])
        gaps, spans = [], []
        for v in x:
            alo, ahi, blo, bhi = (F.col(f"{s}_{n}_{v}") for s in "ab" for n in ("lo", "hi"))
            gap = F.greatest(F.lit(0.0), alo - bhi, blo - ahi)
            span = F.greatest(F.abs(ahi - blo), F.abs(bhi - alo))
            gaps.append(gap * gap)
            spans.append(span * span)
        judged = cut_lineage(
            met.select(
                "a", "b", F.col("part_a").alias("sa"), F.col("part_b").alias("sb"),
                reduce(lambda p, q: p + q, gaps).alias("least"), reduce(lambda p, q: p + q, spans).alias("most"),
            ).where(F.col("least") <= eps * eps)
        )
        found = judged.where(F.col("most") <= eps * eps).select("a", "b").distinct()
        links = cut_lineage(links.unionByName(found))
        open_pairs = cut_lineage(judged.join(found, ["a", "b"], "left_anti").select("a", "b", "sa", "sb"))
        level += 1
    return links


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): smallest node of each connected component.

    Labels travel along links and then jump to their label's label, so the
    number of rounds grows with the logarithm of a component's diameter.
    """
    both = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(nodes.withColumn("label", F.col("node")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b")
        seen = seen.join(labels.select(F.col("node").alias("a"), F.col("label").alias("mine")), "a")
        # the smaller label goes to the node and to the node its own label stands for
        offered = seen.where("theirs < mine").select(F.explode(F.array("a", "mine")).alias("node"), F.col("theirs").alias("label"))
        least = labels.unionByName(offered).groupBy("node").agg(F.min("label").alias("label"))
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = cut_lineage(least.join(jump, "label").select("node", F.col("further").alias("label")))
        old = labels.withColumnRenamed("label", "old")
        if after.join(old, "node").where("label <> old").isEmpty():
            return after
        labels = after


def nearest_neighbours(
    train: DataFrame, train_key: str, label: str, features: str, new: DataFrame, key: str, k: int = NEIGHBOURS, pivots: int | None = None
) -> DataFrame:
    """(key, rank, neighbour, distance, label): the ``k`` nearest training rows, exactly.

    Training rows are filed under their nearest pivot.  Rows that lie nearer
    than any bound allows cannot be in a pivot's cell whose centre is farther
    than its radius plus that bound, so a new row visits only the other cells.
    Cells and visitors are cut by hash, so a task compares bounded blocks, equal vectors once.
    ``features`` is an array column of both tables; equal distances go to the
    smaller training key.
    """
    total = train.count()
    wanted = min(PIVOTS, max(1, total // CELL_ROWS)) if pivots is None else pivots
    centres = np.array([r[0] for r in sample_rows(train, wanted, [train_key]).select(features).collect()], float)

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), len(b)))
        step = max(1, 4_000_000 // max(1, b.size))
        for i in range(0, len(a), step):
            out[i : i + step] = np.sqrt(((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
        return out

    filed_type = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    @F.pandas_udf(filed_type)
    def file_under(v: pd.Series) -> pd.DataFrame:
        dist = distances(np.stack(v.to_numpy()).astype(float), centres)
        return pd.DataFrame({"cell": dist.argmin(axis=1).astype("int32"), "far": dist.min(axis=1)})

    filed = train.select(quoted(train_key).alias("tid"), quoted(label).alias("label"), quoted(features).alias("v"))
    filed = cut_lineage(filed.withColumn("f", file_under("v")).select("tid", "label", "v", "f.*"))
    # at most PIVOTS rows
    shape = {r["cell"]: (r["radius"], r["n"]) for r in filed.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    live = np.array(sorted(shape))
    radius = np.array([shape[c][0] for c in live])
    sizes = np.array([shape[c][1] for c in live])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def visits(v: pd.Series) -> pd.Series:
        dist = distances(np.stack(v.to_numpy()).astype(float), centres[live])
        upper = dist + radius
        order = np.argsort(upper, axis=1)
        enough = (np.cumsum(sizes[order], axis=1) >= min(k, sizes.sum())).argmax(axis=1)
        bound = np.take_along_axis(upper, order, axis=1)[np.arange(len(dist)), enough]
        near = dist - radius <= (bound * (1 + 1e-9) + 1e-12)[:, None]
        return pd.Series([live[row].astype("int32").tolist() for row in near])

    asked = new.select(quoted(key).alias("qid"), quoted(features).alias("q"))
    asked = cut_lineage(asked.withColumn("cell", F.explode(visits("q"))))
    loads = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = lambda counts: F.create_map(*[z for c, n in counts.items() for z in (F.lit(int(c)), F.lit(ceil(n / CELL_ROWS)))])
    train_cuts, new_cuts = pieces({c: n for c, (_, n) in shape.items()}), pieces(loads)
    zero = F.lit(0)
    left = filed.where(F.col("cell").isin([int(c) for c in loads])).select(
        "tid", "label", "v", "cell",
        F.pmod(F.xxhash64("tid"), F.element_at(train_cuts, F.col("cell"))).cast("int").alias("ts"),
        F.explode(F.sequence(zero, F.element_at(new_cuts, F.col("cell")) - 1)).alias("qs"),
    )
    right = asked.select(
        "qid", "q", "cell",
        F.explode(F.sequence(zero, F.element_at(train_cuts, F.col("cell")) - 1)).alias("ts"),
        F.pmod(F.xxhash64("qid"), F.element_at(new_cuts, F.col("cell"))).cast("int").alias("qs"),
    )
    block = ["cell", "ts", "qs"]
    near = T.StructType(
        [
            T.StructField("distance", T.DoubleType()),
            T.StructField("tid", train.schema[train_key].dataType),
            T.StructField("label", train.schema[label].dataType),
        ]
    )
    out = T.StructType([T.StructField("qid", new.schema[key].dataType), T.StructField("best", T.ArrayType(near))])

    def compare(filed_rows: pa.Table, asked_rows: pa.Table) -> pa.Table:
        if not len(filed_rows) or not len(asked_rows):
            return pa.table({"qid": asked_rows["qid"].slice(0, 0), "best": pa.array([], to_arrow_type(out["best"].dataType))})
        filed_rows = filed_rows.sort_by("tid")
        base = vectors(filed_rows["v"])
        _, which = distinct_rows(base)
        # of equal vectors only the first k can be among the nearest
        order = np.argsort(which, kind="stable")
        group = which[order]
        first = np.sort(order[np.arange(len(order)) - np.searchsorted(group, group) < k])
        filed_rows, base = filed_rows.take(pa.array(first)), base[first]
        some, which = distinct_rows(vectors(asked_rows["q"]))
        at, square = nearest_rows(base, vectors(asked_rows["q"])[some], k)
        at, dist = at[which], np.sqrt(square[which])
        taken = filed_rows.take(pa.array(at.ravel()))
        pairs = pa.StructArray.from_arrays(
            [pa.array(dist.ravel()), taken["tid"].combine_chunks(), taken["label"].combine_chunks()], names=["distance", "tid", "label"]
        )
        best = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, at.shape[1], dtype="int32")), pairs)
        return pa.table({"qid": asked_rows["qid"].combine_chunks(), "best": best})

    found = spread_groups(left, block).groupBy(*block).cogroup(spread_groups(right, block).groupBy(*block)).applyInArrow(compare, out)
    # at most k neighbours per visited block and new row
    ranked = found.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return ranked.select(F.col("qid").alias(key), F.posexplode("best").alias("rank", "n")).select(
        key, (F.col("rank") + 1).alias("rank"), F.col("n.tid").alias("neighbour"), "n.distance", F.col("n.label").alias("label")
    )


def vectors(cells: pa.ChunkedArray) -> np.ndarray:
    """An array column as rows x dimensions."""
    return cells.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(cells), -1)


def distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a row of each kind, kind of every row)."""
    x = np.ascontiguousarray(x + 0.0)
    _, at, which = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return at, which


def nearest_rows(base: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of the ``k`` rows of ``base`` nearest to each asked row, equals by place.

    Products tell which rows can be among them, within their rounding error; only those are
    measured by differences.
    """
    n, d = base.shape
    k = min(k, n)
    places, squares = np.empty((len(asked), k), int), np.empty((len(asked), k))
    norms = (base * base).sum(1)
    table = np.vstack([-2 * base.T, norms])
    parts = max(1, n // max(64, 8 * k))
    for at in range(0, len(asked), 128):
        some = asked[at : at + 128]
        like = np.hstack([some, np.ones((len(some), 1))]) @ table
        if np.isfinite(like).all():
            # the k-th least of minima of separate rows is no smaller than the k-th least of all
            width = n // parts
            least = like[:, : parts * width].reshape(len(some), parts, width).min(1)
            limit = np.partition(least, min(k, width) - 1, axis=1)[:, min(k, width) - 1] if width >= k else np.full(len(some), np.inf)
            slack = 16 * (d + 4) * np.finfo(float).eps * ((some * some).sum(1) + norms.max())
            row, col = np.nonzero(like <= (limit + slack)[:, None])
        else:
            row, col = np.indices(like.shape).reshape(2, -1)
        square = np.empty(len(row))
        for i in range(0, len(row), step := max(1, 4_000_000 // d)):
            gap = some[row[i : i + step]] - base[col[i : i + step]]
            square[i : i + step] = (gap**2).sum(axis=1)
        order = np.lexsort((col, square, row))
        starts = np.searchsorted(row[order], np.arange(len(some)))
        chosen = order[starts[:, None] + np.arange(k)]
        places[at : at + 128], squares[at : at + 128] = col[chosen], square[chosen]
    return places, squares


def assign_clusters(train: DataFrame, train_key: str, label: str, features: str, new: DataFrame, key: str, k: int = NEIGHBOURS) -> DataFrame:
    """(key, prediction): majority label of the ``k`` nearest training rows, ties to the smaller label."""
    return knn_votes(nearest_neighbours(train, train_key, label, features, new, key, k), key, "label", "rank", k)
