"""Metrics over scored tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import double, finite, quoted
from .blocks import TASK_ROWS, cut_lineage, running_totals, spread_groups
from .charts import score_groups
from .lookups import broadcast_if_small


def regression_metrics(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row (mae, mse, rmse, r2)."""
    y, p = double(actual), double(predicted)
    e = y - p
    return scored.where(y.isNotNull() & p.isNotNull()).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        finite(1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
    )


def confusion_matrix(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) over the grid of all labels that occur; absent pairs are 0.

    Works on the counted pairs, at most classes x classes rows.
    """
    counts = (
        scored.groupBy(quoted(label).alias("actual"), quoted(predicted).alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    classes = counts.agg(
        F.array_sort(F.array_distinct(F.flatten(F.array_agg(F.array("actual", "predicted"))))).alias("c")
    )
    grid = classes.select(F.explode("c").alias("actual"), "c").select("actual", F.explode("c").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def per_class(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, support, predicted_count, hits, precision, recall, f1), zero on division by zero."""
    pairs = scored.groupBy(quoted(label).alias("a"), quoted(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called")),
            )
        ).alias("s"),
        F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("hit"),
    )
    totals = sides.groupBy("s.class").agg(
        F.sum("s.support").alias("support"),
        F.sum("s.called").alias("predicted_count"),
        # every hit shows up on both sides
        (F.sum("hit") / 2).cast("bigint").alias("hits"),
    )
    precision = F.when(F.col("predicted_count") > 0, F.col("hits") / F.col("predicted_count")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(
        F.col("support") + F.col("predicted_count") > 0,
        2 * F.col("hits") / (F.col("support") + F.col("predicted_count")),
    ).otherwise(F.lit(0.0))
    return totals.select(
        "class", "support", "predicted_count", "hits", precision.alias("precision"), recall.alias("recall"), f1.alias("f1")
    )


def classification_metrics(scored: DataFrame, label: str, predicted: str, positive: object = 1) -> DataFrame:
    """One row (accuracy, precision, recall, f1).

    With at most two true classes the figures are those of ``positive``; with
    more they are plain means over all classes seen.
    """
    classes = per_class(scored, label, predicted)
    many = F.count_if(F.col("support") > 0) > 2
    mine = F.col("class") == F.lit(positive)

    def pick(name: str) -> Column:
        one = F.coalesce(F.max(F.when(mine, F.col(name))), F.lit(0.0))
        return F.when(many, F.avg(name)).otherwise(one).alias(name)

    return classes.agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"), pick("precision"), pick("recall"), pick("f1")
    )


def auc(scored: DataFrame, label: str, score: str, positive: object = 1, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row (auc): area under the ROC curve from tie-averaged ranks; null unless both classes occur."""
    groups = score_groups(scored, label, score, positive)
    run = running_totals(groups, {"upto": F.col("neg")}, ["score"], task_rows=task_rows)
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2.0))
    return run.agg(F.try_divide(wins, F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))


def auc_one_vs_rest(scored: DataFrame, label: str, scores: dict[object, str], task_rows: int = TASK_ROWS) -> DataFrame:
    """One row (auc): mean over classes of the class-versus-rest area.  ``scores`` maps a class to its score column.

    All classes go through one pass: the scores are unpivoted, counted per
    (class, score) and accumulated per class.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(str(v)).alias("class"),
                double(c).alias("score"),
                (quoted(label) == F.lit(v)).alias("hit"),
            )
            for v, c in scores.items()
        ]
    )
    groups = (
        scored.select(F.explode(cells).alias("s"))
        .select("s.*")
        .groupBy("class", "score")
        .agg(F.count_if(F.col("hit")).alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    )
    run = running_totals(groups, {"upto": F.col("neg")}, ["score"], ["class"], task_rows=task_rows)
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2.0))
    each = run.groupBy("class").agg(F.try_divide(wins, F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))
    return each.agg(F.when(F.count_if(F.col("auc").isNull()) == 0, F.avg("auc")).alias("auc"))


def _long(points: DataFrame, label: str, features: str) -> DataFrame:
    """(label, dim, x): one row per coordinate, features being an array column."""
    return points.select(quoted(label).alias("label"), F.posexplode(quoted(features)).alias("dim", "x")).withColumn(
        "x", F.col("x").cast("double")
    )


NARROW = 16
"""Coordinates averaged side by side; longer vectors, or of several lengths, go through one row per coordinate."""


def centroids(points: DataFrame, label: str, features: str) -> DataFrame:
    """(label, n, centre): mean vector per label."""
    size = F.size(quoted(features))
    ends = points.where(size > 0).agg(F.min(size), F.max(size)).first()
    if ends[0] is not None and ends[0] == ends[1] <= NARROW:
        x = [F.get(quoted(features), F.lit(k)).cast("double") for k in range(ends[0])]
        each = [f(v).alias(f"{tag}{k}") for k, v in enumerate(x) for tag, f in (("m", F.avg), ("n", F.count))]
        means = points.where(size > 0).groupBy(quoted(label).alias("label")).agg(*each)
        n = F.array_max(F.array(*[f"n{k}" for k in range(len(x))]))
        return means.select("label", n.alias("n"), F.array(*[f"m{k}" for k in range(len(x))]).alias("centre"))
    means = _long(points, label, features).groupBy("label", "dim").agg(F.avg("x").alias("m"), F.count("x").alias("n"))
    return means.groupBy("label").agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.array_agg(F.struct("dim", "m"))), lambda s: s["m"]).alias("centre"),
    )


PART_CLUSTERS = 1_000
"""Clusters in a part: no row holds the centroids of more than one part."""

MAX_CELLS = 16_384
"""Cells of centroids whose boxes a task holds; beyond it cells grow."""

VISITORS = 20_000
"""Clusters of other cells compared with a cell in one block."""


def _parts(clusters: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The clusters (label, ..), written, with the ``part`` each is dealt to."""
    made = cut_lineage(clusters)
    parts = max(1, -(-made.count() // size))
    return made.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(parts)).cast("int")), parts


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _matrix(cells: pa.ChunkedArray, rows: int) -> np.ndarray:
    """An array column as rows x dimensions."""
    return cells.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _gaps(centre: np.ndarray, others: np.ndarray) -> np.ndarray:
    square = np.zeros((len(centre), len(others)))
    for x, y in zip(centre.T, others.T):
        gap = x[:, None] - y[None]
        square += gap * gap
    return np.sqrt(square)


def _ratios(s: np.ndarray, top: np.ndarray, gap: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(gap > 0, (s[:, None] + top) / gap, 0.0)


def _highest(lo: np.ndarray, hi: np.ndarray, centre: np.ndarray, top: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, top, gap) of the others that have the largest (s + top) / gap for some s of a row, from ``lo`` to ``hi``; and
    per row three s with a ratio that is reached there; a bounded block at a time.

    For each other the ratio is a line in s.  The three s are both ends and where the best lines of the ends cross: a line
    that is above these two nowhere of the three is above them nowhere.
    """
    at, best = np.stack([lo, hi, lo], 1), np.zeros((len(lo), 3))
    found = [(np.zeros(0, int), np.zeros(0), np.zeros(0))]
    for start in range(0, len(lo) if len(others) else 0, step := max(1, 1_000_000 // max(1, len(others)))):
        end = min(start + step, len(lo))
        gap = _gaps(centre[start:end], others)
        each = np.arange(end - start)
        ratio = _ratios(lo[start:end], top, gap)
        first = ratio.argmax(1)
        best[start:end] = ratio[each, first][:, None]
        kept = np.zeros(gap.shape, bool)
        kept[each, first] = True
        if len(wide := np.flatnonzero(hi[start:end] > lo[start:end])):
            mine, rows, each = gap[wide], wide + start, np.arange(len(wide))
            ratio = _ratios(hi[rows], top, mine)
            last, first = ratio.argmax(1), first[wide]
            best[rows, 1] = ratio[each, last]
            kept[wide, last] = True
            a, b = mine[each, first], mine[each, last]
            with np.errstate(divide="ignore", invalid="ignore"):
                cross = (top[last] * a - top[first] * b) / (b - a)
            at[rows, 2] = np.clip(np.where(np.isfinite(cross), cross, lo[rows]), lo[rows], hi[rows])
            ratio = _ratios(at[rows, 2], top, mine)
            best[rows, 2] = np.maximum(ratio[each, first], ratio[each, last])
            kept[wide] |= ratio > best[rows, 2][:, None]
        row, other = np.nonzero(kept & (gap > 0))
        found.append((row + start, top[other], gap[row, other]))
    return *(np.concatenate(c) for c in zip(*found)), at, best


def _halving(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, cut) per inner node of a tree that halves the sample ``depth`` times, widest side first."""
    dims, cuts = np.zeros(1 << depth, int), np.zeros(1 << depth)
    parts = {1: sample}
    for node in range(1, 1 << depth):
        rows = parts.pop(node)
        if len(rows):
            dims[node] = np.ptp(rows, axis=0).argmax()
            cuts[node] = np.median(rows[:, dims[node]])
        low = rows[:, dims[node]] <= cuts[node]
        parts[2 * node], parts[2 * node + 1] = rows[low], rows[~low]
    return dims, cuts


def _visits(at: np.ndarray, best: np.ndarray, centre: np.ndarray, own: int, low: np.ndarray, high: np.ndarray, top: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) pairs: the cells whose box and largest spread could beat what a row has found."""
    apart = np.maximum(np.maximum(low - centre.max(0), centre.min(0) - high), 0)
    across = np.maximum(high - centre.min(0), centre.max(0) - low)
    nearest, farthest = np.sqrt((apart**2).sum(1)), np.sqrt((across**2).sum(1))
    other = ids != own
    with np.errstate(divide="ignore", invalid="ignore"):
        # some centre of the cell has its largest spread, and is no farther than its far corner
        sure = np.where(other, np.nan_to_num((at.min() + top) / farthest, nan=0.0, posinf=0.0), 0.0).max(initial=0.0)
    worth = np.flatnonzero(other & ((at.max() + top) * (1 + 1e-9) > max(best.min(), sure * (1 - 1e-9)) * nearest))
    rows, cells = [], []
    for start in range(0, len(at) if len(worth) else 0, step := max(1, 1_000_000 // max(1, len(worth)))):
        part = slice(start, start + step)
        square, far = (np.zeros((len(at[part]), len(worth))) for _ in range(2))
        for x, a, b in zip(centre[part].T, low[worth].T, high[worth].T):
            square += np.maximum(np.maximum(a[None] - x[:, None], x[:, None] - b[None]), 0) ** 2
            far += np.maximum(b[None] - x[:, None], x[:, None] - a[None]) ** 2
        near, far = np.sqrt(square), np.sqrt(far)
        reach = [(at[part, k][:, None] + top[worth][None]) * (1 + 1e-9) for k in range(3)]
        hit = np.logical_or.reduce([reach[k] > best[part, k][:, None] * near for k in range(3)])
        # what the cell that is sure of the most at the low end holds for the row at both ends
        each, most = np.arange(len(near)), (reach[0] / np.maximum(far, 1e-300)).argmax(1)
        sure = [(at[part, k] + top[worth[most]]) / np.maximum(far[each, most], 1e-300) * (1 - 1e-9) for k in (0, 1)]
        hit &= (reach[0] > sure[0][:, None] * near) | (reach[1] > sure[1][:, None] * near)
        r, c = np.nonzero(hit)
        rows.append(r + start)
        cells.append(ids[worth[c]])
    return np.concatenate([np.zeros(0, int), *rows]), np.concatenate([np.zeros(0, "int32"), *cells])


_FOUND = ["lo", "hi", "cross", "best_lo", "best_hi", "best_cross"]
_LINES = "centre array<double>, top double, gap double"


def _columns(table: pa.Table | pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in names]


def _taken(table: pa.Table, rows: np.ndarray, top: np.ndarray, gap: np.ndarray) -> pa.Table:
    return pa.table({"centre": table["centre"].take(pa.array(rows)), "top": top, "gap": gap})


def _beyond_cells(held: DataFrame, dimensions: int) -> DataFrame:
    """(centre, top, gap): the lines that rows of ``held`` find in the other cells that could hold more."""
    edges = [f(F.col("centre")[k]) for f in (F.min, F.max) for k in range(dimensions)]
    boxes = held.groupBy("cell").agg(F.array(*edges).alias("box"), F.max("hi").alias("top")).collect()  # at most MAX_CELLS rows
    ids = np.array([r["cell"] for r in boxes], "int32")
    box, top = np.array([r["box"] for r in boxes], float), np.array([r["top"] for r in boxes], float)
    low, high = box[:, :dimensions], box[:, dimensions:]

    def spread_out(batches):
        for batch in batches:
            cell, *found = _columns(batch, ["cell", *_FOUND])
            at, best = np.stack(found[:3], 1), np.stack(found[3:], 1)
            centre = _matrix(pa.chunked_array([batch["centre"]]), len(cell))
            order = np.argsort(cell, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                if not len(mine):
                    continue
                rows, cells = _visits(at[mine], best[mine], centre[mine], cell[mine[0]], low, high, top, ids)
                for start in range(0, len(rows), 100_000):
                    some = batch.take(pa.array(mine[rows[start : start + 100_000]]))
                    columns = [some[c] for c in ["centre", *_FOUND]]
                    yield pa.RecordBatch.from_arrays([pa.array(cells[start : start + 100_000], pa.int32()), *columns], names=["cell", "centre", *_FOUND])

    schema = "cell int, centre array<double>, " + ", ".join(f"{c} double" for c in _FOUND)
    asked = cut_lineage(held.select("cell", "centre", *_FOUND).mapInArrow(spread_out, schema))
    loads = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("pieces"))
    loads = F.broadcast(cut_lineage(loads))  # at most MAX_CELLS rows
    visitors = asked.join(loads, "cell").withColumn("piece", F.pmod(F.xxhash64("centre"), "pieces").cast("int")).drop("pieces")
    hosts = held.join(loads, "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("cell", "piece", "centre", "hi")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _taken(left, np.zeros(0, int), np.zeros(0), np.zeros(0))
        lo, hi, cross, *best = _columns(left, _FOUND)
        rows, tops, gaps, *_ = _highest(lo, hi, _matrix(left["centre"], len(left)), right["hi"].to_numpy(), _matrix(right["centre"], len(right)))
        more = np.logical_or.reduce([(s[rows] + tops) / gaps > found[rows] for s, found in zip((lo, hi, cross), best)])
        return _taken(left, rows[more], tops[more], gaps[more])

    block = ["cell", "piece"]
    pairs = spread_groups(visitors, block).groupBy(*block).cogroup(spread_groups(hosts, block).groupBy(*block))
    return pairs.applyInArrow(meet, _LINES)


def _halved(spots: DataFrame, part_clusters: int) -> tuple[DataFrame, int, int]:
    """The spots with the ``cell`` each is dealt to, dimensions, and how often space was halved for the cells."""
    size = spots.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("centre")), F.lit(1)).alias("d")).first()
    depth = max(0, int(np.ceil(np.log2(min(MAX_CELLS, max(1, size["n"] / part_clusters))))))
    share = min(1.0, (16 << depth) / max(1, size["n"]))
    drawn = spots.where(F.pmod(F.xxhash64("centre", F.lit(7)), F.lit(1_000_000)) < F.lit(int(np.ceil(share * 1_000_000)))) if depth else spots.limit(0)
    # only the cells' borders hang on these rows
    dims, cuts = _halving(np.array([r["centre"] for r in drawn.select("centre").collect()], float).reshape(-1, size["d"]), depth)

    def deal(batches):
        for batch in batches:
            centre = _matrix(pa.chunked_array([batch["centre"]]), batch.num_rows)
            node = np.ones(batch.num_rows, int)
            for _ in range(depth):
                node = 2 * node + (centre[np.arange(len(node)), dims[node]] > cuts[node])
            yield batch.append_column("cell", pa.array(node.astype("int32")))

    return spots.mapInArrow(deal, "centre array<double>, lo double, hi double, cell int"), size["d"], depth


def worst_ratios(points: DataFrame, label: str, features: str, part_clusters: int = PART_CLUSTERS) -> DataFrame:
    """(label, w): the largest (s_i + s_j) / d_ij of each cluster, s being mean distances from the centroids.

    Clusters with one centroid are a spot: others need only the largest s of it, and it asks for the whole range of
    its s at once, as the ratio to another spot is a line in s.  Spots are dealt to cells of some ``part_clusters``
    and compared inside their cell; a spot visits those other cells whose box and largest s could still hold a larger ratio,
    in bounded blocks.  Each cluster then takes the largest of its spot's few lines.  Clusters at one place have
    the ratio 0, as have those whose centroid or s is not finite.
    """
    by_label = broadcast_if_small(cut_lineage(centroids(points, label, features)))
    coords = F.transform(quoted(features), lambda x: x.cast("double"))
    spread = (
        points.select(quoted(label).alias("label"), coords.alias("x"))
        .join(by_label, "label")
        .groupBy("label")
        .agg(F.avg(F.sqrt(_squared(F.col("x"), F.col("centre")))).alias("s"), F.first("centre").alias("centre"))
    )
    clusters = cut_lineage(spread)
    sound = F.forall("centre", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.coalesce(F.abs("s") < float("inf"), F.lit(False))
    spots = cut_lineage(clusters.where(sound).groupBy("centre").agg(F.min("s").alias("lo"), F.max("s").alias("hi")))
    dealt, dimensions, depth = _halved(spots, part_clusters)

    def inside(table: pa.Table) -> pa.Table:
        lo, hi = _columns(table, ["lo", "hi"])
        centre = _matrix(table["centre"], len(table))
        rows, tops, gaps, at, best = _highest(lo, hi, centre, hi, centre)
        starts = np.searchsorted(rows, np.arange(len(table) + 1)).astype("int32")
        lines = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([pa.array(tops), pa.array(gaps)], names=["top", "gap"]))
        found = [*at.T, *best.T]
        return pa.table({"centre": table["centre"], "cell": table["cell"], **{c: np.ascontiguousarray(v) for c, v in zip(_FOUND, found)}, "lines": lines})

    schema = "centre array<double>, cell int, " + ", ".join(f"{c} double" for c in _FOUND) + ", lines array<struct<top:double,gap:double>>"
    held = spread_groups(dealt, ["cell"]).groupBy("cell").applyInArrow(inside, schema)
    best = held.select("centre", "lines")
    if depth:
        held = cut_lineage(held)
        beyond = _beyond_cells(held, dimensions).groupBy("centre").agg(F.array_agg(F.struct("top", "gap")).alias("more"))
        lines = F.concat("lines", F.coalesce("more", F.array().cast("array<struct<top:double,gap:double>>")))
        best = held.select("centre", "lines").join(beyond, "centre", "left").select("centre", lines.alias("lines"))
    several = clusters.limit(2).count() > 1
    ratio = F.array_max(F.transform("lines", lambda x: (F.col("s") + x["top"]) / x["gap"]))
    joined = clusters.join(best, "centre", "left").where(F.lit(several))
    return joined.select("label", F.coalesce(F.when(sound, ratio), F.lit(0.0)).alias("w"))


def davies_bouldin(points: DataFrame, label: str, features: str, part_clusters: int = PART_CLUSTERS) -> DataFrame:
    """One row (davies_bouldin): mean over clusters of the worst (s_i + s_j) / d_ij; null below two clusters."""
    return worst_ratios(points, label, features, part_clusters).agg(F.avg("w").alias("davies_bouldin"))


def silhouette_squared(points: DataFrame, label: str, features: str, part_clusters: int = PART_CLUSTERS) -> DataFrame:
    """One row (silhouette_squared): mean silhouette with squared Euclidean distances.

    The mean squared distance from a point to a cluster follows from the
    cluster's size, centroid and mean squared norm, so no pair of points is
    ever formed; a point meets the clusters one part after the other.  A point alone in its cluster scores 0; null
    below two clusters.
    """
    coords = F.transform(quoted(features), lambda x: x.cast("double"))
    norm = F.aggregate(F.transform(F.col("x"), lambda v: v * v), F.lit(0.0), lambda s, v: s + v)
    rows = points.select(quoted(label).alias("label"), coords.alias("x"))
    psi = rows.groupBy("label").agg(F.avg(norm).alias("psi"))
    stats, parts = _parts(centroids(points, label, features).join(psi, "label"), part_clusters)

    def distance(c: Column) -> Column:
        dot = F.aggregate(F.zip_with(F.col("x"), c["centre"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.greatest(norm + c["psi"] - 2 * dot, F.lit(0.0))

    mine = broadcast_if_small(stats.select("label", F.struct("n", "centre", "psi").alias("own")))
    scored = rows.join(mine, "label")
    nearest = []
    for p in range(parts):
        listed = stats.where(F.col("part") == p).agg(F.array_agg(F.struct("label", "centre", "psi")).alias("c"))
        scored = scored.withColumn(f"c{p}", listed.scalar())
        others = F.filter(F.col(f"c{p}"), lambda c: c["label"] != F.col("label"))
        nearest.append(F.array_min(F.transform(others, distance)))
    own = F.col("own")
    scored = scored.select(
        own["n"].alias("n"),
        (distance(own) * own["n"] / F.greatest(own["n"] - 1, F.lit(1))).alias("a"),
        F.array_min(F.array_compact(F.array(*nearest))).alias("b"),
    )
    s = F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return scored.agg(F.when(F.count("b") > 0, F.avg(s)).alias("silhouette_squared"))


def cluster_sizes(scored: DataFrame, label: str = "prediction") -> DataFrame:
    """(cluster, count)."""
    return scored.groupBy(quoted(label).alias("cluster")).agg(F.count(F.lit(1)).alias("count"))


# Comparison metrics.
LOWER_IS_BETTER = ["mae", "mse", "rmse", "daviesBouldin"]
DEFAULT_METRIC = {"regression": "r2", "classification": "f1", "clustering": "silhouette"}


def compare_runs(runs: DataFrame, metric: str | None = None) -> DataFrame:
    """One row per project: the best run by a metric, with the reason in words.

    Without ``metric`` the project's first run decides (r2, f1 or silhouette by
    its task).  Runs without the metric are passed over; equals go to the
    earlier run; if no run has it the first run is named.
    """
    first = F.min_by("task", F.struct("created", "run_id"))
    tasks = runs.groupBy("project").agg(first.alias("_task"), F.min_by("run_id", F.struct("created", "run_id")).alias("_first"))
    if metric is None:
        chosen = F.create_map(*[x for k, v in DEFAULT_METRIC.items() for x in (F.lit(k), F.lit(v))])
        tasks = tasks.withColumn("metric", F.try_element_at(chosen, F.col("_task")))
    else:
        tasks = tasks.withColumn("metric", F.lit(metric))
    scored = runs.join(tasks, "project").withColumn("score", F.try_element_at("metrics", F.col("metric")))
    lower = F.col("metric").isin(LOWER_IS_BETTER)
    merit = F.when(lower, -F.col("score")).otherwise(F.col("score"))
    best = scored.groupBy("project", "metric").agg(
        F.min_by(
            F.struct("run_id", "model_name", "algorithm", "score"),
            F.struct(
                F.col("score").isNull(),
                F.coalesce(-merit, F.lit(0.0)),
                F.col("created"),
                F.col("run_id"),
            ),
        ).alias("b")
    )
    algorithm = F.initcap(F.replace(F.col("b.algorithm"), F.lit("_"), F.lit(" ")))
    who = F.concat(F.col("b.model_name"), F.lit(" ("), algorithm, F.lit(") "))
    why = F.when(F.col("b.score").isNull(), F.lit("is the first run; none of them has this figure.")).otherwise(
        F.concat(
            F.lit("comes first: its "),
            F.upper("metric"),
            F.format_string(" of %.4f is the ", "b.score"),
            F.when(lower, F.lit("lowest")).otherwise(F.lit("highest")),
            F.lit(" of all runs."),
        )
    )
    return best.select(
        "project",
        "metric",
        F.col("b.run_id").alias("best_run"),
        F.col("b.model_name").alias("best_model"),
        F.col("b.score").alias("score"),
        F.concat(who, why).alias("reason"),
    )


def knn_votes(neighbours: DataFrame, key: str, label: str, rank: str, k: int = 5) -> DataFrame:
    """Majority label of the first ``k`` neighbours; ties go to the smaller label."""
    votes = neighbours.where(F.col(rank) <= k).groupBy(quoted(key), quoted(label)).agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(quoted(key)).agg(F.min_by(quoted(label), F.struct(-F.col("n"), quoted(label))).alias("prediction"))


def run_table(runs: DataFrame) -> DataFrame:
    """Every run beside the others of its project: (project, run_id, model_name, algorithm, task, metric, score, place),
    all its metrics, and the seconds its training took.

    The metric is the one of the run's task; runs without it have no score and come last.  Equal scores share a
    place.
    """
    chosen = F.create_map(*[x for k, v in DEFAULT_METRIC.items() for x in (F.lit(k), F.lit(v))])
    timed = runs if "training_seconds" in runs.columns else runs.withColumn("training_seconds", F.lit(None).cast("double"))
    scored = timed.withColumn("metric", F.try_element_at(chosen, F.col("task"))).withColumn("score", F.try_element_at("metrics", F.col("metric")))
    lower = F.col("metric").isin(LOWER_IS_BETTER)
    order = W.partitionBy("project", "metric").orderBy(F.when(lower, -F.col("score")).otherwise(F.col("score")).desc_nulls_last())
    return scored.select(
        "project", "run_id", "model_name", "algorithm", "task", "metric", "score", F.rank().over(order).cast("bigint").alias("place"),
        "metrics", "training_seconds",
    )
