"""Exact Shapley values of tree models, from the paths of their leaves.

What a tree expects when only some features are known is a sum over leaves: the leaf's value, times, for each
feature on its path, 1 or 0 if the feature is known (do all its splits on the path let the row pass?), or else the share of
training rows that pass them.  For one leaf with passes z and shares r, the weighted sum over all subsets of its m
features is an integral, value * (z_i - r_i) * int_0^1 prod_{j != i} (t z_j + (1 - t) r_j) dt, of a polynomial of degree
m - 1, which Gauss-Legendre quadrature of m/2 points gives exactly.  So a row costs leaves times path length.

Nodes come from the saved model, read as a table.  Leaves are dealt into parts of bounded size; tasks take batches of rows
through all leaves of a part, and parts are added up by row and feature.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import quoted
from .blocks import shared_folder
from .prep import FEATURES
from .train import Trained

PART_LEAVES = 50_000
"""Leaves that one task takes its rows through."""
CELLS = 4_000_000
"""Numbers a task holds at a time for rows times leaves times path lengths."""

TREES = ("DecisionTree", "RandomForest", "GBT")


def is_tree_model(trained: Trained) -> bool:
    return type(trained.model).__name__.startswith(TREES)


def model_nodes(trained: Trained, spark: SparkSession) -> DataFrame:
    """(tree, weight, id, left, right, feature, cut, cuts, categories, rows, prediction, stats): nodes of a fitted model.

    The weight of a tree is its share in the model's output.
    """
    path = f"{shared_folder(spark)}/tablescope/{uuid.uuid4().hex}"
    trained.model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "_", "weight").drop("_")
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*").join(F.broadcast(weights), "tree")
        if type(trained.model).__name__.startswith("RandomForest"):
            data = data.withColumn("weight", F.lit(1.0 / trained.model.getNumTrees))
    else:
        data = data.withColumns({"tree": F.lit(0), "weight": F.lit(1.0)})
    return data.select(
        "tree", "weight", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("cuts"),
        F.col("split.numCategories").alias("categories"), F.expr("aggregate(impurityStats, 0D, (a, v) -> a + v)").alias("_sum"),
        F.col("rawCount").alias("rows"), "prediction", F.col("impurityStats").alias("stats"),
    )


@dataclass(frozen=True)
class Leaves:
    """Paths of leaves, padded to one length: a pad lets every row pass and has the share 1."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    allowed: np.ndarray
    """Categories that pass, as bits; all for features that are numbers."""

    @property
    def expected(self) -> float:
        """Output when nothing is known."""
        return float((self.value * self.share.prod(1)).sum())

    def part(self, a: int, b: int) -> Leaves:
        return Leaves(*(getattr(self, c)[a:b] for c in ("value", "feature", "low", "high", "share", "allowed")))


def leaves_of(nodes: Sequence, which: int | None, sign: float = 1.0) -> Leaves:
    """Leaves of the collected nodes; ``which`` class's probability is the value, or the prediction for None.

    Node counts are those of the rows a node was grown on.
    """
    by = {(n["tree"], n["id"]): n for n in nodes}
    paths = []
    for tree in sorted({n["tree"] for n in nodes}):
        stack: list[tuple] = [(by[tree, 0], {})]
        while stack:
            node, path = stack.pop()
            if node["left"] < 0:
                value = node["prediction"] if which is None else node["stats"][which] / max(node["_sum"], 1e-300)
                paths.append((sign * node["weight"] * value, path))
                continue
            left, right = by[tree, node["left"]], by[tree, node["right"]]
            total = left["rows"] + right["rows"]
            if node["categories"] > 0:
                bits = sum(1 << int(c) for c in node["cuts"])
                limits = ((-np.inf, np.inf, bits), (-np.inf, np.inf, ((1 << node["categories"]) - 1) & ~bits))
            else:
                cut = node["cuts"][0]
                limits = ((-np.inf, cut, -1), (cut, np.inf, -1))
            for child, (low, high, allowed) in zip((left, right), limits):
                f = node["feature"]
                a, b, bits, share = path.get(f, (-np.inf, np.inf, -1, 1.0))
                stack.append((child, {**path, f: (max(a, low), min(b, high), bits & allowed, share * child["rows"] / max(total, 1))}))
    deep = max(1, max(len(p) for _, p in paths))
    shape = (len(paths), deep)
    out = Leaves(np.array([v for v, _ in paths]), np.zeros(shape, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape), np.full(shape, -1, object))
    for i, (_, path) in enumerate(paths):
        for j, (f, (low, high, bits, share)) in enumerate(path.items()):
            out.feature[i, j], out.low[i, j], out.high[i, j], out.share[i, j], out.allowed[i, j] = f, low, high, share, bits
    return out


def _passes(x: np.ndarray, leaves: Leaves) -> np.ndarray:
    """Which features of each leaf's path let each row pass."""
    own = x[:, leaves.feature]
    good = (own > leaves.low) & (own <= leaves.high)
    for i, j in zip(*np.nonzero(leaves.allowed != -1)):
        good[:, i, j] &= np.array([bool(int(leaves.allowed[i, j]) >> int(c) & 1) for c in own[:, i, j]])
    return good


def _alike(x: np.ndarray, leaves: Leaves) -> tuple[np.ndarray, np.ndarray]:
    """(place of a row of each kind, kind of every row): rows of a kind pass the same features of every leaf's path."""
    kind = np.zeros(len(x), np.int64)
    for f in np.unique(leaves.feature):
        on = leaves.feature == f
        if (leaves.allowed[on] != -1).any():
            place = np.unique(x[:, f], return_inverse=True)[1]
        else:
            edges = np.unique(np.concatenate([leaves.low[on], leaves.high[on]]))
            place = np.where(np.isnan(x[:, f]), -1, np.searchsorted(edges, x[:, f])) + 1
        kind = np.unique(kind * (int(place.max(initial=0)) + 1) + place, return_inverse=True)[1]
    return np.unique(kind, return_index=True)[1], kind


def contributions(x: np.ndarray, leaves: Leaves, width: int) -> np.ndarray:
    """Shapley values of ``width`` features for each row of ``x``, summed over the leaves; rows no leaf tells apart share the work."""
    first, kind = _alike(x, leaves)
    return _contributions(x[first], leaves, width)[kind]


def _contributions(x: np.ndarray, leaves: Leaves, width: int) -> np.ndarray:
    out = np.zeros((len(x), width))
    deep = leaves.feature.shape[1]
    at, weight = np.polynomial.legendre.leggauss((deep + 1) // 2)
    at, weight = (at + 1) / 2, weight / 2
    step = max(1, CELLS // max(1, len(x) * deep))
    for a in range(0, len(leaves.value), step):
        some = leaves.part(a, a + step)
        z, r = _passes(x, some).astype(float), some.share[None]
        each = np.zeros_like(z)
        for t, w in zip(at, weight):
            known = t * z + (1 - t) * r  # above 0, as t is below 1 and every node has rows
            each += w * known.prod(2, keepdims=True) / known
        each *= (z - r) * some.value[None, :, None]
        flat, feature = each.reshape(len(x), -1), some.feature.ravel()
        order = np.argsort(feature, kind="stable")
        first = np.flatnonzero(np.diff(feature[order], prepend=-1))
        out[:, feature[order][first]] += np.add.reduceat(flat[:, order], first, axis=1)
    return out


def tree_shapley(trained: Trained, df: DataFrame, key: Sequence[str], which: int = 0, part_leaves: int = PART_LEAVES) -> DataFrame:
    """(key, feature, feature_value, shapley_value, expected) of every row, exact for the path-dependent expectation.

    Regressions explain the prediction, decision trees and forests of classes the probability of class number
    ``which``, boosted trees of two classes their margin for it.  Per row the values and ``expected`` (the output when
    no feature is known) add up to the output.  A model's nodes are in the driver already; rows never are.
    """
    name = type(trained.model).__name__
    if not is_tree_model(trained):
        raise ValueError(f"{name} is not a tree model")
    boosted = name.startswith("GBT")
    probability = trained.task == "classification" and not boosted
    nodes = model_nodes(trained, df.sparkSession).collect()
    leaves = leaves_of(nodes, which if probability else None, -1.0 if boosted and trained.task == "classification" and which == 0 else 1.0)
    names = trained.preparation.names
    keys = [quoted(k) for k in key]
    points = trained.preparation.pipeline.transform(df).select(*keys, vector_to_array(FEATURES).alias("x"))
    schema = T.StructType([*[df.schema[k] for k in key], T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("s", T.ArrayType(T.DoubleType()))])

    def explain(part: Leaves):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(names))
                values = contributions(x, part, len(names))
                ends = pa.array(np.arange(0, values.size + 1, len(names), dtype="int32"))
                yield batch.append_column("s", pa.ListArray.from_arrays(ends, pa.array(values.ravel())))

        return run

    cuts = range(0, len(leaves.value), part_leaves)
    parts = [points.mapInArrow(explain(leaves.part(a, a + part_leaves)), schema) for a in cuts]
    row = F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("i")
    label = F.array(*[F.lit(n) for n in names])

    def long(made: DataFrame) -> DataFrame:
        cells = made.select(*keys, "x", "s", row)
        return cells.select(*keys, F.get(label, F.col("i")).alias("feature"), F.get("x", F.col("i")).alias("feature_value"), F.get("s", F.col("i")).alias("shapley_value"))

    out = long(parts[0])
    for more in parts[1:]:
        out = out.unionByName(long(more))
    if len(parts) > 1:
        out = out.groupBy(*keys, "feature", "feature_value").agg(F.sum("shapley_value").alias("shapley_value"))
    return out.withColumn("expected", F.lit(leaves.expected))


def explained_output(values: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, output): what the values of a row and ``expected`` add up to."""
    total: Column = F.sum("shapley_value") + F.max("expected")
    return values.groupBy(*[quoted(k) for k in key]).agg(total.alias("output"))
