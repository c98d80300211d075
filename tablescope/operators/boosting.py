"""Boosted regression trees grown on groups of rows.

Trees see a row only through the bins of its features, and so does every prediction between their rounds.  With squared
error, residuals of rows in the same bins move together, and how they vary among themselves adds the same to both sides of every
split.  So the number and the mean target of the rows of each combination of bins are all that growing needs: the rows are read
once, and Spark's learner takes the groups, with their numbers as weights, in all its passes.  Where few rows share
their bins, there are as many groups as rows and the learner does what it did on rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import quoted
from .blocks import cut_lineage, shared_folder

GROUPED_ROWS = 1_000_000
"""Training rows beyond which groups are made; fewer go to the learner as they are."""
SAMPLE = 10_000
"""Rows the bins are cut from, at least, as in Spark's own learner."""
BLOCK_CELLS = 4_000_000
"""Bins of rows a task holds before it counts them."""

WEIGHT, BINS = "_weight", "_bins"


def bin_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Where a feature is cut, by the rule of Spark's trees: between all values if they are few, else into about equal shares."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) < bins:
        return middles
    upto, stride = np.cumsum(counts), len(values) / bins
    cuts, target = [], stride
    for middle, before, after in zip(middles, upto[:-1], upto[1:]):
        if abs(before - target) < abs(after - target):
            cuts.append(middle)
            target += stride
    return np.array(cuts[: bins - 1])


def _kinds(bins: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(place of a row of each combination of bins, number of every row's combination)."""
    code, space = np.zeros(len(bins), np.int64), 1
    for column, size in zip(bins.T, sizes):
        if space * size > 1 << 62:
            code, space = np.unique(code, return_inverse=True)[1], len(bins)
        code, space = code * size + column, space * size
    _, first, kind = np.unique(code, return_index=True, return_inverse=True)
    return first, kind


def drawn(rows: DataFrame, key: Sequence[str], total: int, wanted: int) -> DataFrame:
    """About ``wanted`` of ``total`` rows by a hash of their key, the same on every run; at most twice as many if keys repeat."""
    place = F.pmod(F.xxhash64(F.lit("bins"), *[quoted(k) for k in key]), F.lit(1 << 30))
    return rows.where(place < F.lit(int(wanted / total * (1 << 30)))).orderBy(place).limit(2 * wanted)


def grouped(
    rows: DataFrame, prepare: Callable[[DataFrame], DataFrame], features: str, label: str, key: Sequence[str], total: int, bins: int
) -> tuple[DataFrame, list[np.ndarray]] | None:
    """(groups, cuts): per combination of bins (features, label, weight, bins), the features being numbers of bins.

    ``prepare`` adds the features and the label to rows.  Cuts come from a sample; None if the key does not tell rows
    apart, so that there is none.
    """
    wanted = max(SAMPLE, bins * bins)
    x = vector_to_array(features).alias("x")
    sample = prepare(drawn(rows, key, total, wanted)).select(x).collect()
    if not wanted < 2 * len(sample) < 4 * wanted:
        return None
    cuts = [bin_cuts(column, bins) for column in np.array([r["x"] for r in sample], float).T]
    sizes = [len(c) + 1 for c in cuts]

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        places, y = (np.concatenate(c) for c in zip(*held))
        first, kind = _kinds(places, sizes)
        ends = pa.array(np.arange(0, len(first) * len(cuts) + 1, len(cuts), dtype="int32"))
        found = pa.ListArray.from_arrays(ends, pa.array(places[first].ravel()))
        n, total = np.bincount(kind), np.bincount(kind, y)
        return pa.RecordBatch.from_arrays([found, pa.array(n.astype("int64")), pa.array(total)], names=[BINS, "n", "total"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
            held.append((np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], 1).astype("int16"), batch["y"].to_numpy(zero_copy_only=False)))
            cells += x.size
            if cells >= BLOCK_CELLS:
                yield counted(held)
                held, cells = [], 0
        if cells:
            yield counted(held)

    parts = prepare(rows).select(x, quoted(label).alias("y")).mapInArrow(count, f"{BINS} array<smallint>, n bigint, total double")
    groups = cut_lineage(parts.groupBy(BINS).agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    vector = array_to_vector(F.col(BINS).cast("array<double>"))
    return groups.select(vector.alias(features), (F.col("total") / F.col("n")).alias(label), F.col("n").cast("double").alias(WEIGHT), BINS), cuts


def with_cuts(model: Model, cuts: Sequence[np.ndarray], df: DataFrame) -> Model:
    """The model grown on bins as one on the features themselves: rows up to a bin are those up to its cut.

    Node counts become those of rows.  The nodes are rewritten as the table they are saved as.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tablescope/{uuid.uuid4().hex}"
    model.write().save(f"{path}/bins")
    spark.read.text(f"{path}/bins/metadata").write.text(f"{path}/cuts/metadata")
    spark.read.parquet(f"{path}/bins/treesMetadata").write.parquet(f"{path}/cuts/treesMetadata")
    data = spark.read.parquet(f"{path}/bins/data")
    known = spark.createDataFrame([(i, k, float(c)) for i, some in enumerate(cuts) for k, c in enumerate(some)], "_f int, _k bigint, _cut double")
    split, node = F.col("nodeData.split"), F.col("nodeData")
    place = F.floor(F.get(split["leftCategoriesOrThreshold"], F.lit(0)))
    here = (split["featureIndex"] == F.col("_f")) & (place == F.col("_k"))
    cut = F.when(F.col("_cut").isNotNull(), F.array("_cut")).otherwise(split["leftCategoriesOrThreshold"])
    changed = node.withField("split.leftCategoriesOrThreshold", cut).withField("rawCount", F.round(F.get(node["impurityStats"], F.lit(0))).cast("bigint"))
    data.join(F.broadcast(known), here, "left").withColumn("nodeData", changed).select(*data.columns).write.parquet(f"{path}/cuts/data")
    return type(model).load(f"{path}/cuts")
