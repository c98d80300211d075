"""Explanations of a trained pipeline, computed by scoring many changed rows in bulk."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.columns import quoted
from .prep import FEATURES
from .sampling import sample_rows
from .train import Trained
from .trees import is_tree_model, tree_shapley

# Sizes of the explained samples.
SURROGATE_FEATURES = 10
SEED = 42


def _output(scored: DataFrame, which: int) -> Column:
    """The explained number: a class probability (or raw score) for classifiers, the prediction otherwise."""
    for name in ("probability", "rawPrediction"):
        if name in scored.columns:
            return F.get(vector_to_array(name), F.lit(which))
    return F.col("_prediction").cast("double")


def _rows(trained: Trained, df: DataFrame, key: Sequence[str]) -> DataFrame:
    prepared = trained.preparation.pipeline.transform(df)
    return prepared.select(*[quoted(k) for k in key], vector_to_array(FEATURES).alias("x"))


def shapley(
    trained: Trained,
    df: DataFrame,
    key: Sequence[str],
    rows: int | None = None,
    permutations: int = 32,
    seed: int = SEED,
    background: int = 32,
    method: str = "auto",
) -> DataFrame:
    """(key, feature, feature_value, shapley_value) for all rows, or for a seeded sample of ``rows`` of them.

    Linear regressions have a closed form: coefficient times distance from the
    mean.  Tree models are explained exactly (``trees.tree_shapley``).  Other models, or all but linear ones with ``method``
    "sampled": features are switched one after another from a
    background row to the explained row, along sampled orders and their
    reverses; each switch's effect on the output belongs to its feature, and
    the effects are averaged.  All steps of all orders of all rows are scored
    as one DataFrame of rows x permutations x (features + 1) rows, spread over
    the cluster.  Per row the values add up to f(row) minus the mean output
    over the background rows.
    """
    if method not in ("auto", "sampled"):
        raise ValueError(f"unknown method {method!r}")
    if method == "auto" and is_tree_model(trained):
        return tree_shapley(trained, df if rows is None else sample_rows(df, rows, key, seed), key).drop("expected")
    points = _rows(trained, df, key)
    chosen = points if rows is None else sample_rows(points, rows, key, seed)
    names = trained.preparation.names
    d = len(names)
    label = F.array(*[F.lit(n) for n in names])
    keys = [quoted(k) for k in key]
    if trained.task == "regression" and hasattr(trained.model, "coefficients"):
        coefficients = F.array(*[F.lit(float(c)) for c in trained.model.coefficients.toArray()])
        means = points.agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(d)])).scalar()
        each = chosen.withColumn("m", means).select(*keys, "x", "m", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("i"))
        value = F.get(coefficients, F.col("i")) * (F.get("x", F.col("i")) - F.get("m", F.col("i")))
        return each.select(
            *keys, F.get(label, F.col("i")).alias("feature"), F.get("x", F.col("i")).alias("feature_value"), value.alias("shapley_value")
        )
    draw = random.Random(seed)
    orders = []
    while len(orders) < permutations:
        one = list(range(d))
        draw.shuffle(one)
        orders += [one, one[::-1]]
    orders = orders[:permutations]
    # orders take turns on a background of bounded size, an order and its reverse on the same row
    half = (permutations + 1) // 2
    drawn = [r["x"] for r in sample_rows(points, background, key, seed + 1).select("x").collect()]
    backs = [drawn[i % len(drawn)] for i in range(half)] if drawn else []
    plans = F.array(
        *[
            F.struct(
                F.lit(p).alias("p"),
                F.array(*[F.lit(i) for i in order]).alias("order"),
                F.array(*[F.lit(order.index(i)) for i in range(d)]).alias("place"),
                F.array(*[F.lit(float(v)) for v in backs[(p // 2) % len(backs)]]).alias("back"),
            )
            for p, order in enumerate(orders)
        ]
    )
    spread = (
        chosen.withColumn("plan", F.explode(plans))
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
        .withColumn(
            FEATURES,
            array_to_vector(
                F.transform(
                    F.sequence(F.lit(0), F.lit(d - 1)),
                    lambda i: F.when(F.get(F.col("plan.place"), i) < F.col("step"), F.get(F.col("x"), i)).otherwise(
                        F.get(F.col("plan.back"), i)
                    ),
                )
            ),
        )
    )
    spread = spread.repartition(*keys, F.col("plan.p"))
    scored = trained.model.transform(spread)
    scored = scored.select(*keys, "x", F.col("plan.p").alias("p"), F.col("plan.order").alias("order"), "step", _output(scored, 0).alias("f"))
    along = W.partitionBy(*keys, "p").orderBy("step")
    steps = scored.withColumn("effect", F.col("f") - F.lag("f").over(along)).where("step > 0")
    index = F.get("order", F.col("step") - 1)
    return (
        steps.groupBy(*keys, index.alias("i"))
        .agg(F.avg("effect").alias("shapley_value"), F.first(F.get("x", index)).alias("feature_value"))
        .select(*keys, F.get(label, F.col("i")).alias("feature"), "feature_value", "shapley_value")
    )


def global_importance(values: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute Shapley value, largest first."""
    return (
        values.groupBy("feature")
        .agg(F.avg(F.abs("shapley_value")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def local_surrogate(
    trained: Trained,
    df: DataFrame,
    instances: DataFrame,
    key: Sequence[str],
    samples: int = 1000,
    features: int = SURROGATE_FEATURES,
    seed: int = SEED,
) -> DataFrame:
    """(key, feature, weight): per instance the ``features`` largest weights of a local linear model.

    Every instance is perturbed ``samples`` times by normal noise of each
    feature's own deviation, all perturbed rows are scored in bulk, and a ridge
    regression weighted by exp(-distance^2 / width^2), width 0.75 sqrt(d), is
    solved per instance on its ``samples`` rows.  Noise comes from hashes, so
    results do not depend on partitioning.
    """
    names = trained.preparation.names
    d = len(names)
    points = _rows(trained, df, key)
    spreads = points.agg(*[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d)]).first()
    scale = [float(spreads[f"s{i}"] or 0.0) or 1.0 for i in range(d)]
    keys = [quoted(k) for k in key]
    unit = float(1 << 53)

    def uniform(tag: int, i: Column) -> Column:
        h = F.xxhash64(F.lit(seed), F.lit(tag), i, F.col("sample"), *keys)
        return (F.shiftrightunsigned(h, 11) + 0.5) / unit

    noise = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda i: F.when(F.col("sample") == 0, F.lit(0.0)).otherwise(
            F.sqrt(-2 * F.ln(uniform(1, i))) * F.cos(2 * np.pi * uniform(2, i))
        ),
    )
    scales = F.array(*[F.lit(s) for s in scale])
    made = (
        _rows(trained, instances, key)
        .withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .repartition(*keys, "sample")
        .withColumn("z", noise)
        .withColumn(
            FEATURES,
            array_to_vector(F.zip_with("x", F.zip_with("z", scales, lambda z, s: z * s), lambda x, e: x + e)),
        )
    )
    scored = trained.model.transform(made)
    which = 1 if trained.task == "classification" else 0
    answered = scored.select(*keys, "z", _output(scored, which).alias("f"))
    width2 = (0.75**2) * d
    out = T.StructType(
        [df.schema[k] for k in key] + [T.StructField("feature", T.StringType()), T.StructField("weight", T.DoubleType())]
    )

    def solve(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(pdf["z"].to_numpy())
        y = pdf["f"].to_numpy(float)
        w = np.exp(-(z**2).sum(axis=1) / width2)
        zc = z - np.average(z, axis=0, weights=w)
        yc = y - np.average(y, weights=w)
        beta = np.linalg.solve(zc.T @ (zc * w[:, None]) + np.eye(d), zc.T @ (w * yc))
        top = np.argsort(-np.abs(beta), kind="stable")[:features]
        return pd.DataFrame({**{k: group[i] for i, k in enumerate(key)}, "feature": [names[j] for j in top], "weight": beta[top]})

    return answered.groupBy(*keys).applyInPandas(solve, out)
