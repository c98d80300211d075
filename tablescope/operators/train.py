"""Training, evaluation and scoring with Spark ML."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import IndexToString, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import double, quoted, require_column
from . import boosting
from .blocks import cut_lineage
from .evaluate import auc, auc_one_vs_rest, classification_metrics, davies_bouldin, regression_metrics, silhouette_squared
from .kinds import classify
from .prep import FEATURES, Preparation, fit_preparation, route_features
from .sampling import split

MAX_CLASSES = 1_000
DEEPEST_TREE = 30
"""Spark's trees end at depth 30; asking for unlimited depth gives this."""

# Algorithm names of the public interface.
CLUSTERINGS = ["kmeans", "dbscan", "hierarchical"]
REGRESSIONS = ["linear_regression", "ridge", "lasso", "decision_tree", "random_forest", "xgboost"]
CLASSIFICATIONS = ["logistic_regression", "decision_tree", "random_forest", "svm", "naive_bayes", "xgboost"]


@dataclass
class Trained:
    task: str
    algorithm: str
    pipeline: PipelineModel
    preparation: Preparation
    metrics: dict[str, float | None]
    importances: list[tuple[str, float]]
    scored: DataFrame
    """Test rows with ``actual`` and ``predicted`` (clustering: all rows with ``predicted``)."""
    left_out: list[str] = field(default_factory=list)
    classes: list[object] = field(default_factory=list)
    seconds: float = 0.0

    @property
    def model(self) -> Model:
        return next(s for s in self.pipeline.stages if s.hasParam("predictionCol") and s.hasParam("featuresCol"))


def task_of(algorithm: str, target: str | None, kinds: Mapping[str, str]) -> str:
    if algorithm in CLUSTERINGS:
        return "clustering"
    if not target:
        raise ValueError("a target column is required")
    return "regression" if kinds.get(target) == "numerical" else "classification"


def _base(algorithm: str) -> str:
    """Both spellings of a classifier's name, with and without ``_clf``, are accepted."""
    return algorithm[: -len("_clf")] if algorithm.endswith("_clf") else algorithm


def _common() -> dict:
    return {"featuresCol": FEATURES, "labelCol": "_label", "predictionCol": "_prediction"}


def _tree(hyper: dict, seed: int) -> dict:
    depth = hyper.pop("max_depth", None)
    return {
        "maxDepth": DEEPEST_TREE if depth is None else int(depth),
        "minInstancesPerNode": int(hyper.pop("min_samples_leaf", 1)),
        "seed": seed,
    }


def _boosted(hyper: dict, seed: int) -> dict:
    return {
        "maxIter": int(hyper.pop("n_estimators", 100)),
        "maxDepth": int(hyper.pop("max_depth", 6)),
        "stepSize": float(hyper.pop("learning_rate", 0.3)),
        "seed": seed,
    }


PART_BYTES = 1 << 28
"""What one task may hold of the training rows, as Spark's learners keep them between their passes."""
ROW_BYTES, VALUE_BYTES = 240, 8
"""What they keep of a row, and of each entry of its vector."""

TINY_PENALTY = 1e-6
"""Picks the shortest of the equally good solutions when indicator columns add up to one."""


def _regressor(name: str, hyper: dict, seed: int, train: DataFrame, redundant: bool = False) -> Estimator:
    common = _common()
    if name == "linear_regression":
        return LinearRegression(**common, elasticNetParam=0.0, standardization=False, regParam=TINY_PENALTY if redundant else 0.0)
    if name == "ridge":
        # Spark divides the squared error by n and the penalty by the label's deviation
        row = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("_label").alias("sd")).first()
        penalty = float(hyper.pop("alpha", 1.0)) * (row["sd"] or 0.0) / row["n"]
        return LinearRegression(**common, elasticNetParam=0.0, standardization=False, regParam=penalty)
    if name == "lasso":
        penalty = float(hyper.pop("alpha", 1.0))
        return LinearRegression(
            **common, elasticNetParam=1.0, standardization=False, regParam=penalty, maxIter=int(hyper.pop("max_iter", 1000))
        )
    if name == "decision_tree":
        return DecisionTreeRegressor(**common, **_tree(hyper, seed))
    if name == "random_forest":
        trees = int(hyper.pop("n_estimators", 100))
        return RandomForestRegressor(**common, numTrees=trees, featureSubsetStrategy="all", **_tree(hyper, seed))
    if name == "xgboost":
        return GBTRegressor(**common, **_boosted(hyper, seed))
    raise ValueError(f"unknown regression algorithm {name!r}")


def _classifier(name: str, hyper: dict, seed: int, rows: int, classes: int) -> Estimator:
    common = _common()
    many = classes > 2
    if name == "logistic_regression":
        c = float(hyper.pop("C", 1.0))
        return LogisticRegression(
            **common, elasticNetParam=0.0, regParam=1.0 / (c * rows), standardization=False, maxIter=int(hyper.pop("max_iter", 1000))
        )
    if name == "decision_tree":
        return DecisionTreeClassifier(**common, **_tree(hyper, seed))
    if name == "random_forest":
        trees = int(hyper.pop("n_estimators", 100))
        return RandomForestClassifier(**common, numTrees=trees, featureSubsetStrategy="sqrt", **_tree(hyper, seed))
    if name == "naive_bayes":
        return NaiveBayes(**common, modelType="gaussian")
    if name == "svm":
        c = float(hyper.pop("C", 1.0))
        one: Estimator = LinearSVC(**common, regParam=1.0 / (c * rows), standardization=False, maxIter=int(hyper.pop("max_iter", 200)))
        return OneVsRest(classifier=one, **common) if many else one
    if name == "xgboost":
        one = GBTClassifier(**common, **_boosted(hyper, seed))
        return OneVsRest(classifier=one, **common) if many else one
    raise ValueError(f"unknown classification algorithm {name!r}")


def _clusterer(name: str, hyper: dict, seed: int) -> Estimator:
    if name == "kmeans":
        return KMeans(
            featuresCol=FEATURES, predictionCol="_prediction", k=int(hyper.pop("n_clusters", 8)), seed=seed,
            maxIter=int(hyper.pop("max_iter", 300)),
        )
    if name == "hierarchical":
        # divisive: the agglomerative form needs all pairs of rows
        return BisectingKMeans(
            featuresCol=FEATURES, predictionCol="_prediction", k=int(hyper.pop("n_clusters", 2)), seed=seed
        )
    raise ValueError(f"unknown clustering algorithm {name!r}; density clusters are in operators.cluster")


def feature_importances(model: Model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Tree importances, else absolute coefficients (mean over classes), largest first; zeros if there are neither."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix") and getattr(model, "numClasses", 2) > 2:
        values = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        values = np.abs(model.coefficients.toArray())
    elif hasattr(model, "models"):
        inner = [dict(feature_importances(m, names)) for m in model.models]
        values = np.array([np.mean([d[n] for d in inner]) for n in names])
    else:
        values = np.zeros(len(names))
    pairs = [(n, float(v)) for n, v in zip(names, values)]
    return sorted(pairs, key=lambda p: -p[1])


def train(
    df: DataFrame,
    features: Sequence[str],
    target: str | None,
    algorithm: str,
    key: Sequence[str] = (),
    hyperparameters: Mapping[str, object] | None = None,
    kinds: Mapping[str, str] | None = None,
    task: str | None = None,
    test_fraction: float = 0.2,
    seed: int = 42,
    stratified: bool = False,
    scaling: str = "standard",
    encoding: str = "onehot",
) -> Trained:
    """Prepare, split, fit, score the test part and compute its metrics.

    ``key`` identifies a row and drives the split.  Features that are neither
    numeric nor categorical are left out and listed in ``left_out``.  Rows
    without a target take no part.
    """
    name = _base(algorithm)
    kinds = dict(classify(df, "basic") if kinds is None else kinds)
    task = task_of(name, target, kinds) if task is None else task
    numeric, categorical, left_out = route_features(kinds, features)
    hyper = dict(hyperparameters or {})
    if task == "clustering":
        return _cluster(df, name, hyper, numeric, categorical, left_out, key, seed, scaling, encoding)
    if target is None:
        raise ValueError("a target column is required")
    require_column(df, target)
    if not key:
        raise ValueError("key columns are needed to split the rows the same way every time")
    rows = df.where(quoted(target).isNotNull())
    preparation = fit_preparation(rows, numeric, categorical, scaling, encoding)
    if task == "regression":
        return _regress(rows, target, name, hyper, preparation, left_out, key, test_fraction, seed)
    if task == "classification":
        return _classify(rows, target, name, hyper, preparation, left_out, key, test_fraction, seed, stratified)
    raise ValueError(f"unknown task {task!r}")


def _no_leftovers(name: str, hyper: dict) -> None:
    if hyper:
        raise ValueError(f"{name}: unknown hyperparameters {sorted(hyper)}")


def _part_rows(prepared: DataFrame) -> tuple[int, int]:
    """(rows, rows of the largest partition)."""
    row = prepared.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    return row["rows"] or 0, row["most"] or 0


def bounded_parts(prepared: DataFrame, columns: Sequence[str], key: Sequence[str], width: int, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``columns`` of the rows, in partitions that a learner may keep: as they are, or dealt by the key if one is too large.

    Dealt rows are in the order of their keys' hashes, so that whoever samples them finds the same ones on every run.
    """
    rows, most = sizes or _part_rows(prepared)
    allowed = max(1, PART_BYTES // (ROW_BYTES + VALUE_BYTES * width))
    kept = [quoted(c) for c in columns]
    if most <= allowed:
        return prepared.select(*kept)
    parts = -(-rows // allowed)
    if not key:
        return prepared.select(*kept).repartition(parts)
    dealt = prepared.select(*kept, F.xxhash64(*[quoted(k) for k in key]).alias("_at"))
    return dealt.repartition(parts, "_at").sortWithinPartitions("_at").drop("_at")


def _fit(
    estimator: Estimator, rows: DataFrame, columns: Sequence[str], key: Sequence[str], preparation: Preparation,
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> tuple[Model, float]:
    """The estimator fitted on ``columns`` of the prepared rows, and the seconds it took."""
    start = time.time()
    width = len(preparation.names)
    if isinstance(estimator, (LinearRegression, NaiveBayes)):  # these read the rows once and keep none
        return estimator.fit(prepare(rows)), time.time() - start
    sizes = _part_rows(rows)
    if isinstance(estimator, GBTRegressor) and sizes[0] > boosting.GROUPED_ROWS:
        made = boosting.grouped(rows, prepare, FEATURES, "_label", key, sizes[0], estimator.getMaxBins())
        if made is not None:
            groups, cuts = made
            model = estimator.setWeightCol(boosting.WEIGHT).fit(bounded_parts(groups, [FEATURES, "_label", boosting.WEIGHT], [boosting.BINS], width))
            return boosting.with_cuts(model, cuts, rows), time.time() - start
    model = estimator.fit(bounded_parts(prepare(rows), columns, key, width, sizes))
    return model, time.time() - start


def _regress(rows, target, name, hyper, preparation, left_out, key, test_fraction, seed) -> Trained:
    def prepare(part: DataFrame) -> DataFrame:
        return preparation.pipeline.transform(part).withColumn("_label", double(target))

    # only the rows of a part are prepared for it: Spark moves no filter below an assembled vector
    parted = split(rows, key, test_fraction, seed)
    part = parted.where(~F.col("is_test"))
    redundant = any(n.startswith("cat__") for n in preparation.names)
    estimator = _regressor(name, hyper, seed, prepare(part), redundant)
    _no_leftovers(name, hyper)
    model, seconds = _fit(estimator, part, [FEATURES, "_label"], key, preparation, prepare)
    scored = model.transform(prepare(parted.where("is_test"))).select(
        *[quoted(k) for k in key], F.col("_label").alias("actual"), F.col("_prediction").alias("predicted")
    )
    metrics = regression_metrics(scored, "actual", "predicted").first().asDict()
    last = SQLTransformer(statement="SELECT *, _prediction AS Prediction FROM __THIS__")
    pipeline = PipelineModel([*preparation.pipeline.stages, model, last])
    return Trained(
        "regression", name, pipeline, preparation, metrics, feature_importances(model, preparation.names), scored,
        left_out, [], seconds,
    )


def _classify(rows, target, name, hyper, preparation, left_out, key, test_fraction, seed, stratified) -> Trained:
    found = rows.select(quoted(target).alias("v")).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{target!r} has more than {MAX_CLASSES} classes")
    classes = sorted(r["v"] for r in found)
    if len(classes) < 2:
        raise ValueError(f"{target!r} has fewer than two classes")
    dtype = rows.schema[target].dataType
    codes = F.create_map(*[x for i, v in enumerate(classes) for x in (F.lit(v).cast(dtype), F.lit(float(i)))])
    prepared = preparation.pipeline.transform(rows).withColumn("_label", F.try_element_at(codes, quoted(target)))
    parted = split(prepared, key, test_fraction, seed, target if stratified else None)
    part = parted.where(~F.col("is_test"))
    estimator = _classifier(name, hyper, seed, part.count(), len(classes))
    _no_leftovers(name, hyper)
    # the class count travels with the column, so a class absent from the training part keeps its place
    part = part.withColumn("_label", F.col("_label").alias("_label", metadata=_nominal(len(classes))))
    model, seconds = _fit(estimator, part, [FEATURES, "_label"], key, preparation)
    tested = model.transform(parted.where("is_test"))
    scores = {}
    if "probability" in tested.columns:
        tested = tested.withColumn("_p", vector_to_array("probability"))
    elif "rawPrediction" in tested.columns:
        tested = tested.withColumn("_p", vector_to_array("rawPrediction"))
    if "_p" in tested.columns:
        scores = {i: f"_p{i}" for i in range(len(classes))}
        tested = tested.withColumns({c: F.get("_p", F.lit(i)) for i, c in scores.items()})
    values = F.array(*[F.lit(v).cast(dtype) for v in classes])
    scored = tested.select(
        *[quoted(k) for k in key],
        quoted(target).alias("actual"),
        F.get(values, F.col("_prediction").cast("int")).alias("predicted"),
        F.col("_label").cast("int").alias("actual_code"),
        F.col("_prediction").cast("int").alias("predicted_code"),
        *[F.col(c).alias(f"score{i}") for i, c in scores.items()],
    )
    # several metrics read the test part; preparing, splitting and scoring all rows runs once for them
    scored = cut_lineage(scored)
    metrics = classification_metrics(scored, "actual_code", "predicted_code").first().asDict()
    metrics["rocAuc"] = None
    if scores and len(classes) == 2:
        metrics["rocAuc"] = auc(scored, "actual_code", "score1").first()["auc"]
    elif scores and "probability" in tested.columns:
        metrics["rocAuc"] = auc_one_vs_rest(scored, "actual_code", {i: f"score{i}" for i in scores}).first()["auc"]
    decode = IndexToString(inputCol="_prediction", outputCol="_decoded", labels=[_as_text(v) for v in classes])
    last = SQLTransformer(statement=f"SELECT *, CAST(_decoded AS {dtype.simpleString()}) AS Prediction FROM __THIS__")
    pipeline = PipelineModel([*preparation.pipeline.stages, model, decode, last])
    return Trained(
        "classification", name, pipeline, preparation, metrics, feature_importances(model, preparation.names), scored,
        left_out, classes, seconds,
    )


def _as_text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _nominal(n: int) -> dict:
    return {"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(n)]}}


def _cluster(df, name, hyper, numeric, categorical, left_out, key, seed, scaling, encoding) -> Trained:
    # bisecting k-means splits a cluster by noise in proportion to its centre, which must not be zero
    offset = 1.0 if name == "hierarchical" else 0.0
    preparation = fit_preparation(df, numeric, categorical, scaling, encoding, offset)
    prepared = preparation.pipeline.transform(df)
    estimator = _clusterer(name, hyper, seed)
    _no_leftovers(name, hyper)
    model, seconds = _fit(estimator, prepared, [FEATURES], key, preparation)
    scored = model.transform(prepared).withColumn("predicted", F.col("_prediction"))
    metrics = clustering_metrics(scored, "predicted", FEATURES)
    if name == "kmeans":
        metrics["inertia"] = inertia(scored, "predicted", FEATURES, model.clusterCenters())
    last = SQLTransformer(statement="SELECT *, _prediction AS Prediction FROM __THIS__")
    pipeline = PipelineModel([*preparation.pipeline.stages, model, last])
    importances = [(n, 0.0) for n in preparation.names]
    return Trained("clustering", name, pipeline, preparation, metrics, importances, scored, left_out, [], seconds)


def clustering_metrics(scored: DataFrame, label: str, features: str) -> dict[str, float | None]:
    """Silhouette (squared distances) and Davies-Bouldin index of a labelled table with a vector column."""
    points = scored.select(quoted(label).alias("label"), vector_to_array(features).alias("x"))
    return {
        "silhouette": silhouette_squared(points, "label", "x").first()[0],
        "daviesBouldin": davies_bouldin(points, "label", "x").first()[0],
    }


def inertia(scored: DataFrame, label: str, features: str, centres: Sequence[np.ndarray]) -> float:
    """Sum of squared distances to the assigned centre, recomputed from the labels."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    square = F.aggregate(
        F.zip_with(vector_to_array(features), F.get(table, quoted(label)), lambda a, b: (a - b) * (a - b)),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    return scored.agg(F.sum(square)).first()[0]


def score(pipeline: PipelineModel, df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """All rows and columns of ``df`` with a ``Prediction`` column.

    ``columns`` are the training inputs and their types; inputs that ``df``
    lacks count as missing.  Works on any table size: one projection, no shuffle.
    """
    absent = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    full = df.withColumns(absent) if absent else df
    out = pipeline.transform(full)
    return out.select(*[quoted(c) for c in df.columns], "Prediction")


def pca_scatter(scored: DataFrame, label: str, key: Sequence[str], points: int = 500, seed: int = 42) -> DataFrame:
    """(key, x, y, cluster) of a seeded sample of rows on the first two principal axes of all rows."""
    from pyspark.ml.feature import PCA, StandardScaler

    from .sampling import sample_rows

    center = StandardScaler(withMean=True, withStd=False, inputCol=FEATURES, outputCol="_c").fit(scored)
    axes = PCA(k=2, inputCol="_c", outputCol="_xy").fit(center.transform(scored))
    shown = sample_rows(scored, points, key, seed).select(*[quoted(k) for k in key], quoted(label).alias("cluster"), FEATURES)
    projected = axes.transform(center.transform(shown))
    xy = vector_to_array("_xy")
    return projected.select(*[quoted(k) for k in key], F.get(xy, F.lit(0)).alias("x"), F.get(xy, F.lit(1)).alias("y"), "cluster")
