"""Exact Shapley values against all subsets of features, walked through the trees."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from tablescope.operators import explain, prep, train, trees


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        a, b, c, d = rng.normal(size=4).tolist()
        group, e = "uvw"[int(rng.integers(0, 3))], float(rng.integers(0, 3))
        y = 3 * a * (b > 0) + c * d + {"u": 0, "v": 2, "w": -1}[group] * e + float(rng.normal(0, 0.1))
        rows.append((i, a, b, c, d, e, group, y, "yes" if y > 0 else "no"))
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, e double, g string, y double, k string")


def expectation(by, tree, x, known):
    """Output of a tree when only some features are known: others follow the training rows."""
    def walk(node):
        if node["left"] < 0:
            return node["value"]
        left, right = by[tree, node["left"]], by[tree, node["right"]]
        f = node["feature"]
        if f in known:
            passes = x[f] in node["cuts"] if node["categories"] > 0 else x[f] <= node["cuts"][0]
            return walk(left if passes else right)
        return (left["rows"] * walk(left) + right["rows"] * walk(right)) / (left["rows"] + right["rows"])

    return walk(by[tree, 0])


def plain(nodes, x, d):
    by = {(n["tree"], n["id"]): n for n in nodes}
    weights = {n["tree"]: n["weight"] for n in nodes}
    value = {s: sum(w * expectation(by, t, x, set(s)) for t, w in weights.items()) for k in range(d + 1) for s in itertools.combinations(range(d), k)}
    out = []
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        out.append(sum(
            math.factorial(len(s)) * math.factorial(d - 1 - len(s)) / math.factorial(d) * (value[tuple(sorted((*s, i)))] - value[s])
            for k in range(d) for s in itertools.combinations(rest, k)
        ))
    return out, value[()]


FOREST = ("random_forest", "y", {"max_depth": 4, "n_estimators": 4}, 5)
MODELS = [("decision_tree", "y", {"max_depth": 6}, trees.PART_LEAVES), FOREST, ("random_forest", "k", {"max_depth": 4, "n_estimators": 3}, trees.PART_LEAVES),
          ("xgboost", "k", {"max_depth": 3, "n_estimators": 4}, trees.PART_LEAVES)]


@pytest.mark.parametrize(("algorithm", "target", "hyper", "part"), MODELS)
def test_equal_to_all_subsets(spark, table, algorithm, target, hyper, part):
    task = "regression" if target == "y" else "classification"
    made = train.train(table, ["a", "b", "c", "d", "e", "g"], target, algorithm, ["id"], hyper, task=task, encoding="ordinal")
    names = made.preparation.names
    assert len(names) == 6
    few = table.where("id < 12")
    got = trees.tree_shapley(made, few, ["id"], part_leaves=part).toPandas()
    boosted = algorithm == "xgboost"
    nodes = []
    for n in trees.model_nodes(made, spark).collect():
        n = n.asDict()
        n["value"] = n["stats"][0] / n["_sum"] if target == "k" and not boosted else -n["prediction"] if target == "k" else n["prediction"]
        nodes.append(n)
    points = made.preparation.pipeline.transform(few).select("id", vector_to_array(prep.FEATURES).alias("x")).collect()
    said = made.model.transform(made.preparation.pipeline.transform(few))
    column = "_prediction" if target == "y" else "probability" if not boosted else "rawPrediction"
    output = {r["id"]: r["o"] if target == "y" else r["o"][0] for r in said.select("id", (said[column] if target == "y" else vector_to_array(column)).alias("o")).collect()}
    for r in points:
        want, expected = plain(nodes, r["x"], 6)
        own = got[got["id"] == r["id"]].set_index("feature")
        assert own["shapley_value"][names].to_numpy() == pytest.approx(want, abs=1e-9)
        assert own["expected"].iloc[0] == pytest.approx(expected)
        assert own["shapley_value"].sum() + expected == pytest.approx(output[r["id"]])


def test_values_of_categories_and_single_leaves():
    none = trees.Leaves(np.array([2.5]), np.zeros((1, 1), int), np.full((1, 1), -np.inf), np.full((1, 1), np.inf), np.ones((1, 1)), np.full((1, 1), -1, object))
    assert none.expected == 2.5 and not trees.contributions(np.zeros((3, 2)), none, 2).any()
    nodes = [
        {"tree": 0, "weight": 1.0, "id": 0, "left": 1, "right": 2, "feature": 1, "cuts": [0.0, 2.0], "categories": 3, "rows": 10, "prediction": 0.0, "stats": [], "_sum": 0.0},
        {"tree": 0, "weight": 1.0, "id": 1, "left": -1, "right": -1, "feature": -1, "cuts": [], "categories": -1, "rows": 4, "prediction": 5.0, "stats": [], "_sum": 0.0},
        {"tree": 0, "weight": 1.0, "id": 2, "left": -1, "right": -1, "feature": -1, "cuts": [], "categories": -1, "rows": 6, "prediction": 1.0, "stats": [], "_sum": 0.0},
    ]
    leaves = trees.leaves_of(nodes, None)
    assert leaves.expected == pytest.approx(2.6)
    assert trees.contributions(np.array([[9.0, 2.0], [9.0, 1.0]]), leaves, 2).tolist() == [[0.0, pytest.approx(2.4)], [0.0, pytest.approx(-1.6)]]


def test_other_models_and_methods_are_refused(table):
    made = train.train(table, ["a", "b"], "y", "linear_regression", ["id"])
    with pytest.raises(ValueError):
        trees.tree_shapley(made, table, ["id"])
    with pytest.raises(ValueError):
        explain.shapley(made, table, ["id"], method="guess")
