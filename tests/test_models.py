"""Training, explanation and forecasting."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablescope.functions.solvers import arima, arima_many, exponential_smoothing, smooth_many
from tablescope.operators import boosting, explain, forecast, prep, sampling, series, train, trees


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        age, group = float(rng.integers(20, 60)), "ABC"[i % 3]
        salary = 1000.0 * age + {"A": 0, "B": 5000, "C": -3000}[group] + float(rng.normal(0, 100))
        rows.append((i, None if i % 40 == 7 else age, group if i % 50 else None, salary, "Yes" if age > 38 else "No"))
    return spark.createDataFrame(rows, "id bigint, Age double, Group string, Salary double, Label string")


def test_preparation(spark, people):
    for scaling in ("standard", "minmax", "robust"):
        made = prep.fit_preparation(people, ["Age"], ["Group"], scaling)
        assert made.names == ["num__Age", "cat__Group_A", "cat__Group_B", "cat__Group_C"]
        rows = made.pipeline.transform(people).select(vector_to_array(prep.FEATURES).alias("v"), "Age").toPandas()
        age = people.toPandas()["Age"]
        filled = age.fillna(age.median())
        got = np.stack(rows["v"])[:, 0]
        if scaling == "standard":
            want = (filled - filled.mean()) / filled.std(ddof=0)
        elif scaling == "minmax":
            want = (filled - filled.min()) / (filled.max() - filled.min())
        else:
            want = (filled - filled.median()) / (filled.quantile(0.75) - filled.quantile(0.25))
        np.testing.assert_allclose(got, want)
    ordinal = prep.fit_preparation(people, [], ["Group"], encoding="ordinal")
    new = spark.createDataFrame([("B",), ("Z",), (None,)], "Group string")
    assert [r[0] for r in ordinal.pipeline.transform(new).select(vector_to_array(prep.FEATURES)[0]).collect()] == [1.0, -1.0, 1.0]


def test_linear_models_match_closed_form(people):
    pdf = people.na.drop().toPandas()
    x = np.c_[(pdf["Age"] - pdf["Age"].mean()) / pdf["Age"].std(ddof=0)]
    y = pdf["Salary"].to_numpy()
    rows = people.na.drop()
    both = train.train(people, ["Group"], "Salary", "linear_regression", ["id"])
    # of all equally good coefficients of the three indicators, those that add up to zero
    assert sum(both.model.coefficients) == pytest.approx(0.0, abs=5.0)
    made = prep.fit_preparation(rows, ["Age"], [])
    prepared = made.pipeline.transform(rows).withColumn("_label", F.col("Salary"))
    for name, alpha in (("linear_regression", 0.0), ("ridge", 25.0)):
        model = train._regressor(name, {"alpha": alpha} if alpha else {}, 1, prepared).fit(prepared)
        yc = y - y.mean()
        want = float((x[:, 0] @ yc) / (x[:, 0] @ x[:, 0] + alpha))
        assert model.coefficients[0] == pytest.approx(want, rel=3e-3)
    alpha = 500.0
    model = train._regressor("lasso", {"alpha": alpha}, 1, prepared).fit(prepared)
    rho = float(x[:, 0] @ (y - y.mean())) / len(y)
    assert model.coefficients[0] == pytest.approx(np.sign(rho) * (abs(rho) - alpha), rel=1e-4)


@pytest.mark.parametrize("algorithm", ["linear_regression", "random_forest"])
def test_regression(people, algorithm):
    hyper = {"n_estimators": 10, "max_depth": 6} if algorithm == "random_forest" else {}
    made = train.train(people, ["Age", "Group", "Missing"], "Salary", algorithm, ["id"], hyper)
    assert set(made.metrics) == {"mae", "mse", "rmse", "r2"} and made.metrics["r2"] > 0.8
    assert made.importances[0][0] == "num__Age" and made.left_out == ["Missing"]
    assert made.scored.count() == 48


def test_classification_and_scoring(spark, people):
    made = train.train(people, ["Age", "Group"], "Label", "random_forest_clf", ["id"], {"n_estimators": 10, "max_depth": 3}, stratified=True)
    assert made.task == "classification" and made.classes == ["No", "Yes"]
    assert made.metrics["accuracy"] > 0.9 and made.metrics["rocAuc"] > 0.9
    new = spark.createDataFrame([(25.0,), (55.0,)], "Age double")
    assert [r["Prediction"] for r in train.score(made.pipeline, new, made.preparation.columns).collect()] == ["No", "Yes"]
    numeric = train.train(people.withColumn("Code", (F.col("Age") > 38).cast("int")).na.drop(), ["Age"], "Code", "logistic_regression", ["id"], task="classification")
    assert numeric.scored.schema["predicted"].dataType.simpleString() == "int"
    assert numeric.metrics["f1"] > 0.9


def test_bad_requests(people):
    with pytest.raises(ValueError):
        train.train(people, ["Age"], None, "ridge", ["id"])
    with pytest.raises(ValueError):
        train.train(people, ["Age"], "Salary", "nonsense", ["id"])
    with pytest.raises(ValueError):
        train.train(people, ["Age"], "Salary", "ridge", ["id"], {"alhpa": 1})
    with pytest.raises(ValueError):
        train.train(people, ["id2"], "Salary", "ridge", ["id"])


@pytest.mark.parametrize("algorithm", ["kmeans", "hierarchical"])
def test_clustering(people, algorithm):
    made = train.train(people, ["Age", "Salary"], None, algorithm, hyperparameters={"n_clusters": 3})
    assert made.scored.select("predicted").distinct().count() == 3
    assert made.metrics["silhouette"] > 0 and made.metrics["daviesBouldin"] > 0
    assert ("inertia" in made.metrics) == (algorithm == "kmeans")
    assert set(train.pca_scatter(made.scored, "predicted", ["id"]).columns) == {"id", "x", "y", "cluster"}


def test_task_rule():
    kinds = {"a": "numerical", "b": "categorical"}
    assert train.task_of("kmeans", None, kinds) == "clustering"
    assert train.task_of("random_forest", "a", kinds) == "regression"
    assert train.task_of("random_forest", "b", kinds) == "classification"


@pytest.mark.parametrize("algorithm", ["linear_regression", "random_forest"])
def test_shapley_values_add_up(people, algorithm):
    hyper = {"n_estimators": 5, "max_depth": 4} if algorithm == "random_forest" else {}
    made = train.train(people, ["Age", "Group"], "Salary", algorithm, ["id"], hyper)
    values = explain.shapley(made, people, ["id"], rows=12, permutations=16).toPandas()
    assert len(values) == 12 * 4
    total = values.groupby("id")["shapley_value"].sum()
    scored = train.score(made.pipeline, people, made.preparation.columns).toPandas().set_index("id")["Prediction"]
    # the same constant for every row: the mean output over the background rows
    gap = scored.loc[total.index] - total
    assert gap.std() < 1e-6 * scored.std()
    assert explain.global_importance(explain.shapley(made, people, ["id"], rows=12)).first()["feature"] == "num__Age"


def test_local_surrogate_finds_the_slope(people):
    made = train.train(people, ["Age"], "Salary", "linear_regression", ["id"])
    got = explain.local_surrogate(made, people, people.where("id < 3"), ["id"], samples=400).collect()
    slope = made.model.coefficients[0]
    assert len(got) == 3
    for r in got:
        assert r["weight"] == pytest.approx(slope, rel=0.05)


def test_smoothing_recovers_a_line_and_a_season():
    line = 3.0 + 2.0 * np.arange(30)
    fitted, ahead = exponential_smoothing(line, 4)
    np.testing.assert_allclose(ahead, 3.0 + 2.0 * np.arange(30, 34), rtol=1e-3)
    season = np.tile([5.0, -2.0, 1.0, -4.0], 10) + 0.5 * np.arange(40)
    _, ahead = exponential_smoothing(season, 4, 4)
    np.testing.assert_allclose(ahead, np.tile([5.0, -2.0, 1.0, -4.0], 1) + 0.5 * np.arange(40, 44), atol=0.3)


def test_arima_recovers_its_parameters():
    rng = np.random.default_rng(4)
    e = rng.normal(0, 1, 3000)
    w = np.zeros(3000)
    for i in range(1, 3000):
        w[i] = 0.6 * w[i - 1] + e[i] + 0.3 * e[i - 1]
    mean, se, found = arima(np.cumsum(w), 5)
    assert found == pytest.approx([0.6, 0.3], abs=0.08)
    assert se[0] == pytest.approx(1.0, abs=0.05) and np.all(np.diff(se) > 0)


def test_sarima_follows_the_season():
    rng = np.random.default_rng(2)
    y = np.tile([10.0, 0.0, -10.0, 5.0], 20) + rng.normal(0, 0.1, 80)
    mean, _, _ = arima(y, 4, 4)
    np.testing.assert_allclose(mean, [10.0, 0.0, -10.0, 5.0], atol=1.5)


@pytest.fixture(scope="module")
def sales(spark):
    first = dt.datetime(2026, 1, 1)
    values = [100, 120, 110, 130, 140, 150, 160, 170, 180, 190, 200, 210]
    rows = [(first + dt.timedelta(days=i), float(v), 1, i % 2) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "Date timestamp, Sales double, StoreOpen int, Promo int")


def test_detects_the_series(sales):
    row = series.detect_series(sales).first()
    assert row["is_feasible"] and row["datetime_column"] == "Date" and row["suggested_target"] == "Sales"
    assert row["target_candidates"] == ["Sales", "Promo"] and row["frequency"] == "D" and row["missing_timestamps"] == 0
    text = sales.withColumn("Date", F.date_format("Date", "yyyy-MM-dd"))
    assert series.detect_series(text).first()["datetime_column"] == "Date"
    assert not series.detect_series(sales.limit(5)).first()["is_feasible"]
    assert series.frequencies(sales, "Date").first()["multiple"] == 1.0


@pytest.mark.parametrize("algorithm", ["arima", "sarima", "holt_winters", "prophet"])
def test_forecast(sales, algorithm):
    made = forecast.forecast(sales, "Date", "Sales", algorithm=algorithm, horizon=5)
    rows = made.toPandas()
    ahead = rows[rows["kind"] == "forecast"].sort_values("step")
    assert len(ahead) == 5 and list(ahead["ts"].dt.day) == [13, 14, 15, 16, 17]
    assert (ahead["lower"] < ahead["upper"]).all()
    assert (rows["kind"] == "historical").sum() == 12 and (rows["kind"] == "residual").sum() == 3
    narrow = forecast.forecast(sales, "Date", "Sales", algorithm=algorithm, horizon=5, level=0.5).toPandas()
    narrow = narrow[narrow["kind"] == "forecast"].sort_values("step")
    assert ((narrow["upper"] - narrow["lower"]).to_numpy() < (ahead["upper"] - ahead["lower"]).to_numpy()).all()
    used = forecast.holdout_metrics(made).first()["method_used"]
    assert used == {"arima": "arima", "sarima": "sarima_fallback_arima"}.get(algorithm, "holt_winters_simple")


def test_future_calendar_matches_pandas(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31),), (dt.datetime(2024, 1, 30),)], "ts timestamp")
    for code in ("D", "W", "ME", "YE", "h"):
        got = [r["ts"] for r in series.future_calendar(df, "ts", code, 4).orderBy("step").collect()]
        want = [d.to_pydatetime() for d in pd.date_range("2024-01-31", periods=6, freq=code) if d > pd.Timestamp("2024-01-31")][:4]
        assert got == want


def test_calendar_length_matches_pandas(spark):
    spans = [("2024-01-03", "2024-05-17"), ("2024-02-29", "2026-12-31"), ("2024-01-07", "2024-01-07"), ("2023-12-31", "2024-01-01")]
    df = spark.createDataFrame([(a, b) for a, b in spans], "a string, b string")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    for code in ("D", "W", "ME", "YE", "h"):
        got = {(r["a"], r["b"]): r["n"] for r in df.select("a", "b", series.calendar_length(us("a"), us("b"), F.lit(code)).alias("n")).collect()}
        for a, b in spans:
            assert got[a, b] == len(pd.date_range(a, b, freq=code)), (code, a, b)


@pytest.mark.parametrize("period", [1, 4])
def test_series_fitted_together_as_each_alone(period):
    y = np.random.default_rng(6).normal(20, 5, (70, 23))
    for many, one in ((smooth_many, exponential_smoothing), (arima_many, arima)):
        together = many(y, 6, period)
        for i in (0, 33, 69):
            for a, b in zip(together, one(y[i], 6, period)):
                assert np.array_equal(a[i], b)


def test_series_of_all_lengths_in_one_batch(spark):
    rows = [(k, f"2024-01-{d:02d}", float((d * 7 + k) % 5)) for k in range(1, 20) for d in range(1, k + 1)]
    df = spark.createDataFrame([*rows, (None, "2024-01-01", 2.0)], "k int, at string, y double")
    made = forecast.forecast(df, "at", "y", ["k"], "holt_winters", horizon=3, period=3).toPandas()
    ahead = made[made["kind"] == "forecast"]
    assert len(ahead) == 20 * 3 and ahead["predicted"].notna().all() and ahead["actual"].isna().all()
    held = made[made["kind"] == "residual"].groupby("k").size()
    assert [held.get(n, 0) for n in range(1, 20)] == [n - (c if (c := int(n * 0.8)) >= 5 else max(1, n - 2)) for n in range(1, 20)]
    last = ahead[ahead["k"] == 19].sort_values("step")
    assert [d.strftime("%d") for d in last["ts"]] == ["20", "21", "22"]
    y = np.array([float((d * 7 + 19) % 5) for d in range(1, 20)])
    assert list(last["predicted"]) == list(exponential_smoothing(y, 3, 3)[1])


def test_rows_alike_share_their_contributions(monkeypatch):
    rng = np.random.default_rng(8)
    shape = (40, 3)
    feature = np.stack([rng.permutation(4)[:3] for _ in range(40)])
    low = np.where(rng.random(shape) < 0.5, -np.inf, np.round(rng.normal(size=shape), 1))
    allowed = np.full(shape, -1, object)
    allowed[feature == 3] = 0b0110
    low[feature == 3] = -np.inf
    leaves = trees.Leaves(rng.normal(size=40), feature, low, np.where(feature == 3, np.inf, low + 0.7), rng.uniform(0.1, 1, shape), allowed)
    x = np.round(rng.normal(size=(3000, 4)), 1)
    x[:, 3] = rng.integers(0, 4, 3000)
    x[5, 0] = np.nan
    sizes = []
    plain = trees._contributions
    monkeypatch.setattr(trees, "_contributions", lambda x, *a: sizes.append(len(x)) or plain(x, *a))
    assert np.array_equal(trees.contributions(x, leaves, 4), plain(x, leaves, 4))
    few = np.repeat(x[:10], 300, axis=0)
    assert np.array_equal(trees.contributions(few, leaves, 4), np.repeat(plain(x[:10], leaves, 4), 300, axis=0))
    assert sizes[1] <= 10


def test_scored_test_rows_are_written_once(people):
    made = train.train(people, ["Age", "Group"], "Label", "naive_bayes", ["id"])
    plan = made.scored._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "LogicalRDD" not in plan and "Relation" in plan
    assert made.scored.count() == 48 and set(made.scored.columns) >= {"id", "actual", "predicted", "score1"}


@pytest.mark.parametrize(("algorithm", "target", "key"), [("xgboost", "y", ["id"]), ("random_forest_clf", "k", ["id"]), ("kmeans", None, [])])
def test_learners_hold_bounded_parts(spark, monkeypatch, algorithm, target, key):
    """Training rows that a learner keeps are cut into partitions of bounded size, and the model is as good."""
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    table = spark.range(0, 4000, 1, 1).select("id", (F.col("id") % 97).cast("double").alias("a"), noise.alias("b"))
    table = table.withColumns({"y": F.col("a") * 2 + F.col("b"), "k": F.when(F.col("a") > 50, "u").otherwise("v")})
    hyper = {"n_clusters": 3} if target is None else {"n_estimators": 2, "max_depth": 3}
    kinds = {"a": "numerical", "b": "numerical", "y": "numerical", "k": "categorical"}
    seen, fit = [], train.Estimator.fit

    def sizes(self, df, params=None):
        seen.append([r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()])
        return fit(self, df, params)

    monkeypatch.setattr(train.Estimator, "fit", sizes)
    runs = []
    for held in (1 << 28, 500 * (240 + 8 * 2)):
        monkeypatch.setattr(train, "PART_BYTES", held, raising=False)
        seen.clear()
        runs.append((train.train(table, ["a", "b"], target, algorithm, key, hyper, kinds).metrics, max(seen, key=sum)))
    (plain, whole), (got, parts) = runs
    assert len(whole) == 1 and sum(parts) == whole[0]
    assert max(parts) <= 600 and len(parts) == -(-whole[0] // 500)
    for name, value in plain.items():
        assert got[name] == pytest.approx(value, rel=0.2, abs=0.02), name


def test_boosting_takes_groups_of_rows(spark, monkeypatch):
    """Many rows reach the learner once per combination of bins, and give the model that the same bins give on all rows."""
    hashed = F.pmod(F.xxhash64("id"), F.lit(100_000))
    table = spark.range(0, 6000, 1, 3).select("id", (hashed % 9).cast("double").alias("a"), (hashed / 777).alias("b"), (F.col("id") % 3).cast("string").alias("g"))
    table = table.withColumn("y", F.col("a") * F.col("b") + F.when(F.col("g") == "2", 500.0).otherwise(F.col("id") % 7))
    kinds = {"a": "numerical", "b": "numerical", "g": "categorical", "y": "numerical"}
    hyper = {"n_estimators": 4, "max_depth": 3}
    plain = train.train(table, ["a", "b", "g"], "y", "xgboost", ["id"], hyper, kinds)
    seen, fit = [], train.Estimator.fit
    monkeypatch.setattr(train.Estimator, "fit", lambda self, df, params=None: seen.append((type(self).__name__, df.count())) or fit(self, df, params))
    monkeypatch.setattr(boosting, "GROUPED_ROWS", 1000)
    monkeypatch.setattr(boosting, "SAMPLE", 500)
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 7000)
    made = train.train(table, ["a", "b", "g"], "y", "xgboost", ["id"], hyper, kinds)
    assert dict(seen)["GBTRegressor"] <= 9 * 32 * 3
    assert made.metrics["r2"] == pytest.approx(plain.metrics["r2"], abs=0.03) and made.metrics["r2"] > 0.9
    monkeypatch.undo()

    prepared = made.preparation.pipeline.transform(table).withColumn("_label", F.col("y"))
    part = sampling.split(prepared, ["id"], 0.2, 42).where("NOT is_test")
    monkeypatch.setattr(boosting, "SAMPLE", 500)
    groups, cuts = boosting.grouped(part, lambda rows: rows, "_features", "_label", ["id"], 4800, 32)
    rows = part.select("id", "_label", vector_to_array("_features").alias("x")).collect()
    binned = [(r.id, r._label, Vectors.dense([float(np.sum(c < v)) for c, v in zip(cuts, r.x)])) for r in rows]
    assert groups.count() == len({tuple(b[2]) for b in binned}) and groups.agg(F.sum("_weight")).first()[0] == 4800
    estimator = train.GBTRegressor(featuresCol="_features", labelCol="_label", predictionCol="_prediction", maxIter=4, maxDepth=3, stepSize=0.3, seed=42)
    on_bins = spark.createDataFrame(binned, ["id", "_label", "_features"])
    want = {r.id: r._prediction for r in estimator.fit(on_bins).transform(on_bins).collect()}
    got = {r.id: r._prediction for r in made.model.transform(part).collect()}
    assert len(got) == 4800 and [got[i] for i in want] == pytest.approx(list(want.values()), rel=1e-9)
    roots = [n for n in trees.model_nodes(made, spark).collect() if n["id"] == 0]
    assert len(roots) == 4 and all(n["rows"] == 4800 for n in roots)


def test_bins_and_their_combinations():
    rng = np.random.default_rng(2)
    assert list(boosting.bin_cuts(np.array([3.0, 1.0, 1.0, 2.0]), 32)) == [1.5, 2.5] and not len(boosting.bin_cuts(np.ones(5), 32))
    values = rng.normal(size=10_000)
    cuts = boosting.bin_cuts(values, 32)
    sizes = np.bincount(np.searchsorted(cuts, values))
    assert len(cuts) == 31 and sizes.min() > 300 and sizes.max() < 330
    bins = np.repeat(rng.integers(0, 32, (200, 30)).astype("int16"), 3, axis=0)[rng.permutation(600)]
    first, kind = boosting._kinds(bins, [32] * 30)
    assert len(first) == 200 and np.array_equal(bins[first][kind], bins)
