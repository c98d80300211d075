"""The five-row table with known answers."""

import pytest
from pyspark.sql import functions as F

from tablescope.operators import advice, clean, findings, kinds, profile, stats
from tablescope.plans.steps import apply_step, apply_steps, steps_from_table, steps_table, undo


def test_shape_missing_duplicates(quality):
    row = profile.summary(quality).first()
    assert (row["rows"], row["columns"], row["missing_values"], row["duplicate_rows"]) == (5, 4, 1, 1)
    assert row["target_suggestion"] == "Target"


def test_kinds(quality):
    assert kinds.classify(quality, "basic") == {"Age": "numerical", "Salary": "numerical", "Target": "numerical", "City": "categorical"}
    assert kinds.classify(quality, "full") == {"Age": "numerical", "Salary": "numerical", "Target": "boolean", "City": "categorical"}


def test_statistics(quality):
    row = stats.describe_numeric(quality, ["Age"]).first()
    assert row["mean"] == 48.0 and row["median"] == 30.0 and row["mode"] == 30.0
    assert stats.describe_categorical(quality, ["City"]).first()["unique_values"] == 3


def test_correlation_matrices(quality):
    found = stats.correlations(quality, ["Age", "Salary", "Target"]).collect()
    assert len([r for r in found if r["method"] == "pearson"]) == 9
    pdf = quality.toPandas()[["Age", "Salary", "Target"]].dropna()
    for method in ("pearson", "spearman"):
        want = pdf.corr(method="pearson") if method == "pearson" else pdf.rank().corr()
        for r in found:
            if r["method"] == method:
                assert r["coefficient"] == pytest.approx(want.loc[r["column_a"], r["column_b"]])


def test_health(quality):
    row = findings.health(quality).first()
    assert row["score"] < 100
    # 5% missing, 20% duplicates (capped at 15), outliers, thin table
    assert row["missing"] == 1 and row["duplicates"] == 1
    kinds_found = {(r["kind"], r["code"]) for r in findings.health_messages(quality).collect()}
    assert ("warning", "duplicates") in kinds_found and ("warning", "thin") in kinds_found


def test_empty_table_scores_zero(quality):
    empty = quality.where("Age < 0")
    assert findings.health(empty).first()["score"] == 0


def test_impute_and_undo(quality):
    step = {"opType": "impute_missing", "params": {"column": "Salary", "strategy": "mean"}}
    cleaned = apply_step(quality, step)
    assert cleaned.where("Salary IS NULL").count() == 0
    assert cleaned.where("Age = 35").first()["Salary"] == 92500.0
    back, left = undo(quality, [step])
    assert left == [] and back.where("Salary IS NULL").count() == 1


def test_history_round_trip(spark, quality):
    steps = [
        {"opType": "remove_duplicates", "params": {}},
        {"opType": "handle_outliers", "params": {"column": "Age", "method": "iqr", "action": "drop", "threshold": 1.5}},
    ]
    assert steps_from_table(steps_table(spark, "d1", steps), "d1") == steps
    # quartiles of 25, 30, 35, 120 are 28.75 and 56.25: 120 lies beyond 97.5
    assert apply_steps(quality, steps).count() == 3


@pytest.mark.parametrize(
    "step",
    [
        {"opType": "nonsense"},
        {"opType": "impute_missing", "params": {"column": "Salary", "strategy": "nonsense"}},
        {"opType": "impute_missing", "params": {"column": "Nope"}},
        {"opType": "impute_missing", "params": {"column": "City", "strategy": "mean"}},
        {"opType": "impute_missing", "params": {"column": "Salary", "strategy": "ffill"}},
        {"opType": "impute_missing", "params": {"column": "City", "strategy": "val", "fill_value": 3}},
        {"opType": "encode_column", "params": {"column": "City", "method": "ordinal"}},
        {"opType": "scale_column", "params": {"column": "City"}},
        {"opType": "handle_outliers", "params": {"column": "Age", "action": "nonsense"}},
        {"opType": "drop_column", "params": {}},
    ],
)
def test_bad_steps_raise(quality, step):
    with pytest.raises(ValueError):
        apply_step(quality, step)


def test_zero_spread_is_unchanged(spark):
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    for method in ("standard", "minmax", "robust"):
        assert {r["x"] for r in clean.scale(flat, "x", method).collect()} == {5.0}
    assert clean.handle_outliers(flat, "x", "zscore", "drop").count() == 2


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    assert stats.describe_numeric(df, ["x"]).first()["mean"] is None
    assert clean.handle_outliers(df, "x").count() == 2
    for strategy in ("mean", "median", "mode"):
        assert clean.impute(df, "x", strategy).where("x IS NULL").count() == 2


def test_nan_becomes_null(spark):
    from tablescope.sources.tables import nan_to_null

    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "id int, x double")
    assert nan_to_null(df).where("x IS NULL").count() == 1


def test_advice(spark, quality):
    cards = {r["title"] for r in advice.advice_cards(quality).collect()}
    assert "Low health score" in cards and "Redundant columns" in cards
    importances = spark.createDataFrame([("Age", 0.9), ("Target", 0.01)], "feature string, importance double")
    found = advice.model_advice(quality, ["Age", "Target"], importances).collect()
    assert {"strength", "removal", "engineering"} <= {r["category"] for r in found}
    calm = spark.createDataFrame([(float(i), float((i * 7) % 11)) for i in range(11)], "a double, b double")
    none = spark.createDataFrame([], "feature string, importance double")
    assert [r["category"] for r in advice.model_advice(calm, ["a", "b"], none).collect()] == ["info"]


def test_context_sections(spark, quality):
    found = {r["section"] for r in advice.context(quality, steps_table(spark, "d", [{"opType": "remove_duplicates"}])).collect()}
    assert {"dataset", "health", "correlation", "step"} <= found
    assert quality.agg(F.count("*")).first()[0] == 5
