"""CSV in and out, run log, saved pipelines."""

import pytest
from pyspark.sql import functions as F

from tablescope.operators import advice, evaluate, profile, train
from tablescope.sources import pipelines, runs, tables

EMPLOYEES = "id,name,salary,hire_date\n1,Ann,100,2020-01-01\n2,Bob,200,2020-02-01\n2,Bob,200,2020-02-01\n3,Cy,300,\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("sources")


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_csv_types_and_counts(spark, folder):
    df = tables.read_table(spark, write(folder, "employees.csv", EMPLOYEES), "csv")
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "salary": "bigint", "hire_date": "string"}
    row = profile.summary(df).first()
    assert (row["rows"], row["missing_values"], row["duplicate_rows"]) == (4, 1, 1)
    assert row["date_columns"] == ["hire_date"]


def test_csv_tokens_quotes_and_kinds(spark, folder):
    text = 'name,age,fare,open\n"Braund, Mr. ""Owen""",22,7.25,True\nX,NA,nan,False\nY,30,N/A,true\n'
    df = tables.read_table(spark, write(folder, "passengers.csv", text), "csv")
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "fare": "double", "open": "boolean"}
    rows = df.collect()
    assert rows[0]["name"] == 'Braund, Mr. "Owen"' and rows[1]["age"] is None and rows[2]["fare"] is None


def test_csv_round_trip(spark, folder, quality):
    path = str(folder / "out")
    tables.write_table(quality, path, "csv")
    again = tables.read_table(spark, path, "csv", quality.schema)
    assert sorted(again.collect(), key=str) == sorted(quality.collect(), key=str)


def test_nested_columns_are_refused(spark, folder):
    path = str(folder / "nested")
    tables.write_table(spark.range(2).select(F.array("id").alias("a")), path)
    with pytest.raises(ValueError, match="nested"):
        tables.read_table(spark, path)


def test_run_log(spark, folder):
    path = str(folder / "runs")
    for name, metrics in (("first", {"r2": 0.5, "note": "text"}), ("second", {"r2": 0.9}), ("third", {"rmse": 1.0})):
        runs.log_run(runs.run_row(spark, "p1", name, "random_forest", "regression", {"n": 1}, metrics, [("a", 0.7)]), path)
    runs.log_run(runs.run_row(spark, "p2", "other", "kmeans", "clustering", metrics={"silhouette": 0.2}), path)
    log = runs.read_runs(spark, path)
    assert log.count() == 4
    assert "note" not in log.where("model_name = 'first'").first()["metrics"]
    best = {r["project"]: r for r in evaluate.compare_runs(log).collect()}
    assert best["p1"]["best_model"] == "second" and best["p2"]["metric"] == "silhouette"
    assert "(Random Forest)" in best["p1"]["reason"] and "R2 of 0.9000 is the highest" in best["p1"]["reason"]
    by_error = evaluate.compare_runs(runs.read_runs(spark, path, "p1"), "rmse").first()
    assert by_error["best_model"] == "third" and "lowest" in by_error["reason"]
    card = advice.best_run_card(runs.read_runs(spark, path, "p1")).first()
    assert "`second`" in card["description"]


def test_saved_pipeline_scores_the_same(spark, folder, t):
    trained = train.train(t.part, ["p_size", "p_type"], "p_retailprice", "linear_regression", ["p_partkey"])
    path = pipelines.save_pipeline(trained.pipeline, str(folder / "model"))
    new = spark.createDataFrame([(5, "NEVER SEEN"), (None, None)], "p_size int, p_type string")
    a = train.score(trained.pipeline, new, trained.preparation.columns).collect()
    b = train.score(pipelines.load_pipeline(path), new, trained.preparation.columns).collect()
    assert a == b and all(r["Prediction"] is not None for r in a)


def test_csv_records_are_put_together_once(spark, folder):
    """Names, types and cells come from written records, not from the lines again."""
    path = f"{folder}/once"
    spark.createDataFrame([(i, f'a "{i}"\nb') for i in range(50)], "id int, note string").coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    got = tables.read_table(spark, path, "csv")
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(i, f'a "{i}"\nb') for i in range(50)]
