"""The run log: one Parquet table of training and forecast runs."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

RUN_SCHEMA = (
    "run_id string, project string, dataset string, model_name string, algorithm string, task string, "
    "target string, features array<string>, hyperparameters map<string,string>, metrics map<string,double>, "
    "feature_importance array<struct<feature:string,importance:double>>, training_seconds double, created timestamp"
)


def run_row(
    spark: SparkSession,
    project: str,
    model_name: str,
    algorithm: str,
    task: str,
    hyperparameters: Mapping[str, object] | None = None,
    metrics: Mapping[str, object] | None = None,
    importances: Sequence[tuple[str, float]] = (),
    dataset: str | None = None,
    target: str | None = None,
    features: Sequence[str] = (),
    training_seconds: float | None = None,
) -> DataFrame:
    """One run as a one-row table; metrics that are not numbers are left out."""
    numbers = {k: float(v) for k, v in (metrics or {}).items() if isinstance(v, (int, float)) and v == v}
    row = (
        uuid.uuid4().hex, project, dataset, model_name, algorithm, task, target, list(features),
        {k: str(v) for k, v in (hyperparameters or {}).items()}, numbers,
        [(f, float(i)) for f, i in importances], training_seconds, dt.datetime.now(dt.timezone.utc),
    )
    return spark.createDataFrame([row], RUN_SCHEMA)


def log_run(run: DataFrame, path: str) -> None:
    """Append to the log, partitioned by project so that one project's runs prune the scan."""
    run.coalesce(1).write.mode("append").partitionBy("project").parquet(path)


def read_runs(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    runs = spark.read.parquet(path)
    return runs if project is None else runs.where(runs["project"] == project)
