"""Replayable cleaning: a step list is data, the cleaned table is a lazy plan over the raw one."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import clean

Step = dict

# Step names and parameter names of the public interface.
_STEPS: dict[str, tuple[Callable[..., DataFrame], set[str]]] = {
    "impute_missing": (clean.impute, {"column", "strategy", "fill_value", "order_by", "partition_by"}),
    "drop_missing_rows": (clean.drop_missing, {"column"}),
    "drop_column": (clean.drop_column, {"column"}),
    "remove_duplicates": (clean.remove_duplicates, set()),
    "handle_outliers": (clean.handle_outliers, {"column", "method", "action", "threshold"}),
    "encode_column": (clean.encode, {"column", "method", "order", "order_by"}),
    "scale_column": (clean.scale, {"column", "method"}),
}


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    """One step ``{"opType": ..., "params": {...}}``; anything unknown raises ``ValueError``."""
    kind = step.get("opType")
    if kind not in _STEPS:
        raise ValueError(f"unknown cleaning step {kind!r}")
    function, allowed = _STEPS[kind]
    params = dict(step.get("params") or {})
    unknown = set(params) - allowed
    if unknown:
        raise ValueError(f"{kind}: unknown parameters {sorted(unknown)}")
    if "column" in allowed and "column" not in params and kind != "drop_missing_rows":
        raise ValueError(f"{kind}: parameter 'column' is required")
    if "threshold" in params:
        params["threshold"] = float(params["threshold"])
    return function(df, **params)


def apply_steps(raw: DataFrame, steps: Sequence[Step]) -> DataFrame:
    return reduce(apply_step, steps, raw)


def undo(raw: DataFrame, steps: Sequence[Step]) -> tuple[DataFrame, list[Step]]:
    """Take the last step back: replay all but it on the raw table."""
    if not steps:
        raise ValueError("there is no step to undo")
    left = list(steps[:-1])
    return apply_steps(raw, left), left


def steps_table(spark: SparkSession, dataset: str, steps: Sequence[Step]) -> DataFrame:
    """The history as rows (dataset, position, op_type, params JSON)."""
    rows = [(dataset, i, s["opType"], json.dumps(s.get("params") or {})) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "dataset string, position int, op_type string, params string")


def steps_from_table(table: DataFrame, dataset: str) -> list[Step]:
    """Read a history back (a handful of rows)."""
    rows = table.where(F.col("dataset") == dataset).orderBy("position").collect()
    return [{"opType": r["op_type"], "params": json.loads(r["params"])} for r in rows]
