"""Feature preparation as a saved pipeline: imputation, scaling, encoding, one vector column.

All figures (medians, means, modes) are exact and computed by aggregates, then
frozen as constants in the pipeline's stages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import double, require_column
from .clean import MAX_CATEGORIES
from .quantiles import quantiles
from .stats import value_counts

FEATURES = "_features"


@dataclass
class Preparation:
    pipeline: PipelineModel
    names: list[str]
    """Names of the vector's entries: ``num__<column>`` and ``cat__<column>_<value>``."""
    columns: dict[str, str] = field(default_factory=dict)
    """Input columns and their types."""


def quantile_values(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float]]:
    found = quantiles(df, columns, probabilities)
    flat = [q.alias(f"q{i}_{j}") for i, c in enumerate(columns) for j, q in enumerate(found[c])]
    row = df.sparkSession.range(0, 1, 1, 1).select(*flat).first()
    return {c: [row[f"q{i}_{j}"] for j in range(len(probabilities))] for i, c in enumerate(columns)}


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _numeric_stage(df: DataFrame, columns: Sequence[str], scaling: str, offset: float) -> SQLTransformer:
    """Median imputation, scaling and a shift in one projection; a zero divisor counts as one."""
    medians = {c: q[0] for c, q in quantile_values(df, columns, [0.5]).items()}
    empty = [c for c in columns if medians[c] is None]
    if empty:
        raise ValueError(f"no values to learn from in {', '.join(empty)}")
    filled = {c: F.coalesce(double(c), F.lit(medians[c])) for c in columns}
    if scaling == "standard":
        aggregates = [f(filled[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.avg), ("b", F.stddev_pop))]
    elif scaling == "minmax":
        aggregates = [f(filled[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", lambda x: F.max(x) - F.min(x)))]
    elif scaling == "robust":
        aggregates = []
        filled_frame = df.select(*[filled[c].alias(c) for c in columns])
        after = quantile_values(filled_frame, columns, [0.25, 0.5, 0.75])
    elif scaling == "none":
        aggregates = []
    else:
        raise ValueError(f"unknown scaling {scaling!r}")
    row = df.agg(*aggregates).first() if aggregates else None
    made = []
    for i, c in enumerate(columns):
        if scaling == "none":
            centre, spread = 0.0, 1.0
        elif scaling == "robust":
            centre, spread = after[c][1], after[c][2] - after[c][0]
        else:
            centre, spread = row[f"a{i}"], row[f"b{i}"]
        value = f"coalesce(CAST({_sql_name(c)} AS DOUBLE), {medians[c]!r}D)"
        made.append(f"({value} - {centre!r}D) / {spread or 1.0!r}D + {offset!r}D AS {_sql_name('_num_' + c)}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__")


def _text_stage(df: DataFrame, columns: Sequence[str]) -> SQLTransformer:
    """Most frequent value (smallest of the tied) for missing text."""
    top = value_counts(df, columns).groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.count(F.lit(1)).alias("distinct")
    )
    found = {r["column"]: r for r in top.collect()}
    made = []
    for c in columns:
        if c not in found:
            raise ValueError(f"no values to learn from in {c}")
        if found[c]["distinct"] > MAX_CATEGORIES:
            raise ValueError(f"{c!r} has more than {MAX_CATEGORIES} categories")
        made.append(f"coalesce(CAST({_sql_name(c)} AS STRING), {_sql_text(found[c]['top'])}) AS {_sql_name('_cat_' + c)}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__")


def fit_preparation(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    scaling: str = "standard",
    encoding: str = "onehot",
    offset: float = 0.0,
) -> Preparation:
    """Learn the preparation on ``df``.  Unknown categories become all zeros (one-hot) or -1 (ordinal).

    ``offset`` shifts the scaled numbers; distances do not change.
    """
    for c in [*numeric, *categorical]:
        require_column(df, c)
    if not numeric and not categorical:
        raise ValueError("no numeric or categorical feature is left to train on")
    if encoding not in ("onehot", "ordinal"):
        raise ValueError(f"unknown encoding {encoding!r}")
    stages, inputs, names = [], [], []
    if numeric:
        stages.append(_numeric_stage(df, numeric, scaling, offset))
        inputs += [f"_num_{c}" for c in numeric]
        names += [f"num__{c}" for c in numeric]
    if categorical:
        filled = _text_stage(df, categorical)
        stages.append(filled)
        indexer = StringIndexer(
            inputCols=[f"_cat_{c}" for c in categorical],
            outputCols=[f"_idx_{c}" for c in categorical],
            stringOrderType="alphabetAsc",
            handleInvalid="keep",
        ).fit(filled.transform(df))
        stages.append(indexer)
        labels = dict(zip(categorical, indexer.labelsArray))
        if encoding == "onehot":
            encoder = OneHotEncoder(
                inputCols=[f"_idx_{c}" for c in categorical], outputCols=[f"_hot_{c}" for c in categorical], dropLast=True
            ).fit(indexer.transform(filled.transform(df)))
            stages.append(encoder)
            inputs += [f"_hot_{c}" for c in categorical]
            names += [f"cat__{c}_{v}" for c in categorical for v in labels[c]]
        else:
            made = [
                f"CASE WHEN {_sql_name('_idx_' + c)} < {len(labels[c])} THEN {_sql_name('_idx_' + c)} ELSE -1D END"
                f" AS {_sql_name('_hot_' + c)}"
                for c in categorical
            ]
            stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__"))
            inputs += [f"_hot_{c}" for c in categorical]
            names += [f"cat__{c}" for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    types = {c: df.schema[c].dataType.simpleString() for c in [*numeric, *categorical]}
    return Preparation(PipelineModel(stages), names, types)


def route_features(kinds: dict[str, str], features: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """(numeric, categorical, left out) of the wanted features by their kinds."""
    numeric = [f for f in features if kinds.get(f) == "numerical"]
    categorical = [f for f in features if kinds.get(f) == "categorical"]
    return numeric, categorical, [f for f in features if f not in numeric and f not in categorical]
