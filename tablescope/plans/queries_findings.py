"""Health, findings, advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import advice, evaluate, findings
from ..sources.tables import Tables
from .registry import query
from .shared import CHARGES, VISITS, charges, rounded, rsql, visits

_NUMBERS = ["l_quantity", "l_extendedprice", "net", "charge", "weight"]


def _outliers_sql(table: str, columns: list[str]) -> str:
    fences = ", ".join(
        f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in columns
    )
    beyond = " + ".join(
        f"count(*) FILTER ({c} < {c}_1 - 1.5 * ({c}_3 - {c}_1) OR {c} > {c}_3 + 1.5 * ({c}_3 - {c}_1))" for c in columns
    )
    cells = " + ".join(f"count({c})" for c in columns)
    return f"(SELECT {beyond} AS outliers, {cells} AS cells FROM {table}, (SELECT {fences} FROM {table}))"


def _inputs_sql(table: str, columns: list[str], numbers: list[str]) -> str:
    """CTEs ending in ``h``: the profile figures and the score."""
    missing = " + ".join(f"(count(*) - count({c}))" for c in columns)
    return f"""p AS (SELECT count(*) AS rows, {len(columns)}::BIGINT AS columns, {missing} AS missing,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS duplicates FROM {table}),
      o AS (SELECT * FROM {_outliers_sql(table, numbers)}),
      x AS (SELECT *, missing * 100.0 / (rows * columns) AS missing_pct, duplicates * 100.0 / rows AS duplicate_pct,
                   outliers * 100.0 / cells AS outlier_pct, rows * 1.0 / columns AS depth FROM p, o),
      h AS (SELECT *, greatest(0, least(100, 100 - least(30, floor(missing_pct)) - least(15, floor(duplicate_pct))
              - CASE WHEN outlier_pct > 5 THEN least(10, floor((outlier_pct - 5) * 0.5)) ELSE 0 END
              - CASE WHEN depth < 10 THEN 10 ELSE 0 END))::BIGINT AS score FROM x)"""


_VISITS_INPUTS = f"WITH {VISITS}, {_inputs_sql('visits', ['user_id', 'event_type', 'value'], ['user_id', 'value'])}"
_CHARGES_INPUTS = f"WITH {CHARGES}, {_inputs_sql('charges', [*_NUMBERS, 'l_returnflag', 'currency'], _NUMBERS)}"


@query("health_visits", f"{_VISITS_INPUTS} SELECT score, rows, columns, missing, duplicates, outliers, cells FROM h")
def health_visits(t: Tables) -> DataFrame:
    return findings.health(visits(t))


@query("health_charges", f"{_CHARGES_INPUTS} SELECT score, rows, columns, missing, duplicates, outliers, cells FROM h")
def health_charges(t: Tables) -> DataFrame:
    return findings.health(charges(t))


@query(
    "health_messages",
    f"""{_VISITS_INPUTS},
  m AS (
    SELECT 'strength' AS kind, 'missing' AS code, 'No missing values detected.' AS message, missing = 0 AS ok FROM h
    UNION ALL SELECT 'warning', 'missing', printf('Missing values occupy %.1f%% of total cells.', missing_pct), missing > 0 FROM h
    UNION ALL SELECT 'recommendation', 'missing', 'Apply Imputation (Mean, Median, or Mode) to clean missing values.', missing > 0 FROM h
    UNION ALL SELECT 'strength', 'duplicates', 'No duplicate rows found.', duplicates = 0 FROM h
    UNION ALL SELECT 'warning', 'duplicates', printf('Duplicate rows account for %.1f%% of the dataset.', duplicate_pct), duplicates > 0 FROM h
    UNION ALL SELECT 'recommendation', 'duplicates', 'Remove duplicate rows using the duplicate removal action.', duplicates > 0 FROM h
    UNION ALL SELECT 'warning', 'outliers', printf('Significant outliers detected in numerical columns (%.1f%% of values).', outlier_pct), outlier_pct > 5 FROM h
    UNION ALL SELECT 'recommendation', 'outliers', 'Handle outliers using IQR/Z-score clipping or dropping.', outlier_pct > 5 FROM h
    UNION ALL SELECT 'strength', 'outliers', 'Numerical data is free of extreme outliers.', outlier_pct = 0 FROM h
    UNION ALL SELECT 'warning', 'thin', 'Low row-to-column ratio (fewer than 10 rows per column). Highly vulnerable to overfitting.', depth < 10 FROM h
    UNION ALL SELECT 'recommendation', 'thin', 'Collect more data rows or drop non-essential features/columns.', depth < 10 FROM h
    UNION ALL SELECT 'strength', 'deep', 'High row-to-column ratio, providing strong support for statistical models.', depth > 100 FROM h)
  SELECT kind, code, message FROM m WHERE ok""",
)
def health_messages(t: Tables) -> DataFrame:
    return findings.health_messages(visits(t))


@query("outlier_share", f"WITH {CHARGES} SELECT outliers, cells FROM {_outliers_sql('charges', _NUMBERS)}")
def outlier_share(t: Tables) -> DataFrame:
    return findings.outlier_share(charges(t), _NUMBERS)


def _pairs_sql(above: float) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {rsql(f'corr({a}, {b})', 6)} AS coefficient FROM charges "
        f"HAVING abs(corr({a}, {b})) > {above}"
        for i, a in enumerate(_NUMBERS)
        for b in _NUMBERS[i + 1 :]
    )


@query("collinear_pairs", f"WITH {CHARGES} {_pairs_sql(0.85)}")
def collinear_pairs(t: Tables) -> DataFrame:
    out = findings.strong_pairs(charges(t), _NUMBERS, findings.COLLINEAR)
    return out.select("column_a", "column_b", rounded("coefficient", 6).alias("coefficient"))


@query("strong_pairs", f"WITH {CHARGES} {_pairs_sql(0.6)}")
def strong_pairs(t: Tables) -> DataFrame:
    out = findings.strong_pairs(charges(t), _NUMBERS, findings.STRONG)
    return out.select("column_a", "column_b", rounded("coefficient", 6).alias("coefficient"))


_SKEWS = " UNION ALL ".join(f"SELECT '{c}' AS c, skewness({c}) AS s, {i} AS i FROM charges" for i, c in enumerate(_NUMBERS))


@query(
    "most_skewed",
    f"""WITH {CHARGES}, k AS ({_SKEWS})
        SELECT c AS "column", {rsql('abs(s)')} AS abs_skewness FROM k ORDER BY abs(s) DESC, i LIMIT 1""",
)
def most_skewed(t: Tables) -> DataFrame:
    return findings.most_skewed(charges(t), _NUMBERS).withColumn("abs_skewness", rounded("abs_skewness"))


_PAIR_LIST = " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM charges"
    for i, a in enumerate(_NUMBERS)
    for j, b in enumerate(_NUMBERS)
    if i < j
)


@query(
    "findings",
    f"""WITH {CHARGES}, k AS ({_SKEWS}), pairs AS ({_PAIR_LIST}),
  three AS (SELECT * FROM pairs WHERE r > 0.85 ORDER BY i, j LIMIT 3)
  SELECT 'warning' AS kind, 'collinear' AS code, 'Columns that repeat each other' AS title, 'These columns move together: '
         || string_agg(printf('%s and %s (%.2f)', a, b, r), ', ' ORDER BY i, j) || '.' AS message, 'Keep one column of each pair.' AS action
  FROM three HAVING count(*) > 0
  UNION ALL (SELECT 'info', 'skewed', 'A column with a long tail', printf('The skewness of ''%s'' is %.2f in size.', c, abs(s)), 'Try a logarithm or power of it.'
             FROM k WHERE abs(s) > 2 AND abs(s) = (SELECT max(abs(s)) FROM k))
  UNION ALL SELECT 'success', 'target', 'A likely target', '''l_extendedprice'', a column of kind numerical, may be the one to predict.', 'Train a regression model on it.'
  UNION ALL SELECT 'warning', 'constant', 'Columns that never vary', 'Always the same: currency.', 'Leave them out of models.' FROM charges HAVING count(DISTINCT currency) = 1""",
)
def all_findings(t: Tables) -> DataFrame:
    return findings.findings(charges(t))


def _with_rate(t: Tables) -> DataFrame:
    """The charges with a number that never varies."""
    return charges(t).withColumn("rate", F.lit(0.19))


@query(
    "findings_constant_number",
    f"""WITH {CHARGES}, k AS ({_SKEWS}), pairs AS ({_PAIR_LIST}),
  three AS (SELECT * FROM pairs WHERE r > 0.85 ORDER BY i, j LIMIT 3)
  SELECT 'warning' AS kind, 'collinear' AS code, 'Columns that repeat each other' AS title, 'These columns move together: '
         || string_agg(printf('%s and %s (%.2f)', a, b, r), ', ' ORDER BY i, j) || '.' AS message, 'Keep one column of each pair.' AS action
  FROM three HAVING count(*) > 0
  UNION ALL (SELECT 'info', 'skewed', 'A column with a long tail', printf('The skewness of ''%s'' is %.2f in size.', c, abs(s)), 'Try a logarithm or power of it.'
             FROM k WHERE abs(s) > 2 AND abs(s) = (SELECT max(abs(s)) FROM k))
  UNION ALL SELECT 'success', 'target', 'A likely target', '''l_extendedprice'', a column of kind numerical, may be the one to predict.', 'Train a regression model on it.'
  UNION ALL SELECT 'warning', 'constant', 'Columns that never vary', 'Always the same: currency, rate.', 'Leave them out of models.' FROM charges HAVING count(DISTINCT currency) = 1""",
)
def findings_constant_number(t: Tables) -> DataFrame:
    return findings.findings(_with_rate(t))


def runs_from_lines(t: Tables) -> DataFrame:
    """A run log made from the line items: one "model" per line number and status, one project per return flag."""
    r = F.corr("l_quantity", "l_extendedprice")
    made = t.lineitem.groupBy("l_returnflag", "l_linenumber", "l_linestatus").agg(
        F.round(r * r, 6).alias("r2"),
        F.round(F.stddev_samp("l_extendedprice"), 2).alias("rmse"),
        F.min("l_shipdate").alias("first"),
        F.count(F.lit(1)).alias("lines"),
    )
    name = F.concat(F.lit("price_"), F.col("l_linenumber").cast("string"), F.lower("l_linestatus"))
    return made.select(
        name.alias("run_id"),
        F.col("l_returnflag").alias("project"),
        name.alias("model_name"),
        F.lit("linear_regression").alias("algorithm"),
        F.lit("regression").alias("task"),
        F.when(
            F.col("l_linenumber") == 7, F.create_map(F.lit("rmse"), F.col("rmse"))
        ).otherwise(F.create_map(F.lit("r2"), F.col("r2"), F.lit("rmse"), F.col("rmse"))).alias("metrics"),
        (F.col("lines") / 1000).alias("training_seconds"),
        F.col("first").cast("timestamp").alias("created"),
    )


RUNS = """runs AS (SELECT 'price_' || l_linenumber || lower(l_linestatus) AS run_id, l_returnflag AS project, min(l_shipdate) AS created,
    CASE WHEN l_linenumber <> 7 THEN round(corr(l_quantity, l_extendedprice) * corr(l_quantity, l_extendedprice), 6) END AS r2,
    round(stddev_samp(l_extendedprice), 2) AS rmse, count(*) AS lines FROM lineitem GROUP BY l_returnflag, l_linenumber, l_linestatus)"""


def _compare_sql(metric: str, direction: str) -> str:
    better = "lowest" if direction == "ASC" else "highest"
    return f"""WITH {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {metric} IS NULL, {metric} {direction}, created, run_id) AS rn FROM runs)
      SELECT project, '{metric}' AS metric, run_id AS best_run, run_id AS best_model, {metric} AS score,
             printf('%s (Linear Regression) comes first: its {metric.upper()} of %.4f is the {better} of all runs.', run_id, {metric}) AS reason
      FROM k WHERE rn = 1"""


@query("compare_runs", _compare_sql("r2", "DESC"))
def compare_runs(t: Tables) -> DataFrame:
    return evaluate.compare_runs(runs_from_lines(t))


@query("compare_runs_by_error", _compare_sql("rmse", "ASC"))
def compare_runs_by_error(t: Tables) -> DataFrame:
    return evaluate.compare_runs(runs_from_lines(t), "rmse")


@query(
    "run_table",
    f"""WITH {RUNS} SELECT project, run_id, run_id AS model_name, 'linear_regression' AS algorithm, 'regression' AS task, 'r2' AS metric, r2 AS score,
        rank() OVER (PARTITION BY project ORDER BY r2 DESC NULLS LAST) AS place, r2, rmse, lines / 1000 AS training_seconds FROM runs""",
)
def run_table(t: Tables) -> DataFrame:
    made = evaluate.run_table(runs_from_lines(t))
    return made.select("*", *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in ("r2", "rmse")]).drop("metrics")


@query(
    "advice_cards",
    f"""{_CHARGES_INPUTS}, pairs AS ({_PAIR_LIST}), {RUNS}
  SELECT 'Data Quality' AS category, CASE WHEN score < 85 THEN 'Low health score' ELSE 'Good health score' END AS title,
         CASE WHEN score < 85 THEN printf('Health is %d%%: look at missing cells and repeated rows first.', score)
              ELSE 'Nothing in the profile stands against training on this table.' END AS description,
         printf('Health Score = %d%%', score) AS evidence, CASE WHEN score < 85 THEN 0.95 ELSE 0.90 END::DOUBLE AS confidence FROM h
  UNION ALL (SELECT 'Feature Engineering', 'Redundant columns', printf('`%s` and `%s` say nearly the same; drop one of them.', a, b), printf('Pearson Correlation = %.3f', r), 0.98 FROM pairs WHERE r > 0.85 ORDER BY i, j LIMIT 1)
  UNION ALL SELECT 'Model Performance', 'Best run so far',
         printf('Run `%s` (%s) scores highest, with %.4f.', arg_max(run_id, (coalesce(r2, 0), -epoch(created::TIMESTAMP))), 'linear_regression', max(coalesce(r2, 0))),
         printf('Metric Score = %.4f', max(coalesce(r2, 0))), 0.92 FROM runs HAVING count(*) > 1""",
)
def advice_cards(t: Tables) -> DataFrame:
    cards = advice.advice_cards(charges(t), runs_from_lines(t))
    return cards


_RATED_INPUTS = f"WITH {CHARGES}, rated AS (SELECT *, 0.19::DOUBLE AS rate FROM charges), {_inputs_sql('rated', [*_NUMBERS, 'l_returnflag', 'currency', 'rate'], [*_NUMBERS, 'rate'])}"


@query(
    "advice_cards_constant",
    f"""{_RATED_INPUTS}, pairs AS ({_PAIR_LIST}), {RUNS}
  SELECT 'Data Quality' AS category, CASE WHEN score < 85 THEN 'Low health score' ELSE 'Good health score' END AS title,
         CASE WHEN score < 85 THEN printf('Health is %d%%: look at missing cells and repeated rows first.', score)
              ELSE 'Nothing in the profile stands against training on this table.' END AS description,
         printf('Health Score = %d%%', score) AS evidence, CASE WHEN score < 85 THEN 0.95 ELSE 0.90 END::DOUBLE AS confidence FROM h
  UNION ALL (SELECT 'Feature Engineering', 'Redundant columns', printf('`%s` and `%s` say nearly the same; drop one of them.', a, b), printf('Pearson Correlation = %.3f', r), 0.98 FROM pairs WHERE r > 0.85 ORDER BY i, j LIMIT 1)
  UNION ALL SELECT 'Model Performance', 'Best run so far',
         printf('Run `%s` (%s) scores highest, with %.4f.', arg_max(run_id, (coalesce(r2, 0), -epoch(created::TIMESTAMP))), 'linear_regression', max(coalesce(r2, 0))),
         printf('Metric Score = %.4f', max(coalesce(r2, 0))), 0.92 FROM runs HAVING count(*) > 1""",
)
def advice_cards_constant(t: Tables) -> DataFrame:
    cards = advice.advice_cards(_with_rate(t), runs_from_lines(t))
    return cards


@query(
    "model_advice",
    f"""WITH {CHARGES}, k AS ({_SKEWS}), pairs AS ({_PAIR_LIST}),
  imp AS (SELECT a AS feature, round(r * r, 6) AS importance FROM pairs WHERE b = 'weight'),
  best AS (SELECT * FROM imp WHERE importance > 0 ORDER BY importance DESC, feature LIMIT 3),
  last AS (SELECT * FROM (SELECT * FROM imp ORDER BY importance, feature DESC LIMIT 3) WHERE importance <= 0.05)
  SELECT 'strength' AS category, 'What the model relies on' AS title, 'The model relies most on ' || string_agg('`' || feature || '`', ', ' ORDER BY importance DESC, feature)
         || '; check these columns with the most care.' AS description
  FROM best HAVING count(*) > 0
  UNION ALL SELECT 'removal', 'What the model ignores', 'The model hardly uses ' || string_agg('`' || feature || '`', ', ' ORDER BY importance DESC, feature)
         || '; the next run can do without.' FROM last HAVING count(*) > 0
  UNION ALL SELECT 'multicollinearity', 'Inputs that repeat each other', printf('`%s` and `%s` correlate at %.2f; one of them is enough.', a, b, r)
         FROM pairs WHERE r > 0.85
  UNION ALL SELECT 'engineering', 'An input with a long tail', printf('`%s` has a skewness of %.2f; log1p may serve models that work with distances or weights.', c, s)
         FROM k WHERE abs(s) > 1.5""",
)
def model_advice(t: Tables) -> DataFrame:
    """Importances are the squared correlations with the weight."""
    df = charges(t)
    shares = df.agg(
        *[F.round(F.corr(c, "weight") * F.corr(c, "weight"), 6).alias(c) for c in _NUMBERS[:-1]]
    ).unpivot([], _NUMBERS[:-1], "feature", "importance")
    return advice.model_advice(df, _NUMBERS, shares)


@query("workspace_context")
def workspace_context(t: Tables) -> DataFrame:
    runs = runs_from_lines(t).withColumn(
        "feature_importance",
        F.array(F.struct(F.lit("l_quantity").alias("feature"), F.try_element_at("metrics", F.lit("r2")).alias("importance"))),
    )
    return advice.context(charges(t), runs=runs)
