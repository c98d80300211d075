"""Splits, metrics, training, scoring, explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import cluster, evaluate, explain, sampling, train, trees
from ..operators.blocks import cut_lineage
from ..operators.quantiles import quantiles
from ..sources.tables import Tables
from .queries_charts import SCORED_LINES, judged_documents, scored_lines
from .registry import query
from .shared import rounded, rsql

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("split_counts", "SELECT count(*) AS rows, ceil(count(*) * 0.2)::BIGINT AS test_rows FROM orders")
def split_counts(t: Tables) -> DataFrame:
    parted = sampling.split(t.orders, ["o_orderkey"], 0.2)
    return parted.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test_rows"))


def _strata_sql(label: str, table: str) -> str:
    return f"""WITH c AS (SELECT {label}, count(*) AS n FROM {table} GROUP BY 1),
  e AS (SELECT {label}, n, n * ceil(sum(n) OVER () * 0.2) / sum(n) OVER () AS share, ceil(sum(n) OVER () * 0.2) AS wanted,
               (n * ceil(sum(n) OVER () * 0.2)::BIGINT) % (sum(n) OVER ())::BIGINT AS rest FROM c),
  f AS (SELECT *, floor(share) AS base, wanted - sum(floor(share)) OVER () AS spare,
               row_number() OVER (ORDER BY rest DESC, {label}::VARCHAR) AS rn FROM e)
  SELECT {label}, n AS rows, (base + CASE WHEN rn <= spare THEN 1 ELSE 0 END)::BIGINT AS test_rows FROM f"""


def _strata(parted: DataFrame, label: str) -> DataFrame:
    return parted.groupBy(label).agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test_rows"))


@query("stratified_split_counts", _strata_sql("quality", "labels"))
def stratified_split_counts(t: Tables) -> DataFrame:
    return _strata(sampling.split(t.labels, ["doc_id"], 0.2, label="quality"), "quality")


@query("stratified_split_by_part", _strata_sql("l_partkey", "lineitem"))
def stratified_split_by_part(t: Tables) -> DataFrame:
    """As many classes as there are parts."""
    return _strata(sampling.split(t.lineitem, LINE_KEY, 0.2, label="l_partkey"), "l_partkey")


@query(
    "regression_metrics",
    f"""WITH {SCORED_LINES} SELECT {rsql('avg(abs(actual - predicted))')} AS mae,
        {rsql('avg((actual - predicted) * (actual - predicted))', 0)} AS mse,
        {rsql('sqrt(avg((actual - predicted) * (actual - predicted)))')} AS rmse,
        {rsql('1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual)', 6)} AS r2 FROM scored""",
)
def regression_metrics(t: Tables) -> DataFrame:
    m = evaluate.regression_metrics(scored_lines(t), "actual", "predicted")
    return m.select(
        rounded("mae").alias("mae"), rounded("mse", 0).alias("mse"), rounded("rmse").alias("rmse"), rounded("r2", 6).alias("r2")
    )


@query(
    "confusion_matrix",
    """WITH c AS (SELECT quality AS v FROM labels UNION SELECT toxic FROM labels)
  SELECT a.v AS actual, p.v AS predicted, (SELECT count(*) FROM labels WHERE quality = a.v AND toxic = p.v) AS n FROM c a, c p""",
)
def confusion_matrix(t: Tables) -> DataFrame:
    return evaluate.confusion_matrix(t.labels, "quality", "toxic")


@query(
    "class_metrics",
    f"""WITH k AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
        count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = toxic) AS hit, count(*) AS n FROM labels)
  SELECT {rsql('hit / n', 8)} AS accuracy, {rsql('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END', 8)} AS precision,
         {rsql('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END', 8)} AS recall,
         {rsql('CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END', 8)} AS f1 FROM k""",
)
def class_metrics(t: Tables) -> DataFrame:
    m = evaluate.classification_metrics(t.labels, "quality", "toxic")
    return m.select(*[rounded(c, 8).alias(c) for c in m.columns])


def many_classes(t: Tables) -> DataFrame:
    """Nearest thousand of the price against the line number's, as a seven-class stand-in."""
    guess = (F.floor(F.col("l_extendedprice") / 15000) + 1).cast("int")
    return t.lineitem.select(F.col("l_linenumber").alias("actual"), guess.alias("predicted"), "l_quantity", "l_tax", "l_discount")


_MANY = """s AS (SELECT l_linenumber AS a, (floor(l_extendedprice / 15000) + 1)::INT AS p FROM lineitem),
  c AS (SELECT a AS v FROM s UNION SELECT p FROM s),
  k AS (SELECT v, (SELECT count(*) FROM s WHERE a = v) AS support, (SELECT count(*) FROM s WHERE p = v) AS called,
               (SELECT count(*) FROM s WHERE a = v AND p = v) AS hits FROM c)"""


@query(
    "class_metrics_macro",
    f"""WITH {_MANY} SELECT {rsql('sum(hits) / sum(support)', 8)} AS accuracy,
  {rsql('avg(CASE WHEN called > 0 THEN hits / called ELSE 0 END)', 8)} AS precision,
  {rsql('avg(CASE WHEN support > 0 THEN hits / support ELSE 0 END)', 8)} AS recall,
  {rsql('avg(CASE WHEN support + called > 0 THEN 2 * hits / (support + called) ELSE 0 END)', 8)} AS f1 FROM k""",
)
def class_metrics_macro(t: Tables) -> DataFrame:
    m = evaluate.classification_metrics(many_classes(t), "actual", "predicted")
    return m.select(*[rounded(c, 8).alias(c) for c in m.columns])


@query(
    "class_report",
    f"""WITH {_MANY} SELECT v AS class, support, called AS predicted_count, hits,
  {rsql('CASE WHEN called > 0 THEN hits / called ELSE 0 END', 8)} AS precision,
  {rsql('CASE WHEN support > 0 THEN hits / support ELSE 0 END', 8)} AS recall,
  {rsql('CASE WHEN support + called > 0 THEN 2 * hits / (support + called) ELSE 0 END', 8)} AS f1 FROM k""",
)
def class_report(t: Tables) -> DataFrame:
    m = evaluate.per_class(many_classes(t), "actual", "predicted")
    return m.withColumns({c: rounded(c, 8) for c in ("precision", "recall", "f1")})


def _auc_sql(source: str) -> str:
    """Mann-Whitney statistic over a query giving hit and score."""
    return f"""WITH s AS ({source}), r AS (SELECT hit, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM s)
      SELECT {rsql('(sum(k) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2) / (count(*) FILTER (hit) * count(*) FILTER (NOT hit))', 8)} AS auc FROM r"""


@query("auc", _auc_sql("SELECT quality = 1 AS hit, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id)"))
def auc(t: Tables) -> DataFrame:
    return evaluate.auc(judged_documents(t), "quality", "n_chars").select(rounded("auc", 8).alias("auc"))


@query(
    "auc_one_vs_rest",
    f"""WITH s AS (SELECT l_returnflag AS y, 'A' AS c, l_quantity AS score FROM lineitem UNION ALL SELECT l_returnflag, 'N', l_tax FROM lineitem
          UNION ALL SELECT l_returnflag, 'R', l_discount FROM lineitem),
  r AS (SELECT c, y = c AS hit, rank() OVER (PARTITION BY c ORDER BY score) + (count(*) OVER (PARTITION BY c, score) - 1) / 2.0 AS k FROM s),
  a AS (SELECT c, (sum(k) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2) / (count(*) FILTER (hit) * count(*) FILTER (NOT hit)) AS auc FROM r GROUP BY c)
  SELECT {rsql('avg(auc)', 8)} AS auc FROM a""",
)
def auc_one_vs_rest(t: Tables) -> DataFrame:
    m = evaluate.auc_one_vs_rest(t.lineitem, "l_returnflag", {"A": "l_quantity", "N": "l_tax", "R": "l_discount"})
    return m.select(rounded("auc", 8).alias("auc"))


_CENTRES = """pts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
  cen AS (SELECT label, d, avg(x) AS c FROM pts GROUP BY 1, 2),
  dist AS (SELECT p.label, p.vec_id, sqrt(sum((x - c) * (x - c))) AS r FROM pts p JOIN cen USING (label, d) GROUP BY 1, 2),
  spread AS (SELECT label, avg(r) AS s FROM dist GROUP BY 1)"""


@query(
    "davies_bouldin",
    f"""WITH {_CENTRES}, gap AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m
      FROM cen a JOIN cen b ON a.d = b.d AND a.label <> b.label GROUP BY 1, 2),
  worst AS (SELECT i, max((p.s + q.s) / m) AS w FROM gap JOIN spread p ON p.label = i JOIN spread q ON q.label = j GROUP BY i)
  SELECT {rsql('avg(w)', 6)} AS davies_bouldin FROM worst""",
)
def davies_bouldin(t: Tables) -> DataFrame:
    return evaluate.davies_bouldin(t.embeddings, "label", "embedding").select(
        rounded("davies_bouldin", 6).alias("davies_bouldin")
    )


@query(
    "davies_bouldin_of_orders",
    f"""WITH p AS (SELECT l_orderkey AS label, l_quantity AS x, 100 * l_discount AS y FROM lineitem),
  cen AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY label),
  spread AS (SELECT label, cx, cy, avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS s FROM p JOIN cen USING (label) GROUP BY label, cx, cy),
  worst AS (SELECT a.label, max(coalesce((a.s + b.s) / nullif(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)), 0), 0)) AS w
            FROM spread a JOIN spread b ON a.label <> b.label GROUP BY a.label)
  SELECT count(*) AS clusters, {rsql('median(w)', 3)} AS middle FROM worst""",
)
def davies_bouldin_of_orders(t: Tables) -> DataFrame:
    """As many clusters as orders; the middle of the worst ratios, as their mean hangs on the closest centroids."""
    points = t.lineitem.select("l_orderkey", F.array("l_quantity", 100 * F.col("l_discount")).alias("v"))
    worst = cut_lineage(evaluate.worst_ratios(points, "l_orderkey", "v"))
    clusters = worst.count()
    middle = quantiles(worst, ["w"], [0.5], clusters)["w"][0]
    return t.spark.range(0, 1, 1, 1).select(F.lit(clusters).cast("bigint").alias("clusters"), rounded(middle, 3).alias("middle"))


@query(
    "silhouette_squared",
    f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
  d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v) ** 2) AS s, count(*) AS n
        FROM e a, e b GROUP BY 1, 2, 3),
  m AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS n,
               max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY 1)
  SELECT {rsql('avg(CASE WHEN n <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END)', 6)} AS silhouette_squared FROM m""",
)
def silhouette_squared(t: Tables) -> DataFrame:
    return evaluate.silhouette_squared(t.embeddings, "label", "embedding").select(
        rounded("silhouette_squared", 6).alias("silhouette_squared")
    )


@query(
    "simple_regression",
    f"""SELECT 'tax' AS term, {rsql('regr_slope(charge, tax)', 2)} AS estimate FROM
          (SELECT l_extendedprice * (1 + l_tax) AS charge, l_tax AS tax FROM lineitem)
        UNION ALL SELECT 'intercept', {rsql('regr_intercept(charge, tax)', 2)} FROM
          (SELECT l_extendedprice * (1 + l_tax) AS charge, l_tax AS tax FROM lineitem)""",
)
def simple_regression(t: Tables) -> DataFrame:
    """Least squares by Spark ML on all rows, unscaled."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = t.lineitem.select((F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("charge"), F.col("l_tax").alias("tax"))
    made = VectorAssembler(inputCols=["tax"], outputCol="x").transform(rows)
    model = LinearRegression(featuresCol="x", labelCol="charge", regParam=0.0, solver="normal").fit(made)
    terms = {"tax": float(model.coefficients[0]), "intercept": float(model.intercept)}
    out = F.array(*[F.struct(F.lit(k).alias("term"), F.lit(round(v, 2)).alias("estimate")) for k, v in terms.items()])
    return t.spark.range(0, 1, 1, 1).select(F.explode(out).alias("r")).select("r.*")


def _metrics(t: Tables, trained: train.Trained) -> DataFrame:
    """(metric, value) rows of a run."""
    pairs = [
        F.struct(F.lit(k).alias("metric"), F.lit(None if v is None else float(v)).cast("double").alias("value"))
        for k, v in trained.metrics.items()
    ]
    return t.spark.range(0, 1, 1, 1).select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def price_model(t: Tables, algorithm: str, **hyper: object) -> train.Trained:
    lines = t.lineitem.withColumn("charge", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return train.train(
        lines, ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"], "charge", algorithm, LINE_KEY, hyper, seed=7
    )


def expensive_model(t: Tables, algorithm: str, **hyper: object) -> train.Trained:
    orders = t.orders.withColumn("expensive", F.when(F.col("o_totalprice") > 250000, "yes").otherwise("no"))
    return train.train(
        orders, ["o_totalprice", "o_custkey", "o_orderstatus"], "expensive", algorithm, ["o_orderkey"], hyper,
        stratified=True, seed=7,
    )


def flag_model(t: Tables, algorithm: str, **hyper: object) -> train.Trained:
    return train.train(
        t.lineitem, ["l_quantity", "l_extendedprice", "l_linestatus"], "l_returnflag", algorithm, LINE_KEY, hyper, seed=7
    )


_TREES = {"max_depth": 5}
_FEW_TREES = {"max_depth": 5, "n_estimators": 10}


@query("train_linear")
def train_linear(t: Tables) -> DataFrame:
    return _metrics(t, price_model(t, "linear_regression"))


@query("train_ridge")
def train_ridge(t: Tables) -> DataFrame:
    return _metrics(t, price_model(t, "ridge", alpha=2.0))


@query("train_lasso")
def train_lasso(t: Tables) -> DataFrame:
    return _metrics(t, price_model(t, "lasso", alpha=10.0))


@query("train_tree")
def train_tree(t: Tables) -> DataFrame:
    return _metrics(t, price_model(t, "decision_tree", **_TREES))


@query("train_forest")
def train_forest(t: Tables) -> DataFrame:
    return _metrics(t, price_model(t, "random_forest", **_FEW_TREES))


@query("train_boosted")
def train_boosted(t: Tables) -> DataFrame:
    return _metrics(t, price_model(t, "xgboost", n_estimators=10, max_depth=4))


@query("classify_logistic")
def classify_logistic(t: Tables) -> DataFrame:
    return _metrics(t, expensive_model(t, "logistic_regression"))


@query("classify_tree")
def classify_tree(t: Tables) -> DataFrame:
    return _metrics(t, expensive_model(t, "decision_tree_clf", **_TREES))


@query("classify_forest")
def classify_forest(t: Tables) -> DataFrame:
    return _metrics(t, flag_model(t, "random_forest_clf", **_FEW_TREES))


@query("classify_svm")
def classify_svm(t: Tables) -> DataFrame:
    return _metrics(t, expensive_model(t, "svm", max_iter=50))


@query("classify_bayes")
def classify_bayes(t: Tables) -> DataFrame:
    return _metrics(t, flag_model(t, "naive_bayes"))


@query("classify_boosted")
def classify_boosted(t: Tables) -> DataFrame:
    return _metrics(t, expensive_model(t, "xgboost_clf", n_estimators=5, max_depth=3))


def _clusters(t: Tables, algorithm: str, k: int) -> train.Trained:
    return train.train(t.part, ["p_size", "p_retailprice"], None, algorithm, ["p_partkey"], {"n_clusters": k})


@query("cluster_kmeans")
def cluster_kmeans(t: Tables) -> DataFrame:
    return _metrics(t, _clusters(t, "kmeans", 4))


@query("cluster_bisecting")
def cluster_bisecting(t: Tables) -> DataFrame:
    return _metrics(t, _clusters(t, "hierarchical", 4))


@query("cluster_scatter")
def cluster_scatter(t: Tables) -> DataFrame:
    return train.pca_scatter(_clusters(t, "kmeans", 4).scored, "predicted", ["p_partkey"])


@query("score_orders")
def score_orders(t: Tables) -> DataFrame:
    """Every order with its decoded prediction; the model's third column is absent and counts as missing."""
    trained = expensive_model(t, "decision_tree", **_TREES)
    return train.score(trained.pipeline, t.orders.drop("o_orderstatus"), trained.preparation.columns)


@query("importances")
def importances(t: Tables) -> DataFrame:
    trained = price_model(t, "random_forest", **_FEW_TREES)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("importance")) for f, v in trained.importances])
    return t.spark.range(0, 1, 1, 1).select(F.explode(rows).alias("r")).select("r.*")


@query("shapley_linear")
def shapley_linear(t: Tables) -> DataFrame:
    return explain.global_importance(explain.shapley(price_model(t, "linear_regression"), t.lineitem, LINE_KEY, rows=None))


def _marked_orders(t: Tables) -> DataFrame:
    """Orders with two marks, and a figure the marks decide."""
    marked = t.orders.withColumns({"dear": (F.col("o_totalprice") > 150000).cast("double"), "rush": F.col("o_orderpriority").startswith("1").cast("double")})
    return marked.withColumn("fee", 100 * F.col("dear") + 10 * F.col("rush") + 5 * F.col("dear") * F.col("rush"))


_FEES = """SELECT o_orderkey, 100.0 * (o_totalprice > 150000)::INT + 10.0 * (o_orderpriority LIKE '1%')::INT
    + 5.0 * (o_totalprice > 150000 AND o_orderpriority LIKE '1%')::INT AS output FROM orders"""


@query("shapley_tree_sums", _FEES)
def shapley_tree_sums(t: Tables) -> DataFrame:
    """Exact values of a tree, added up per order: they give back what the tree says."""
    orders = _marked_orders(t)
    grown = train.train(orders, ["dear", "rush"], "fee", "decision_tree", ["o_orderkey"], {"max_depth": 4}, task="regression")
    made = trees.explained_output(trees.tree_shapley(grown, orders, ["o_orderkey"]), ["o_orderkey"])
    return made.select("o_orderkey", F.round("output", 6).alias("output"))


@query("shapley_forest_sums", "SELECT o_orderkey, true AS same FROM orders")
def shapley_forest_sums(t: Tables) -> DataFrame:
    """Exact values of a forest against its own predictions."""
    grown = train.train(t.orders, ["o_custkey", "o_orderpriority"], "o_totalprice", "random_forest", ["o_orderkey"], _FEW_TREES)
    made = trees.explained_output(trees.tree_shapley(grown, t.orders, ["o_orderkey"]), ["o_orderkey"])
    said = train.score(grown.pipeline, t.orders, grown.preparation.columns).select("o_orderkey", "Prediction")
    return made.join(said, "o_orderkey").select("o_orderkey", (F.abs(F.col("output") - F.col("Prediction")) < 1e-6 * F.abs("Prediction")).alias("same"))


@query("score_lines_exact", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(3 * l_quantity - 40 * l_discount + CASE l_returnflag WHEN 'R' THEN 7 ELSE 0 END + 2, 4) AS output FROM lineitem")
def score_lines_exact(t: Tables) -> DataFrame:
    """A linear model of a figure that is linear: every line's prediction is the figure."""
    lines = t.lineitem.withColumn("figure", 3 * F.col("l_quantity") - 40 * F.col("l_discount") + F.when(F.col("l_returnflag") == "R", 7).otherwise(0) + 2)
    fitted = train.train(lines, ["l_quantity", "l_discount", "l_returnflag"], "figure", "linear_regression", LINE_KEY, seed=7)
    said = train.score(fitted.pipeline, lines, fitted.preparation.columns)
    return said.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), (F.round("Prediction", 4) + 0.0).alias("output"))


@query("shapley_forest")
def shapley_forest(t: Tables) -> DataFrame:
    return explain.shapley(price_model(t, "random_forest", **_FEW_TREES), t.lineitem, LINE_KEY, permutations=4)


@query("local_surrogate")
def local_surrogate(t: Tables) -> DataFrame:
    trained = expensive_model(t, "logistic_regression")
    dearest = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)
    return explain.local_surrogate(trained, t.orders, dearest, ["o_orderkey"])


@query(
    "nearest_labels",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
  d AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rn FROM e a, e b),
  n AS (SELECT vec_id, label, count(*) AS votes FROM d WHERE rn <= 5 GROUP BY 1, 2),
  w AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) AS rn FROM n)
  SELECT vec_id, label AS prediction FROM w WHERE rn = 1""",
)
def nearest_labels(t: Tables) -> DataFrame:
    """Every vector gets the majority label of its five nearest vectors, itself included."""
    return cluster.assign_clusters(t.embeddings, "vec_id", "label", "embedding", t.embeddings, "vec_id")


@query("cluster_density")
def cluster_density(t: Tables) -> DataFrame:
    """Density clusters of the parts over size and price; compared with brute force in the tests."""
    parts = t.part.select("p_partkey", "p_size", (F.col("p_retailprice") / 10).alias("price"))
    return cluster.dbscan(parts, "p_partkey", ["p_size", "price"], eps=1.0, min_samples=6)
