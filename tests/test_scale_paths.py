"""The paths for large tables and hot keys, forced on small ones, against pandas or the plain path."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablescope.operators import blocks, charts, clean, conversations, evaluate, lookups, sampling, series, stats, throttle
from tablescope.operators.quantiles import order_statistics, quantiles


@pytest.fixture(scope="module")
def hot(spark):
    """One key with most rows, missing values, one value held by a third of the rows."""
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        key = "hot" if i % 4 else rnd.choice(["a", "b", "c"])
        value = None if rnd.random() < 0.3 else (7.0 if rnd.random() < 0.4 else round(rnd.gauss(50, 20), 3))
        rows.append((i, key, value))
    return spark.createDataFrame(rows, "id bigint, key string, value double").repartition(5)


def frame(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


@pytest.mark.parametrize("keys", [[], ["key"]])
@pytest.mark.parametrize("how", ["ffill", "bfill"])
def test_fill_in_blocks(hot, keys, how):
    got = frame(clean.impute(hot, "value", how, order_by=["id"], partition_by=keys, task_rows=0), "id")
    want = frame(hot, "id")
    series_ = want.groupby("key")["value"] if keys else want["value"]
    np.testing.assert_array_equal(got["value"], getattr(series_, how)())


@pytest.mark.parametrize("keys", [[], ["key"]])
@pytest.mark.parametrize("block_rows", [37, 10_000])
def test_running_totals_in_blocks(hot, keys, block_rows):
    made = blocks.running_totals(
        hot, {"at": F.lit(1).cast("bigint"), "total": F.coalesce("value", F.lit(0.0))}, ["id"], keys, task_rows=0, block_rows=block_rows
    )
    got, want = frame(made, "id"), frame(hot, "id")
    want["value"] = want["value"].fillna(0.0)
    if keys:
        at, total = want.groupby("key").cumcount() + 1, want.groupby("key")["value"].cumsum()
    else:
        at, total = pd.Series(range(1, len(want) + 1)), want["value"].cumsum()
    np.testing.assert_array_equal(got["at"], at)
    np.testing.assert_allclose(got["total"], total)


@pytest.mark.parametrize("block_rows", [12, 50, 1000])
def test_rolling_mean_in_chunks(hot, block_rows):
    made = blocks.rolling(hot, "m", F.avg("value"), 12, ["id"], task_rows=0, block_rows=block_rows)
    got, want = frame(made, "id"), frame(hot, "id")
    np.testing.assert_allclose(got["m"], want["value"].rolling(12, min_periods=1).mean())


def test_rolling_mean_of_few_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "id int, value double")
    got = frame(series.trend(df, "value", ["id"], task_rows=0), "id")
    np.testing.assert_allclose(got["trend"], [0, 0.5, 1, 1.5, 2])


def test_quantiles_by_narrowing(hot):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = quantiles(hot, ["value", "id"], probs, direct_rows=5)
    row = hot.sparkSession.range(1).select(*[q.alias(f"{c}{i}") for c, qs in found.items() for i, q in enumerate(qs)]).first()
    pdf = hot.toPandas()
    for c in ("value", "id"):
        for i, p in enumerate(probs):
            assert row[f"{c}{i}"] == pytest.approx(pdf[c].quantile(p))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.integers(-3, 3), st.integers(-1000, 1000)), min_size=1, max_size=60))
def test_order_statistics_on_any_values(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    n, found = order_statistics(df, {"v": (F.col("v"), lambda n: range(n))}, direct_rows=2)["v"]
    assert n == len(values)
    assert [found[r] for r in range(n)] == sorted(map(float, values))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(0, 5))), min_size=1, max_size=40))
def test_fill_on_any_rows(spark, rows):
    df = spark.createDataFrame([(i, k, None if v is None else float(v)) for i, (k, v) in enumerate(rows)], "id int, key int, value double")
    made = clean.impute(df, "value", "ffill", order_by=["id"], partition_by=["key"], task_rows=0)
    want = frame(df, "id").groupby("key")["value"].ffill()
    np.testing.assert_array_equal(frame(made, "id")["value"].astype(float), want.astype(float))


def test_label_codes_of_many_values(hot):
    made = frame(clean.encode(hot, "value", "label", order_by=["id"], task_rows=0), "id")
    want = pd.factorize(frame(hot, "id")["value"])[0]
    np.testing.assert_array_equal(made["value"], want)


def test_ranks_and_curve_in_blocks(hot):
    scored = hot.where("value IS NOT NULL").withColumn("hit", (F.col("key") == "hot").cast("int"))
    assert sorted(stats.average_ranks(hot, ["value"], task_rows=0).collect()) == sorted(stats.average_ranks(hot, ["value"]).collect())
    plain, cut = evaluate.auc(scored, "hit", "value").first()[0], evaluate.auc(scored, "hit", "value", task_rows=0).first()[0]
    assert plain == pytest.approx(cut)
    a = charts.roc_curve(scored, "hit", "value").collect()
    b = charts.roc_curve(scored, "hit", "value", task_rows=0).collect()
    assert sorted(a) == sorted(b)
    assert (min(r["fpr"] for r in a), max(r["tpr"] for r in a)) == (0.0, 1.0)


def test_spearman_in_blocks(hot):
    pdf = hot.toPandas()[["id", "value"]].dropna().rank()
    got = {(r[0], r[1]): r[2] for r in stats.spearman(hot, ["id", "value"], task_rows=0).collect()}
    assert got["id", "value"] == pytest.approx(pdf.corr().loc["id", "value"])


def test_blocks_of_a_table_fit_a_task(spark):
    """Blocks and chunks of the split path hold no more rows than an unsplit group may have."""
    assert blocks.BLOCK_ROWS <= blocks.TASK_ROWS
    df = spark.range(2_500_000).select("id", (F.col("id") % 7).cast("double").alias("v"))
    made = series.trend(df, "v", ["id"], task_rows=0)
    assert made.groupBy(F.spark_partition_id()).count().count() > 1
    want = [sum(k % 7 for k in range(i - 11, i + 1)) / 12 for i in (999_999, 1_000_000, 2_000_003)]
    got = made.where(F.col("id").isin(999_999, 1_000_000, 2_000_003)).orderBy("id").collect()
    assert [r["trend"] for r in got] == pytest.approx(want) and made.count() == 2_500_000


@pytest.mark.parametrize("limit", [0, 50 * 32, 2100 * 32])
def test_spearman_without_hot_values_in_the_join(spark, limit, monkeypatch):
    """Ranks of none, of the narrow columns, of one wide column are broadcast; a constant one is never shuffled."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.permutation(2000) + 0.5, "b": rng.integers(0, 40, 2000), "c": 5.0, "d": rng.normal(size=2000)})
    pdf["d"] = np.where(rng.random(2000) < 0.3, 1.0, pdf["a"] / 1000 + pdf["d"])
    seen = []
    plain = stats.cut_lineage
    monkeypatch.setattr(stats, "cut_lineage", lambda df: seen.append(df.columns) or plain(df))
    got = {(r[0], r[1]): r[2] for r in stats.spearman(spark.createDataFrame(pdf), ["a", "b", "c", "d"], limit=limit).collect()}
    want = pdf.rank().corr()
    for x in "abcd":
        for y in "abcd":
            assert (got[x, y] is None) if "c" in (x, y) else got[x, y] == pytest.approx(want.loc[x, y], abs=1e-12)
    # the wide columns alone are numbered, the others travel as ranks
    assert limit == 0 or seen[-1] == (["v0", "c2", "c1", "c3", "_row"] if limit > 50 * 32 else ["v0", "v3", "c2", "c1", "_row"])


def test_weighted_median_in_blocks(spark):
    rows = [("a", 1, 3), ("a", 5, 1), ("b", 2, 1), ("b", 4, 1), ("c", 9, 2), ("c", 1, 5), ("c", 3, 1)]
    df = spark.createDataFrame(rows, "key string, value bigint, w bigint")
    got = {r["key"]: r["median"] for r in series.weighted_median(df, "value", "w", ["key"], task_rows=0).collect()}
    want = {r["key"]: r["median"] for r in series.weighted_median(df, "value", "w", ["key"]).collect()}
    assert got == want == {"a": 1.0, "b": 3.0, "c": 1.0}


@pytest.mark.parametrize("limit", [1, 3])
def test_throttle_in_chunks(spark, limit):
    rnd = random.Random(limit)
    seconds, rows = 0, []
    for i in range(400):
        seconds += rnd.choice([0, 1, 3, 10, 90])
        rows.append((i, "k" if i % 5 else "other", 1_700_000_000 + seconds))
    df = spark.createDataFrame(rows, "id bigint, key string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["accepted"] for r in throttle.throttle(df, "key", "ts", ["id"], limit, task_rows=40).collect()}
    plain = {r["id"]: r["accepted"] for r in throttle.throttle(df, "key", "ts", ["id"], limit).collect()}
    kept: dict = {}
    want = {}
    for i, key, s in rows:
        live = [x for x in kept.get(key, []) if s - x < 60]
        want[i] = len(live) < limit
        kept[key] = live + [s] if want[i] else live
    assert got == plain == want


def test_samples_and_splits_are_exact_and_stable(hot):
    a = sampling.sample_rows(hot, 50, ["id"])
    assert a.count() == 50
    assert {r["id"] for r in a.collect()} == {r["id"] for r in sampling.sample_rows(hot.repartition(2), 50, ["id"]).collect()}
    for direct in (5, 100_000):
        parted = sampling.split(hot, ["id"], 0.25, direct_rows=direct)
        assert parted.where("is_test").count() == 150
        strata = sampling.split(hot, ["id"], 0.25, label="key", direct_rows=direct)
        counts = {r["key"]: (r["n"], r["k"]) for r in strata.groupBy("key").agg(F.count("*").alias("n"), F.count_if("is_test").alias("k")).collect()}
        assert sum(k for _, k in counts.values()) == 150
        assert all(abs(k - n * 0.25) <= 1 for n, k in counts.values())


def test_strata_settle_equal_hashes_and_hot_classes(spark, monkeypatch):
    df = spark.range(300).withColumn("v", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") < 12, F.lit(None)).otherwise("b"))
    jobs = []
    plain = sampling.split(df, ["id"], 0.2, label="v")
    monkeypatch.setattr(sampling, "positions", lambda *a, **k: jobs.append(a) or blocks.positions(*a, **k, task_rows=7, block_rows=20))
    forced = sampling.split(df, ["id"], 0.2, label="v")
    assert {r["id"] for r in plain.where("is_test").collect()} == {r["id"] for r in forced.where("is_test").collect()}
    assert {r["v"]: r["k"] for r in plain.groupBy("v").agg(F.count_if("is_test").alias("k")).collect()} == {"hot": 40, "b": 19, None: 1}
    monkeypatch.setattr(sampling, "hash_order", lambda key, seed: F.col("id") % 2)
    assert {r["v"]: r["k"] for r in sampling.split(df, ["id"], 0.2, label="v").groupBy("v").agg(F.count_if("is_test").alias("k")).collect()} == {"hot": 40, "b": 19, None: 1}
    assert len(jobs) == 4


def test_split_settles_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(sampling, "hash_order", lambda key, seed: F.col("id") % 2)
    df = spark.range(10)
    assert sampling.split(df, ["id"], 0.3).where("is_test").count() == 3


def test_trailing_counts_of_hot_keys_and_instants(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i % 9 == 0 else int(rng.integers(0, 3)), int(t)) for i, t in enumerate([*rng.integers(0, 400, 150), *[100] * 80])]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "id int, k int, t int")
    df = df.select("id", "k", F.timestamp_seconds("t").alias("ts")).unionByName(spark.createDataFrame([(999, 1, None)], "id int, k int, ts timestamp"))
    want = {i: sum(k2 == k and 0 <= t - t2 < 60 for k2, t2 in rows) for i, (k, t) in enumerate(rows)}
    for sizes in ({}, {"task_rows": 10, "block_rows": 15}):
        got = {r.id: r.events_in_window for r in throttle.trailing_counts(df, "k", "ts", **sizes).collect()}
        assert got == want


def test_cluster_scores_part_by_part(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i % 11), [float(v) for v in rng.normal(i % 11, 1 + i % 3, 3)]) for i in range(400)] + [(50, [1.0, 2.0, 3.0]), (51, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    for score in (evaluate.davies_bouldin, evaluate.silhouette_squared):
        assert score(df, "k", "v", part_clusters=3).first()[0] == pytest.approx(score(df, "k", "v").first()[0], rel=1e-9)
    pdf = df.where("k < 50").toPandas()
    x, k = np.stack(pdf["v"]), pdf["k"].to_numpy()
    centre = np.stack([x[k == c].mean(0) for c in range(11)])
    s = np.array([np.linalg.norm(x[k == c] - centre[c], axis=1).mean() for c in range(11)])
    want = np.mean([max((s[i] + s[j]) / np.linalg.norm(centre[i] - centre[j]) for j in range(11) if j != i) for i in range(11)])
    assert evaluate.davies_bouldin(df.where("k < 50"), "k", "v", part_clusters=4).first()[0] == pytest.approx(want)
    assert evaluate.davies_bouldin(df.where("k = 1"), "k", "v").first()[0] is None


@pytest.mark.parametrize("kind", ["plane", "copies", "outliers", "line"])
def test_worst_ratios_meet_few_cells(spark, kind, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 50, (2000, 2))
    if kind == "copies":
        x = np.floor(x / 4)
    if kind == "line":
        x[:, 1] = 1.0
    reach = rng.uniform(0, 3, 2000)
    if kind == "outliers":
        reach[:3], x[:3] = 1e5, [[1e4, 0.0], [25.0, 25.0], [-1e3, 7.0]]
    # two points a cluster, at the same distance from its centroid
    rows = [(i, [float(a + side * r), float(b)]) for i, ((a, b), r) in enumerate(zip(x, reach)) for side in (-1, 1)]
    df = spark.createDataFrame([*rows, (-1, [1.0, None])], "k int, v array<double>")
    met = []
    plain = evaluate._beyond_cells
    monkeypatch.setattr(evaluate, "_beyond_cells", lambda *a: met.append(plain(*a)) or met[-1])
    got = {r.label: r.w for r in evaluate.worst_ratios(df, "k", "v", part_clusters=20).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    centre = np.stack(pdf.groupby("k")["v"].apply(lambda v: np.stack(v.to_list()).mean(0)).to_list())
    s = np.array([np.linalg.norm(np.stack(v.to_list()) - centre[k], axis=1).mean() for k, v in pdf.groupby("k")["v"]])
    gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
    want = np.divide(s[:, None] + s[None], gap, out=np.zeros_like(gap), where=gap > 0).max(1)
    # a centroid that is missing a coordinate takes part without hiding the others
    assert got.pop(-1) == 0
    if kind != "copies":  # where centroids all but agree, their last bits decide
        assert [got[i] for i in range(2000)] == pytest.approx(list(want), rel=1e-6)
    assert len(got) == 2000 and met[0].count() < 10 * 2000


def test_worst_ratios_of_clusters_at_few_places(spark, monkeypatch):
    rng = np.random.default_rng(4)
    spots = np.array([(float(a), float(b)) for a in range(8) for b in range(5)])
    place = rng.integers(0, len(spots), 3000)
    reach = rng.uniform(0, 3, 3000) * (1 + place % 3) ** 2
    rows = [(i, [float(spots[p, 0] + side * r), float(spots[p, 1])]) for i, (p, r) in enumerate(zip(place, reach)) for side in (-1, 1)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    # centroids and spreads as they are computed, so that clusters of a place are at one place to the last bit
    monkeypatch.setattr(evaluate, "centroids", lambda points, label, features: spark.createDataFrame(
        [(i, 2, [float(c) for c in spots[p]]) for i, p in enumerate(place)], "label int, n bigint, centre array<double>"))
    dealt = []
    plain = evaluate.spread_groups
    monkeypatch.setattr(evaluate, "spread_groups", lambda t, keys: dealt.append((t, keys)) or plain(t, keys))
    got = {r.label: r.w for r in evaluate.worst_ratios(df, "k", "v", part_clusters=5).collect()}
    centre = spots[place]
    gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
    want = np.divide(reach[:, None] + reach[None], gap, out=np.zeros_like(gap), where=gap > 0).max(1)
    assert [got[i] for i in range(3000)] == pytest.approx(list(want), rel=1e-9)
    # what meets in a task grows with the places, not with the clusters at them
    assert len(dealt) == 3 and all(t.groupBy(*keys).count().agg({"count": "max"}).first()[0] <= 40 for t, keys in dealt)


@pytest.mark.parametrize("odd", [[], [("a", [1.0]), ("b", [4.0, 5.0, 6.0])]])
def test_centroids_side_by_side_and_by_rows(spark, monkeypatch, odd):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, None]), ("b", [None, 5.0]), (None, [7.0, 8.0]), ("c", None), ("c", []), ("d", [None, None]), *odd]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    made = evaluate.centroids(df, "k", "v")
    assert ("posexplode" in made._jdf.queryExecution().toString()) == bool(odd)  # rows of coordinates only where lengths differ
    got = sorted(map(str, made.collect()))
    monkeypatch.setattr(evaluate, "NARROW", 0, raising=False)
    assert got == sorted(map(str, evaluate.centroids(df, "k", "v").collect()))
    assert evaluate.centroids(df.where("k = 'c'"), "k", "v").count() == 0


def test_mentions_both_ways(spark):
    words = ["The Random Forest wins", "ridge, RIDGE", "x", "a forest", None, "", "gradient boosted trees and a random forest", "customer#000017 met customer#000018"]
    messages = spark.createDataFrame([*enumerate(words), (None, "Ridge"), (2, "random  forest"), (2, "a ridge")], "msg int, text string")
    names = [("m1", "random forest"), ("m2", "Ridge"), ("m3", "x"), ("m4", "zzz"), ("m5", "gradient boosted tree"), ("m6", None), ("m7", ""),
             ("m8", "customer#000017"), ("m9", "customer#000019"), ("m1", "wins"), ("m10", "random forests")]
    want = {(m, i) for m, t in [*enumerate(words), (None, "Ridge"), (2, "random  forest"), (2, "a ridge")] for i, n in names if t and n and n.lower() in t.lower()}
    df = spark.createDataFrame(names, "id string, name string")
    for limit in (conversations.BROADCAST_BYTES, 0):
        got = conversations.mentions(messages, df, ["msg"], broadcast_bytes=limit).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert conversations.mentions(messages, df.where("false"), ["msg"]).count() == 0
    assert conversations.mentions(messages.where("false"), df, ["msg"]).count() == 0


def test_names_are_filed_under_their_rarest_gram(spark):
    messages = spark.createDataFrame([("customer#000017",), ("customer#000018",), ("customer#000018 again",)], "text string")
    names = spark.createDataFrame([(1, "customer#000017"), (2, "customer#000018"), (3, "customer#000099"), (4, "again")], "id int, name string")
    filed = {r.id: r.gram for r in conversations.file_names(messages, names).collect()}
    assert filed == {1: "r#000017", 2: "r#000018", 4: "again"}


def test_shape_estimators_match_pandas(hot):
    row = stats.describe_numeric(hot, ["value"]).first()
    s = hot.toPandas()["value"]
    assert row["skewness"] == pytest.approx(s.skew()) and row["kurtosis"] == pytest.approx(s.kurt())
    assert row["variance"] == pytest.approx(s.var()) and row["mode"] == s.mode()[0]
    assert row["distinct_count"] == s.nunique()


def test_histogram_matches_numpy(hot, spark):
    s = hot.toPandas()["value"].dropna()
    want, edges = np.histogram(s, bins=13)
    got = sorted(charts.histogram(hot, "value", 13).collect())
    assert [r["count"] for r in got] == list(want)
    assert [r["low"] for r in got] == pytest.approx(list(edges[:-1]))
    flat = sorted(charts.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").collect())
    want, edges = np.histogram([2.0, 2.0], bins=10)
    assert [r["count"] for r in flat] == list(want) and flat[0]["low"] == edges[0] and math.isclose(flat[-1]["high"], edges[-1])


def test_unknown_values_keep_their_rows_on_both_paths(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, value string")
    codes = spark.createDataFrame([("a", 0)], "value string, code bigint")
    for limit in (0, 1 << 20):
        got = lookups.code_lookup(df, "value", codes, "value", -1, limit=limit)
        assert sorted(map(tuple, got.collect())) == [(1, 0), (2, -1), (3, -1)]


def test_date_column_by_all_rows(spark):
    rows = [(f"n{i}", "2024-01-01" if i < 30 else f"x{i}", f"2024-02-{i % 28 + 1:02d}" if i > 15 else "soon") for i in range(200)]
    df = spark.createDataFrame(rows, "name string, misleading string, day string")
    assert series.find_date_column(df) == "day"


@pytest.mark.parametrize("aggregated", [0, 16])
def test_correlation_of_constants_and_gaps(spark, monkeypatch, aggregated):
    monkeypatch.setattr(stats, "AGGREGATED", aggregated)
    rows = [(0.19, float(i), float(i * i % 7), None if i % 3 else float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "fixed double, a double, b double, c double").repartition(4)
    frame_ = pd.DataFrame(rows, columns=["fixed", "a", "b", "c"])
    for listwise in (True, False):
        want = (frame_.dropna() if listwise else frame_).corr()
        for r in stats.pearson(df, listwise=listwise).collect():
            w = want.loc[r.column_a, r.column_b]
            assert (r.coefficient is None and (math.isnan(w) or "fixed" in (r.column_a, r.column_b))) or r.coefficient == pytest.approx(w)
