"""Density clusters and neighbours against brute force."""

import numpy as np
import pytest


from tablescope.operators import cluster


def brute_dbscan(points, eps, min_samples):
    n = len(points)
    d2 = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    near = d2 <= eps * eps
    core = near.sum(axis=1) >= min_samples
    labels, current = np.full(n, -1), 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        labels[i] = current
        while stack:
            p = stack.pop()
            if core[p]:
                for q in np.flatnonzero(near[p]):
                    if labels[q] == -1:
                        labels[q] = current
                        stack.append(q)
        current += 1
    return labels


def table(spark, points):
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id bigint, " + ", ".join(f"f{j} double" for j in range(points.shape[1])))


def moons(rng, n):
    a = rng.uniform(0, np.pi, n)
    first = np.c_[np.cos(a), np.sin(a)]
    second = np.c_[1 - np.cos(a), 0.5 - np.sin(a)]
    return np.vstack([first, second]) + rng.normal(0, 0.05, (2 * n, 2))


@pytest.mark.parametrize("case", ["moons", "dense_and_copies", "line"])
def test_dbscan(spark, case):
    rng = np.random.default_rng(3)
    if case == "moons":
        points, eps, least = moons(rng, 90), 0.25, 5
    elif case == "dense_and_copies":
        blob = rng.normal(0, 0.05, (80, 2))
        points = np.vstack([blob, blob[:30], np.repeat([[3.0, 3.0]], 40, axis=0), rng.uniform(-4, 4, (40, 2))])
        eps, least = 0.4, 6
    else:
        points, eps, least = np.sort(rng.uniform(0, 40, 120))[:, None], 0.5, 3
    df = table(spark, points)
    got = cluster.dbscan(df, "id", df.columns[1:], eps, least).orderBy("id").collect()
    assert [r["cluster"] for r in got] == list(brute_dbscan(points, eps, least))


def test_dbscan_refuses_many_columns(spark):
    df = table(spark, np.zeros((3, 5)))
    with pytest.raises(ValueError):
        cluster.dbscan(df, "id", df.columns[1:])


@pytest.mark.parametrize("pivots", [1, 7])
def test_neighbours(spark, pivots, monkeypatch):
    monkeypatch.setattr(cluster, "CELL_ROWS", 40)
    rng = np.random.default_rng(1)
    base, asked = rng.normal(0, 1, (150, 3)), rng.normal(0, 1.5, (60, 3))
    labels = rng.integers(0, 3, 150)
    train = spark.createDataFrame([(i, int(l), [float(x) for x in v]) for i, (v, l) in enumerate(zip(base, labels))], "tid bigint, label int, v array<double>")
    new = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "id bigint, v array<double>")
    got = cluster.nearest_neighbours(train, "tid", "label", "v", new, "id", 5, pivots).orderBy("id", "rank").collect()
    dist = np.sqrt(((asked[:, None, :] - base[None, :, :]) ** 2).sum(axis=2))
    want = np.argsort(dist, axis=1, kind="stable")[:, :5]
    assert [r["neighbour"] for r in got] == list(want.ravel())
    votes = {r["id"]: r["prediction"] for r in cluster.assign_clusters(train, "tid", "label", "v", new, "id").collect()}
    for i in range(60):
        counts = np.bincount(labels[want[i]], minlength=3)
        assert votes[i] == counts.argmax()


@pytest.mark.parametrize("kind", ["far", "grid", "copies", "few"])
def test_nearest_rows_against_differences(kind):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3 if kind == "few" else 900, 6)) + (1e4 if kind == "far" else 0)
    if kind in ("grid", "copies"):
        base = np.round(base) if kind == "grid" else np.repeat(base[:9], 100, axis=0)
    asked = np.concatenate([base[:150], base[:150] + 1e-9])
    square = ((asked[:, None] - base[None]) ** 2).sum(2)
    want = np.argsort(square, axis=1, kind="stable")[:, :5]
    at, found = cluster.nearest_rows(base, asked, 5)
    assert np.array_equal(at, want) and np.array_equal(found, np.take_along_axis(square, want, axis=1))


def test_neighbours_among_copies(spark):
    rows = [(i, "ab"[i % 2], [float(i % 3), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, label string, v array<double>")
    got = cluster.nearest_neighbours(df, "id", "label", "v", df, "id", 5, 2).orderBy("id", "rank").collect()
    assert [r["neighbour"] for r in got] == [n for i, _, _ in rows for n in range(i % 3, 15, 3)]
