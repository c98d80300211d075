"""Linked vectors against all pairs, and components against a plain search."""

import numpy as np

from tablescope.llm import graph, vectors


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(300):
        rows.append((k, rng.normal(size=16).astype(float).tolist(), k % 2))
    dense = rng.normal(size=16)
    for k in range(300, 420):  # more copies than a list holds
        rows.append((k, (dense + rng.normal(size=16) * 0.04).tolist(), 1))
    rows += [(500 + i, rows[i][1], rows[i][2]) for i in range(5)]  # equal vectors
    rows += [(600, rows[0][1], None), (601, None, 1), (602, [0.0] * 16, 1), (603, [float("nan")] * 16, 1), (604, [None] * 16, 1), (605, [], 1)]
    rows += [(606, rows[0][1][:8], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, rep string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.linked_vectors(df).collect()}
    keys = [r[0] for r in rows]
    fine = [r for r in rows if r[2] is not None and r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and np.linalg.norm(r[1]) > 0]
    ids = np.array([r[0] for r in fine])
    x = np.array([r[1] for r in fine])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in fine])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    root = ids.copy()
    for _ in range(20):
        root = np.array([root[n].min() for n in near])
    want = {k: (0, k, True) for k in keys} | {int(i): (int(n.sum()) - 1, int(r), bool(i == r)) for i, n, r in zip(ids, near, root)}
    assert got == want


def test_vectors_of_odd_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], "vec_id bigint, embedding array<float>, label int")
    rows = sorted((tuple(r) for r in vectors.linked_vectors(df).collect()), key=repr)
    assert rows == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]
    assert vectors.linked_vectors(df.where("false")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    root = {x: x for p in pairs if p[0] != p[1] for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root


def brute(ids, x, least=0.93):
    """Numbers of links and smallest ids reachable, by all pairs."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    root, before = ids.copy(), None
    while before is None or (root != before).any():
        before, root = root, np.array([root[n].min() for n in near])
    return {int(i): (int(n.sum()) - 1, int(r), bool(i == r)) for i, n, r in zip(ids, near, root)}


def linked(spark, x, **options):
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int").repartition(3)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.linked_vectors(df, **options).collect()}


def test_tight_clusters_that_are_linked_with_each_other(spark):
    rng = np.random.default_rng(9)
    a, b = np.eye(32)[0], 0.95 * np.eye(32)[0] + (1 - 0.95**2) ** 0.5 * np.eye(32)[1]
    x = np.array([c + rng.normal(size=32) * 0.002 for c in (a, b) for _ in range(20)])
    want = brute(np.arange(len(x)), x)
    assert {v[:2] for v in want.values()} == {(39, 0)}
    assert linked(spark, x) == want


def test_no_pair_is_missed_in_a_large_label(spark):
    rng = np.random.default_rng(10)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    b = 0.94 * a + (1 - 0.94**2) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)
    got = linked(spark, np.concatenate([a, b]))
    assert got == {k: (1, k % 4000, k < 4000) for k in range(8000)}


def test_blocks_are_bounded_and_far_ones_are_not_compared(spark):
    rng = np.random.default_rng(11)
    x = np.array([c + rng.normal(size=16) * 0.02 for c in np.eye(16)[:3] for _ in range(100)])
    rows = [("1|16", k, 1, bytearray(v.astype("<f8").tobytes())) for k, v in enumerate(x)]
    nodes = spark.createDataFrame(rows, "grp string, rep bigint, w bigint, raw binary")
    placed = vectors._blocks(nodes, "<f8", 0.93, 20)
    blocks = placed.where("mean is not null")
    assert placed.groupBy("block").count().agg({"count": "max"}).first()[0] <= 20 and placed.count() == 300
    assert 0 < vectors._pairs(blocks, 0.93).count() < vectors._pairs(blocks, -1.0).count()
    assert linked(spark, x, rows_per_block=20) == brute(np.arange(len(x)), x)
