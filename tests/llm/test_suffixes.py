"""Removal of repeated strings against all windows, with every size forced small; maximal repeats against plain search."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.llm import suffixes

from .conftest import ROWS


def plain(rows, n):
    """The result for (id, text) rows; rows of one id follow each other as the operator orders them."""
    texts = sorted(((1 << 64 if k is None else k, suffixes.xxhash.xxh32_intdigest((t or "").encode()), i, (t or "").encode()) for i, (k, t) in enumerate(rows)))
    first, out = {}, []
    for d, (k, _, _, t) in enumerate(texts):
        for s in range(len(t) - n + 1):
            first.setdefault(t[s : s + n], (d, s))
    for d, (k, _, _, t) in enumerate(texts):
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - n + 1):
            if first[t[s : s + n]] != (d, s):
                gone[s : s + n] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((None if k == 1 << 64 else k, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def corpus(n=160, seed=4):
    rng = np.random.default_rng(seed)
    say = lambda m: " ".join("".join(rng.choice(list("abcdefgh é"), rng.integers(2, 9))) for _ in range(m))
    passages = [say(m) for m in (15, 18, 30, 60, 300)] + ["ab" * 200, "z" * 150]
    rows = []
    for d in range(n):
        text = say(int(rng.integers(0, 60)))
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(0, len(passages)))]
            a, b = sorted(rng.integers(0, len(p) + 1, 2))
            text += p[a:b] + say(int(rng.integers(0, 5))) if rng.random() < 0.6 else p
        rows.append((int(rng.integers(-5, n)), text))
    rows += [(n + 1, rows[0][1]), rows[1], rows[1], (None, rows[2][1]), (None, rows[2][1]), (None, None), (n + 2, ""), (n + 3, passages[4] * 3)]
    return rows


TINY = {"chunk_bytes": 1500, "share": 2000, "width": 2, "partition": 3000}


@pytest.mark.parametrize(("length", "options"), [(100, {}), (100, TINY), (64, {**TINY, "hot": 3})])
def test_against_all_windows(spark, length, options):
    rows = corpus()
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id bigint, text string, unit int, keys string").repartition(4)
    assert found(suffixes.remove_repeated_strings(df, length, whole=False, **options)) == plain(rows, length)


def test_odd_rows_and_whole_results(docs, none):
    assert found(suffixes.remove_repeated_strings(docs, whole=False)) == plain(ROWS, 100)
    got = suffixes.remove_repeated_strings(docs, keep=["doc_id", "text", "lang"]).where("n_removed = 0 and text is not null")
    assert got.where(F.expr("kept <> cast(text as binary)")).count() == 0 < got.count()
    assert suffixes.remove_repeated_strings(none).count() == 0
    with pytest.raises(ValueError):
        suffixes.remove_repeated_strings(docs, key="lang")


def test_stretches_cover_every_window_once_and_anchors_agree(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    rng = np.random.default_rng(0)
    body = rng.integers(97, 101, 3000).astype(np.uint8).tobytes()
    texts = [body[:50], body, b"", body[500:900] + b"x" + body[:1200], b"q" * 400]
    s = suffixes.Stretches(texts, 100)
    starts = [x for a, b in zip(s.low, s.high) for x in range(a, b + 1)]
    assert starts == [s.origin[d] + i for d, t in enumerate(texts) for i in range(len(t) - 99)]
    anchors = {}
    for a, b, p in zip(s.low, s.high, s.anchor):
        for x in range(a, b + 1):
            assert x <= p <= x + 68
            assert anchors.setdefault(s.joined[x : x + 100], p - x) == p - x


def test_maximal_repeats():
    lefts = [b"cba", b"cbx", b"cba", b"zzz"]  # backwards
    rights = [b"ANCHOR12", b"ANCHOR12", b"ANCHOR99", b"ANCHOR12"]
    got = {(a, b, tuple(sorted(x))) for a, b, x in suffixes.maximal_repeats(lefts, rights, 8, 6)}
    assert got == {(0, 8, (0, 1, 3)), (2, 8, (0, 1)), (2, 6, (0, 1, 2)), (3, 6, (0, 2))}
