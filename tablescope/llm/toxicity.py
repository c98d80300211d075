"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Each word is outside (O) or toxic (T).  Its potential is a sum of hashed weights: the word and its first 3 to 7
bytes, lower-cased in A-Z and without marks at its ends; two neighbours add transition weights.  Forward-backward
runs as a scan of 2x2 maps over all words of a slice of documents at once, restarting at each document.

Training labels of words come from the labelled documents: a word of a toxic document is T when one of its
features is far more frequent in toxic than in clean documents; all words of clean documents are O.  The field is
fitted by exact gradients.  A document's score is a logistic curve over the sum and the maximum of its words'
marginals, fitted on the same sample; a text without words has both at zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .kernels import U, Words, code_points, mix, slices, texts_of
from .samples import labelled_sample

WIDTH_BITS = 18
PREFIXES = (3, 4, 5, 6, 7)
SAMPLE = 3000
"""Labelled documents used for training, at most."""
TRAIN_WORDS = 800_000
"""Words of the sample the field is fitted on, at most; whole documents, in the order of their hashes."""
ROUNDS = 30
CUT = 0.7
SPAN = 0.5
"""Words with at least this marginal are reported as toxic."""
STEP = 128


def features(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    w = Words(texts, lower=True, trim=True, prefixes=PREFIXES)
    return w, (np.stack([w.hash, *w.prefixes]) >> U(64 - WIDTH_BITS)).astype(np.int64)


def _scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """All prefixes x_t = (a_t x + b_t) / (c_t x + d_t), x before the first being 1; entries are not negative.

    Blocks of ``STEP`` maps are multiplied out side by side, the block ends follow one another, then all blocks
    run again from their known starts.
    """
    n = len(a)
    blocks = -(-n // STEP)
    pad = blocks * STEP - n
    a, d = (np.concatenate([x, np.ones(pad)]).reshape(blocks, STEP).T.copy() for x in (a, d))
    b, c = (np.concatenate([x, np.zeros(pad)]).reshape(blocks, STEP).T.copy() for x in (b, c))
    p, q, r, s = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(STEP):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        top = 1 / np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p * top, q * top, r * top, s * top
    start, x = np.empty(blocks), 1.0
    for k, (pk, qk, rk, sk) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        start[k] = x
        x = (pk * x + qk) / max(rk * x + sk, 1e-300)
    out = np.empty((STEP, blocks))
    x = start
    for t in range(STEP):
        x = np.clip((a[t] * x + b[t]) / np.maximum(c[t] * x + d[t], 1e-300), 1e-30, 1e30)
        out[t] = x
    return out.T.ravel()[:n]


class Field:
    """weights: potential of T against O by feature; links: logs of O-T, T-O and T-T against O-O, and the start."""

    def __init__(self, weights: np.ndarray, links: np.ndarray, curve: np.ndarray):
        self.weights, self.links, self.curve = weights, links, curve

    def ratios(self, potential: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(e, forward, backward): odds of T against O from the word itself, from what is before it with it, from what is after."""
        ot, to, tt, begin = np.exp(self.links)
        e = np.exp(np.clip(potential, -30, 30))
        n = len(e)
        head = np.zeros(n, bool)
        head[first] = True
        keep = ~head
        forward = _scan(e * tt * keep, np.where(head, e * begin, e * ot), to * keep, np.ones(n))
        tail = np.zeros(n, bool)
        tail[np.append(first[1:], n) - 1] = True
        after = np.append(e[1:], 1.0)
        live = ~tail
        flip = lambda x: x[::-1]
        backward = flip(_scan(flip(tt * after * live), flip(np.where(tail, 1.0, to)), flip(ot * after * live), np.ones(n)))
        return e, forward, backward

    def marginals(self, w: Words, numbers: np.ndarray) -> np.ndarray:
        if not len(w.start):
            return np.empty(0)
        potential = self.weights[numbers].sum(axis=0)
        _, forward, backward = self.ratios(potential, np.unique(w.first[:-1][np.diff(w.first) > 0]))
        x = forward * backward
        return x / (1 + x)

    @staticmethod
    def fit(numbers: np.ndarray, first: np.ndarray, truth: np.ndarray, rounds: int = ROUNDS) -> Field:
        """Exact gradients of the log-likelihood, Adam steps."""
        n = numbers.shape[1]
        field = Field(np.zeros(1 << WIDTH_BITS), np.array([-3.0, 0.0, -3.0, -3.0]), np.zeros(3))
        head = np.zeros(n, bool)
        head[first] = True
        y = truth.astype(float)
        before = np.concatenate([[0.0], y[:-1]])
        seen = np.array([((1 - before) * y)[~head].sum(), (before * (1 - y))[~head].sum(), (before * y)[~head].sum(), y[head].sum()])
        used = np.unique(numbers)
        place = np.searchsorted(used, numbers)
        w = np.full(len(used), -0.3)
        moments = [np.zeros(len(used)), np.zeros(len(used)), np.zeros(4), np.zeros(4)]
        scale = max(1.0, y.sum())
        for step in range(1, rounds + 1):
            e, forward, backward = field.ratios(w[place].sum(axis=0), first)
            p = forward * backward / (1 + forward * backward)
            ot, to, tt, _ = np.exp(field.links)
            r = np.concatenate([[1.0], forward[:-1]])
            parts = np.stack([ot * e * backward, r * to, r * tt * e * backward])
            share = parts / (1 + parts.sum(axis=0))
            expected = np.append(share[:, ~head].sum(axis=1), p[head].sum())
            g = np.bincount(place.ravel(), np.broadcast_to(p - y, place.shape).ravel(), len(used)) / scale + 1e-4 * w
            gl = (expected - seen) / scale
            for k, (grad, at) in enumerate(((g, w), (gl, field.links))):
                m, v = moments[2 * k], moments[2 * k + 1]
                m += 0.1 * (grad - m)
                v += 0.02 * (grad * grad - v)
                at -= 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-6)
        field.weights[:] = -0.3  # features never seen count as weak evidence for O
        field.weights[used] = w
        return field

    def summary(self, p: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(sum, maximum) of the marginals of each document."""
        docs = len(w.first) - 1
        high = np.zeros(docs)
        np.maximum.at(high, w.doc[p > 0.01], p[p > 0.01])
        return np.bincount(w.doc, np.where(p > 0.01, p, 0.0), docs), high

    def score(self, total: np.ndarray, high: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.log1p(total) + self.curve[2] * high, -40, 40)))


def _word_labels(numbers: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words of the toxic documents are toxic: those with a feature that sets toxic documents apart."""
    width = 1 << WIDTH_BITS
    bad, good = np.zeros(width), np.zeros(width)
    for d in range(len(toxic)):
        own = np.unique(numbers[:, first[d] : first[d + 1]])
        (bad if toxic[d] else good)[own] += 1
    n_bad, n_good = max(1, toxic.sum()), max(1, (~toxic).sum())
    odds = np.log((bad + 0.3) / (n_bad - bad + 0.3)) - np.log((good + 0.3) / (n_good - good + 0.3))
    marked = (odds >= 3) & (bad >= max(3, 0.008 * n_bad))
    doc = np.searchsorted(first, np.arange(numbers.shape[1]), "right") - 1
    return marked[numbers].any(axis=0) & toxic[doc]


def _curve(total: np.ndarray, high: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression of the labels on (log1p(sum), maximum), Newton steps with a small ridge."""
    x = np.stack([np.ones(len(total)), np.log1p(total), high], axis=1)
    c = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        c = c + np.linalg.solve(h, x.T @ (toxic - p) - 0.05 * c)
    return c


def fit_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample: int = SAMPLE, key: str = "doc_id") -> Field:
    """Fit on at most ``sample`` labelled documents among the ``allowed`` ones; without any, every score is one half."""
    known = labels.select(key, F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    rows = labelled_sample(docs, known, sample, key, allowed).select(key, "toxic", F.octet_length("text").alias("size"), "text")
    table = rows.where("size > 0").toArrow()
    if not table.num_rows:
        return Field(np.zeros(1 << WIDTH_BITS), np.array([-3.0, 0.0, -3.0, -3.0]), np.zeros(3))
    ids = table[key].to_numpy().astype(np.int64)
    order = np.argsort(mix(ids.view(U)), kind="stable")
    toxic = (table["toxic"].to_numpy() == 1)[order]
    texts = _in_order(table, order)
    w, numbers = features(texts)
    truth = _word_labels(numbers, w.first, toxic)
    # all toxic documents and as many clean ones, as far as the words go
    rank = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic))
    turn = np.argsort(rank * 2 + ~toxic, kind="stable")
    size = np.diff(w.first)
    chosen = np.sort(turn[np.cumsum(size[turn]) <= TRAIN_WORDS])
    chosen = chosen[size[chosen] > 0]
    take = np.concatenate([np.arange(w.first[d], w.first[d + 1]) for d in chosen]) if len(chosen) else np.empty(0, np.int64)
    heads = np.concatenate([[0], np.cumsum(size[chosen])[:-1]]) if len(chosen) else np.empty(0, np.int64)
    if not len(take):
        return Field(np.zeros(1 << WIDTH_BITS), np.array([-3.0, 0.0, -3.0, -3.0]), np.zeros(3))
    field = Field.fit(numbers[:, take], heads.astype(np.int64), truth[take])
    field.curve = _curve(*field.summary(field.marginals(w, numbers), w), toxic)
    return field


def _in_order(table: pa.Table, order: np.ndarray) -> list[bytes]:
    texts = texts_of(table["text"].combine_chunks())
    return [texts[i] for i in order]


def _tag(field: Field):
    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            scores, spans = [], []
            for a, b in slices(texts):
                w, numbers = features(texts[a:b])
                p = field.marginals(w, numbers)
                scores.append(field.score(*field.summary(p, w)))
                chars = code_points(w.data)
                own: list[list[str]] = [[] for _ in range(b - a)]
                for k in np.flatnonzero(p >= SPAN).tolist():
                    d = int(w.doc[k])
                    base = chars[w.origin[d]]
                    own[d].append(f"{chars[w.start[k]] - base}:{chars[w.end[k]] - base}")
                spans.extend(",".join(x) for x in own)
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(spans, pa.string())], names=["id", "score", "spans"])

    return tag


def tag_toxicity(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score (0 to 1) and spans (start:end in code points of the toxic words, comma-joined).

    Null and empty texts score as a document without toxic words; repeated rows and null keys come back as they
    are; an empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(_tag(field), f"id {kind}, score double, spans string")
    return out.withColumnRenamed("id", key)
