"""Document quality by ordinal regression on graded ratings.

A cumulative-link model: P(grade <= k) = sigmoid(threshold_k - score), the score being a weighted mean of hashed
features of the text's words; the weights are shared by all grades, the thresholds ascend.  Features of a word are
the word itself and its form (case, marks, last character, whether it repeats the word before it).

Ratings: 0 for low quality, 1 for sound but toxic, 2 for sound.  A document is selected when P(grade >= 1) is at
least one half.  The model is fitted on a bounded sample (``sample`` documents); everything else is per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .kernels import U, Words, mix, slices, texts_of
from .samples import labelled_sample

WIDTH_BITS = 18
SAMPLE = 4000
ROUNDS = 80


def word_features(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """(words, feature numbers: two rows per word)."""
    w = Words(texts)
    upper = (w.data >= 65) & (w.data <= 90)
    letter = upper | ((w.data >= 97) & (w.data <= 122)) | (w.data >= 128)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return sums[w.end] - sums[w.start]

    length = w.end - w.start
    n_letter = count(letter)
    shout = (count(upper) > 1) * 1
    marks = np.minimum(length - n_letter, 4)
    again = np.zeros(len(length), np.int64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    last = w.data[w.end - 1].astype(np.int64) if len(length) else np.empty(0, np.int64)
    last = np.where((last >= 128) | ((last | 32) >= 97) & ((last | 32) <= 122), 0, last)
    form = (((shout * 5 + marks) * 2 + again) * 256 + last).astype(U)
    numbers = np.stack([w.hash, mix(form + U(1 << 40))]) >> U(64 - WIDTH_BITS)
    return w, numbers.astype(np.int64)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, grade) to (features, counts, words, grade)."""
    for batch in batches:
        texts = texts_of(batch.column(0))
        for a, b in slices(texts):
            w, numbers = word_features(texts[a:b])
            ids, counts = [], []
            for d in range(b - a):
                n, c = np.unique(numbers[:, w.first[d] : w.first[d + 1]], return_counts=True)
                ids.append(n.astype("<u4").tobytes())
                counts.append(c.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), pa.array(np.diff(w.first), pa.int64()), batch.column(1).slice(a, b - a)],
                names=["ids", "counts", "words", "grade"],
            )


class Ordinal:
    """Shared weights and ascending thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    @staticmethod
    def fit(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, grade: np.ndarray, grades: int, rounds: int = ROUNDS, decay: float = 1e-3) -> Ordinal:
        """Maximum likelihood by Adam over all rows; a threshold is the one before it plus exp of a free number."""
        n, width = len(grade), 1 << WIDTH_BITS
        share = np.array([(np.sum(grade <= k) + 0.5) / (n + 1.0) for k in range(grades - 1)])
        start = np.log(share / (1 - share))
        free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
        p = np.concatenate([np.zeros(width), free])
        m, v = np.zeros_like(p), np.zeros_like(p)
        bound = lambda t: np.concatenate([[-np.inf], t, [np.inf]])
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        for step in range(1, rounds + 1):
            t = np.cumsum(np.concatenate([p[width : width + 1], np.exp(p[width + 1 :])]))
            score = np.bincount(rows, p[ids] * values, n)
            edge = bound(t)
            up, low = sig(edge[grade + 1] - score), sig(edge[grade] - score)
            up, low = np.where(grade == grades - 1, 1.0, up), np.where(grade == 0, 0.0, low)
            mass = np.maximum(up - low, 1e-9)
            d_up, d_low = up * (1 - up) / mass, low * (1 - low) / mass
            d_score = (d_up - d_low) / n
            g = np.zeros_like(p)
            g[:width] = np.bincount(ids, d_score[rows] * values, width) + decay / n * p[:width]
            d_t = np.array([-(d_up[grade == k].sum() - d_low[grade == k + 1].sum()) / n for k in range(grades - 1)])
            tail = np.cumsum(d_t[::-1])[::-1]
            g[width] = tail[0] if len(tail) else 0.0
            g[width + 1 :] = tail[1:] * np.exp(p[width + 1 :])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            p -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return Ordinal(p[:width], np.cumsum(np.concatenate([p[width : width + 1], np.exp(p[width + 1 :])])))

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """P(grade >= k) for k = 1 ..., one row per text; a text without words has score 0."""
        w, numbers = word_features(texts)
        own = np.bincount(np.broadcast_to(w.doc, numbers.shape).ravel(), self.weights[numbers].ravel(), len(texts))
        score = own / np.maximum(np.diff(w.first), 1)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).when(F.col(quality) == 1, 2)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> Ordinal:
    """Fit on at most ``sample`` documents whose rating is known; without any, every document scores alike."""
    rated = labels.select(key, grade_of().cast("int").alias("grade")).where("grade is not null")
    found = labelled_sample(docs, rated, sample, key).select("text", "grade")
    got = found.mapInArrow(_vectors, "ids binary, counts binary, words bigint, grade int").toArrow()
    if not got.num_rows:
        return Ordinal(np.zeros(1 << WIDTH_BITS), np.array([-2.0, -1.0]))
    ids = [np.frombuffer(x, "<u4") for x in got["ids"].to_pylist()]
    counts = [np.frombuffer(x, "<u4") for x in got["counts"].to_pylist()]
    rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    words = np.maximum(got["words"].to_numpy(), 1)
    values = np.concatenate(counts) / words[rows]
    return Ordinal.fit(rows, np.concatenate(ids).astype(np.int64), values, got["grade"].to_numpy().astype(np.int64), 3)


def _score(model: Ordinal):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(batch.schema.get_field_index("_text")))
            tails = [model.tails(texts[a:b]) for a, b in slices(texts)]
            t = np.concatenate(tails) if tails else np.empty((0, 2))
            keep = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(t.sum(axis=1)), pa.array(t[:, 0]), pa.array(t[:, 0] >= 0.5)],
                names=[*[batch.schema.names[i] for i in keep], "expected_grade", "p_sound", "selected"],
            )

    return score


def score_quality(docs: DataFrame, model: Ordinal, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` (default doc_id) with expected_grade (0 to 2), p_sound = P(grade >= 1) and selected.

    Null and empty texts have no features and get the score 0, so the thresholds alone decide; repeated rows come
    back as often as they are there; null keys pass through; an empty table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    read = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields if f.name != "_text")
    return read.mapInArrow(_score(model), f"{kinds}, expected_grade double, p_sound double, selected boolean")
