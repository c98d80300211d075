"""Removal of long repeated passages: Rabin-Karp hashes of every window of words, counted in Spark.

1. Documents are dealt into chunks of a few megabytes by a hash of id and text, and sorted inside a chunk, so that
   the number of a window inside its chunk is the same whenever the chunk is read.
2. Each chunk hashes all its windows at once and sends, per range of hash values, the hashes and window numbers,
   packed to 9 bytes a window (7 bytes of hash, the rest is the range; 2 bytes of distance to the window before).
3. Each range sorts its hashes; values that occur more than once go back to their chunks as window numbers.
4. Each chunk marks the words that repeated windows cover; adjoining windows merge into maximal intervals.

A range holds about a million windows whatever the input, so ranges and chunks grow in number only.  A window that
occurs very often costs each chunk one entry per place; no task gathers its copies beyond that range's share.
Windows are equal when their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .kernels import U, Words, flat, texts_of

CHUNK_BYTES = 2 << 20
"""Text in a chunk, on average."""
RANGE_BYTES = 6 << 20
"""Text whose windows share a range of hash values, on average: about a million windows."""

PACKED = "bucket int, chunk int, wide boolean, hashes binary, gaps binary"


def _ordered(table: pa.Table, key: str, text: str) -> tuple[list[int], list[bytes]]:
    """Rows of a chunk in the order of (id, text), and their texts in that order."""
    texts = texts_of(flat(table[text]))
    ids = [str(x) for x in table[key].to_pylist()]
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return order, [texts[i] for i in order]


def _pack(words: int, bits: int, key: str, text: str):
    def pack(table: pa.Table) -> pa.Table:
        _, texts = _ordered(table, key, text)
        _, hashes = Words(texts).runs(words)
        bucket = (hashes >> U(64 - bits)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order])) + 1
        rows = {"bucket": [], "wide": [], "hashes": [], "gaps": []}
        for part in np.split(order, edges) if len(order) else []:
            gaps = np.diff(part, prepend=-1)
            wide = bool(gaps.max() > 0xFFFF)
            rows["bucket"].append(int(bucket[part[0]]))
            rows["wide"].append(wide)
            rows["hashes"].append(hashes[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes())
            rows["gaps"].append(gaps.astype("<u4" if wide else "<u2").tobytes())
        chunk = table["chunk"][0].as_py() if len(table) else 0
        n = len(rows["bucket"])
        return pa.table({
            "bucket": pa.array(rows["bucket"], pa.int32()), "chunk": pa.array([chunk] * n, pa.int32()),
            "wide": pa.array(rows["wide"], pa.bool_()), "hashes": pa.array(rows["hashes"], pa.binary()),
            "gaps": pa.array(rows["gaps"], pa.binary()),
        })

    return pack


def _repeated(table: pa.Table) -> pa.Table:
    """Window numbers, per chunk, whose hash occurs more than once in the range."""
    blobs = [np.frombuffer(x, np.uint8).reshape(-1, 7) for x in table["hashes"].to_pylist()]
    sizes = np.array([len(b) for b in blobs], np.int64)
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    wide[:, :7] = np.concatenate(blobs)
    values = wide.view("<u8").ravel()
    order = np.argsort(values)
    same = values[order][1:] == values[order][:-1]
    twice = np.zeros(len(values), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    chunks, found = [], []
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, (gaps, big, chunk) in enumerate(zip(table["gaps"].to_pylist(), table["wide"].to_pylist(), table["chunk"].to_pylist())):
        mark = twice[at[i] : at[i + 1]]
        if mark.any():
            numbers = np.cumsum(np.frombuffer(gaps, "<u4" if big else "<u2").astype(np.int64)) - 1
            chunks.append(chunk)
            found.append(numbers[mark].astype("<u4").tobytes())
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "found": pa.array(found, pa.binary())})


def covered(words: Words, length: int, numbers: np.ndarray) -> np.ndarray:
    """Which words the windows of these numbers cover."""
    where, _ = words.runs(length)
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, where[numbers], 1)
    np.add.at(edge, where[numbers] + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(words: int, key: str, text: str, columns: list[str], whole: bool):
    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        order, texts = _ordered(docs, key, text)
        w = Words(texts)
        numbers = [np.frombuffer(x, "<u4").astype(np.int64) for x in found["found"].to_pylist()]
        gone = covered(w, words, np.concatenate(numbers)) if numbers else np.zeros(len(w.start), bool)
        data = w.data.tobytes()
        kept, n_words, n_removed = [], [], []
        for d, raw in enumerate(texts):
            a, b = w.first[d], w.first[d + 1]
            n_words.append(int(b - a))
            n_removed.append(int(gone[a:b].sum()))
            if n_removed[-1] or not whole:
                stay = np.flatnonzero(~gone[a:b]) + a
                kept.append(b" ".join([data[s:e] for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist())]))
            else:
                kept.append(raw)
        out = docs.select(columns).take(pa.array(order, pa.int64()))
        out = out.append_column("n_words", pa.array(n_words, pa.int64()))
        out = out.append_column("n_removed", pa.array(n_removed, pa.int64()))
        if whole:
            return out.append_column("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))
        return out.append_column("kept_sha256", pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))

    return cut


def _spread(key: str, text: str, chunks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(chunks)).cast("int")


def remove_repeats(
    docs: DataFrame, words: int = 50, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, whole: bool = True
) -> DataFrame:
    """Drop every word covered by a window of ``words`` words that occurs at least twice in all of ``docs``.

    Returns the columns ``keep`` (default: the key) with n_words, n_removed, and ``kept_text``: the text itself
    where nothing goes, otherwise the words that stay, joined by one blank (``whole``); without ``whole`` the
    lowercase hex SHA-256 of the joined words, as kept_sha256.  Null texts have no words; a text shorter than a
    window keeps them all; a repeated row repeats every window it has; null keys are ids like any other; an empty
    table gives an empty result.  Columns named chunk, found or as the results must not be among ``keep``.
    """
    keep = [key] if keep is None else keep
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    chunks = max(32, -(-size // CHUNK_BYTES))
    bits = max(6, (size // RANGE_BYTES).bit_length())
    columns = list(dict.fromkeys([*keep, key, text]))
    dealt = docs.select(*columns, _spread(key, text, chunks).alias("chunk"))
    packed = dealt.select(key, text, "chunk") if columns == [key, text] else dealt
    windows = packed.groupBy("chunk").applyInArrow(_pack(words, bits, key, text), PACKED)
    found = windows.groupBy("bucket").applyInArrow(_repeated, "chunk int, found binary")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    result = "kept_text string" if whole else "kept_sha256 string"
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_words bigint", "n_removed bigint", result])
    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_cut(words, key, text, keep, whole), schema)
