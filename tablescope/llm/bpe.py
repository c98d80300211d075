"""Byte-level BPE, encoding and decoding, with a segment tree over adjacent pair ranks.

A piece of text (as the vocabulary's pattern splits it) is a row of symbols.  Leaf p of its tree holds the rank of
the pair that starts at symbol p, joined with p; an inner node holds the smaller of its children, so the root is
the leftmost pair of the lowest rank.  A merge changes three leaves and the paths above them, and the root is asked
again until no mergeable pair is left.

Many pieces are worked on side by side: a step performs the next merge of every unfinished piece of one tree size.
Long pieces run alone on plain lists.  Results are kept by piece, up to a fixed number, while a task runs.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .kernels import flat, slices, texts_of

PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
NONE = np.int64(1) << 60
LONG = 512
"""Pieces of more bytes run alone."""
KEPT = 250_000
"""Pieces whose results are kept at most."""
TOGETHER = 16_384
"""Pieces side by side."""


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    own = set(plain)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        letters = byte_characters()
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        back = {c: b for b, c in enumerate(letters)}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        left, right, made = [], [], []
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left.append(ids[a])
            right.append(ids[b])
            made.append(ids[a + b])
        pair = (np.array(left, np.int64) << 20) | np.array(right, np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank, self.made = pair[order], order.astype(np.int64), np.array(made, np.int64)
        self.rank_of = dict(zip(pair.tolist(), range(len(made))))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it cannot merge; a negative id is no symbol."""
        wanted = (a << 20) | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        return np.where((self.pair[at] == wanted) & (a >= 0) & (b >= 0), self.rank[at], NONE)

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; all pieces have 2 to LONG bytes."""
        lengths = np.array([len(p) for p in pieces])
        out: list = [None] * len(pieces)
        sizes = np.maximum(2, 1 << np.ceil(np.log2(lengths)).astype(np.int64))
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            per = max(1, min(TOGETHER, (TOGETHER * 16) // size))
            for a in range(0, len(own), per):
                part = own[a : a + per]
                for i, ids in zip(part.tolist(), self._together([pieces[i] for i in part.tolist()], lengths[part], size)):
                    out[i] = ids
        return out

    def _together(self, pieces: list[bytes], lengths: np.ndarray, size: int) -> list[list[int]]:
        n = len(pieces)
        shift = size.bit_length()
        inside = np.arange(size)[None, :] < lengths[:, None]
        symbol = np.full((n, size + 1), -1, np.int64)
        symbol[:, :size][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, size + 2), (n, 1))
        before = np.tile(np.arange(-1, size - 1), (n, 1))
        tree = np.full((n, 2 * size), NONE, np.int64)
        rank = self.ranks(symbol[:, :size].ravel(), symbol[:, 1:].ravel()).reshape(n, size)
        tree[:, size:] = np.where(rank < NONE, (rank << shift) | np.arange(size), NONE)
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        symbol_f, after_f, before_f, tree_f = symbol.ravel(), after.ravel(), before.ravel(), tree.ravel()
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            p = root & ((1 << shift) - 1)
            sym, link, low = rows * (size + 1), rows * (size + 1), rows * (2 * size)
            q = after_f[link + p]
            nxt = np.minimum(after_f[link + q], size)
            new = self.made[root >> shift]
            symbol_f[sym + p] = new
            symbol_f[sym + q] = -1
            after_f[link + p] = nxt
            inner = nxt < size
            before_f[(rows * size + nxt)[inner]] = p[inner]
            prev = before_f[rows * size + p]
            has = prev >= 0
            r_own = self.ranks(new, symbol_f[sym + nxt])
            r_prev = self.ranks(np.where(has, symbol_f[sym + np.maximum(prev, 0)], -1), new)
            tree_f[low + size + q] = NONE
            tree_f[low + size + p] = np.where(r_own < NONE, (r_own << shift) | p, NONE)
            where = (low + size + prev)[has]
            tree_f[where] = np.where(r_prev < NONE, (r_prev << shift) | prev, NONE)[has]
            for leaf in (q, p, np.where(has, prev, p)):
                at = leaf + size
                while at[0] > 1:
                    at = at >> 1
                    tree_f[low + at] = np.minimum(tree_f[low + 2 * at], tree_f[low + 2 * at + 1])
            rows = rows[tree[rows, 1] < NONE]
        left = symbol[:, :size]
        there = left >= 0
        flat_ids = left[there].tolist()
        ends = np.cumsum(there.sum(axis=1)).tolist()
        return [flat_ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def merge_one(self, piece: bytes) -> list[int]:
        """The same for one long piece, on plain lists."""
        symbol = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(symbol)
        size = 1 << max(1, (n - 1).bit_length())
        none = (1 << 60, 0)
        tree = [none] * (2 * size)
        rank_of, made = self.rank_of, self.made

        def leaf(p: int, q: int) -> tuple[int, int]:
            rank = rank_of.get(symbol[p] << 20 | symbol[q]) if 0 <= p and q < n else None
            return none if rank is None else (rank, p)

        for p in range(n - 1):
            tree[size + p] = leaf(p, p + 1)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] < none:
            rank, p = tree[1]
            q = after[p]
            symbol[p], symbol[q] = int(made[rank]), -1
            after[p] = after[q]
            if after[p] < n:
                before[after[p]] = p
            changed = [(q, none), (p, leaf(p, after[p]))]
            if before[p] >= 0:
                changed.append((before[p], leaf(before[p], p)))
            for place, value in changed:
                k = size + place
                tree[k] = value
                while k > 1:
                    k >>= 1
                    tree[k] = min(tree[2 * k], tree[2 * k + 1])
        return [s for s in symbol if s >= 0]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        raw = [p.encode() for p in pieces]
        out: list = [self.byte_ids[np.frombuffer(b, np.uint8)].tolist() if len(b) < 2 else None for b in raw]
        short = [i for i, b in enumerate(raw) if 2 <= len(b) <= LONG]
        for i, ids in zip(short, self.merge_many([raw[i] for i in short]) if short else []):
            out[i] = ids
        for i, b in enumerate(raw):
            if len(b) > LONG:
                out[i] = self.merge_one(b)
        return out

    def pieces(self, text: str) -> list[str]:
        """The text cut at special tokens, and by the pattern between them."""
        if self.split is None or "<" not in text:
            return PATTERN.findall(text)
        parts = self.split.split(text)
        return [x for i, part in enumerate(parts) for x in ([part] if i % 2 else PATTERN.findall(part))]

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        ids = self.encode_pieces([p for p in pieces if p not in self.special])
        found = iter(ids)
        return [i for p in pieces for i in ([self.special[p]] if p in self.special else next(found))]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per process."""
    path = os.fspath(path)
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


class Codec:
    """Encodes and decodes documents by way of their pieces."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known: dict[str, str] = {}
        self.back: dict[str, str] = {}

    def learn(self, documents: list[list[str]]) -> None:
        new = list(set().union(*documents) - self.known.keys())
        if len(self.known) + len(new) > KEPT:
            self.known, self.back = {}, {}
            new = list(set().union(*documents))
        special = self.vocab.special
        plain = [p for p in new if p not in special]
        for piece, ids in zip(plain, self.vocab.encode_pieces(plain)):
            text = ",".join(map(str, ids))
            self.known[piece] = text
            self.back[text] = self.vocab.decode(ids)
        for piece in set(new) & special.keys():
            self.known[piece] = str(special[piece])
            self.back[str(special[piece])] = self.vocab.decode([special[piece]])

    def run(self, texts: list[bytes]) -> Iterator[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each text."""
        documents = [self.vocab.pieces(t.decode()) for t in texts]
        self.learn(documents)
        for pieces in documents:
            coded = list(map(self.known.__getitem__, pieces))
            yield ",".join(coded), "".join(map(self.back.__getitem__, coded))


def _round_trip(path: str):
    def trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary(path))
        for batch in batches:
            texts = texts_of(batch.column(1))
            n, ids_hash, text_hash = [], [], []
            for a, b in slices(texts, 1 << 20):
                for ids, back in codec.run(texts[a:b]):
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return trip


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary(path))
        for batch in batches:
            texts = texts_of(batch.column(1))
            ids: list[list[int]] = []
            for a, b in slices(texts, 1 << 20):
                ids.extend([int(x) for x in joined.split(",")] if joined else [] for joined, _ in codec.run(texts[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return encode


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(ids or []) for ids in flat(batch.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return decode


def bpe_encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every text.  Null and empty texts have no ids; see ``bpe_round_trip`` for the rest."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_encode(path), f"id {kind}, ids array<int>").withColumnRenamed("id", key)


def bpe_decode(coded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids; null ids give an empty text."""
    kind = coded.schema[key].dataType.simpleString()
    return coded.select(key, ids).mapInArrow(_decode(path), f"id {kind}, text string").withColumnRenamed("id", key)


def bpe_round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text).

    Whole texts, null as empty (no tokens); special tokens in a text get their own ids.  Repeated rows and null
    keys come back as they are; an empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(_round_trip(path), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", key)
