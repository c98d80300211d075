"""Training sequences: tokenize documents, cut the over-long ones, pack the pieces into sequences of fixed length.

Packing follows Martello and Toth's reduction.  From the largest piece down, a small set is fixed for good when it
dominates every other filling of the sequence that holds the piece: the piece alone if nothing else fits, the
piece with one that fills the rest exactly, or with the largest that fits when no two others fit together or none
of the pairs that fit is larger than it.  What is left is packed best-fit, largest first.

Pieces are dealt by hash into groups of about ``GROUP``; a group is packed by one task, so the work is spread and
the loss is at most about one open sequence a group.  Only ids, numbers and lengths are dealt.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from ..operators.blocks import cut_lineage
from .bpe import byte_characters
from .kernels import slices, texts_of

LENGTH = 2048
GROUP = 8192
"""Pieces packed together, on average."""
KEPT = 500_000
"""Words whose ids are kept at most."""
LETTERS = {i: c for i, c in enumerate(byte_characters()) if i != 10}
"""Letters that stand for bytes; a line feed is in no word and stands between words."""
BLANK, LETTER, NUMBER, OTHER = range(4)
MARKS = 0xD800
"""Special tokens stand in texts as lone surrogates from here on, which no UTF-8 text holds."""


def _kinds() -> np.ndarray:
    """The kind of every code point."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    kinds = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((BLANK, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for found in regex.finditer(pattern, every):
            kinds[found.start() : found.end()] = kind
    kinds[MARKS : 0xE000] = NUMBER  # a word each
    return kinds


class WordTokenizer:
    """Ids of whole texts by way of their words, for a vocabulary file whose words do not depend on each other.

    The words are cut as the file says (normal form C, lower case, its pattern ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|
    [^\\s\\p{L}\\p{N}]+``), over the bytes of many texts at once; the tokenizers library turns a word into ids, and results are
    kept by word.  No Python loop runs per word but for those not seen before.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.special = {chr(MARKS + k).encode("utf-8", "surrogatepass"): i for k, i in enumerate(special.values())}
        self.marks = {c: chr(MARKS + k) for k, c in enumerate(special)}
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.kinds = _kinds()
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.ids, self.starts = np.empty(0, "<u4"), np.zeros(1, np.int64)

    @staticmethod
    def lower(text: str) -> str:
        """Lower case letter by letter, whatever stands beside a letter."""
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def normal(self, raw: bytes) -> bytes:
        """The text in normal form and lower case, special tokens as their marks."""
        if b"<|" not in raw or self.split is None:
            if raw.isascii():
                return raw.lower()
            return self.lower(unicodedata.normalize("NFC", raw.decode())).encode()
        parts = self.split.split(raw.decode())
        made = [self.marks[p] if i % 2 else self.lower(unicodedata.normalize("NFC", p)) for i, p in enumerate(parts)]
        return "".join(made).encode("utf-8", "surrogatepass")

    def words(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """All words of the texts one after the other, and the number of words before each text and in all."""
        made = [self.normal(t) for t in texts]
        at = np.cumsum([0, *(len(t) + 1 for t in made)])
        raw = np.frombuffer(b"\n".join(made) + b"\n\n\n\n", np.uint8)
        kind = self.kinds[:256][raw]
        first = np.empty(len(raw), bool)
        first[0] = True
        wide = np.flatnonzero(raw >= 0xC0)
        if len(wide):
            code, long = raw[wide].astype(np.int32), np.zeros(len(wide), bool)
            code = np.where(code < 0xE0, code & 0x1F, np.where(code < 0xF0, code & 0x0F, code & 0x07))
            for k in (1, 2, 3):  # bytes that go on with a code point are of its kind
                long = (raw[wide + k] & 0xC0) == 0x80 if k == 1 else long & ((raw[wide + k] & 0xC0) == 0x80)
                code = np.where(long, code << 6 | raw[wide + k] & 0x3F, code)
            kind[wide] = self.kinds[code]
            more = np.flatnonzero((raw & 0xC0) == 0x80)
            kind[more] = kind[wide[np.searchsorted(wide, more, "right") - 1]]
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        if len(wide):
            first[more] = False
        first &= kind != BLANK
        mark = np.flatnonzero(first & (raw == ord("'")))
        mark = mark[kind[mark + 1] == LETTER]
        a, b = raw[mark + 1], raw[mark + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        mark, size = mark[one | two], np.where(one, 1, 2)[one | two]
        first[mark + 1] = False
        after = mark + 1 + size
        first[after[kind[after] == LETTER]] = True
        held = kind != BLANK
        ends = np.flatnonzero(np.append(first[held], True)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw[held])])
        return found, np.searchsorted(np.flatnonzero(first), at)

    def _learn(self, new: pa.Array) -> None:
        """Keep the ids of more words."""
        tokenize = self.model.tokenize
        listed = new.to_pylist()
        letters = b"\n".join(listed).decode("latin-1").translate(LETTERS).split("\n")
        ids = [[self.special[w]] if w in self.special else [t.id for t in tokenize(s)] for w, s in zip(listed, letters)]
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), "<u4", ends[-1])])
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
        self.known = pa.concat_arrays([self.known, new])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        words, cuts = self.words(texts)
        coded = words.dictionary_encode()
        place = pc.index_in(coded.dictionary, self.known)
        if place.null_count and len(self.known) + place.null_count > KEPT:
            self._forget()
            place = pc.index_in(coded.dictionary, self.known)
        if place.null_count:
            new = place.is_null()
            place = place.fill_null(0).to_numpy().copy()
            place[new.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + pc.sum(new).as_py())
            self._learn(coded.dictionary.filter(new))
        word = np.asarray(place)[coded.indices.to_numpy()]
        sizes = np.diff(self.starts)[word]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[word] - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = ends[cuts].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


_LOADED: dict[str, WordTokenizer] = {}


def _pieces(path: str, end: int, length: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = WordTokenizer(os.fspath(path))
        tokenizer = _LOADED[path]
        closing = np.array([end], "<u4").tobytes()
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts, 1 << 22):
                row, number, start, size, crc, ids = [], [], [], [], [], []
                for d, raw in enumerate(tokenizer.encode(texts[a:b]), a):
                    raw += closing
                    for k, at in enumerate(range(0, len(raw), 4 * length)):
                        part = raw[at : at + 4 * length]
                        row.append(d)
                        number.append(k)
                        start.append(k * length)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        ids.append(np.frombuffer(part, "<i4") if with_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                    names=["id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return pieces


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids): documents as ids with ``end`` after them, cut only if longer than ``length``.

    A null or empty text is the end alone; repeated rows give repeated pieces; null keys pass through; an empty
    table has no pieces; ids are null unless asked for.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>"
    return docs.select(key, text).mapInArrow(_pieces(path, end, length, with_ids), schema).withColumnRenamed("id", key)


def pack_lengths(sizes: list[int], length: int) -> list[list[int]]:
    """Groups of positions, each of at most ``length`` in sum; every size is 1 to ``length``."""
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    for i, size in enumerate(sizes):
        stacks[size].append(i)
    there = 0  # bit s: some piece of size s is free
    for size in range(1, length + 1):
        if stacks[size]:
            there |= 1 << size

    def take(size: int) -> int:
        nonlocal there
        found = stacks[size].pop()
        if not stacks[size]:
            there &= ~(1 << size)
        return found

    def smallest(n: int) -> list[int]:
        out, mask = [], there
        while mask and len(out) < n:
            size = (mask & -mask).bit_length() - 1
            out += [size] * min(len(stacks[size]), n - len(out))
            mask &= mask - 1
        return out

    packed, rest = [], []
    for a in range(length, 0, -1):
        while stacks[a]:
            own, room = take(a), length - a
            fits = (there & ((1 << (room + 1)) - 1)).bit_length() - 1
            if 0 < fits == room:
                packed.append([own, take(fits)])
            elif rest and rest[-1][0] <= room:  # a piece put off, no smaller than this one, might share its sequence
                rest.append((a, own))
            elif fits <= 0:
                packed.append([own])
            elif not _pair_beats(fits, room, smallest(3), there, stacks):
                packed.append([own, take(fits)])
            else:
                rest.append((a, own))
    open_at: list[list[list[int]]] = [[] for _ in range(length + 1)]
    mask = 0  # bit r: some open sequence has room r
    for size, own in rest:
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            group = open_at[room].pop()
            if not open_at[room]:
                mask &= ~(1 << room)
        else:
            room, group = length, []
            packed.append(group)
        group.append(own)
        if room > size:
            open_at[room - size].append(group)
            mask |= 1 << (room - size)
    return packed


def _pair_beats(fits: int, room: int, least: list[int], there: int, stacks: list[list[int]]) -> bool:
    """Whether some set of two or more free pieces within ``room`` could do better than the single one of size ``fits``."""
    if len(least) < 2 or least[0] + least[1] > room:
        return False
    if len(least) > 2 and sum(least) <= room:
        return True
    best, mask = 0, there & ((1 << room) - 1)  # at most two fit: the largest pair within the room
    while mask:
        x = mask.bit_length() - 1
        mask &= ~(1 << x)
        other = there & ((1 << (min(x, room - x) + 1)) - 1)
        if x <= room - x and len(stacks[x]) < 2:
            other &= ~(1 << x)
        y = other.bit_length() - 1
        if y > 0:
            best = max(best, x + y)
    return best > fits


def _pack(length: int, kept: list[str]):
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        sizes = table["length"].to_pylist()
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        base = key[0].as_py() << 32
        for k, group in enumerate(pack_lengths(sizes, length)):
            at = 0
            for i in group:
                sequence[i], offset[i] = base + k, at
                at += sizes[i]
        out = table.select(kept)
        return out.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return pack


def pack_pieces(pieces: DataFrame, key: str = "doc_id", length: int = LENGTH, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Add sequence_id and offset to pieces (key, piece, start, length, ids_crc32): gapless places in sequences of ``length``.

    With ``with_ids`` the pieces keep their ids, so that the sequences can be put together.  Equal rows are packed each for
    itself; ties go by key and piece; an empty table gives an empty result.
    """
    kind = pieces.schema[key].dataType.simpleString()
    kept = ["id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    small = cut_lineage(pieces.withColumnRenamed(key, "id").select(*kept))
    groups = max(1, round(small.count() / group))
    dealt = small.withColumn("grp", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(groups)))
    kinds = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, " + ("ids array<int>, " if with_ids else "")
    packed = dealt.groupBy("grp").applyInArrow(_pack(length, kept), f"{kinds}sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("id", key)
