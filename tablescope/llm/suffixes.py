"""Removal of long repeated strings by common-prefix intervals of a sampled suffix array.

Matches are of at least ``length`` bytes, so the array needs only sampled suffixes: of all runs of ``GRAM`` bytes inside a
window of ``length`` bytes the one with the least hash (the leftmost of these) is its anchor, and equal windows have
equal anchors at equal places.  Neighbouring windows with one anchor are a stretch.

1. Documents are dealt into chunks.  Longer passages, cut where the hash of a run of bytes ends in zeros, are compared
   whole (``exchange``, 96-bit hashes): a passage that an earlier document holds is repeated as it stands.
2. Chunks ask which anchors of their other stretches occur elsewhere.
3. Stretches with such an anchor go, with the bytes around it, to the prefix partition of the anchor.  There the
   suffixes that start at anchors are sorted; their common-prefix intervals are scanned with a stack; inside an interval
   the bytes to the left are sorted and scanned alike, which splits it where left extensions differ.  Each pair
   of a prefix interval and a left interval is a maximal repeat around the anchor, with all its occurrences: all but
   the earliest are repeated.
4. An anchor in ``HOT`` stretches or more would be an unbounded group.  The windows of its stretches are compared one by
   one instead (``exchange``), so a hot string spreads over all tasks; each chunk sends a window once.
5. Each chunk removes what repeated windows cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.blocks import cut_lineage
from . import exchange
from .exchange import FOUND, NOWHERE, PLACE, Question, among, packed, unpacked
from .kernels import BASE, CHUNK, U, WORD_BASE, _inverse, flat, mix, powers, texts_of

GRAM = 32
CHUNK_BYTES = 4 << 20
"""Text in a chunk, on average."""
SHARE_BYTES = 64 << 20
"""Text whose anchors share a prefix, on average."""
PARTITION_BYTES = 8 << 20
"""Text whose stretches share a partition of suffixes, on average."""
PASSAGE_BITS = 9
"""A passage ends where so many bits of a hash are zero."""
HOT = 20_000
BLOCK = 2 << 20
"""Bytes looked at together; a longer document takes several."""

STRETCH = "part int, unit bigint, number bigint, place binary, left int, body binary"
LOW = U(0xFFFFFFFF)


def rolling(data: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of every run of ``length`` bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, U)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(base, len(data)), out=sums[1:])
    return mix((sums[length:] - sums[:n]) * powers(_inverse(base), n))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbouring values."""
    have, out = 1, values
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :])


class Stretches:
    """Stretches and passages of some texts, as ranges of window starts in ``data`` (the texts with a byte between)."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, self.joined = length, b"\n".join(texts)
        self.data = np.frombuffer(self.joined, np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.origin = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        parts = [self._of(a, min(a + BLOCK, len(self.data))) for a in range(0, len(self.data), BLOCK)]
        joined = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * 4 + [np.empty(0, bool)]
        self.low, self.high, self.anchor, hashes, opens = joined
        self.gram = hashes.astype(U)
        self.doc = np.searchsorted(self.origin, self.low, "right") - 1
        new_doc = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])[: len(self.doc)]
        self.passage = np.cumsum(opens | new_doc) - 1
        first = np.flatnonzero(np.diff(self.passage, prepend=-1))
        self.passage_low = self.low[first]
        self.passage_high = self.high[np.concatenate([first[1:] - 1, [len(self.low) - 1]])] if len(first) else self.high
        self.passage_doc = self.doc[first]

    def _of(self, start: int, stop: int) -> tuple[np.ndarray, ...]:
        """Stretches of the windows that start in a range; a stretch ends where the range or a passage does."""
        n = self.length
        piece = self.data[start : stop + n - 1]
        hashes = rolling(piece, GRAM)
        if len(piece) < n:
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, U), np.empty(0, bool))
        least = sliding_least((hashes & ~LOW) | np.arange(len(hashes), dtype=U), n - GRAM + 1)
        step = np.zeros(len(least) + 1, np.int8)
        long = np.flatnonzero(self.sizes >= n)
        first, last = self.origin[long] - start, self.origin[long] + self.sizes[long] - n - start
        near = (last >= 0) & (first < len(least))
        step[np.maximum(first[near], 0)] += 1
        step[np.minimum(last[near], len(least) - 1) + 1] -= 1
        at = np.flatnonzero(np.cumsum(step[:-1]))
        if not len(at):
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, U), np.empty(0, bool))
        anchor = (least[at] & LOW).astype(np.int64)
        opens = (hashes[at] & U((1 << PASSAGE_BITS) - 1)) == 0
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | opens[1:]]))
        high = at[np.concatenate([new[1:] - 1, [len(at) - 1]])]
        return at[new] + start, high + start, anchor[new] + start, hashes[anchor[new]], opens[new]

    def body(self, i: int) -> bytes:
        return self.joined[self.low[i] : self.high[i] + self.length]

    def passages(self, place: np.ndarray) -> exchange.Entries:
        """Keys of the passages, in their order, and the places of their documents."""
        pairs = zip(self.passage_low.tolist(), self.passage_high.tolist())
        digests = [xxhash.xxh3_128_intdigest(self.joined[a : b + self.length]) for a, b in pairs]
        keys = np.array([d >> 64 for d in digests], U)
        return keys, np.array([d & 0xFFFFFFFF for d in digests], "<u4"), place[self.passage_doc]

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and 96-bit hash of every window of the chosen stretches."""
        n = self.length
        counts = self.high[chosen] - self.low[chosen] + 1
        ends = np.cumsum(counts + n - 1)
        starts, keys, more = [np.empty(0, np.int64)], [np.empty(0, U)], [np.empty(0, "<u4")]
        at = 0
        while at < len(chosen):  # so many stretches that their bytes fit one look
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            some = chosen[at:to]
            data = np.frombuffer(b"".join([self.body(i) for i in some.tolist()]), np.uint8)
            ramp = np.arange(counts[at:to].sum()) - np.repeat(np.cumsum(counts[at:to]) - counts[at:to], counts[at:to])
            inside = np.repeat(ends[at:to] - base - counts[at:to] - n + 1, counts[at:to]) + ramp
            starts.append(np.repeat(self.low[some], counts[at:to]) + ramp)
            keys.append(rolling(data, n)[inside])
            more.append((rolling(data, n, WORD_BASE)[inside] >> U(32)).astype("<u4"))
            at = to
        return np.concatenate(starts), np.concatenate(keys), np.concatenate(more)


class Chunk:
    """The documents of a chunk in their order, and what is known of their stretches."""

    def __init__(self, docs: pa.Table, key: str, text: str, length: int):
        texts = texts_of(flat(docs[text]))
        ids = [(1 << 64) - 1 if k is None else k + (1 << 63) for k in docs[key].to_pylist()]
        ties = [xxhash.xxh32_intdigest(t) for t in texts]
        self.order = sorted(range(len(texts)), key=lambda i: (ids[i], ties[i], texts[i]))
        self.texts = [texts[i] for i in self.order]
        self.place = np.array([(ids[i], ties[i]) for i in self.order], PLACE)
        self.number = docs["chunk"][0].as_py() if docs.num_rows else 0
        self.s = Stretches(self.texts, length)

    def know(self, found: pa.Table | None, hot: int) -> None:
        """Take in the answers so far: repeated passages, fresh stretches, shared and hot ones."""
        s = self.s
        said = _by_kind(found)
        keys, more, place = s.passages(self.place)
        self.again = exchange.member(keys, more, *said[0])
        order = np.lexsort((np.arange(len(keys)), more, keys))
        self.again[order[1:]] |= (keys[order[1:]] == keys[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
        fresh = ~self.again[s.passage]
        self.copies = self._copies(fresh)
        fresh[self.copies] = False
        self.fresh = np.flatnonzero(fresh)
        known, at = np.unique(said[1][0], return_index=True)
        shared = self.fresh[among(s.gram[self.fresh], known)]
        total = said[1][1][at][np.searchsorted(known, s.gram[shared])] if len(shared) else np.empty(0, "<u4")
        self.shared, self.hot = shared[total < hot], shared[total >= hot]
        self.marks, self.windows_again = said[2][0], said[3]

    def _copies(self, fresh: np.ndarray) -> np.ndarray:
        """Stretches that equal an earlier fresh one of this chunk, byte for byte."""
        s, own = self.s, np.flatnonzero(fresh)
        _, inverse, counts = np.unique(s.gram[own], return_inverse=True, return_counts=True)
        seen, out = set(), []
        for i in own[counts[inverse] > 1].tolist():
            body = s.body(i)
            if body in seen:
                out.append(i)
            seen.add(body)
        return np.array(out, np.int64)

    def hot_windows(self) -> tuple[np.ndarray, exchange.Entries]:
        start, keys, more = self.s.windows(self.hot)
        doc = np.searchsorted(self.s.origin, start, "right") - 1
        return start, (keys, more, self.place[doc])


def _by_kind(found: pa.Table | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Answers about passages (0), anchors (1), stretches (2) and hot windows (3): keys, and what is said of them."""
    out = []
    for kind in range(4):
        rows = found.filter(pa.array([k == kind for k in found["kind"].to_pylist()], pa.bool_())) if found is not None else None
        out.append(unpacked(rows)[1:] if rows is not None else (np.empty(0, "<u8"), np.empty(0, "<u4")))
    return out


class _Steps:
    """What is done with a chunk at each step."""

    def __init__(self, key: str, text: str, length: int, plan: exchange.Plan, parts: int, hot: int):
        self.key, self.text, self.length, self.plan, self.parts, self.hot = key, text, length, plan, parts, hot

    def chunk(self, docs: pa.Table, found: pa.Table | None) -> Chunk:
        chunk = Chunk(docs, self.key, self.text, self.length)
        chunk.know(found, self.hot)
        return chunk

    def passages(self, docs: pa.Table) -> pa.Table:
        chunk = Chunk(docs, self.key, self.text, self.length)
        return packed(chunk.number, *Question().merged(*chunk.s.passages(chunk.place)), self.plan.width)

    def anchors(self, docs: pa.Table, found: pa.Table) -> pa.Table:
        chunk = self.chunk(docs, found)
        keys, counts = np.unique(chunk.s.gram[chunk.fresh], return_counts=True)
        return packed(chunk.number, keys, np.minimum(counts, 0xFFFFFFFF), NOWHERE, self.plan.width)

    def stretches(self, docs: pa.Table, found: pa.Table) -> pa.Table:
        chunk = self.chunk(docs, found)
        s, own = chunk.s, chunk.shared
        place = chunk.place[s.doc[own]]
        return pa.table({
            "part": pa.array((s.gram[own] % U(self.parts)).astype(np.int32)), "unit": pa.array([chunk.number] * len(own), pa.int64()),
            "number": pa.array(own, pa.int64()), "place": pa.array([p.tobytes() for p in place], pa.binary()),
            "left": pa.array((s.anchor[own] - s.low[own]).astype(np.int32)), "body": pa.array([s.body(i) for i in own.tolist()], pa.binary()),
        })

    def windows(self, docs: pa.Table, found: pa.Table) -> pa.Table:
        chunk = self.chunk(docs, found)
        return packed(chunk.number, *Question().merged(*chunk.hot_windows()[1]), self.plan.width)


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of sorted strings whose neighbours share ``least`` or more; innermost first.

    ``common[i]`` is what strings i-1 and i share.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(common) + 1):
        depth, first = common[i] if i < len(common) else -1, i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i - 1
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def shared_start(a: bytes, b: bytes) -> int:
    """Number of bytes two strings share from their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is shared, a[:high] is not
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


def _shared_starts(strings: list[bytes]) -> list[int]:
    return [0, *map(shared_start, strings, strings[1:])]


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int, least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, occurrences) of each maximal repeat of ``length`` bytes or more around the anchors.

    ``rights`` start at an anchor; ``lefts`` are the bytes before it, backwards.  ``left`` and ``right`` are the
    bytes all occurrences share on either side; those of a wider group share less.
    """
    suffixes = sorted(range(len(rights)), key=rights.__getitem__)
    for right, first, last in intervals(_shared_starts([rights[i] for i in suffixes]), least):
        need = length - right
        own = [i for i in suffixes[first : last + 1] if len(lefts[i]) >= need]
        if len(own) > 1:
            own.sort(key=lefts.__getitem__)
            for left, a, b in intervals(_shared_starts([lefts[i] for i in own]), max(need, 0)):
                yield left, right, own[a : b + 1]


def _repeated(length: int):
    """Windows of stretches that an earlier occurrence has too, per chunk."""

    def repeated(table: pa.Table) -> pa.Table:
        bodies, left = table["body"].to_pylist(), table["left"].to_pylist()
        unit, number = table["unit"].to_pylist(), table["number"].to_pylist()
        place = np.frombuffer(b"".join(table["place"].to_pylist()), PLACE)
        when = list(zip(place["id"].tolist(), place["tie"].tolist(), number))
        rights = [b[n:] for b, n in zip(bodies, left)]
        lefts = [b[:n][::-1] for b, n in zip(bodies, left)]
        masks = [0] * len(bodies)  # bit o: the window that starts o bytes before the anchor is repeated
        for shared_left, shared_right, own in maximal_repeats(lefts, rights, length, GRAM):
            mask = (1 << shared_left + 1) - (1 << max(0, length - shared_right))
            earliest = min(own, key=when.__getitem__)
            for i in own:
                if i != earliest:
                    masks[i] |= mask
        found: dict[int, list[int]] = {}
        for i, mask in enumerate(masks):
            mask &= (1 << left[i] + 1) - (1 << max(0, length - len(rights[i])))
            while mask:
                low = (mask & -mask).bit_length() - 1
                high = low + ((~(mask >> low)) & ((mask >> low) + 1)).bit_length() - 1
                found.setdefault(unit[i], []).append(number[i] << 32 | left[i] - high + 1 << 16 | left[i] - low)
                mask &= ~((1 << high) - 1)
        return pa.table({
            "unit": pa.array(list(found), pa.int64()), "keys": pa.array([np.array(x, "<u8").tobytes() for x in found.values()], pa.binary()),
            "more": pa.array([b""] * len(found), pa.binary()), "prefix": pa.array([0] * len(found), pa.int64()),
        })

    return repeated


def gone_bytes(chunk: Chunk) -> np.ndarray:
    """Which bytes of a chunk repeated windows cover."""
    s = chunk.s
    edge = np.zeros(len(s.data) + 1, np.int64)

    def cover(low: np.ndarray, high: np.ndarray) -> None:
        np.add.at(edge, low, 1)
        np.add.at(edge, high + s.length, -1)

    cover(s.passage_low[chunk.again], s.passage_high[chunk.again])
    cover(s.low[chunk.copies], s.high[chunk.copies])
    marks = chunk.marks.astype(np.int64)
    base = s.low[marks >> 32]
    cover(base + (marks >> 16 & 0xFFFF), base + (marks & 0xFFFF))
    start, (keys, more, _) = chunk.hot_windows()
    hit = exchange.member(keys, more, *chunk.windows_again)
    order = np.lexsort((np.arange(len(keys)), more, keys))
    hit[order[1:]] |= (keys[order[1:]] == keys[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
    cover(start[hit], start[hit])
    return np.cumsum(edge[:-1]) > 0


def _cut(steps: _Steps, keep: list[str], whole: bool):
    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        chunk = steps.chunk(docs, found)
        gone, s = gone_bytes(chunk), chunk.s
        kept, removed, spans = [], [], []
        for d, raw in enumerate(chunk.texts):
            own = gone[s.origin[d] : s.origin[d] + len(raw)]
            removed.append(int(own.sum()))
            spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
            kept.append(np.frombuffer(raw, np.uint8)[~own].tobytes() if removed[-1] else raw)
        out = docs.select(keep).take(pa.array(chunk.order, pa.int64()))
        out = out.append_column("n_bytes", pa.array(s.sizes, pa.int64()))
        out = out.append_column("n_removed", pa.array(removed, pa.int64())).append_column("n_spans", pa.array(spans, pa.int64()))
        if whole:
            return out.append_column("kept", pa.array(kept, pa.binary()))
        return out.append_column("kept_sha256", pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))

    return cut


def remove_repeated_strings(
    docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, whole: bool = True,
    chunk_bytes: int = CHUNK_BYTES, share: int = SHARE_BYTES, width: int = exchange.WIDTH, partition: int = PARTITION_BYTES, hot: int = HOT,
) -> DataFrame:
    """Drop every byte covered by a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller id, or the same row and a smaller start.  Ids are whole numbers; rows without an id come last;
    rows of one id follow each other by a hash of their texts, equal rows in any order.  Strings do not cross texts and are
    judged on the input.  Returns the columns ``keep`` (default: the key) with n_bytes, n_removed, n_spans (maximal runs
    removed) and the remaining bytes as ``kept`` (a binary column, as a cut may part a character), or without
    ``whole`` their lowercase hex SHA-256 as kept_sha256.  Null texts have no bytes; texts shorter than ``length`` stay as they
    are; an empty table gives none.  Columns named chunk or as the results must not be among ``keep``.
    """
    if not isinstance(docs.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise ValueError(f"{key} must be a whole number, as earlier documents are those of smaller ids")
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} bytes or more")
    keep = [key] if keep is None else keep
    clash = {"chunk", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"} & set(keep)
    if clash:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    chunks = max(32, -(-size // chunk_bytes))
    plan = exchange.plan_for(size, share, width)
    steps = _Steps(key, text, length, plan, max(64, -(-size // partition)), hot)
    columns = list(dict.fromkeys([*keep, key, text]))
    dealt = docs.select(*columns, F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(chunks)).alias("chunk"))
    grouped = dealt.groupBy("chunk")
    answered = lambda found, kind: found.withColumn("kind", F.lit(kind))
    step = lambda known, work, schema: grouped.cogroup(known.groupBy("unit")).applyInArrow(work, schema)
    passages = grouped.applyInArrow(lambda docs: steps.passages(docs), exchange.SENT)
    known = cut_lineage(answered(exchange.ask(passages, Question(), plan), 0))
    anchors = step(known, lambda docs, found: steps.anchors(docs, found), exchange.SENT)
    known = known.unionByName(cut_lineage(answered(exchange.ask(anchors, Question(2), plan), 1)))
    stretches = step(known, lambda docs, found: steps.stretches(docs, found), STRETCH)
    marks = stretches.groupBy("part").applyInArrow(_repeated(length), FOUND)
    windows = step(known, lambda docs, found: steps.windows(docs, found), exchange.SENT)
    again = exchange.ask(windows, Question(), plan)
    known = known.unionByName(answered(marks, 2)).unionByName(answered(again, 3))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_bytes bigint, n_removed bigint, n_spans bigint", "kept binary" if whole else "kept_sha256 string"])
    return step(known, _cut(steps, keep, whole), schema)
