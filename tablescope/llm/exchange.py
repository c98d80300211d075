"""Questions of chunks about keys that other chunks may hold: packed, sorted, and with a fixed fan-out.

A chunk of documents asks about its distinct 64-bit keys.  It sends them sorted and packed, one row for each of at most
``2 ** WIDTH`` prefixes.  While that many prefixes suffice, one exchange by prefix answers.  Beyond, ``2 ** width``
chunks form a unit: a task joins their rows of one prefix, keeps every key once, and asks in their name by longer
prefixes; the answers come back the same way.  So a chunk's rows do not grow in number with the input, a key that
every chunk holds is one entry a unit at each step, and no task holds more than its share of distinct keys.

Two questions: ``frequent`` (which keys have ``least`` occurrences or more in all; the answer brings their number) and
``earlier`` (which keys does a document before this one hold; keys then carry 32 further bits, and are equal when all
96 bits are, and the place of the document in the order of all).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import U

WIDTH = 10
"""Most prefix bits in one exchange."""

SENT = "prefix bigint, unit bigint, keys binary, more binary, place binary"
FOUND = "unit bigint, keys binary, more binary, prefix bigint"
PLACE = np.dtype([("id", "<u8"), ("tie", "<u4")])
"""Place of a document: its id as an ordered number, then a hash of its text."""


@dataclass(frozen=True)
class Plan:
    """Exchanges one after the other (``steps``), and the prefix bits each adds (``width``)."""

    steps: int
    width: int


def plan_for(size: int, share: int, width: int = WIDTH, least_bits: int = 6) -> Plan:
    """So many prefixes that one covers the keys of about ``share`` of ``size`` bytes."""
    bits = max(least_bits, (max(0, size - 1) // share).bit_length())
    steps = -(-bits // width)
    return Plan(steps, -(-bits // steps))


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]
"""Keys, what else they carry (occurrences, or further bits), and places (none when occurrences are counted)."""


@dataclass(frozen=True)
class Question:
    """``least`` occurrences in all, or (``least`` 0) an earlier document."""

    least: int = 0

    def merged(self, keys: np.ndarray, more: np.ndarray, place: np.ndarray) -> Entries:
        """Every entry once, sorted: occurrences added (up to what 32 bits hold), or the earliest place."""
        if not len(keys):
            return keys, more, place
        if self.least:
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            total = np.add.reduceat(more[order].astype(U), new)
            return keys[new], np.minimum(total, U(0xFFFFFFFF)).astype("<u4"), place
        order = np.lexsort((place["tie"], place["id"], more, keys))
        keys, more, place = keys[order], more[order], place[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])])
        return keys[new], more[new], place[new]

    def answered(self, keys: np.ndarray, more: np.ndarray, place: np.ndarray, above: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Which of the entries the answer names, and what it says of them; ``above`` is the answer to all of them together."""
        if self.least:
            if above is None:
                own, total, _ = self.merged(keys, more, place)
                total = total[np.searchsorted(own, keys)]
                return total >= self.least, total
            known, at = np.unique(above[0], return_index=True)
            if not len(known):
                return np.zeros(len(keys), bool), more
            where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            return known[where] == keys, above[1][at][where]
        order = np.lexsort((more, keys))
        k, m, p = keys[order], more[order], place[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])[: len(k)]
        group = np.cumsum(new) - 1
        first = p[np.lexsort((p["tie"], p["id"], group))][np.flatnonzero(new)] if len(k) else p
        hit = np.empty(len(keys), bool)
        hit[order] = p != first[group]
        if above is not None:
            hit |= member(keys, more, *above)
        return hit, more


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among sorted others."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def member(keys: np.ndarray, more: np.ndarray, of_keys: np.ndarray, of_more: np.ndarray) -> np.ndarray:
    """Which entries are among others, by key and further bits."""
    pair = np.dtype([("k", "<u8"), ("m", "<u4")])
    both = lambda k, m: np.rec.fromarrays([k, m], dtype=pair)
    out = among(keys, np.unique(of_keys))
    out[out] = np.isin(both(keys[out], more[out]), both(of_keys, of_more))
    return out


def packed(unit: int, keys: np.ndarray, more: np.ndarray, place: np.ndarray, bits: int) -> pa.Table:
    """Sorted entries as one row for each prefix of ``bits`` bits."""
    prefix = (keys >> U(64 - bits)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(prefix)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return pa.table({
        "prefix": pa.array([int(prefix[a]) for a, _ in spans], pa.int64()), "unit": pa.array([unit] * len(spans), pa.int64()),
        "keys": pa.array([keys[a:b].astype("<u8").tobytes() for a, b in spans], pa.binary()),
        "more": pa.array([more[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
        "place": pa.array([place[a:b].tobytes() for a, b in spans], pa.binary()),
    })


NOWHERE = np.empty(0, PLACE)


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, keys, more) of the entries of packed rows."""
    keys = [np.frombuffer(x, "<u8") for x in table["keys"].to_pylist()]
    more = [np.frombuffer(x, "<u4") for x in table["more"].to_pylist()]
    if not keys:
        return np.empty(0, np.int64), np.empty(0, "<u8"), np.empty(0, "<u4")
    return np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate(keys), np.concatenate(more)


def places(table: pa.Table) -> np.ndarray:
    """The places the entries of packed rows carry."""
    found = [np.frombuffer(x, PLACE) for x in table["place"].to_pylist()]
    return np.concatenate(found) if found else NOWHERE


def _named(table: pa.Table, row: np.ndarray, keys: np.ndarray, more: np.ndarray, hit: np.ndarray) -> pa.Table:
    """The named entries, in rows of the units that sent them."""
    units, prefixes = table["unit"].to_pylist(), table["prefix"].to_pylist()
    rows = {"unit": [], "keys": [], "more": [], "prefix": []}
    at = np.searchsorted(row, np.arange(table.num_rows + 1))
    for i in range(table.num_rows):
        own = hit[at[i] : at[i + 1]]
        if own.any():
            rows["unit"].append(units[i])
            rows["prefix"].append(prefixes[i])
            rows["keys"].append(keys[at[i] : at[i + 1]][own].tobytes())
            rows["more"].append(more[at[i] : at[i + 1]][own].tobytes())
    kinds = {"unit": pa.int64(), "keys": pa.binary(), "more": pa.binary(), "prefix": pa.int64()}
    return pa.table({name: pa.array(rows[name], kind) for name, kind in kinds.items()})


def _answer(question: Question):
    def answer(sent: pa.Table, found: pa.Table | None = None) -> pa.Table:
        row, keys, more = unpacked(sent)
        hit, said = question.answered(keys, more, places(sent), None if found is None else unpacked(found)[1:])
        return _named(sent, row, keys, said, hit)

    return answer


def _climb(question: Question, bits: int):
    def climb(table: pa.Table) -> pa.Table:
        _, keys, more = unpacked(table)
        return packed(table["parent"][0].as_py(), *question.merged(keys, more, places(table)), bits)

    return climb


def ask(sent: DataFrame, question: Question, plan: Plan, step: int = 1) -> DataFrame:
    """Answers to the packed rows ``sent`` (prefixes of ``width`` bits a step), as rows of the asking units."""
    if step >= plan.steps:
        return sent.groupBy("prefix").applyInArrow(lambda table: _answer(question)(table), FOUND)
    grouped = sent.withColumn("parent", F.shiftright("unit", plan.width))
    up = grouped.groupBy("prefix", "parent").applyInArrow(_climb(question, plan.width * (step + 1)), SENT)
    down = ask(up, question, plan, step + 1).withColumn("prefix", F.shiftright("prefix", plan.width))
    return grouped.groupBy("prefix", "parent").cogroup(down.groupBy("prefix", "unit")).applyInArrow(lambda own, found: _answer(question)(own, found), FOUND)
