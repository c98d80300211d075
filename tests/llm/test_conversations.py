"""Conversation repair against all edits of small conversations, over several batches, spilled, and with odd rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from tablescope.llm import conversations as conv

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, fault string, alive int"


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        c, t, r, x = (" " if v is None else str(v) for v in (c, t, r, x))
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            out += [("user" if kind == 4 else r, x, None if t == " " else int(t))] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[2] is not None, r[2] or 0, r[0], r[1]))


def plain(rows):
    seen, faults = set(), []
    for r, x, _ in rows:
        body = x.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((r, x))
    best = None
    ways = ["", "I", "II"]
    for puts in itertools.product(ways, repeat=len(rows) + 1):
        for letters in itertools.product("DKR", repeat=len(rows)):
            cost, edits, said = 0, "", []
            for put, letter, (r, x, _), fault in zip(puts, letters, rows, faults):
                for _ in put:
                    said.append(("assistant" if said and said[-1][0][:1] == "u" else "user", ""))
                if letter != "D" and fault in ("blank", "duplicate"):
                    break
                edits += put + letter
                cost += 5 * len(put) + {"D": 2, "R": 1, "K": 0}[letter] + (5 if letter != "D" and fault == "truncated" else 0)
                if letter == "K":
                    said.append((r, x))
                elif letter == "R":
                    said.append(("assistant" if said and said[-1][0][:1] == "u" else "user", x))
            else:
                for _ in puts[-1]:
                    said.append(("assistant" if said and said[-1][0][:1] == "u" else "user", ""))
                edits, cost = edits + puts[-1], cost + 5 * len(puts[-1])
                initials = "".join(r[:1] or "-" for r, _ in said)
                if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, edits) < best[:2]):
                    best = (cost, edits, "\n".join(f"{r}:{x}" for r, x in said))
    turns = [t for _, _, t in rows if t is not None]
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def made(seed=5, n=60):
    rng = np.random.default_rng(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["One.", "Two!", "open end", " \t", "", None, "Why? ", "é。"]
    rows = []
    for c in range(n):
        for k in range(int(rng.integers(1, 5))):
            turn = None if rng.random() < 0.05 else int(k + rng.integers(0, 2) * rng.integers(0, 3))
            rows.append((c if c else None, turn, roles[rng.integers(0, 8)], texts[rng.integers(0, 8)]))
    return rows


def results(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("held", [conv.HELD, 1])
def test_against_all_edits(spark, held):
    rows = made()
    df = spark.createDataFrame([(*r, "k", "f", 1) for r in rows], SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = results(conv.repaired_conversations(df, held=held))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert got == {c: plain(damaged(own)) for c, own in by.items()}


def test_long_conversation_in_blocks(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("'x' AS key", "true AS alive", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', id, '.') AS text")
    got = conv.repair(rows, held=10_000).first()
    said = "\n".join(f"{'assistant' if i % 2 else 'user'}:text {i}." for i in range(n))
    assert (got.cost, got.audit, got.repaired_sha256) == (0, "K" * n, hashlib.sha256(said.encode()).hexdigest())


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Yes.", "k", "f", 1)], SCHEMA)
    assert results(conv.repaired_conversations(df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conv.repaired_conversations(df.where("false")).count() == 0
