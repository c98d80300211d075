"""Repair of conversations: damaged turns are found and the cheapest edits give a legal order of roles.

One shuffle by conversation; each task sorts its rows by conversation and, inside one, from the last turn to the
first, and streams them through ``mapInPandas``.  Only the costs of the four places a conversation can be in are
carried from row to row, so a conversation may go over any number of Arrow batches.  Two bytes a row (what to do from
each place) and the row's text are kept until its first turn arrives; beyond ``HELD`` bytes they go to an unnamed file
of the task in blocks that are read backwards.  Then the choices are followed from the first turn to the last.

Places: nothing said yet, after the system, after the user, after the assistant.  A conversation may end in the first
and the last one.  Costs are carried backwards, so the least letter that keeps the cost may be taken at each step
forwards, which gives the ASCII-least edits.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

HELD = 8 << 20
"""Bytes of one conversation a task keeps in memory before they go to its file."""

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = ("user", "user", "assistant", "user")
"""The role that may follow in each place (the system may open too, but is never put in)."""
NEXT = (USER, USER, ASSISTANT, USER)
LEGAL = {"su", "ua", "au"}
ENDING = (0, 2, 1, 0)
"""Rows to put in after the last one: after the system, user and assistant must follow; after the user, the assistant."""
BLANK, DUPLICATE, CUT, SOUND = "blank", "duplicate", "truncated", ""


def _own_costs(costs: tuple[int, ...], initial: str, fault: str) -> list[tuple[int, str, int]]:
    """Per place: cost, letter and next place of the cheapest way to treat this row without inserting before it."""
    out = []
    for place in range(4):
        ways = [(DELETE + costs[place], "D", place)]
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT else 0
            kept = AFTER.get((place, initial))
            if kept is not None:
                ways.append((extra + costs[kept], "K", kept))
            ways.append((REROLE + extra + costs[NEXT[place]], "R", NEXT[place]))
        out.append(min(ways))
    return out


def _step(costs: tuple[int, ...], initial: str, fault: str) -> tuple[tuple[int, ...], int]:
    """Costs before a row from those after it, and the choices per place packed into two bytes.

    Four bits a place: two for the rows put in before this one (0 to 2), two for the letter.  Of equal costs the
    ASCII-least edits win: ``D`` before ``I`` before ``K`` before ``R``.
    """
    own = _own_costs(costs, initial, fault)
    best, packed = [], 0
    for place in range(4):
        at, ways = place, []
        for put in range(3):
            cost, letter, _ = own[at]
            ways.append((put * INSERT + cost, "I" * put + letter))
            at = NEXT[at]
        cost, letters = min(ways)
        best.append(cost)
        packed |= ((len(letters) - 1) | "DKR".index(letters[-1]) << 2) << 4 * place
    return tuple(best), packed


class _Backwards:
    """Rows pushed in reverse order and read forwards; blocks beyond ``held`` bytes lie in the task's own file."""

    def __init__(self, held: int):
        self.held, self.rows, self.size, self.file, self.places = held, [], 0, None, []

    def push(self, row: tuple[int, str, str]) -> None:
        self.rows.append(row)
        self.size += len(row[1]) + len(row[2]) + 80
        if self.size > self.held:
            self.file = self.file or tempfile.TemporaryFile()
            self.places.append(self.file.tell())
            pickle.dump(self.rows, self.file)
            self.rows, self.size = [], 0

    def __iter__(self) -> Iterator[tuple[int, str, str]]:
        yield from reversed(self.rows)
        for place in reversed(self.places):
            self.file.seek(place)
            yield from reversed(pickle.load(self.file))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Conversation:
    """State carried over the rows of one conversation, from its last row to its first."""

    def __init__(self, key: str | None, held: int):
        self.key, self.rows = key, _Backwards(held)
        self.costs = tuple(INSERT * n for n in ENDING)
        self.counts = dict.fromkeys((BLANK, DUPLICATE, CUT), 0)
        self.illegal = self.turns = 0
        self.high = self.low = self.later = None

    def add(self, alive: bool, known: bool, turn: int, role: str, text: str, fault: str) -> None:
        if not alive:
            return
        if known:
            self.turns += turn != self.low
            self.low = turn
            self.high = turn if self.high is None else self.high
        initial = role[:1]
        self.illegal += self.later is not None and initial + self.later not in LEGAL
        self.later = initial
        if fault:
            self.counts[fault] += 1
        self.costs, packed = _step(self.costs, initial, fault)
        self.rows.push((packed, role, text))

    def result(self) -> dict:
        letters, digest, place, first = [], hashlib.sha256(), START, True

        def say(role: str, text: str) -> None:
            nonlocal first
            digest.update((("" if first else "\n") + f"{role}:{text}").encode())
            first = False

        for packed, role, text in self.rows:
            choice = packed >> 4 * place & 15
            for _ in range(choice & 3):
                letters.append("I")
                say(WANTED[place], "")
                place = NEXT[place]
            letter = "DKR"[choice >> 2]
            letters.append(letter)
            if letter == "K":
                say(role, text)
                place = AFTER[place, role[:1]]
            elif letter == "R":
                say(WANTED[place], text)
                place = NEXT[place]
        for _ in range(ENDING[place]):
            letters.append("I")
            say(WANTED[place], "")
            place = NEXT[place]
        self.rows.close()
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return {"key": self.key, "gaps": gaps, **self.counts, "illegal": self.illegal, "cost": self.costs[START],
                "audit": "".join(letters), "repaired_sha256": digest.hexdigest()}


FOUND = "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _stream(held: int):
    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, done = None, []
        for batch in batches:
            keys = [None if missing else k for k, missing in zip(batch["key"], batch["key"].isna())]
            for key, *row in zip(keys, *(batch[c].tolist() for c in ("alive", "known", "at", "role", "text", "fault"))):
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(key, held)
                now.add(*row)
                if len(done) >= 2000:
                    yield pd.DataFrame(done)
                    done = []
        if now is not None:
            done.append(now.result())
        if done:
            yield pd.DataFrame(done)

    return stream


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as (key, alive, turn, role, text) after damage by the checksum of ``conv:turn``; nulls are one blank.

    Of twenty remainders, 0 drops the row (it stays as one that is not alive), 1 empties its text, 2 removes full
    stops, exclamation and question marks, 3 repeats the row, 4 gives it the role of a user.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word(conv), F.lit(":"), word(turn))) % 20
    return rows.select(
        F.col(conv).cast("string").alias("key"),
        (kind != 0).alias("alive"),
        F.col(turn).cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(word(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word(text), "[.!?]", "")).otherwise(word(text)).alias("text"),
        F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"),
    ).select("*", F.explode("copies").alias("copy")).drop("copies")


def _fault(earlier: Column) -> Column:
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, BLANK).when(earlier, DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(SOUND)


def repair(rows: DataFrame, held: int = HELD) -> DataFrame:
    """One row per conversation of ``rows`` (key, alive, turn, role, text): its faults, cheapest edits and repaired text.

    Rows are taken by turn (nulls first), those of one turn by role and text in byte order, so equal rows adjoin.  A
    row's first fault counts: blank, duplicate (its role and text were there earlier), truncated.  A role counts by
    its initial; an empty or other role cannot be kept, only changed or deleted.  ``gaps`` counts the turns missing
    between the least and the greatest.  Conversations without living rows have zeros, no edits and the digest of an
    empty text; the null key is a conversation like any other; an empty table gives none.
    """
    dealt = rows.select("key", "alive", "turn", "role", "text").repartition("key")
    same = W.partitionBy("key", "alive", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    marked = dealt.withColumn("again", F.row_number().over(same) > 1).withColumn("fault", _fault(F.col("again")))
    ordered = marked.sortWithinPartitions(
        "key", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("again")
    )
    sent = ordered.select(
        "key", "alive", F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"), "role",
        F.when(F.col("alive"), F.col("text")).otherwise("").alias("text"), "fault",
    )
    return sent.mapInPandas(_stream(held), FOUND)


def repaired_conversations(rows: DataFrame, conv: str = "conv_id", held: int = HELD) -> DataFrame:
    """The table damaged as in :func:`damage` and repaired as in :func:`repair`, with the conversation's own key."""
    found = repair(damage(rows, conv=conv), held)
    kind = rows.schema[conv].dataType
    return found.select(F.col("key").cast(kind).alias(conv), *[c for c in found.columns if c != "key"])
