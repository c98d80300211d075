"""Sliding-window throttle over an event table.

Per key an event is accepted if fewer than ``limit`` accepted events lie in the
window before it; rejected events do not count.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.columns import micros, quoted
from .blocks import BLOCK_ROWS, TASK_ROWS, cut_lineage, group_sizes, running_last, running_totals, spread_groups
from .lookups import broadcast_if_small

# The limits per minute for an address and for a user.
WINDOW_SECONDS = 60
ADDRESS_LIMIT = 60
USER_LIMIT = 30


def decide(times: Iterable[int], kept: deque, limit: int, window: int) -> list[bool]:
    """Accept or reject times in order; ``kept`` holds the accepted times still in the window."""
    out = []
    for t in times:
        while kept and t - kept[0] >= window:
            kept.popleft()
        ok = len(kept) < limit
        if ok:
            kept.append(t)
        out.append(ok)
    return out


def trailing_counts(
    df: DataFrame, key: str, ts: str, seconds: int = WINDOW_SECONDS, task_rows: int = TASK_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``events_in_window``: the key's events less than ``seconds`` old, this one included.

    Rows without a time are left out.  Keys that fit a task are one window each.  With a larger one, events are
    counted per instant first, and the answer at an instant is the running count there less the running count at
    the last instant outside its window; both run in blocks of rows, so neither a hot key nor a hot instant is one task's.
    """
    span = seconds * 1_000_000
    timed = df.withColumn("_us", micros(quoted(ts), df.schema[ts].dataType)).where("_us IS NOT NULL")
    _, largest = group_sizes(timed, [key])
    if largest <= task_rows:
        w = W.partitionBy(quoted(key)).orderBy("_us").rangeBetween(-(span - 1), 0)
        return timed.withColumn("events_in_window", F.count(F.lit(1)).over(w)).drop("_us")
    sizes = {"task_rows": task_rows, "block_rows": block_rows}
    counted = timed.groupBy(quoted(key).alias("_key"), "_us").agg(F.count(F.lit(1)).alias("_n"))
    upto = cut_lineage(running_totals(counted, {"_upto": F.col("_n")}, ["_us"], ["_key"], **sizes))
    events = upto.select("_key", F.col("_us").alias("at"), F.lit(0).alias("probe"), F.col("_us").alias("of"), "_upto", F.col("_upto").alias("seen"))
    probes = upto.select("_key", (F.col("_us") - span).alias("at"), F.lit(1).alias("probe"), F.col("_us").alias("of"), "_upto", F.lit(None).cast("bigint").alias("seen"))
    found = running_last(events.unionByName(probes), "gone", F.col("seen"), ["at", "probe"], ["_key"], **sizes).where("probe = 1")
    answers = found.select("_key", F.col("of").alias("_at"), (F.col("_upto") - F.coalesce("gone", F.lit(0))).alias("events_in_window"))
    same = quoted(key).eqNullSafe(F.col("_key")) & (F.col("_us") == F.col("_at"))
    return timed.join(broadcast_if_small(answers), same).drop("_us", "_key", "_at")


def throttle(
    df: DataFrame,
    key: str,
    ts: str,
    order: Sequence[str],
    limit: int = USER_LIMIT,
    seconds: int = WINDOW_SECONDS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(key, order columns, ts_us, accepted) for every event; equal times by the ``order`` columns.

    The rule is a chain in time.  A key of up to ``task_rows`` events is one
    group.  A larger one is cut into time chunks that run in parallel; a chunk
    needs the times accepted in the window before it, at most ``limit`` of
    them.  The first guess is that all of those were accepted; chunks whose
    start then turns out different run again until nothing changes, which makes
    the result exact.  Traffic under the limit settles in the first round.
    """
    window = seconds * 1_000_000
    order = list(order)
    events = df.select(
        quoted(key).alias("_key"), micros(quoted(ts), df.schema[ts].dataType).alias("_us"), *[quoted(c) for c in order]
    ).where("_us IS NOT NULL")
    rows, largest = group_sizes(events, ["_key"])
    fields = [T.StructField("_key", events.schema["_key"].dataType), T.StructField("_us", T.LongType())]
    fields += [events.schema[c] for c in order]
    fields += [T.StructField("_chunk", T.LongType()), T.StructField("accepted", T.BooleanType())]
    schema = T.StructType(fields)
    columns = [f.name for f in fields]

    def run(pdf: pd.DataFrame, kept: Sequence[int] = ()) -> pd.DataFrame:
        pdf = pdf.sort_values(["_us", *order], kind="stable")
        pdf["accepted"] = decide((int(t) for t in pdf["_us"]), deque(kept), limit, window)
        return pdf[columns]

    if largest <= task_rows:
        whole = spread_groups(events.withColumn("_chunk", F.lit(0).cast("bigint")), ["_key"])
        decided = whole.groupBy("_key").applyInPandas(lambda pdf: run(pdf), schema)
    else:
        decided = _in_chunks(events, order, limit, window, rows, largest, task_rows, run, schema)
    return decided.select(F.col("_key").alias(key), *[quoted(c) for c in order], F.col("_us").alias("ts_us"), "accepted")


def _in_chunks(
    events: DataFrame,
    order: list[str],
    limit: int,
    window: int,
    rows: int,
    largest: int,
    task_rows: int,
    run: Callable[..., pd.DataFrame],
    schema: T.StructType,
) -> DataFrame:
    span = events.agg(F.max("_us") - F.min("_us")).first()[0] + 1
    chunk = max(window, span * task_rows // (2 * largest))
    # at most rows / task_rows keys are that large
    big = events.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > task_rows).select(F.col("_key").alias("_large"))
    cut = events.join(F.broadcast(big), F.col("_key").eqNullSafe(F.col("_large")), "left")
    own = F.when(F.col("_large").isNotNull(), F.floor(F.col("_us") / chunk)).otherwise(F.lit(0))
    events = cut_lineage(cut.withColumn("_chunk", own))
    same = ["_key", "_chunk"]

    def carried(rows: DataFrame) -> DataFrame:
        """The last ``limit`` times each chunk hands to the next one, ascending."""
        late = rows.where(F.col("_large").isNotNull() & (F.col("_us") > (F.col("_chunk") + 1) * chunk - window))
        newest = W.partitionBy(*same).orderBy(F.desc("_us"), *[F.desc(c) for c in order])
        few = late.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= limit)
        return few.groupBy("_key", (F.col("_chunk") + 1).alias("_chunk")).agg(
            F.sort_array(F.collect_list("_us")).alias("_carry")
        )

    full = T.StructType([*schema.fields, T.StructField("_large", events.schema["_large"].dataType)])

    def pair(pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=full.names)
        done = run(pdf, [int(t) for t in carry["_carry"].iloc[0]] if len(carry) else ())
        return done.assign(_large=pdf["_large"].iloc[0])

    def solve(pdfs: DataFrame, carry: DataFrame) -> DataFrame:
        return spread_groups(pdfs, same).groupBy(*same).cogroup(carry.groupBy(*same)).applyInPandas(pair, full)

    used = cut_lineage(carried(events))
    decided = cut_lineage(solve(events, used))
    while True:
        now = cut_lineage(carried(decided.where("accepted")))
        old = used.withColumnRenamed("_carry", "_old")
        moved = now.join(old, same, "full").where(~F.col("_carry").eqNullSafe(F.col("_old"))).select(*same)
        moved = cut_lineage(moved.join(events.select(*same).distinct(), same, "left_semi"))
        if moved.isEmpty():
            return decided
        redo = solve(events.join(moved, same, "left_semi"), now.join(moved, same, "left_semi"))
        decided = cut_lineage(decided.join(moved, same, "left_anti").unionByName(redo))
        used = now
