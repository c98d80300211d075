"""The throttle as a stateful stream operator."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import micros, quoted
from ..operators.throttle import USER_LIMIT, WINDOW_SECONDS, decide


def throttle_stream(
    events: DataFrame,
    key: str,
    ts: str,
    event_id: str,
    limit: int = USER_LIMIT,
    seconds: int = WINDOW_SECONDS,
    watermark: str = "10 minutes",
) -> DataFrame:
    """(key, event_id, ts_us, accepted) for a streaming DataFrame.

    State per key: the accepted times still in the window, at most ``limit``.
    A key that stays silent until the watermark passes its window loses its
    state.  Events older than the watermark are dropped by Spark and show in
    the query's progress.  Events of one micro-batch are decided in time order;
    an event that arrives in a later batch than its successors is decided
    against what is still kept, so exact agreement with the batch operator
    needs input in time order from batch to batch.
    """
    window = seconds * 1_000_000
    stamped = events.withColumn("_at", quoted(ts).cast("timestamp"))
    rows = stamped.withWatermark("_at", watermark).select(
        quoted(key).alias("_key"),
        quoted(event_id).alias("_id"),
        "_at",
        micros(F.col("_at"), T.TimestampType()).alias("_us"),
    )
    key_type, id_type = events.schema[key].dataType, events.schema[event_id].dataType
    out = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField(event_id, id_type),
            T.StructField("ts_us", T.LongType()),
            T.StructField("accepted", T.BooleanType()),
        ]
    )
    state_type = T.StructType([T.StructField("kept", T.ArrayType(T.LongType()))])

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["_us", "_id"], kind="stable")
        kept = deque(state.get[0]) if state.exists else deque()
        accepted = decide((int(t) for t in pdf["_us"]), kept, limit, window)
        state.update((list(kept),))
        if kept:
            expires = (max(kept) + window) // 1000 + 1
            state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: group[0], event_id: pdf["_id"], "ts_us": pdf["_us"], "accepted": accepted})

    return rows.groupBy("_key").applyInPandasWithState(
        step, out, state_type, "append", GroupStateTimeout.EventTimeTimeout
    )
