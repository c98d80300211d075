"""The throttle on a file stream gives what the batch operator gives."""

import random

from pyspark.sql import functions as F

from tablescope.operators.throttle import throttle
from tablescope.streaming.throttle import throttle_stream


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(9)
    seconds, rows = 0, []
    for i in range(300):
        seconds += rnd.choice([0, 1, 5, 40])
        rows.append((i, rnd.choice(["u", "v"]), 1_700_000_000 + seconds))
    events = spark.createDataFrame(rows, "event_id bigint, user string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    for part in range(3):
        events.where(F.col("event_id").between(part * 100, part * 100 + 99)).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    source = (
        spark.readStream.schema(events.schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(str(tmp_path / "in"))
    )
    made = throttle_stream(source, "user", "ts", "event_id", limit=4, watermark="1 day")
    run = (
        made.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    assert run.awaitTermination(120)
    got = {r["event_id"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["event_id"]: r["accepted"] for r in throttle(events, "user", "ts", ["event_id"], limit=4).collect()}
    assert got == want and len(got) == 300 and not all(got.values())
