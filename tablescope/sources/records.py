"""Records of CSV files with line ends inside quotes, read by many tasks side by side.

Where a record starts depends on all quotes before it, so a plain split of a file may begin inside a cell.  Lines are
read by Spark's splittable text reader.  Each byte range first reports how it maps the two states a line can begin in
(between records, inside a quoted cell) to the state after its last line, as if it began in either; one scan of these
maps over the ranges of a file settles in which state each of them begins.  Then every range puts its own records
together.  What a range only holds in part, a record over its edge, comes out as fragments that are joined by
the range in which the record opened.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.blocks import cut_lineage

BROADCAST_RANGES = 500_000
"""Ranges that begin inside a cell, up to which they are broadcast (two numbers each)."""

ENDS = ["after_between", "after_inside", "inside_lasts", "spans_between", "spans_inside"]
"""Inside a cell after the last line, begun between records or inside; inside all along; and whether a record takes several lines."""
MAPS = "file bigint, start bigint, " + ", ".join(f"{c} boolean" for c in ENDS)
STATES = "file bigint, start bigint, owner bigint, spans boolean"
PIECES = "file bigint, owner bigint, start bigint, header boolean, whole boolean, value string"
BETWEEN, INSIDE = False, True
BOM = "\ufeff"


def inside_after(line: str, inside: bool) -> bool:
    """Does a quoted cell go on after this line?

    A quote opens a cell only at the start of one; two quotes in a quoted cell stand for one; what follows the closing
    quote up to the next comma is plain text.
    """
    at, n = 0, len(line)
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside = False
        elif at < n and line[at] == '"':
            at, inside = at + 1, True
            continue
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, seq, value): lines in the order of their ranges; files are named by a hash."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """(file, start) of the byte ranges in a batch, and which rows are theirs; a range may go on in the next batch."""
    if batch.num_rows:
        file, start = batch["file"].to_numpy(), batch["start"].to_numpy()
        edges = ((file[1:] != file[:-1]) | (start[1:] != start[:-1])).nonzero()[0] + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            yield (int(file[a]), int(start[a])), int(a), int(b)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each range: where its lines lead from either state."""
    schema = pa.schema([("file", pa.int64()), ("start", pa.int64()), *[(c, pa.bool_()) for c in ENDS]])
    now, state = None, ()
    for batch in batches:
        for key, a, b in _ranges(batch):
            if key != now:
                if now is not None:
                    yield _batch([(*now, *state)], schema)
                now, state = key, (BETWEEN, INSIDE, True, False, False)
            lines = batch["value"].slice(a, b - a)
            between, inside, lasts, spans_between, spans_inside = state
            for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
                after = inside_after(line, between)
                between, inside = after, after if inside == between else inside_after(line, inside)
                lasts, spans_between, spans_inside = lasts and inside, spans_between or between, spans_inside or inside
            state = (between, inside, lasts, spans_between, spans_inside)
    if now is not None:
        yield _batch([(*now, *state)], schema)


def _states(maps: pd.DataFrame) -> pd.DataFrame:
    """Scan of a file's maps: in which range the cell opened that each range begins in, if it begins in one."""
    owner, rows = None, []
    for row in maps.sort_values("start").itertuples(index=False):
        rows.append((row.file, row.start, owner, bool(row.spans_between if owner is None else True)))
        if owner is None:
            owner = row.start if row.after_between else None
        elif not row.after_inside:
            owner = None
        elif not row.inside_lasts:
            owner = row.start
    return pd.DataFrame(rows, columns=["file", "start", "owner", "spans"]).astype({"owner": "Int64"})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each range, and fragments of those that go over its edges."""
    schema = pa.schema([("file", pa.int64()), ("owner", pa.int64()), ("start", pa.int64()), ("header", pa.bool_()), ("whole", pa.bool_()), ("value", pa.string())])
    rows: list[tuple] = []
    parts: list[str] = []
    now, owner, inside, first = None, 0, BETWEEN, False

    def close(whole: bool) -> bool:
        """Add a record or fragment; is the next one still the first of its file?"""
        value = "\n".join(parts)
        parts.clear()
        value = value.removeprefix(BOM) if first else value
        if whole and not value.strip():
            return first
        rows.append((now[0], owner, now[1], first, whole, value.removesuffix("\r") if whole else value))
        return False

    for batch in batches:
        for key, a, b in _ranges(batch):
            if key != now:
                if parts:
                    close(False)
                opened = batch["owner"][a].as_py()
                now, first = key, key[1] == 0
                inside, owner = (BETWEEN, key[1]) if opened is None else (INSIDE, opened)
            for line in batch["value"].slice(a, b - a).to_pylist():
                parts.append(line)
                inside = inside_after(line, inside) if '"' in line else inside
                if not inside:
                    first = close(owner == now[1])
                    owner = now[1]
        if len(rows) >= 5000:
            yield _batch(rows, schema)
            rows.clear()
    if parts:
        close(False)
    if rows:
        yield _batch(rows, schema)


def csv_records(spark: SparkSession, path: str, broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame | None:
    """(file, header, value): every record of CSV files, of any length, without its line end; None when each is one line.

    ``header`` marks the first record of a file.  Records of blanks only are left out.  Line ends are ``\\n`` or
    ``\\r\\n``.  One record is one cell of text, so it must fit a task, whatever ranges it goes over.
    """
    lines = _lines(spark, path)
    states = cut_lineage(lines.drop("seq").mapInArrow(_maps, MAPS).groupBy("file").applyInPandas(_states, STATES))
    seen = states.agg(F.coalesce(F.bool_or("spans"), F.lit(False)).alias("spans"), F.count("owner").alias("opened")).first()
    if not seen["spans"]:
        return None
    opened = states.where("owner IS NOT NULL").select("file", "start", "owner")
    if seen["opened"] <= broadcast_ranges:
        known = lines.join(F.broadcast(opened), ["file", "start"], "left")
    else:
        known = lines.join(opened, ["file", "start"], "left").repartition("file", "start").sortWithinPartitions("file", "start", "seq")
    # written, as records are read several times (names, types, cells) and putting them together is the dear part
    pieces = cut_lineage(known.select("file", "start", "owner", "value").mapInArrow(_pieces, PIECES))
    parts = F.array_sort(F.collect_list(F.struct("start", "value")))
    value = F.array_join(F.transform(parts, lambda p: p["value"]), "\n")
    over = pieces.where("NOT whole").groupBy("file", "owner").agg(F.bool_or("header").alias("header"), value.alias("value"))
    over = over.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    return pieces.where("whole").select("file", "header", "value").unionByName(over.select("file", "header", "value"))


def header_names(records: DataFrame) -> list[str]:
    """Column names from the first record of a file: empty ones by place, repeated ones with their place behind."""
    line = records.where("header").agg(F.min_by("value", "file").alias("h")).first()["h"]
    names = next(csv.reader(io.StringIO(line or "", newline="")), [])
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]
