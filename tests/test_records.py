"""CSV files with line ends in quotes, cut into many byte ranges, against the reader that takes a file whole."""

import csv
import io
import random

import pandas as pd
import pytest

from tablescope.sources import records, tables

CELLS = ["plain", "", "a, b", 'say ""x""', "two\nlines", "\n", "\r\nmixed\n\nends ", '""', ",\n,", "é\n日本", "7", "x" * 300, "\n\n" * 40]


def text_of(seed, rows, end="\n"):
    rng = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "note", "other\nname", "n"])
    for i in range(rows):
        writer.writerow([9007199254740993 + i, rng.choice(CELLS).replace('""', '"'), rng.choice(CELLS).replace('""', '"'), rng.choice(["1", "", "2.5"])])
    return out.getvalue()


def write(folder, name, text):
    (folder / name).write_bytes(text.encode())
    return str(folder / name)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def ranges(spark):
    """Byte ranges of 197 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "197")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("limit", [records.BROADCAST_RANGES, 0])
def test_many_ranges_as_one_reader(spark, ranges, tmp_path, monkeypatch, end, limit):
    monkeypatch.setattr(records.csv_records, "__defaults__", (limit,))
    text = text_of(1, 70, end)
    path = write(tmp_path, "a.csv", text)
    got = tables.read_csv(spark, path)
    want = list(csv.reader(io.StringIO(text, newline="")))
    assert got.columns == want[0] and dict(got.dtypes)["id"] == "bigint"
    missing = lambda c: None if c.strip(" ") in tables.MISSING_TOKENS else c
    assert plain(got.select("id", "note", "`other\nname`")) == sorted(((int(r[0]), missing(r[1]), missing(r[2])) for r in want[1:]), key=repr)
    found = records.csv_records(spark, path)
    assert limit == 0 or found.rdd.getNumPartitions() > 5
    assert sorted(r["value"] for r in found.where("NOT header").collect()) == sorted(_records(text, end)[1:])


def _records(text, end):
    out, part, inside = [], "", False
    for line in text.split("\n"):
        part = f"{part}\n{line}" if inside else line
        inside = part.count('"') % 2 == 1
        if not inside and part.strip():
            out.append(part.removesuffix("\r") if end == "\r\n" else part)
    return out


def test_folder_of_files(spark, ranges, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    texts = [text_of(seed, 15) for seed in range(5)]
    for i, text in enumerate(texts):
        write(folder, f"{i}.csv", ("﻿" if i == 2 else "") + "\n \n" * (i % 2) + text)
    got = tables.read_csv(spark, str(folder))
    assert got.count() == 75 and got.columns == ["id", "note", "other\nname", "n"]
    whole = pd.concat([pd.read_csv(io.StringIO(x)) for x in texts])
    assert sorted(r["id"] for r in got.collect()) == sorted(whole["id"])


def test_plain_files_take_the_plain_reader(spark, ranges, tmp_path):
    path = write(tmp_path, "p.csv", 'a,b\n1,"x, y"\n2,z\n' * 1 + "".join(f"{i},w{i}\n" for i in range(100)))
    assert records.csv_records(spark, path) is None
    assert tables.read_csv(spark, path).count() == 102
    empty = write(tmp_path, "e.csv", "")
    assert records.csv_records(spark, empty) is None


def test_quotes_inside_plain_cells(spark, ranges, tmp_path):
    text = 'size,note\n5" pipe,"a\nb"\n6" pipe,c""d\n7,"e"f"g\n8,"h\n\n""i"""\n'
    got = tables.read_csv(spark, write(tmp_path, "q.csv", text))
    assert sorted((r["size"], r["note"]) for r in got.collect())[0] == ('5" pipe', "a\nb")
    assert {r["size"]: r["note"] for r in got.collect()}["8"] == 'h\n\n"i"'


def test_state_after_a_line():
    after = records.inside_after
    assert not after("a,b", False) and after('a,"b', False) and not after('b"', True) and after("b", True)
    assert after('x""', True) and not after('x""",y', True) and not after('5" a,6" b', False) and after('"a"",', False)
    assert not after('"a"b"c,d', False) and not after('"a",""", "', False) and after('"a",""", ', False)


def test_schema_and_round_trip(spark, ranges, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc'), (2, None), (3, "d,\r\ne")], "id bigint, note string")
    path = str(tmp_path / "out")
    tables.write_table(df, path, "csv")
    assert plain(tables.read_table(spark, path, "csv")) == plain(df)
    assert plain(tables.read_table(spark, path, "csv", df.schema)) == plain(df)
