"""The pipeline on a small corpus with planted cases, stage by stage, against plain versions; and its registration."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"shared{i}" for i in range(55))
FIRST, SECOND = (" ".join(f"{side}{i}" for i in range(40)) for side in ("tale", "story"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for k in range(160):
        own = [f"w{x}" for x in rng.integers(0, 4000, 60)]
        bad = k % 8 == 0
        if bad:
            own = [f"{w.upper()}!!" for w in own]
        rows.append((k, " ".join(own), "en", "s", 0))
        labels.append((k, int(not bad), 0))
    clean = [r for r in rows if r[0] % 8]
    near = clean[0][1].split()
    near[3] = "changed"
    rows += [(200, clean[0][1], "en", "s", 0), (201, " ".join(near), "en", "s", 0)]
    rows += [(202, f"{FIRST} {PASSAGE} ends", "en", "s", 0), (203, f"{SECOND} {PASSAGE} stops", "en", "s", 0)]
    rows += [(204, "write to jo.x@mail.example.com or 10.0.0.7 soon please thanks", "en", "s", 0), (205, None, None, None, None), (None, "no id here", "en", "s", 0)]
    rows += [clean[1]]
    place = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.withColumn("n_chars", F.length("text").cast("bigint")).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return str(place)


def test_stages_against_plain_versions(spark, folder, tmp_path, word_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
            assert docs.where("n_chars <> length(text)").count() == 0
            texts[name] = {r.doc_id: r.text for r in docs.collect()}
            assert len(texts[name]) == docs.count() or name == "quality"
    kept = set(texts["quality"])
    assert not kept & set(range(0, 160, 8)) and set(range(160)) - set(range(0, 160, 8)) <= kept and {202, 203, 204, 205, None} <= kept
    assert set(texts["near_copies"]) == kept - {200, 201}
    # every window of 35 words that occurs twice goes
    n, words = pipeline.PASSAGE, {k: WORD.findall(t or "") for k, t in texts["near_copies"].items()}
    seen: dict = {}
    for w in words.values():
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] = seen.get(tuple(w[i : i + n]), 0) + 1
    for k, w in words.items():
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        want = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else texts["near_copies"][k]
        assert texts["repeats"][k] == want
    assert texts["repeats"][202] == f"{FIRST} ends"
    changed = {k for k in texts["pii"] if texts["pii"][k] != texts["repeats"][k]}
    assert changed == {204} and texts["pii"][204] == "write to [EMAIL] or [IP] soon please thanks"
    whole = Tokenizer.from_file(word_path)
    lengths = {k: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in texts["pii"].items()}
    assert {r.doc_id: r.length for r in docs.collect()} == lengths
    least = -(-sum(lengths.values()) // 2048)
    assert least <= docs.select("sequence_id").distinct().count() <= 1.15 * least + 1


def test_registered():
    found = entry.queries()
    assert [k for k in found if k == "pipeline" or re.fullmatch(r"op\d+_\w+", k)].__len__() == 14
    assert {k.split("_")[0] for k in found if re.fullmatch(r"op\d+_\w+", k)} == {f"op{n}" for n in range(1, 14)}
    assert set(entry.oracle_sql()) <= set(found)
