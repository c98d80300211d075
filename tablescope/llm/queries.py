"""The registered queries of this subpackage: each applies one operator to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import bpe_round_trip
from .collocations import find_collocations
from .conversations import repaired_conversations
from .fingerprints import neighbour_likeness
from .neardup import near_duplicates
from .packing import pack_pieces, token_pieces
from .pii import find_pii, fit_pii
from .quality import fit_quality, score_quality
from .secrets import secret_spans
from .sql import SQL  # noqa: F401  (offered beside the queries)
from .substrings import remove_repeats
from .suffixes import remove_repeated_strings
from .toxicity import CUT, fit_toxicity, tag_toxicity
from .vectors import linked_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), words=35, whole=False)


@query
def op5_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), words=3, threshold=(85, 100))


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, folder, "labels")))


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    field = fit_toxicity(docs, table(spark, folder, "labels"), allowed=fold != 1)
    return tag_toxicity(docs, field).select(
        "doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "spans"
    )


@query
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = find_pii(docs, fit_pii(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = token_pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack_pieces(pieces)


@query
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_spans(table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_likeness(table(spark, folder, "documents"))


@query
def op4_linked_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return linked_vectors(table(spark, folder, "embeddings"), least=0.93)


@query
def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return repaired_conversations(table(spark, folder, "conversations"))


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return find_collocations(table(spark, folder, "documents"))


@query
def op13_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated_strings(table(spark, folder, "documents"), whole=False)
