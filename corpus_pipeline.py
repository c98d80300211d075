"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder) and returns the documents it keeps, with the columns of documents; the last
returns placed token pieces.  A stage works on all rows of its input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tablescope.llm.neardup import near_duplicates
from tablescope.llm.packing import pack_pieces, token_pieces
from tablescope.llm.pii import find_pii, fit_pii
from tablescope.llm.quality import fit_quality, score_quality
from tablescope.llm.substrings import remove_repeats
from tablescope.operators.blocks import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PASSAGE = 35
"""Words of a passage that counts as repeated."""


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The documents with another text column, and n_chars to fit; a null text stays null."""
    own = F.when(F.col("text").isNotNull(), F.col(text))
    return docs.select("doc_id", own.alias("text"), "lang", "source", F.length(own).cast("bigint").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents the ordinal model selects; it is fitted on rated documents of the folder."""
    model = fit_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    return score_quality(docs, model, keep=COLUMNS).where("selected").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one of the smallest id, once.

    Rows are compared, not ids: two different texts of one id both stay.  Documents without an id belong to no group
    and stay.
    """
    found = near_duplicates(docs.where("doc_id is not null"), by_text=True)
    first = found.where("component_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "text_id")).alias("m"))
    chosen = first.select("m.*").unionByName(found.where("component_id is null").select("doc_id", "text_id").distinct())
    once = W.partitionBy("doc_id", "text_id").orderBy("doc_id")
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("text_id")).join(chosen, ["doc_id", "text_id"])
    kept = named.withColumn("_n", F.row_number().over(once)).where("_n = 1").select(*COLUMNS)
    return kept.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the passages that occur more than once."""
    return _with_text(remove_repeats(docs, words=PASSAGE, keep=COLUMNS), "kept_text")


def pii(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _with_text(find_pii(docs.select(*COLUMNS), fit_pii(docs), keep=COLUMNS, redact=True), "redacted")


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces, their ids included, with their places in sequences of 2048."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    return pack_pieces(pieces, with_ids=True)


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("pii", pii), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
