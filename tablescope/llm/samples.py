"""Bounded samples of labelled documents, reduced to numbers in the tasks that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int, key: str = "doc_id", allowed: Column | None = None) -> DataFrame:
    """At most ``size`` labelled documents, those whose ids hash lowest; other columns of ``docs`` are left out.

    Only ids and labels are sorted, and at most ``size`` of them are sent to the tasks that read the texts.
    """
    chosen = labels.where(F.col(key).isNotNull())
    if allowed is not None:
        chosen = chosen.where(allowed)
    chosen = chosen.dropDuplicates([key]).orderBy(F.xxhash64(F.col(key), F.lit(11)), key).limit(size)
    return docs.select(key, "text").join(F.broadcast(chosen), key)
