"""Conversation tables (conv_id, turn, role, text) and text guards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import quoted
from .blocks import cut_lineage
from .lookups import BROADCAST_BYTES, measured_bytes

# Preview and message limits, and the tag pattern.
PREVIEW_CHARS = 60
MESSAGE_CHARS = 1000
TAG_PATTERN = "<.*?>"
NO_MESSAGES = "Empty conversation"
GRAM = 8
SALTS = 16


def _overview(messages: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    last = F.max_by("text", "turn")
    preview = F.when(F.max("turn").isNull(), F.lit(NO_MESSAGES)).otherwise(
        F.concat(F.left(last, F.lit(PREVIEW_CHARS)), F.lit("..."))
    )
    return messages.groupBy("conv_id").agg(
        F.count("turn").alias("messages_count"), preview.alias("preview_text"), F.max("turn").alias("last_turn"), *extra
    )


def list_conversations(messages: DataFrame, newest: Column | None = None) -> DataFrame:
    """One row per conversation with message count and preview, newest first.

    ``newest`` is an aggregate giving the last-modified value; by default
    conversation ids are taken to grow with time.  Partial maxima are combined
    before the shuffle, so a very long conversation is no burden.
    """
    made = _overview(messages, [(newest if newest is not None else F.max("conv_id")).alias("_newest")])
    return made.orderBy(F.desc("_newest"), F.desc("conv_id")).drop("_newest")


def search_conversations(messages: DataFrame, pattern: str, newest: Column | None = None) -> DataFrame:
    """Conversations with any message matching the regular expression, case ignored.

    The match is one more maximum in the overview aggregate: no join back.
    """
    hit = F.bool_or(F.col("text").rlike(f"(?i){pattern}"))
    made = _overview(messages, [hit.alias("_hit"), (newest if newest is not None else F.max("conv_id")).alias("_newest")])
    return made.where("_hit").orderBy(F.desc("_newest"), F.desc("conv_id")).drop("_hit", "_newest")


def get_conversation(messages: DataFrame, conv_id: object) -> DataFrame:
    """The messages of one conversation in order, one row each."""
    wanted = conv_id if isinstance(conv_id, Column) else F.lit(conv_id)
    return messages.where(F.col("conv_id") == wanted).orderBy("turn").select("conv_id", "turn", "role", "text")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG_PATTERN, "")


def within_limit(messages: DataFrame, limit: int = MESSAGE_CHARS) -> DataFrame:
    """Messages not longer than the limit."""
    return messages.where(F.length("text") <= limit)


def _pieces_of(c: Column, length: int) -> Column:
    """All overlapping substrings of a length: a look-ahead matches at every character, so one pass gives them."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def file_names(messages: DataFrame, names: DataFrame, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Index of names: (gram, id, needle), each name once, under the one of its grams that fewest messages hold.

    A gram is eight characters, or the whole of a shorter name; case is ignored.  Names with a gram that no message
    holds are left out, as they occur nowhere.
    """
    needles = names.select(F.col("id"), F.lower("name").alias("needle")).where("length(needle) > 0").distinct()
    grams = F.when(F.length("needle") > GRAM, F.array_distinct(_pieces_of(F.col("needle"), GRAM))).otherwise(F.array("needle"))
    filed = cut_lineage(needles.select("id", "needle", F.explode(grams).alias("gram")))
    wanted = filed.select("gram").distinct()
    posted = _postings(messages, filed, [], text)
    if measured_bytes(wanted) <= broadcast_bytes:
        counts = posted.join(F.broadcast(wanted), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).join(wanted, "gram", "left_semi")
    counted = filed.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("id", "needle").agg(F.min(F.struct("n", "gram")).alias("r"))
    return rarest.where("r.n > 0").select("r.gram", "id", "needle")


def _postings(messages: DataFrame, filed: DataFrame, keys: Sequence[Column], text: str) -> DataFrame:
    """(keys, gram): the distinct grams of each message, of the lengths names are filed under; no text goes along."""
    low = F.lower(quoted(text))
    lengths = sorted(r[0] for r in filed.select(F.length("gram")).distinct().collect())
    grams = F.array_distinct(F.flatten(F.array(*[_pieces_of(low, n) for n in lengths]))) if lengths else F.array().cast("array<string>")
    return messages.select(*keys, F.explode(grams).alias("gram"))


def mentions(
    messages: DataFrame, names: DataFrame, key: Sequence[str], text: str = "text", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Distinct (key, id): messages whose text contains a name, case ignored.

    ``names`` is (id, name).  Names are filed under their rarest gram (:func:`file_names`); messages meet them by equal
    grams, without their texts, and a gram that very many messages hold is met by ``SALTS`` tasks.  A name of up to
    eight characters is then found; for longer ones the text is fetched once for each message with candidates, and
    compared.  The index is broadcast when its measured size allows it.  Null texts and names match nothing; null keys
    are keys like any other.
    """
    index = cut_lineage(file_names(messages, names, text, broadcast_bytes))
    mine = [f"_k{i}" for i in range(len(key))]
    posted = _postings(messages, index, [quoted(k).alias(m) for k, m in zip(key, mine)], text)
    if measured_bytes(index) <= broadcast_bytes:
        pairs = posted.join(F.broadcast(index), "gram")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = posted.withColumn("salt", F.pmod(F.xxhash64(*mine), F.lit(SALTS)).cast("int"))
        pairs = salted.join(index.withColumn("salt", salts), ["gram", "salt"])
    short = F.length("needle") <= GRAM
    found = pairs.where(short).select(*mine, "id")
    candidates = pairs.where(~short).select(*mine, "id", "needle").distinct()
    listed = candidates.groupBy(*mine).agg(F.collect_list(F.struct("id", "needle")).alias("_names"))
    texts = messages.select(*[quoted(k).alias(f"_m{m}") for k, m in zip(key, mine)], F.lower(quoted(text)).alias("_low"))
    read = listed.join(texts, reduce(lambda a, b: a & b, [F.col(m).eqNullSafe(F.col(f"_m{m}")) for m in mine]))
    hits = F.filter("_names", lambda n: F.contains(F.col("_low"), n["needle"]))
    checked = read.select(*mine, F.explode(F.transform(hits, lambda n: n["id"])).alias("id"))
    return found.unionByName(checked).distinct().select(*[F.col(m).alias(k) for k, m in zip(key, mine)], "id")
