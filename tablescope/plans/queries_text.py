"""Conversations, text, throttle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import conversations, throttle
from ..sources.tables import Tables
from .registry import query

_OVERVIEW = """SELECT conv_id, count(turn) AS messages_count, left(arg_max(text, turn), 60) || '...' AS preview_text,
  max(turn) AS last_turn FROM conversations GROUP BY conv_id"""


@query("conversation_list", _OVERVIEW)
def conversation_list(t: Tables) -> DataFrame:
    return conversations.list_conversations(t.conversations)


@query("conversation_search", f"{_OVERVIEW} HAVING bool_or(regexp_matches(text, 'th[aeiou]t|schön', 'i'))")
def conversation_search(t: Tables) -> DataFrame:
    return conversations.search_conversations(t.conversations, "th[aeiou]t|schön")


@query(
    "conversation_newest",
    """SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations)""",
)
def conversation_newest(t: Tables) -> DataFrame:
    """The messages of one conversation: the one with the highest id."""
    newest = t.conversations.agg(F.max("conv_id")).scalar()
    return conversations.get_conversation(t.conversations, newest)


@query("strip_tags", "SELECT page_id, md5(regexp_replace(html, '<.*?>', '', 'g')) AS digest FROM pages")
def strip_tags(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(conversations.strip_tags(F.col("html"))).alias("digest"))


@query("short_messages", "SELECT conv_id, turn, length(text) AS n FROM conversations WHERE length(text) <= 1000")
def short_messages(t: Tables) -> DataFrame:
    return conversations.within_limit(t.conversations).select(
        "conv_id", "turn", F.length("text").cast("bigint").alias("n")
    )


def _names(t: Tables) -> DataFrame:
    """Languages and sources of the documents stand in for model names and algorithms."""
    both = F.explode(F.array(F.struct(F.col("lang").alias("id"), F.col("lang").alias("name")),
                             F.struct(F.col("lang").alias("id"), F.col("source").alias("name"))))
    return t.documents.select(both.alias("n")).select("n.id", "n.name").distinct()


_MENTIONS = """WITH names AS (SELECT DISTINCT lang AS id, lang AS name FROM documents UNION SELECT DISTINCT lang, source FROM documents)
  SELECT DISTINCT conv_id, turn, id FROM conversations JOIN names ON contains(lower(text), lower(name))"""


@query("mentions", _MENTIONS)
def mentions(t: Tables) -> DataFrame:
    return conversations.mentions(t.conversations, _names(t), ["conv_id", "turn"])


@query("mentions_by_substring", _MENTIONS)
def mentions_by_substring(t: Tables) -> DataFrame:
    """The same with an index too large to broadcast."""
    return conversations.mentions(t.conversations, _names(t), ["conv_id", "turn"], broadcast_bytes=0)


_OPENINGS = """WITH names AS (SELECT conv_id AS opening, left(text, 24) AS name FROM conversations WHERE turn = 0)
  SELECT DISTINCT conv_id, turn, opening FROM conversations JOIN names ON contains(lower(text), lower(name))"""


def _openings(t: Tables, **options) -> DataFrame:
    first = t.conversations.where("turn = 0").select(F.col("conv_id").alias("id"), F.left("text", F.lit(24)).alias("name"))
    return conversations.mentions(t.conversations, first, ["conv_id", "turn"], **options).withColumnRenamed("id", "opening")


@query("mentions_of_openings", _OPENINGS)
def mentions_of_openings(t: Tables) -> DataFrame:
    """Which messages contain the first words of a conversation: a list of names that grows with the table."""
    return _openings(t)


@query("mentions_of_openings_shuffled", _OPENINGS)
def mentions_of_openings_shuffled(t: Tables) -> DataFrame:
    return _openings(t, broadcast_bytes=0)


@query(
    "events_last_60s",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS events_in_window
       FROM events""",
)
def events_last_60s(t: Tables) -> DataFrame:
    return throttle.trailing_counts(t.events.select("event_id", "user_id", "ts"), "user_id", "ts").select(
        "event_id", "events_in_window"
    )


@query(
    "events_last_hour",
    """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS events_in_window
       FROM events""",
)
def events_last_hour(t: Tables) -> DataFrame:
    return throttle.trailing_counts(t.events.select("event_id", "event_type", "ts"), "event_type", "ts", 3600).select(
        "event_id", "events_in_window"
    )


@query("throttle_users")
def throttle_users(t: Tables) -> DataFrame:
    """At most two accepted events per user and ten minutes."""
    return throttle.throttle(t.events, "user_id", "ts", ["event_id"], limit=2, seconds=600)


@query(
    "throttle_first_of_window",
    """WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
  walk AS (SELECT event_type, rn, event_id, us, us AS kept, true AS accepted FROM e WHERE rn = 1
    UNION ALL SELECT e.event_type, e.rn, e.event_id, e.us, CASE WHEN e.us - w.kept >= 3600000000 THEN e.us ELSE w.kept END,
           e.us - w.kept >= 3600000000 FROM walk w JOIN e ON e.event_type = w.event_type AND e.rn = w.rn + 1)
  SELECT event_type, event_id, us AS ts_us, accepted FROM walk""",
)
def throttle_first_of_window(t: Tables) -> DataFrame:
    """One accepted event per type and hour after the last accepted one."""
    return throttle.throttle(t.events, "event_type", "ts", ["event_id"], limit=1, seconds=3600)
