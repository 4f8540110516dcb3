"""Conversation jobs: follow-up questions, routing of raw activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What makes a question refer to the one before.
FOLLOW_UP_OPENERS = ["and ", "what about", "how about", "what else", "tell me more", "more about", "also ", "what's ", "explain "]
PRONOUNS = ["it", "that", "this", "they", "those", "these", "them"]
ACTIVITY = "type STRING, id STRING, text STRING, `from` STRUCT<id: STRING, aadObjectId: STRING>, value STRUCT<callback_keyword: STRING, verdict: STRING, question: STRING>"


def is_referential(text: Column) -> Column:
    """Begins like a follow-up, or is of four words at most with a pronoun."""
    low = F.trim(F.lower(text))
    begins = F.lit(False)
    for opener in FOLLOW_UP_OPENERS:
        begins = begins | F.startswith(low, F.lit(opener))
    said = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    return begins | ((F.size(said) <= 4) & F.arrays_overlap(said, F.array(*map(F.lit, PRONOUNS))))


def in_context(text: Column, previous: Column) -> Column:
    with_topic = F.concat(text, F.lit(" (in the context of: "), previous, F.lit(")"))
    return F.when(previous.isNotNull() & (previous != "") & is_referential(text), with_topic).otherwise(text)


def follow_ups(chat: DataFrame, ttl_seconds: float | None = None) -> DataFrame:
    """thread_id, sender, turn, text, query: a referential question carries the same sender's previous one; with a time
    to live only one that was said (said_at) at most so long before."""
    order = Window.partitionBy("thread_id", "sender").orderBy(*([] if ttl_seconds is None else ["said_at"]), "turn")
    before = F.lag("text").over(order)
    if ttl_seconds is not None:
        seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
        before = F.when(seconds(F.col("said_at")) - seconds(F.lag("said_at").over(order)) <= ttl_seconds, before)
    return chat.select("thread_id", "sender", "turn", "text", in_context(F.col("text"), before).alias("query"))


def route_activities(raw: DataFrame, column: str = "value", keyword: str = "feedback") -> dict[str, DataFrame]:
    """Message (sender, text), feedback (sender, verdict, question) and ignored rows of raw JSON activities."""
    a = raw.select(F.from_json(column, ACTIVITY).alias("a"), F.col(column).alias("raw"))
    sender = F.coalesce(F.when(F.col("a.from.aadObjectId") != "", F.col("a.from.aadObjectId")), "a.from.id", F.lit(""))
    text = F.trim(F.regexp_replace(F.coalesce("a.text", F.lit("")), r"(?s)<at\b[^>]*>.*?</at>", ""))
    is_message = F.coalesce(F.col("a.type") == "message", F.lit(False))
    is_feedback = is_message & F.coalesce(F.col("a.value.callback_keyword") == keyword, F.lit(False))
    kind = F.when(is_feedback, "feedback").when(is_message & (text != ""), "message").otherwise("ignore")
    marked = a.select(kind.alias("kind"), sender.alias("sender"), text.alias("text"), F.coalesce("a.value.verdict", F.lit("")).alias("verdict"), F.coalesce("a.value.question", F.lit("")).alias("question"), "raw")
    return {
        "message": marked.where("kind = 'message'").select("sender", "text"),
        "feedback": marked.where("kind = 'feedback'").select("sender", "verdict", "question"),
        "ignore": marked.where("kind = 'ignore'").select("raw"),
    }
