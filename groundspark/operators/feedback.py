"""Ask and feedback logs: events, knowledge gaps, counters, cache hits, the curated-answer life cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.functions.text import cache_key, question_key
from groundspark.operators import heavy
from groundspark.operators.corpus import CURATED_PREFIX, CURATED_SPACE
from groundspark.operators.ordered import Slices

QUARANTINE_AT = 3


def ask_events(asks: DataFrame, keep_text: bool = True) -> DataFrame:
    """The ask log with the question's sha256; the text itself is blanked when it is to be withheld."""
    digest = F.sha2(F.coalesce("question", F.lit("")), 256)
    return asks.withColumn("question_sha256", digest).withColumn("question", F.col("question") if keep_text else F.lit(""))


def gaps(events: DataFrame, limit: int = 50, capacity: int = heavy.CAPACITY) -> DataFrame:
    """Escalated questions by key: question_key, asked, last_asked, avg_confidence; most asked first, 1 to 500 rows.

    Summaries of bounded size say which keys can be among the first, and only those are counted: of any number of keys
    few are shuffled. Where keys are so evenly frequent that summaries can't tell, all are counted.
    """
    limit = max(1, min(500, limit))
    rows = events.where("escalated AND question <> ''").withColumn("question_key", question_key(F.col("question")))
    some = heavy.candidates(rows, F.col("question_key"), limit, capacity)
    if some is not None:
        rows = rows.join(F.broadcast(some), F.col("question_key") == F.col("key"), "left_semi")
    out = rows.groupBy("question_key").agg(F.count("*").alias("asked"), F.max("asked_at").alias("last_asked"), F.avg("confidence").alias("avg_confidence"))
    return out.orderBy(F.desc("asked"), F.desc("last_asked"), "question_key").limit(limit)


def metrics(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Metric, value: asks, escalations, cache_hits, duration_count, duration_ms_sum, and feedback by verdict. A cache hit is
    an ask without a duration."""
    served = ~F.col("cache_hit")
    one = events.agg(
        F.count("*").cast("double").alias("asks"), F.count_if("escalated").cast("double").alias("escalations"), F.count_if("cache_hit").cast("double").alias("cache_hits"),
        F.count_if(served).cast("double").alias("duration_count"), F.coalesce(F.sum(F.when(served, F.col("duration_ms"))), F.lit(0)).cast("double").alias("duration_ms_sum"),
    )
    counters = one.unpivot([], ["asks", "escalations", "cache_hits", "duration_count", "duration_ms_sum"], "metric", "value")
    votes = feedback.groupBy("verdict").count().select(F.concat(F.lit("feedback_"), "verdict").alias("metric"), F.col("count").cast("double").alias("value"))
    return counters.unionByName(votes)


def daily_metrics(events: DataFrame) -> DataFrame:
    """I3 by day, with a total (null day)."""
    return events.rollup(F.to_date("asked_at").alias("day")).agg(F.count("*").alias("asks"), F.count_if("escalated").alias("escalations"))


def feedback_events(feedback: DataFrame, escalations: DataFrame) -> DataFrame:
    """I4: the feedback log with texts cut (question 1000, reporter 200 characters), and explicit escalations as a verdict."""
    both = feedback.select("question", "verdict", "reporter", "created_at").unionByName(escalations.select("question", F.lit("escalate").alias("verdict"), "reporter", "created_at"))
    return both.select(F.substring("question", 1, 1000).alias("question"), "verdict", F.substring("reporter", 1, 200).alias("reporter"), "created_at")


def cache_hits(asks: DataFrame, busts: DataFrame) -> DataFrame:
    """Asks (id, asked_at, question, escalated) with `hit`: an earlier answered ask has the same trimmed key, and the
    index hasn't changed (busts: at) since.

    The last change before an ask is a running maximum over the log in order of time, and an earlier answer one over
    the asks of a key and that change; both are scans by slices, so neither a busy hour nor a frequent key is one task.
    """
    log = asks.withColumn("at", F.col("asked_at")).withColumn("kind", F.lit(1)).withColumn("key", cache_key(F.col("question")))
    log = log.unionByName(busts.select("at", F.lit(0).alias("kind")), allowMissingColumns=True)
    timed = Slices(log, [], ["at", "kind", "id"]).running("epoch", F.when(F.col("kind") == 0, F.col("at")), "max").rows.where("kind = 1")
    own = Slices(timed.select("id", "asked_at", "key", "escalated", "epoch"), ["key", "epoch"], ["asked_at", "id"])
    served = own.running("served", (~F.col("escalated")).cast("int"), "max", before=True).rows
    return served.select("id", "asked_at", "key", "escalated", (F.coalesce("served", F.lit(0)) == 1).alias("hit"))


def downvotes(feedback: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate id, votes: down-votes on every approved candidate with the same question key."""
    down = feedback.where("verdict = 'down'").select(question_key(F.col("question")).alias("key"))
    approved = candidates.where("status = 'approved'").select("id", question_key(F.col("question")).alias("key"))
    return approved.join(down, "key").groupBy("id").agg(F.count("*").alias("votes"))


def quarantine(events: DataFrame, threshold: int = QUARANTINE_AT) -> DataFrame:
    """Candidate id, at: each time the down-votes since the last approval first reach the threshold. events: id, at,
    seq, kind (approve or down). A threshold of 0 never quarantines."""
    counted = Slices(events, ["id"], ["at", "seq"]).running("downs", (F.col("kind") == "down").cast("long"))
    rows = counted.running("before", F.when(F.col("kind") == "approve", F.col("downs")), "max").rows
    # down-votes never fall, so the latest approval is the one with the most before it
    reached = (F.col("kind") == "down") & (F.lit(threshold) > 0) & (F.col("downs") - F.col("before") == threshold)
    return rows.where(reached).select("id", "at")


def curated_docs(candidates: DataFrame) -> DataFrame:
    """Documents of approved candidates with an answer: question as title, question and answer as body."""
    good = candidates.where((F.col("status") == "approved") & (F.trim(F.coalesce("answer", F.lit(""))) != ""))
    question, answer = F.trim("question"), F.trim("answer")
    return good.select(F.concat(F.lit(CURATED_PREFIX), F.col("id").cast("string")).alias("doc_id"), question.alias("title"), F.lit("").alias("url"), F.concat(question, F.lit("\n\n"), answer).alias("body"), F.lit(CURATED_SPACE).alias("space"), F.lit("text").alias("content_type"))


def list_candidates(candidates: DataFrame, status: str = "pending", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of candidates, newest first; status all lists every one."""
    rows = candidates if status == "all" else candidates.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset)).limit(max(1, min(500, limit)))


def get_candidate(candidates: DataFrame, candidate_id: int) -> DataFrame:
    """One candidate."""
    return candidates.where(F.col("id") == candidate_id)
