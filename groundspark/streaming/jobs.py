"""Structured Streaming forms of the online jobs; each has a batch twin among the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from groundspark.functions.text import question_key
from groundspark.operators import chat, corpus, heavy
from groundspark.operators.feedback import QUARANTINE_AT
from groundspark.sources.store import ChunkStore, Conflict

WATERMARK, WINDOW = "10 minutes", "5 minutes"
#: Times that a batch is worked out when other writers come in between.
ATTEMPTS = 20
TTL_MS = 24 * 3600 * 1000
#: State stores that transformWithState needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_ingest(docs: DataFrame, store: ChunkStore, checkpoint: str, width: int = 64):
    """L1: a stream of documents, diffed, chunked, embedded and replaced batch by batch; a batch is committed once.

    A batch reads and rewrites only the buckets of its own documents. Several streams may write to one store: a batch
    whose buckets another one has changed meanwhile is worked out again from the new rows.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(ATTEMPTS):
            base, touched = store.seq(), store.buckets_of(batch)
            done = corpus.ingest(batch, *_tables(store, batch, touched), width=width)
            try:
                store.commit(done["chunks"], done["stamp"], batch=f"{checkpoint}:{batch_id}", buckets=touched, base=base)
                return
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _tables(store: ChunkStore, batch: DataFrame, buckets: list[int]) -> tuple[DataFrame, DataFrame]:
    if store.current() is not None:
        return store.chunks(buckets).drop("doc_bucket"), store.hashes(buckets)
    spark = batch.sparkSession
    chunks = "chunk_id string, doc_id string, title string, url string, space string, ordinal int, text string, embedding array<float>"
    return spark.createDataFrame([], chunks), spark.createDataFrame([], "doc_id string, content_hash string")


def _watermarked(events: DataFrame, watermark: str) -> DataFrame:
    """A stream with its watermark, which needs a timestamp with a zone; a batch as it is."""
    if not events.isStreaming:
        return events
    return events.withColumn("asked_at", F.col("asked_at").cast("timestamp")).withWatermark("asked_at", watermark)


def stream_metrics(events: DataFrame, watermark: str = WATERMARK, window: str = WINDOW) -> DataFrame:
    """L2: counters of asks (asked_at, escalated, duration_ms) per tumbling window; rows later than the watermark are dropped."""
    late = _watermarked(events, watermark)
    out = late.groupBy(F.window("asked_at", window).alias("w")).agg(F.count("*").alias("asks"), F.count_if("escalated").alias("escalations"), F.sum("duration_ms").alias("duration_ms_sum"))
    return out.select(F.col("w.start").alias("window_start"), "asks", "escalations", "duration_ms_sum")


def stream_gaps(events: DataFrame, watermark: str = WATERMARK, window: str = WINDOW) -> DataFrame:
    """Escalated questions per key and window."""
    rows = events.where("escalated AND question <> ''").withColumn("question_key", question_key(F.col("question")))
    late = _watermarked(rows, watermark)
    out = late.groupBy(F.window("asked_at", window).alias("w"), "question_key").agg(F.count("*").alias("asked"), F.max("asked_at").alias("last_asked"))
    return out.select(F.col("w.start").alias("window_start"), "question_key", "asked", "last_asked")


class _Frequent(StatefulProcessor):
    """A summary of bounded size; each batch gives all of it, with the number of rows so far."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("summary", "keys array<string>, counts array<long>, lost long, total long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts, lost, total = pd.Series(dtype="int64"), 0, 0
        if self.state.exists():
            keys, held, lost, total = self.state.get()
            counts = pd.Series(list(held), index=list(keys), dtype="int64")
        for frame in rows:
            total += int(frame.n.sum())
            found = frame.groupby("question_key").n.sum()
            counts, gone = heavy.shortened(counts.add(found, fill_value=0).astype("int64"), self.capacity)
            lost += gone
        self.state.update((counts.index.tolist(), counts.tolist(), lost, total))
        if counts.empty:  # all of its keys were equally frequent: still its numbers must be told
            counts = pd.Series([0], index=[None], dtype="int64")
        yield pd.DataFrame({"shard": pd.Series([key[0]] * len(counts), dtype="int32"), "question_key": counts.index.astype(object), "at_least": counts.to_numpy(), "at_most": counts.to_numpy() + lost, "lost": lost, "total": total})

    def close(self) -> None:
        pass


def stream_frequent_gaps(events: DataFrame, capacity: int = 1000, shards: int = 16) -> DataFrame:
    """L5 with bounded state: shard, question_key, at_least, at_most, lost, total: after each batch the summary of every
    shard of keys that had rows. The rows of a shard's largest `total` are its current ones. A summary that is left
    without keys is one row of a null key.

    State is shards * capacity keys at most, however long the stream is. A batch is counted in its tasks first, so a
    frequent key is few rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["question_key", "n"])

    keys = events.where("escalated AND question <> ''").select(question_key(F.col("question")).alias("question_key"))
    partial = keys.mapInArrow(counted, "question_key string, n long").withColumn("shard", F.pmod(F.xxhash64("question_key"), F.lit(shards)).cast("int"))
    schema = "shard int, question_key string, at_least long, at_most long, lost long, total long"
    return partial.groupBy("shard").transformWithStateInPandas(_Frequent(capacity), schema, "Append", "None")


class _Votes(StatefulProcessor):
    """Down-votes since the last approval; a row when they first reach the threshold. Other kinds of events don't count."""

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("votes", "approved boolean, votes int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        approved, votes = self.state.get() if self.state.exists() else (False, 0)
        frame = pd.concat(list(rows)).sort_values(["at", "seq"])
        out = []
        for r in frame.itertuples():
            if r.kind == "approve":
                approved, votes = True, 0
            elif r.kind == "down" and approved:
                votes += 1
                if self.threshold > 0 and votes == self.threshold:
                    out.append(r.at)
        self.state.update((approved, votes))
        yield pd.DataFrame({"id": [key[0]] * len(out), "at": pd.Series(out, dtype="datetime64[ns]")})

    def close(self) -> None:
        pass


def stream_quarantine(events: DataFrame, threshold: int = QUARANTINE_AT) -> DataFrame:
    """L3: id, at when a candidate's down-votes since its last approval reach the threshold (events: id, at, seq, kind;
    other kinds than approve and down change nothing)."""
    return events.groupBy("id").transformWithStateInPandas(_Votes(threshold), "id long, at timestamp", "Append", "None")


class _Memory(StatefulProcessor):
    """The last question of a sender in a thread and when it was asked; a timer in event time forgets it.

    A key's rows of one batch are taken in order of time. A row older than what is remembered comes too late: it gets no
    context, and changes nothing."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("last", "text string, said_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, at = self.state.get() if self.state.exists() else (None, None)
        frame = pd.concat(list(rows)).sort_values(["said_at", "turn"], kind="stable")
        said = frame.said_at.astype("datetime64[ms]").astype("int64")
        late = (said < at) if at is not None else pd.Series(False, index=frame.index)
        fresh, when = frame.text[~late], said[~late]
        before, before_at = fresh.shift(fill_value=last), when.shift(fill_value=at if at is not None else 0)
        in_time = when - before_at <= self.ttl_ms
        previous = pd.Series(None, index=frame.index, dtype=object)
        previous[~late] = before.where(in_time, None)
        if len(fresh):
            if at is not None:
                self.handle.deleteTimer(at + self.ttl_ms + 1)
            at = int(when.iloc[-1])
            self.state.update((fresh.iloc[-1], at))
            self.handle.registerTimer(at + self.ttl_ms + 1)
        yield pd.DataFrame({"thread_id": key[0], "sender": key[1], "turn": frame.turn.to_numpy(), "text": frame.text.to_numpy(), "previous": previous.to_numpy(), "late": late.to_numpy()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame({"thread_id": pd.Series(dtype=object), "sender": pd.Series(dtype=object), "turn": pd.Series(dtype="int64"), "text": pd.Series(dtype=object), "previous": pd.Series(dtype=object), "late": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def stream_follow_ups(messages: DataFrame, ttl_ms: int = TTL_MS, watermark: str = WATERMARK) -> DataFrame:
    """L4: thread_id, sender, turn, text, query, late, as follow_ups over messages (thread_id, sender, turn, text, said_at).

    A question counts as the previous one for ttl_ms of event time; behind the watermark its state is dropped, and Spark
    drops rows that are older. Only the previous question is kept as state, the rest is SQL."""
    schema = "thread_id string, sender string, turn long, text string, previous string, late boolean"
    timed = messages.withColumn("said_at", F.col("said_at").cast("timestamp")).withWatermark("said_at", watermark)
    said = timed.groupBy("thread_id", "sender").transformWithStateInPandas(_Memory(ttl_ms), schema, "Append", "EventTime")
    return said.select("thread_id", "sender", "turn", "text", chat.in_context(F.col("text"), F.col("previous")).alias("query"), "late")
