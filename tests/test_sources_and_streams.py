"""Files, exports, the chunk store, and the streams against their batch twins."""

import json

import pytest
from pyspark.sql import functions as F

from groundspark.operators import chat, corpus, feedback
from groundspark.sources import files
from groundspark.sources.scratch import put_if_absent
from groundspark.sources.store import ChunkStore, Conflict
from groundspark.streaming import jobs


def test_scan_files(spark, tmp_path):
    for name, data in {"a.md": b"# Hi", "sub/b.txt": "wide é".encode("utf-16"), "c.log": "caf\xe9".encode("cp1252"), "d.txt": bytes(range(256)), "e.docx": b"x", "f.pdf": b"%PDF-", "g.txt": b" ", "big.txt": b"x" * 2000, ".git/h.txt": b"x", "node_modules/i.md": b"x", "j.html": b"\xef\xbb\xbf<p>z</p>"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    got = {r.doc_id: r for r in files.scan_files(spark, str(tmp_path), 1000).collect()}
    assert {k: r.status for k, r in got.items()} == {"a.md": "ok", "sub/b.txt": "ok", "c.log": "ok", "d.txt": "undecodable", "e.docx": "unsupported", "f.pdf": "no text", "g.txt": "empty", "big.txt": "too large", "j.html": "ok"}
    assert got["sub/b.txt"].body == "wide é" and got["c.log"].body == "café" and got["j.html"].body == "<p>z</p>" and got["a.md"].content_type == "markdown" and got["sub/b.txt"].title == "b"
    assert files.skip_report(files.scan_files(spark, str(tmp_path), 1000)).agg(F.sum("files")).first()[0] == 5


def test_files_above_the_limit_are_not_opened(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"x" * 2000)
    (tmp_path / "big.docx").write_bytes(b"x" * 2000)
    (tmp_path / "a.txt").write_bytes(b"x" * 1000)
    key = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "1500")  # Spark refuses to open what is longer
    try:
        assert {r.doc_id: r.status for r in files.scan_files(spark, str(tmp_path), 1000).collect()} == {"big.txt": "too large", "big.docx": "unsupported", "a.txt": "ok"}
    finally:
        spark.conf.set(key, before)


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"f{i}").mkdir()
        (tmp_path / f"f{i}" / "a.txt").write_text("x")
    key, context = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    before = spark.conf.get(key)
    context.setJobGroup("listing", "listing")
    try:
        scanned = files.scan_files(spark, str(tmp_path))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < sum(tracker.getStageInfo(s).numTasks for s in stages) <= 2 * context.defaultParallelism
    assert spark.conf.get(key) == before and scanned.count() == 60


def test_one_byte_texts_are_decoded_without_python(spark):
    def expected(raw):
        text = raw.decode("cp1252", "replace")
        bad = sum(c == "\ufffd" or (ord(c) < 32 and c not in "\t\n\r") for c in text)
        return text.replace("\0", "") if bad / len(text) <= 0.05 else None

    words = b"caf\xe9 "
    some = [words * 4 + bytes([c]) for c in range(256)] + [words * n + b"\0\x81" for n in range(1, 12)] + [bytes(range(128, 256)), bytes(range(256)), b"\xef\xbb\xbf\xff" + words * 9]
    rows = spark.createDataFrame(list(enumerate(some)), "id int, raw binary").select("id", files.decode_bytes(F.col("raw")).alias("text"))
    assert {r.id: r.text for r in rows.collect()} == {i: expected(raw) for i, raw in enumerate(some)}
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_wiki_export_and_subtree(spark, tmp_path):
    page = lambda i, title, parent=None, body="<p>x</p>": {"id": i, "title": title, "body": {"storage": {"value": body}}, "space": {"key": "K"}, "metadata": {"labels": {"results": [{"name": "l"}, {"name": ""}]}}, "ancestors": [{"id": parent}] if parent else [], "_links": {"webui": "/x", "base": "https://h/wiki"}}
    (tmp_path / "p.json").write_text(json.dumps({"results": [page("1", "Root"), page("2", "Kid", "1"), page("3", "", "2", ""), page("4", "Other"), page(" ", "no id")]}))
    pages = files.scan_wiki_export(spark, str(tmp_path), "https://user:pw@Wiki.Example.org/wiki")
    got = {r.doc_id: r for r in pages.collect()}
    assert set(got) == {f"wiki.example.org:{i}" for i in range(1, 5)} and got["wiki.example.org:3"].body is None and got["wiki.example.org:3"].title == "3"
    assert got["wiki.example.org:1"].labels == ["l"] and got["wiki.example.org:1"].url == "https://h/wiki/x"
    assert {(r.doc_id[-1], r.depth) for r in files.subtree(pages, "Root").collect()} == {("1", 0), ("2", 1), ("3", 2)}


def test_golden_and_report(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"cases": [{"id": "a", "category": "in_scope", "question": "q", "expect_any": ["x"]}, {"id": "b", "category": "oos", "question": "r", "expect_escalate": True}]}))
    got = {r.id: r for r in files.scan_golden(spark, str(tmp_path / "g.json")).collect()}
    assert got["a"].expect_any == ["x"] and got["a"].expect_escalate is False and got["b"].expect_any == []
    files.write_report(files.scan_golden(spark, str(tmp_path / "g.json")), spark.range(1), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/rows")).count() == 2


def test_cap_and_union(spark):
    docs = spark.range(5).withColumnRenamed("id", "doc_id")
    assert files.cap_docs(docs, 3)[1] is False and files.cap_docs(docs, 5)[1] is True
    out, report = files.union_sources({"a": docs, "b": docs.select(F.raise_error(F.lit("x")).cast("long").alias("doc_id")).where("doc_id > 0")})
    assert out.count() == 5 and {(r.source, r.error is None) for r in report.collect()} == {("a", True), ("b", False)}


DOCS = "doc_id string, title string, url string, body string, space string, content_type string"


def test_store_and_stream_ingest(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    source = tmp_path / "in"
    write = lambda *rows: spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(source))
    write(("a", "A", "", "first body", "s", "text"))
    run = lambda: jobs.stream_ingest(spark.readStream.schema(DOCS).parquet(str(source)), store, str(tmp_path / "cp")).awaitTermination()
    run()
    assert [r.chunk_id for r in store.chunks().collect()] == ["a#0"]
    write(("a", "A", "", "second body", "s", "text"), ("b", "B", "", "other", "s", "text"))
    run()
    assert {r.text for r in store.chunks().collect()} == {"A\nsecond body", "B\nother"} and store.hashes().count() == 2
    name = store.current()
    assert store.commit(store.chunks().drop("doc_bucket"), store.hashes(), batch=f"{tmp_path / 'cp'}:1") == name


def test_a_commit_rewrites_only_the_buckets_of_its_documents(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=8)
    table = lambda texts: spark.createDataFrame([(f"{k}#0", f"d{k}", t) for k, t in texts.items()], "chunk_id string, doc_id string, text string")
    first = {k: f"text {k}" for k in range(40)}
    store.commit(table(first), table(first).select("doc_id", F.lit("h").alias("content_hash")))
    touched = store.buckets_of(table({3: ""}))
    old = store.chunks(touched).drop("doc_bucket")
    assert len(touched) == 1 and 0 < old.count() < 40
    new = old.where("doc_id <> 'd3'").unionByName(table({3: "changed"}))
    name = store.commit(new, store.hashes(touched), buckets=touched)
    assert {r.doc_id: r.text for r in store.chunks().collect()} == {f"d{k}": "changed" if k == 3 else t for k, t in first.items()}
    assert store.hashes().count() == 40 and spark.read.parquet(f"{store.path}/{name}/chunks").count() == old.count()
    assert ChunkStore(spark, store.path, buckets=99).buckets == 8


CHUNKS = "chunk_id string, doc_id string, text string"


def some_chunks(spark, texts):
    rows = spark.createDataFrame([(f"{k}#0", k, t) for k, t in texts.items()], CHUNKS)
    return rows, rows.select("doc_id", F.lit("h").alias("content_hash"))


def texts_of(store):
    return {r.doc_id: r.text for r in store.chunks().collect()}


def test_commits_of_two_writers_lose_neither(spark, tmp_path):
    one, other = (ChunkStore(spark, str(tmp_path / "store"), buckets=8) for _ in range(2))
    first = {f"d{k}": "old" for k in range(30)}
    one.commit(*some_chunks(spark, first))
    own = {k: one.buckets_of(some_chunks(spark, {k: ""})[0]) for k in first}
    a = next(iter(first))
    b = next(k for k in first if own[k] != own[a])

    def changed(store, k, text):
        base = store.seq()
        old = store.chunks(own[k]).drop("doc_bucket")
        return {"chunks": old.where(F.col("doc_id") != k).unionByName(some_chunks(spark, {k: text})[0]), "hashes": store.hashes(own[k]), "buckets": own[k], "base": base}

    x, y = changed(one, a, "new a"), changed(other, b, "new b")
    one.commit(**x)
    other.commit(**y)  # another bucket: merged
    assert texts_of(one) == first | {a: "new a", b: "new b"} and one.seq() == 2
    x, y = changed(one, a, "third a"), changed(other, a, "fourth a")
    one.commit(**x)
    with pytest.raises(Conflict):  # the same bucket: to be read again
        other.commit(**y)
    other.commit(**changed(other, a, "fourth a"))
    assert texts_of(one) == first | {a: "fourth a", b: "new b"} and one.hashes().count() == 30


def test_markers_are_created_once(spark, tmp_path):
    path = str(tmp_path / "m" / "0.json")
    (tmp_path / "m").mkdir()
    assert put_if_absent(spark, path, "one") and not put_if_absent(spark, path, "two")
    assert [p.read_text() for p in (tmp_path / "m").glob("*.json")] == ["one"] and not list((tmp_path / "m").glob(".[0-9a-f]*[0-9a-f]"))


def test_two_streams_into_one_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=2)
    streams = []
    for k in "ab":
        spark.createDataFrame([(f"{k}{i}", "T", "", f"body {i}", "s", "text") for i in range(6)], DOCS).repartition(3).write.parquet(str(tmp_path / k))
        source = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / k))
        streams.append(jobs.stream_ingest(source, store, str(tmp_path / f"cp-{k}")))
    for s in streams:
        s.awaitTermination()
    assert {r.doc_id for r in store.chunks().collect()} == {f"{k}{i}" for k in "ab" for i in range(6)} == {r.doc_id for r in store.hashes().collect()}


def test_buckets_grow_by_splitting(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=2)
    texts = {f"d{k}": "old" for k in range(40)}
    store.commit(*some_chunks(spark, texts))
    assert store.grow(4) == 8 == store.buckets and texts_of(store) == texts
    parts = [store.chunks([b]) for b in range(8)]
    assert sum(p.count() for p in parts) == 40 and all({r.doc_bucket for r in p.collect()} <= {b} for b, p in enumerate(parts))
    own = store.buckets_of(some_chunks(spark, {"d3": ""})[0])
    old = store.chunks(own).drop("doc_bucket").where("doc_id <> 'd3'")
    store.commit(old.unionByName(some_chunks(spark, {"d3": "new"})[0]), store.hashes(own), buckets=own)
    assert texts_of(store) == texts | {"d3": "new"} and store.hashes().count() == 40


def test_cleaning_leaves_what_markers_name(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=2)
    names = [store.commit(*some_chunks(spark, {"a": f"{k}"})) for k in range(4)]
    assert store.clean() == []  # too young
    assert set(store.clean(least_age=-5)) == set(names[:2]) and texts_of(store) == {"a": "3"}
    assert store.commit(*some_chunks(spark, {"a": "4"})) and store.seq() == 4


def test_stored_chunks_are_not_shuffled(spark, tmp_path):
    """Replacing some documents joins the stored chunks with their broadcast ids, and reads their buckets only."""
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=8)
    docs = spark.createDataFrame([(f"d{k}", "T", "", f"body {k}", "s", "text") for k in range(40)], DOCS)
    done = corpus.ingest(docs, *jobs._tables(store, docs, []))
    store.commit(done["chunks"], done["hashes"])
    batch = docs.limit(1).withColumn("body", F.lit("changed"))
    touched = store.buckets_of(batch)
    chunks = corpus.ingest(batch, store.chunks(touched).drop("doc_bucket"), store.hashes(touched))["chunks"]
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    stored = plan[plan.index("LeftAnti") :].split("Union")[0]
    assert "BroadcastHashJoin [doc_id" in plan and "LeftAnti" in plan
    scan = stored[: stored.index("BroadcastExchange")]
    assert "Exchange" not in scan.replace("BroadcastExchange", "") and f"[{touched[0]}]" in plan.replace("doc_bucket", "").replace("IN (", "[") or f"= {touched[0]})" in plan
    assert "Exchange hashpartitioning(doc_id" not in scan


def test_subtree_of_pages_that_are_each_others_parents(spark):
    pages = spark.createDataFrame([("a", "A", "c"), ("b", "B", "a"), ("c", "C", "b"), ("d", "D", "d"), ("e", "E", "b")], "doc_id string, title string, parent string")
    assert {(r.doc_id, r.depth) for r in files.subtree(pages, "A").collect()} == {("a", 0), ("b", 1), ("c", 2), ("e", 2)}
    assert files.subtree(pages, "d").count() == 1 and files.subtree(pages, "none").count() == 0


def drain(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return spark.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_windowed_streams_equal_their_batch_twins(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    asks = events.select(F.col("ts").cast("timestamp").alias("asked_at"), (F.col("event_type") == "error").alias("escalated"), F.col("value").cast("long").alias("duration_ms"), F.col("user_id").cast("string").alias("question"))
    asks.coalesce(1).write.parquet(str(tmp_path / "asks"))
    stream = lambda: spark.readStream.schema(asks.schema).parquet(str(tmp_path / "asks"))
    assert rows(drain(spark, jobs.stream_metrics(stream()), "metrics", "complete")) == rows(jobs.stream_metrics(asks))
    assert rows(drain(spark, jobs.stream_gaps(stream()), "gaps", "complete")) == rows(jobs.stream_gaps(asks))


def test_stateful_streams_equal_their_batch_twins(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kinds = F.element_at(F.array(*map(F.lit, ["approve", "down", "reject", "down", "submit", "down", "down", "revoke"])), (F.col("event_id") % 8 + 1).cast("int"))
    life = events.select((F.col("user_id") % 40).alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kinds.alias("kind")).orderBy("at", "seq")
    life.coalesce(1).write.parquet(str(tmp_path / "life"))
    stream = spark.readStream.schema(life.schema).parquet(str(tmp_path / "life"))
    assert rows(drain(spark, jobs.stream_quarantine(stream), "quarantined").select("id", "at")) == rows(feedback.quarantine(life)) != []


def test_follow_ups_in_event_time(spark, tmp_path):
    """Questions live for an hour; a question said earlier than what is remembered is late."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    minute = lambda *rows: spark.createDataFrame([(t, s, n, x, 1_700_000_000 + m * 60) for t, s, n, x, m in rows], "thread_id string, sender string, turn long, text string, m long").select("thread_id", "sender", "turn", "text", F.timestamp_seconds("m").alias("said_at"))
    batches = [
        minute(("t", "a", 1, "What is a VPN?", 0), ("t", "b", 2, "and it?", 1), ("t", "a", 3, "how about it", 30)),
        minute(("t", "a", 4, "and now it", 70), ("t", "a", 5, "and that", 200)),
        minute(("t", "a", 6, "and late", 100), ("t", "b", 7, "and them?", 210), ("t", "a", 8, None, 211), ("t", "a", 9, "and it", 212)),
    ]
    folder = tmp_path / "said"
    for k, rows_of in enumerate(batches):
        rows_of.coalesce(1).write.mode("append").parquet(str(folder))
        stream = jobs.stream_follow_ups(spark.readStream.schema(rows_of.schema).parquet(str(folder)), ttl_ms=3_600_000, watermark="5 hours")
        done = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert done.awaitTermination(240)
    got = {r.turn: (r.query, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    topic = lambda x, y: (f"{x} (in the context of: {y})", False)
    assert got == {
        1: ("What is a VPN?", False), 2: ("and it?", False), 3: topic("how about it", "What is a VPN?"), 4: topic("and now it", "how about it"), 5: ("and that", False),
        6: ("and late", True), 7: ("and them?", False), 8: (None, False), 9: ("and it", False),
    }
    on_time = batches[0].union(batches[1]).union(batches[2].where("turn <> 6"))
    assert {r.turn: r.query for r in chat.follow_ups(on_time, 3600).collect()} == {k: q for k, (q, late) in got.items() if not late}


def test_all_new_documents_are_cut_once_where_they_are(spark, tmp_path):
    """No join before the chunks where nothing is unchanged; hashes from the stored chunks are those from the new ones."""
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=4)
    docs = spark.createDataFrame([(f"d{k}", "T", "", " \n" if k % 5 == 0 else f"body {k}", "s", "text") for k in range(20)], DOCS)
    done = corpus.ingest(docs, *jobs._tables(store, docs, []))
    assert "LeftSemi" not in done["new"]._jdf.queryExecution().optimizedPlan().toString()
    store.commit(done["chunks"], done["stamp"])
    hashes = lambda df: sorted(map(tuple, df.select("doc_id", "content_hash").collect()))
    assert len(hashes(store.hashes())) == 16 and hashes(store.hashes()) == hashes(done["hashes"])
    done = corpus.ingest(docs.withColumn("body", F.when(F.col("doc_id") == "d3", "").otherwise(F.col("body"))), store.chunks().drop("doc_bucket"), store.hashes())
    assert "LeftSemi" in done["new"]._jdf.queryExecution().optimizedPlan().toString()
    store.commit(done["chunks"], done["stamp"])
    assert {r.doc_id for r in store.hashes().collect()} == {r.doc_id for r in store.chunks().collect()} == {f"d{k}" for k in range(20) if k % 5 and k != 3}
