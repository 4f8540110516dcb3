"""Tables of the domain, derived from the driver's tables: in Spark, and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.functions.cutting import single_spaced
from groundspark.functions.text import first_words
from groundspark.operators import chunking, lexical, lexical_index, search, vectors
from groundspark.sources.scratch import spread, written

TARGET, OVERLAP, WIDTH = 200, 40, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    """documents as plain-text documents; the title is the first eight words."""
    return as_docs(spread(table(spark, d, "documents")))


def as_docs(t: DataFrame) -> DataFrame:
    title = F.array_join(first_words(F.col("text"), 8), " ")
    return t.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), title.alias("title"),
        F.concat(F.lit("https://kb.example.org/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.coalesce("text", F.lit("")).alias("body"), F.col("source").alias("space"), F.lit("text").alias("content_type"), F.col("doc_id").alias("id"),
    )


def marked_docs(spark: SparkSession, d: str) -> DataFrame:
    """documents as markdown: every third line is a heading, every seventh a fence."""
    t = table(spark, d, "documents")
    line = lambda x, i: F.when(i % 7 == 6, F.concat(F.lit("```\n"), x)).when(i % 3 == 0, F.concat(F.lit("## "), x)).otherwise(x)
    return t.select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n").alias("body"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(docs(spark, d), TARGET, OVERLAP)


def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    return vectors.with_hash_embedding(chunks(spark, d), "text", WIDTH)


def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Embedded chunks as a table that is written once, for queries that read it several times."""
    return written(embedded_chunks(spark, d), "chunks")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """benchmark items as questions: all their words; an `or` among them joins alternatives."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.array_join(found, " ").alias("question"))


def embedded_questions(spark: SparkSession, d: str) -> DataFrame:
    return vectors.with_hash_embedding(questions(spark, d), "question", WIDTH)


def postings(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build_postings(chunks(spark, d))


def index(spark: SparkSession, d: str) -> DataFrame:
    return lexical_index.stored_index(chunks(spark, d))


def hits(spark: SparkSession, d: str, top_k: int = 8) -> DataFrame:
    return search.hybrid_search(embedded_questions(spark, d), stored_chunks(spark, d), top_k=top_k, width=WIDTH)


def drafts(spark: SparkSession, d: str) -> DataFrame:
    """An answer drafted from every document: all its words, with what the guards look for, by the id."""
    t = spread(table(spark, d, "documents").where("text IS NOT NULL"))
    t, first = t.withColumn("first", single_spaced(F.col("text"))), F.col("first")
    kind = F.col("doc_id") % 8
    answer = (
        F.when(kind == 0, F.concat(first, F.lit(" [1].")))
        .when(kind == 1, F.concat(first, F.lit(" [2] in total 1,234,567 units.")))
        .when(kind == 2, F.lit("I don't know"))
        .when(kind == 3, F.concat(first, F.lit(" uses org.example.Driver [1] and server.properties.")))
        .when(kind == 4, F.lit("Unfortunately, the sources could not find it."))
        .when(kind == 5, F.concat(first, F.lit(" [1]\nSources:\n[1]\n[2]")))
        .when(kind == 6, F.concat(F.lit("Based on the context, "), first, F.lit(" .. and  more [7][2].\nI don't know")))
        .otherwise(F.concat(first, F.lit(". It has nothing to do with any of these several entirely unrelated imaginary words.")))
    )
    return t.select(F.col("doc_id").alias("question_id"), F.concat(F.lit("what is in "), "source", F.lit(" "), F.col("doc_id").cast("string")).alias("question"), answer.alias("answer"))


def draft_hits(spark: SparkSession, d: str) -> DataFrame:
    """Two hits for each draft: its own document, and the next one, both whole."""
    t = spread(table(spark, d, "documents").where("text IS NOT NULL"))
    t = t.select("doc_id", "source", F.array_join(first_words(F.col("text"), 4), " ").alias("title"), single_spaced(F.col("text")).alias("text"))
    hit = lambda shift, rank: F.struct(F.lit(shift).alias("shift"), F.lit(rank).alias("rank"))
    both = t.select("*", F.inline(F.array(hit(0, 1), hit(1, 2))))
    url = F.concat(F.lit("https://kb.example.org/"), "source")
    return both.select((F.col("doc_id") - F.col("shift")).alias("question_id"), "rank", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "title", url.alias("url"), F.col("source").alias("space"), "text", (1.0 / (60 + F.col("doc_id") % 5 + F.col("rank"))).alias("score"), (F.col("doc_id") % 10 / 10.0).alias("vector_score"), F.lit(None).cast("double").alias("rerank_score"))


def ask_log(spark: SparkSession, d: str) -> DataFrame:
    """events as an ask log: errors escalate, the user is the question's key."""
    return as_asks(table(spark, d, "events"))


def as_asks(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("asked_at"), F.concat(F.lit("Topic  "), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, " ").otherwise("")).alias("question"),
        (F.col("event_type") == "error").alias("escalated"), (F.col("value") / 200).alias("confidence"), F.floor("value").cast("long").alias("duration_ms"), (F.col("event_id") % 7 == 0).alias("cache_hit"),
    )


def feedback_log(spark: SparkSession, d: str) -> DataFrame:
    """events as votes."""
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("topic "), F.col("user_id").cast("string")).alias("question"), F.when(F.col("event_id") % 3 == 0, "down").otherwise("up").alias("verdict"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("reporter"), F.col("ts").alias("created_at"), "event_id")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Users of events as curated candidates."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
    status = F.element_at(F.array(*map(F.lit, ["approved", "pending", "rejected", "approved"])), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(F.col("user_id").alias("id"), "created_at", F.concat(F.lit("Topic "), F.col("user_id").cast("string")).alias("question"), F.when(F.col("user_id") % 5 == 0, " ").otherwise(F.concat(F.lit("Answer "), F.col("user_id").cast("string"))).alias("answer"), status.alias("status"))


def candidate_events(spark: SparkSession, d: str) -> DataFrame:
    """events as the life of candidates: id, at, seq, kind, author, approver."""
    return as_candidate_events(table(spark, d, "events"))


def as_candidate_events(e: DataFrame) -> DataFrame:
    kinds = F.array(*map(F.lit, ["submit", "approve", "reject", "down", "revoke", "down", "down", "quarantine"]))
    return e.select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.element_at(kinds, (F.col("event_id") % 8 + 1).cast("int")).alias("kind"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("author"), F.concat(F.lit("U"), (F.col("event_id") % 5).cast("string")).alias("approver"))


def chat_log(spark: SparkSession, d: str) -> DataFrame:
    """conversations: thread, sender; every third turn is a follow-up."""
    return as_chat(table(spark, d, "conversations"))


def as_chat(c: DataFrame) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("what about "), "text")).otherwise(F.col("text"))
    return c.select(F.col("conv_id").cast("string").alias("thread_id"), F.col("role").alias("sender"), "turn", text.alias("text"))


#: The same tables as SQL; a name may use those before it.
CTE: dict[str, str] = {
    "docs": """SELECT 'd' || doc_id AS doc_id, array_to_string(toks[1:8], ' ') AS title, 'https://kb.example.org/' || source || '/' || doc_id AS url, source AS space,
        coalesce(text, '') AS body, toks, doc_id AS id FROM (SELECT *, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS toks FROM documents)""",
    "chunks": """SELECT doc_id || '#' || ordinal AS chunk_id, doc_id, title, url, space, ordinal::INT AS ordinal, title || chr(10) || array_to_string(toks[ordinal * 160 + 1 : ordinal * 160 + 200], ' ') AS text
        FROM (SELECT *, unnest(range(0, 1 + greatest(0, ceil((len(toks) - 200) / 160.0)::BIGINT))) AS ordinal FROM docs WHERE len(toks) > 0)""",
    "vec": """SELECT * EXCLUDE (c), list_transform(c, lambda x: (x / sqrt(list_sum(list_transform(c, lambda y: y * y))))::FLOAT) AS embedding FROM (
        SELECT * EXCLUDE (b), list_transform(range(0, 64), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS c FROM (
        SELECT *, list_transform(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''), lambda w: ('0x' || substr(sha256(w), 1, 2))::INT % 64) AS b FROM chunks))""",
    "questions": """SELECT item_id AS question_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS question FROM benchmark""",
    "qvec": """SELECT * EXCLUDE (c), list_transform(c, lambda x: (x / CASE WHEN list_sum(list_transform(c, lambda y: y * y)) = 0 THEN 1 ELSE sqrt(list_sum(list_transform(c, lambda y: y * y))) END)::FLOAT) AS q FROM (
        SELECT * EXCLUDE (b), list_transform(range(0, 64), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS c FROM (
        SELECT *, list_transform(list_filter(string_split_regex(lower(question), '\\s+'), lambda x: x <> ''), lambda w: ('0x' || substr(sha256(w), 1, 2))::INT % 64) AS b FROM questions))""",
    "sims": """SELECT question_id, chunk_id, list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS vector_score FROM qvec, vec""",
    "dense": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(vector_score, 9) DESC, chunk_id) AS rank FROM sims) WHERE rank <= 32""",
    "stops": "SELECT unnest(string_split('{stops}', ' ')) AS term",
    "postings": """SELECT chunk_id, term, pos FROM (SELECT chunk_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT chunk_id, regexp_extract_all(lower(title || ' ' || text), '[a-z0-9]+') AS t FROM chunks)) WHERE term NOT IN (SELECT term FROM stops)""",
    "raws": """SELECT *, raw <> 'or' AND coalesce(lag(raw) OVER (PARTITION BY question_id ORDER BY n) = 'or', false) AS joins FROM (SELECT question_id, unnest(r) AS raw, generate_subscripts(r, 1) - 1 AS n FROM (SELECT question_id, regexp_extract_all(lower(question), '-?"[^"]*"|-?[^\\s"]+') AS r FROM questions))""",
    "terms": """SELECT question_id, grp, n, unnest(t) AS term, kind, generate_subscripts(t, 1) - 1 AS place FROM (SELECT question_id, n, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY question_id ORDER BY n) AS grp,
        CASE WHEN starts_with(raw, '-') THEN 'not' WHEN contains(raw, '"') THEN 'phrase' ELSE 'word' END AS kind, regexp_extract_all(raw, '[a-z0-9]+') AS t FROM raws WHERE raw <> 'or')""",
    "asked": "SELECT * FROM terms WHERE term NOT IN (SELECT term FROM stops)",
    "parts": """SELECT DISTINCT question_id, grp, kind, chunk_id FROM (SELECT s.question_id, s.grp, s.n, s.kind, s.size, p.chunk_id, p.pos - s.place AS at, count(DISTINCT s.place) AS m
        FROM (SELECT *, count(*) OVER (PARTITION BY question_id, n) AS size FROM asked) s JOIN postings p USING (term) GROUP BY ALL) WHERE m = size""",
    "matched": """SELECT p.question_id, p.chunk_id FROM parts p JOIN (SELECT question_id, count(DISTINCT grp) AS g FROM asked WHERE kind <> 'not' GROUP BY 1) USING (question_id)
        WHERE kind <> 'not' AND NOT EXISTS (SELECT 1 FROM parts x WHERE x.kind = 'not' AND x.question_id = p.question_id AND x.chunk_id = p.chunk_id) GROUP BY p.question_id, p.chunk_id, g HAVING count(DISTINCT p.grp) = g""",
    "loose": """SELECT DISTINCT question_id, term FROM (SELECT question_id, unnest(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda x: len(x) >= 2)[1:12]) AS term FROM questions WHERE question_id NOT IN (SELECT question_id FROM matched)) WHERE term NOT IN (SELECT term FROM stops)""",
    "occ": """SELECT w.question_id, p.chunk_id, w.term, p.pos, w.size FROM (SELECT question_id, term, count(*) OVER (PARTITION BY question_id) AS size FROM (SELECT DISTINCT question_id, term FROM asked WHERE kind <> 'not')) w JOIN postings p USING (term) JOIN matched m ON m.question_id = w.question_id AND m.chunk_id = p.chunk_id""",
    "covers": """SELECT question_id, chunk_id, size, l, min(r) AS r FROM (
        SELECT question_id, chunk_id, size, r, min(last) AS l FROM (
          SELECT a.question_id, a.chunk_id, a.size, a.pos AS r, b.term, max(b.pos) AS last FROM occ a JOIN occ b ON a.question_id = b.question_id AND a.chunk_id = b.chunk_id AND b.pos <= a.pos GROUP BY ALL)
        GROUP BY question_id, chunk_id, size, r HAVING count(*) = size) GROUP BY question_id, chunk_id, size, l""",
    "lexed": """SELECT question_id, chunk_id, sum(1.0::DOUBLE / (1 + greatest(0, r - l + 1 - size))) AS lex_score FROM covers GROUP BY 1, 2
        UNION ALL SELECT o.question_id, p.chunk_id, count(*)::DOUBLE FROM loose o JOIN postings p USING (term) GROUP BY 1, 2""",
    "words": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(lex_score, 9) DESC, chunk_id) AS rank FROM lexed) WHERE rank <= 32""",
    "fused": """SELECT question_id, chunk_id, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + w.rank), 0) AS score FROM dense d FULL OUTER JOIN words w USING (question_id, chunk_id)""",
    "hits": """SELECT f.question_id, f.rank, f.chunk_id, c.doc_id, c.title, c.url, c.space, c.text, f.score, s.vector_score
        FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fused) f JOIN chunks c USING (chunk_id) JOIN sims s ON s.question_id = f.question_id AND s.chunk_id = f.chunk_id WHERE f.rank <= 8""",
    "conf": """SELECT q.question_id, q.question, coalesce(h.n, 0) AS n_hits,
        CASE WHEN h.n IS NULL THEN 0 ELSE greatest(0, least(1, h.best)) * (0.5 + 0.5 * CASE WHEN len(q.toks) = 0 THEN greatest(0, least(1, h.best)) ELSE len(list_intersect(q.toks, h.seen)) / len(q.toks) END) END AS confidence
        FROM (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: len(w) >= 2 AND NOT list_contains(string_split('{stops}', ' '), w))) AS toks FROM questions) q
        LEFT JOIN (SELECT question_id, count(*) AS n, max(vector_score) AS best, list_distinct(flatten(list(regexp_extract_all(lower(title || ' ' || text), '[a-z0-9]+')))) AS seen FROM hits GROUP BY 1) h USING (question_id)""",
    "drafts": """SELECT doc_id AS question_id, 'what is in ' || source || ' ' || doc_id AS question, CASE doc_id % 8
        WHEN 0 THEN first || ' [1].' WHEN 1 THEN first || ' [2] in total 1,234,567 units.' WHEN 2 THEN 'I don''t know'
        WHEN 3 THEN first || ' uses org.example.Driver [1] and server.properties.' WHEN 4 THEN 'Unfortunately, the sources could not find it.'
        WHEN 5 THEN first || ' [1]' || chr(10) || 'Sources:' || chr(10) || '[1]' || chr(10) || '[2]'
        WHEN 6 THEN 'Based on the context, ' || first || ' .. and  more [7][2].' || chr(10) || 'I don''t know'
        ELSE first || '. It has nothing to do with any of these several entirely unrelated imaginary words.' END AS answer
        FROM (SELECT doc_id, source, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') AS first FROM documents WHERE text IS NOT NULL)""",
    "dhits": """SELECT doc_id - s AS question_id, s + 1 AS rank, 'd' || doc_id AS doc_id, array_to_string(toks[1:4], ' ') AS title, 'https://kb.example.org/' || source AS url, source AS space,
        array_to_string(toks, ' ') AS text, 1.0::DOUBLE / (60 + doc_id % 5 + s + 1) AS score, (doc_id % 10 / 10.0)::DOUBLE AS vector_score
        FROM (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS toks FROM documents WHERE text IS NOT NULL), (SELECT unnest([0, 1]) AS s)""",
    "asks": """SELECT event_id AS id, ts AS asked_at, 'Topic  ' || user_id || CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END AS question, event_type = 'error' AS escalated, value / 200 AS confidence, floor(value)::BIGINT AS duration_ms, event_id % 7 = 0 AS cache_hit FROM events""",
    "votes": """SELECT 'topic ' || user_id AS question, CASE WHEN event_id % 3 = 0 THEN 'down' ELSE 'up' END AS verdict, 'u' || user_id AS reporter, ts AS created_at, event_id FROM events""",
    "cands": """SELECT user_id AS id, min(ts) AS created_at, 'Topic ' || user_id AS question, CASE WHEN user_id % 5 = 0 THEN ' ' ELSE 'Answer ' || user_id END AS answer, ['approved', 'pending', 'rejected', 'approved'][user_id % 4 + 1] AS status FROM events GROUP BY user_id""",
    "cevents": """SELECT user_id AS id, ts AS "at", event_id AS seq, ['submit', 'approve', 'reject', 'down', 'revoke', 'down', 'down', 'quarantine'][event_id % 8 + 1] AS kind, 'u' || (user_id % 3) AS author, 'U' || (event_id % 5) AS approver FROM events""",
    "chat": """SELECT conv_id::VARCHAR AS thread_id, role AS sender, turn, CASE WHEN turn % 3 = 2 THEN 'what about ' || text ELSE text END AS text FROM conversations""",
}
_NEEDS = {
    "chunks": ["docs"], "vec": ["chunks"], "qvec": ["questions"], "sims": ["vec", "qvec"], "dense": ["sims"], "postings": ["chunks", "stops"],
    "raws": ["questions"], "terms": ["raws"], "asked": ["terms", "stops"], "parts": ["asked", "postings"], "matched": ["parts"], "loose": ["matched"], "occ": ["matched"], "covers": ["occ"], "lexed": ["covers", "loose"],
    "words": ["lexed"], "fused": ["dense", "words"], "hits": ["fused"], "conf": ["hits"],
}


def sql(needs: str, select: str) -> str:
    """The select with the expressions that it needs in front."""
    from groundspark.functions.text import STOP_WORDS

    wanted: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in wanted:
            wanted.append(name)

    for name in needs.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({CTE[n]})" for n in CTE if n in wanted]
    text = (f"WITH {', '.join(parts)} " if parts else "") + select
    return text.replace("{stops}", " ".join(STOP_WORDS))
