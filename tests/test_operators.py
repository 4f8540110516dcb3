"""Small cases of the operators: expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from groundspark.functions import text as tx
from groundspark.operators import chat, chunking, corpus, evaluate, feedback, guards, lexical_index, life, search, vectors
from groundspark.operators.confidence import confidence, gate


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(f(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><th>Broker</th><th>Host</th></tr><tr><td>1</td><td>a.example</td></tr></table>", "Broker | Host |\n1 | a.example |"),
        ("<p>Hello <b>world</b></p>", "Hello world"),
        ("<style>p{}</style><script>x</script><!-- c --><h2>Repli&amp;cation</h2><p>a &lt; b &eacute;</p>", "## Repli&cation\na < b é"),
        (None, ""),
    ],
)
def test_clean_html(spark, html, text):
    assert one(spark, tx.clean_html, html) == text


@pytest.mark.parametrize(
    ("question", "topic"),
    [("show me details of RFC 1918 please", "RFC 1918"), ("what is RFC 1918", "what is RFC 1918"), ("please", "please"), ("show me", "show me"), ("Can you tell me about  VPN, thanks!", "VPN"), ("explainable models", "explainable models")],
)
def test_normalize_question(spark, question, topic):
    assert one(spark, tx.normalize_question, question) == topic
    assert one(spark, lambda q: tx.normalize_question(tx.normalize_question(q)), question) == topic


def test_windows(spark):
    words = " ".join(f"t{i}" for i in range(23))
    got = one(spark, lambda c: chunking.token_windows(c, 10, 3), words)
    assert [w.split()[0] for w in got] == ["t0", "t7", "t14"] and got[-1].split()[-1] == "t22"
    assert one(spark, lambda c: chunking.token_windows(c, 10, 3), " ") == []
    chars = one(spark, chunking.char_windows, "x" * 3000)
    assert len(chars) == 4 and all(len(c) <= 1000 for c in chars) and one(spark, chunking.char_windows, "  ") == [""]
    for target, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.check_window(target, overlap)


def test_sections_ignore_fences(spark):
    body = "intro\n# One\ntext\n```\n# no heading\n```\n## Two\n## Three\nend"
    df = spark.createDataFrame([("a", body)], "doc_id string, body string")
    got = [(r.heading, r.body) for r in chunking.sections(df, "doc_id", "body").orderBy("section").collect()]
    assert got == [(None, "intro"), ("One", "text\n```\n# no heading\n```"), ("Two", ""), ("Three", "end")]
    pieces = [r.piece for r in chunking.header_windows(df, "doc_id", "body").orderBy("ordinal").collect()]
    assert pieces[1].startswith("One\ntext") and pieces[2] == "Two"


ANSWERS = "question_id long, question string, answer string"
HITS = "question_id long, rank int, chunk_id string, doc_id string, title string, url string, space string, text string, score double, vector_score double, rerank_score double"


def case(spark, answer, *sources, urls=None):
    hits = [(1, i + 1, f"c{i}", f"d{i}", f"T{i}", (urls or [f"u{k}" for k in range(len(sources))])[i], "s", s, 0.5, 0.5, None) for i, s in enumerate(sources)]
    return spark.createDataFrame([(1, "q", answer)], ANSWERS), spark.createDataFrame(hits, HITS)


@pytest.mark.parametrize(
    ("answer", "source", "flagged"),
    [
        ("total 4,160,768", "none", "4,160,768"), ("16,384", "16384", None), ("5000.0", "5,000", None), ("1,000,000", "1e6", None), ("0.50", "0.5", None),
        ("28.7", "28.4", "28.7"), ("12345", "912345678", "12345"), ("1e400", "none", "1e400"), ("1e400", "1e400", None),
        ("9007199254740993", "9007199254740992", "9007199254740993"), ("10.0.0.1 v2.3.1 [1][2] 3, possibly 4", "none", None), ("16,384 of 99,999", "16384", "99,999"), ("1.15", "1.15.0", None),
    ],
)
def test_numbers(spark, answer, source, flagged):
    got = [r.token for r in guards.fabricated_numbers(*case(spark, answer, source)).collect()]
    assert got == ([flagged] if flagged else [])


@pytest.mark.parametrize(
    ("answer", "source", "flagged"),
    [
        ("org.example.Driver", "metadata", {"org.example.Driver"}), ("jdbc:db://host", "x", {"jdbc:db://host"}), ("see http://x.y.z/a", "x", set()),
        ("server.properties and e.getMessage()", "x", set()), ("a.b.c", "a.b.c.d", {"a.b.c"}), ("meta.data.cache", "metadata cache", {"meta.data.cache"}), ("a.b.c.d", "A.B.C.D", set()),
    ],
)
def test_specifics(spark, answer, source, flagged):
    assert {r.token for r in guards.fabricated_specifics(*case(spark, answer, source)).collect()} == flagged


@pytest.mark.parametrize(
    ("answer", "refusal"),
    [("I don't know", True), ("Unfortunately, I cannot answer that", True), ("", True), ("There is not enough information to say", True), ("The broker could not find a leader", False), ("The sources do not help: could not find the document", True), ("It is 5 [1]; the page does not contain the provided price", False)],
)
def test_refusal(spark, answer, refusal):
    assert one(spark, guards.is_refusal, answer) is refusal


@pytest.mark.parametrize(
    ("answer", "urls", "text", "cited"),
    [
        ("a [1] b [2]", ["u", "u"], "a [1] b [1]", ["u"]), ("a [2] b [1]", ["u", "v"], "a [1] b [2]", ["v", "u"]), ("a [9] b [1]", ["u", "v"], "a  b [1]", ["u"]),
        ("Kafka[1] arr[7]", ["u", "v"], "Kafka[1] arr[7]", ["u"]), ("x [1][2]", ["u", "v"], "x [1][2]", ["u", "v"]), ("`p[1]` none", ["u", "v"], "`p[1]` none", ["u"]),
        ("a [2]\n\nSources:\n[1] A\n[2] B", ["u", "v"], "a [1]", ["v"]),
    ],
)
def test_citations(spark, answer, urls, text, cited):
    r = guards.finalize_citations(*case(spark, answer, "none here", "other", urls=urls)).first()
    assert r.answer == text and [c.url for c in r.citations] == cited


def test_tidy(spark):
    assert one(spark, guards.tidy_answer, "Based on the context, it  works () .. `f()  x` end...") == "It works . `f()  x` end..."
    assert one(spark, guards.strip_sources_block, "text\n[1] Title\n[2] Other") == "text\n[1] Title\n[2] Other"
    assert one(spark, guards.strip_sources_block, "text\n[1]\n[2]") == "text"
    assert one(spark, guards.strip_trailing_refusal, "good [1]\nI don't know") == "good [1]"
    assert [one(spark, guards.parse_verdict, v) for v in ("**FAIL**", "pass, I think", "hm", None)] == ["fail", "pass", "open", "open"]


def test_confidence(spark):
    questions = spark.createDataFrame([(1, "red car"), (2, "blue sky")], "question_id long, question string")
    hit = lambda q, cos, rr: (q, 1, "c", "d", "red", "u", "s", "car", 0.1, cos, rr)
    got = lambda rr: {r.question_id: r for r in gate(confidence(questions, spark.createDataFrame([hit(1, 0.5, rr)], HITS))).collect()}
    assert got(None)[2].confidence == 0 and got(None)[2].escalate and got(None)[1].confidence == 0.5
    assert got(8.0)[1].confidence > 0.7 > got(-8.0)[1].confidence > 0


def chunk_rows(spark):
    rows = [("keep#0", "keep", "Kafka", "u", "a", 0, "the quorum controller elects", [1.0] + [0.0] * 7), ("other#0", "other", "Misc", "v", "b", 0, "orthogonal words", [0.0, 1.0] + [0.0] * 6)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, title string, url string, space string, ordinal int, text string, embedding array<float>")


def test_hybrid_search(spark):
    asked = spark.createDataFrame([(1, "quorum controller", [0.0, 1.0] + [0.0] * 6), (2, "quorum zzzznotacorpusword", [0.0, 0.0, 1.0] + [0.0] * 5)], "question_id long, question string, embedding array<float>")
    hits = search.hybrid_search(asked, chunk_rows(spark), width=8).collect()
    first = {(r.question_id, r.chunk_id): r for r in hits}
    assert abs(first[(1, "other#0")].vector_score - 1) < 1e-9 and first[(1, "keep#0")].score > 1 / 62 and max(r.score for r in hits) <= 2 / 61
    assert [r.chunk_id for r in hits if r.question_id == 2 and r["rank"] == 1] == ["keep#0"]
    assert {r.doc_id for r in search.hybrid_search(asked, chunk_rows(spark), filters={"doc_id": "keep"}, width=8).collect()} == {"keep"}
    assert search.hybrid_search(asked, chunk_rows(spark), top_k=0, width=8).count() == 0
    with pytest.raises(ValueError):
        search.with_filters(chunk_rows(spark), {"text": "x"})
    lex = lexical_index.search(asked.where("question_id = 1"), lexical_index.stored_index(chunk_rows(spark)), 5).collect()
    assert [(r.chunk_id, r.lex_score) for r in lex] == [("keep#0", 1.0)]


def test_rerank_bypass_and_order(spark):
    asked = spark.createDataFrame([(1, "red fox"), (2, "x y")], "question_id long, question string")
    rows = [(1, 1, "a", "d", "t", "u", "s", "nothing", 0.1, 0.2, None), (1, 2, "b", "d", "t", "u", "s", "a red fox", 0.1, 0.3, None), (2, 1, "c", "d", "t", "u", "s", "x", 0.1, 0.4, None)]
    got = {(r.question_id, r["rank"]): r for r in search.rerank(spark.createDataFrame(rows, HITS), asked, 5).collect()}
    assert got[(1, 1)].chunk_id == "b" and got[(1, 1)].score == got[(1, 1)].rerank_score == 4.0 and got[(2, 1)].rerank_score is None
    own = search.rerank(spark.createDataFrame(rows, HITS), asked, 5, scorer=lambda q, w: [-float(len(x)) for x in w])
    assert [r.chunk_id for r in own.where("question_id = 1 AND rank = 1").collect()] == ["a"]


def test_embed_falls_back(spark):
    def embedder(texts):
        if len(texts) > 1 or len(texts[0]) > 1500:
            raise ValueError("too much")
        if "bad" in texts[0]:
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([("a",), ("bad",), ("x" * 2000,)], "t string").coalesce(1)
    got = {r.t[:3]: r for r in vectors.embed(df, "t", embedder).collect()}
    assert got["a"].embedding == [1.0] and got["bad"].embed_error.startswith("RuntimeError") and got["xxx"].embedding == [1500.0]


DOCS = "doc_id string, title string, url string, body string, space string, content_type string"


def test_ingest_twice_and_changes(spark):
    docs = spark.createDataFrame([("a", "A", "", "vpn access guide", "s", "text"), ("b", "B", "", "one " * 900, "s", "text"), ("bad", "C", "", None, "s", "text")], DOCS)
    chunks = spark.createDataFrame([], "chunk_id string, doc_id string, title string, url string, space string, ordinal int, text string, embedding array<float>")
    hashes = spark.createDataFrame([], "doc_id string, content_hash string")
    first = corpus.ingest(docs, chunks, hashes)
    assert first["summary"].first().asDict() == {"docs": 2, "new": 2, "changed": 0, "unchanged": 0, "empty": 0, "chunks": 3, "failed": 1}
    again = corpus.ingest(docs, first["chunks"], first["hashes"])
    assert again["summary"].first().chunks == 0 and again["chunks"].count() == 3
    short = docs.withColumn("body", F.when(F.col("doc_id") == "b", "short").when(F.col("doc_id") == "a", " ").otherwise(F.col("body")))
    after = corpus.ingest(short, first["chunks"], first["hashes"])
    assert {r.chunk_id for r in after["chunks"].collect()} == {"b#0"} and {r.doc_id for r in after["hashes"].collect()} == {"b"}


def test_prune_guards(spark):
    chunks = spark.createDataFrame([(i,) for i in ("a", "b", "c", "curated:1")], "doc_id string")
    seen = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id string")
    plan = lambda *a, **k: corpus.prune_plan(chunks, *a, **k).first()["decision"]
    assert plan(seen("a", "b")) == "prune" and plan(seen("a")) == "too_many" and plan(seen()) == "empty"
    assert plan(seen("a", "b"), source_errors=1) == "errors" and plan(seen("a", "b"), full_crawl=False) == "partial"
    left, _, _ = corpus.prune(chunks, spark.createDataFrame([], "doc_id string, content_hash string"), seen("a", "b"))
    assert {r.doc_id for r in left.collect()} == {"a", "b", "curated:1"}


def test_candidate_life(spark):
    rows = [(1, 1, "submit", "ann", None), (1, 2, "approve", "ann", "Ann "), (1, 3, "approve", "ann", "bob"), (1, 4, "reject", "ann", None), (1, 5, "revoke", "ann", None), (2, 1, "approve", "x", "y")]
    got = {r.id: r for r in life.candidate_state(spark.createDataFrame(rows, "id long, seq long, kind string, author string, approver string")).collect()}
    assert (got[1].status, got[1].accepted, got[1].refused) == ("revoked", 3, 2) and got[2].status == ""


def test_follow_ups_and_routes(spark):
    rows = [("t", "a", 1, "What is a VPN?"), ("t", "b", 2, "and that?"), ("t", "a", 3, "How about it"), ("t", "a", 4, "A long question that stands for itself")]
    got = {r.turn: r.query for r in chat.follow_ups(spark.createDataFrame(rows, "thread_id string, sender string, turn long, text string")).collect()}
    assert got[2] == "and that?" and got[3] == "How about it (in the context of: What is a VPN?)" and got[4] == rows[3][3]
    raw = spark.createDataFrame([('{"type":"message","text":"<at>B</at> hi","from":{"id":"u"}}',), ('{"type":"message","value":{"callback_keyword":"feedback","verdict":"up","question":"q"}}',), ('{"type":"typing"}',), ("nonsense",)], "value string")
    routed = chat.route_activities(raw)
    assert [tuple(r) for r in routed["message"].collect()] == [("u", "hi")] and routed["feedback"].first()["verdict"] == "up" and routed["ignore"].count() == 2


def test_quality_flags(spark):
    flags = lambda a, n: one(spark, lambda c: evaluate.quality_flags(c, F.lit(n)), a)
    assert flags("Fine [1].", 1) == [] and flags("Cut off [3]", 1) == ["MARKER>SOURCES", "MARKERS_NONCONTIGUOUS"]
    assert "DOUBLE_SPACE" in flags("a  b.", 0) and flags("`a  b` and f() ok.", 0) == [] and "TRUNCATED_MIDSENTENCE" in flags("it ends", 0)


def test_facts_of_copied_pages_meet_each_text_once(spark):
    cases = spark.createDataFrame([(i, "in_scope", ["Alpha" if i % 2 else "beta"]) for i in range(300)] + [(300, "in_scope", [None]), (301, "other", ["beta"]), (302, "in_scope", ["x"])], "id long, category string, expect_any array<string>")
    cited = spark.createDataFrame([(i, "T") for i in range(302)] + [(302, None), (302, "unknown")], "id long, title string")
    chunks = spark.createDataFrame([("T", f"an alpha {i}") for i in range(300)] + [(None, "x")], "title string, text string")
    checked = evaluate.grounded_check(cases, cited, chunks)
    got = {r.id: r.grounded for r in checked.collect()}
    assert got == {i: bool(i % 2) for i in range(300)} | {300: None}
    by_id = next(x for x in checked._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [id" in x)
    assert "Contains" not in by_id  # texts are tested before they meet ids


def test_entities_without_a_semicolon(spark):
    html = "<h1>Cut short &amp</h1><p>&amp;&amp;amp &eacute; &copy &lt;b&gt; &bogus; &#39; &#x41;</p>"
    assert one(spark, tx.clean_html, html) == "# Cut short &\n&&amp é © <b> &bogus; ' A"
    assert one(spark, lambda c: tx.clean_html(c, bare_entities=False), html) == "# Cut short &amp\n&&amp é &copy <b> &bogus; ' A"
    assert one(spark, lambda c: tx.clean_html(c, bare_entities=False), "<h1>x &amp</h1>") == "# x &amp"


def test_lead_ins_without_articles(spark):
    short = [p for p in tx.LEAD_INS if not p.endswith(" the")]
    assert one(spark, tx.normalize_question, "Show me the broker thanks!") == "broker"
    assert one(spark, lambda q: tx.normalize_question(q, short), "Show me the broker thanks!") == "the broker"


def test_first_words_and_windows_of_odd_white_space(spark):
    text = "\u00a0 one\ttwo\n\n three\r\rfour \x00fi\x07ve\u2003six "
    assert one(spark, tx.words, text) == ["one", "two", "three", "four", "\x00fi\x07ve", "six"]
    for n in (0, 1, 3, 6, 9):
        assert one(spark, lambda c, n=n: tx.first_words(c, n), text) == one(spark, tx.words, text)[:n]
    assert one(spark, lambda c: tx.first_words(c, 8), None) == one(spark, lambda c: tx.first_words(c, 8), " \n") == []
    docs = spark.createDataFrame([("a", "", "u", "s", text, "text")], "doc_id string, title string, url string, space string, body string, content_type string")
    assert [r.text for r in chunking.chunk_documents(docs, 4, 1).orderBy("ordinal").collect()] == ["one two three four", "four five six"]
