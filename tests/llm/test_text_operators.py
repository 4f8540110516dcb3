"""Operators on documents against brute force, with null, empty, repeated and very long rows."""

import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.llm import decontaminate, jaccard_join, language_id, licenses, line_dedup, packing, quality, substring_dedup, token_store
from groundspark.llm.encode import Encoder, default_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=400):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, vocabulary, n))


def corpus():
    base, passage = prose(1, 120), prose(2, 40)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"), (8, "one two"),
        (9, prose(3, 30) + " " + passage), (10, passage + "\n" + prose(4, 50)), (11, prose(5, 9000)), (12, "İ é ñ ΣΑΣ it's a.b.c 12,345"),
        (13, prose(6, 60) + " " + prose(6, 60)), (None, prose(7, 40)), (14, base), (14, base), (15, "a a a a a a a a a a a a a a a a a a a a a a a"),
    ]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.createDataFrame(corpus(), SCHEMA).cache()
    yield own
    own.unpersist()


def by_id(df):
    return {(r.doc_id, k): r for k, r in enumerate(sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)))}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination_equals_brute_force(spark, docs):
    items = [(1, prose(2, 20)), (2, "one two"), (3, None), (4, "!!"), (None, prose(5, 20)), (5, prose(5, 25).upper()), (5, prose(3, 14)), (10, prose(5, 25))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, text in items:
        w = folded(text)
        if item is not None and w:
            for i in range(max(1, len(w) - 12)):
                windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    for words in (1_000_000, 30):  # one block, several
        marked, names = decontaminate.annotate_hits(docs.select("doc_id", "text"), bench, block_words=words)
        got = marked.collect()
        assert len(got) == docs.count()
        for r in got:
            w, hit, found = folded(r.text), set(), set()
            for size in {len(k) for k in windows}:
                for i in range(len(w) - size + 1):
                    if tuple(w[i : i + size]) in windows:
                        hit.update(range(i, i + size))
                        found |= windows[tuple(w[i : i + size])]
            assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    best = {(r.item_id, r.item_start): r for r in decontaminate.longest_matches(docs, bench).collect()}
    assert best[("1", 0)].n_words == 20 and best[("1", 0)].doc_id == 9 and best[("1", 0)].doc_start == 30
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({7, 8, 9, 10})


def longest_match(words, items):
    """Longest run of at least 13 words, or of a whole shorter item, by trying all."""
    best = 0
    for item in items:
        for i in range(len(words)):
            for j in range(len(item)):
                n = 0
                while i + n < len(words) and j + n < len(item) and words[i + n] == item[j + n]:
                    n += 1
                if n >= 13 or (0 < n == len(item)):
                    best = max(best, n)
    return best


def test_longest_matches_equal_brute_force(spark):
    r = np.random.default_rng(4)
    items = [(k, " ".join(f"v{x}" for x in r.integers(0, 3, int(r.integers(3, 60))))) for k in range(12)] + [(20, "z " * 40)]
    texts = [" ".join(f"v{x}" for x in r.integers(0, 3, 60)) for _ in range(6)] + [f"a b {items[k][1]} c" for k in range(5)] + ["z " * 70, "z " * 14, "z " * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words in (1_000_000, 30):
        marked, names = decontaminate.annotate_hits(docs, bench, block_words=words)
        got = {x.doc_id: x[names[4]] for x in marked.collect()}
        assert got == {i: longest_match(t.split(), [x.split() for _, x in items]) for i, t in enumerate(texts)}
    suffixes = {(x.item_id, x.item_start): x for x in decontaminate.longest_matches(docs, bench).collect()}
    for (item, start), x in suffixes.items():
        own, words = items[12 if item == "20" else int(item)][1].split(), texts[x.doc_id].split()
        assert own[start : start + x.n_words] == words[x.doc_start : x.doc_start + x.n_words]
        assert x.n_words == max(longest_match(t.split(), [own[start:]]) if x.n_words >= 13 else x.n_words for t in texts) or x.n_words >= 13
    assert suffixes[("20", 0)].n_words == 40 and ("20", 28) not in suffixes


def test_sieve_misses_no_window_and_leaves_little(spark):
    items = [(k, prose(300 + k, 3 if k % 5 == 0 else 40, 5000)) for k in range(60)]
    bench = spark.createDataFrame([*items, (None, prose(9, 30)), (60, None), (61, "!!")], "item_id long, text string")
    texts = [prose(1000 + k, 200, 5000) for k in range(400)]
    for k in range(60):
        words = items[k][1].split()
        texts[5 * k] += " " + " ".join(words[-13:])  # the last window of an item, or the whole of a short one
    rows = [*enumerate(texts), (400, None), (401, ""), (402, " ".join(items[1][1].split()[:12])), (None, items[2][1]), (7, items[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("may_hold", F.col("doc_id"))
    left = decontaminate.sieved(docs, bench)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert {5 * k for k in range(60)} | {None, 7} <= set(ids) and not {400, 401, 402} & set(ids)
    assert len(ids) <= 62 + 2
    # blocks after the sieve find what one block finds
    one, several = ({(r.doc_id, r.text): r[3:] for r in decontaminate.annotate_hits(docs, bench, block_words=n)[0].collect()} for n in (10**6, 200))
    assert one == several
    one, several = (set(map(tuple, decontaminate.longest_matches(docs, bench, block_words=n).collect())) for n in (10**6, 200))
    assert {x[:3] for x in one} == {x[:3] for x in several} and len(one) > 100


def test_full_sieve_changes_nothing(spark, docs, monkeypatch):
    """A sieve that leaves every text gives the same rows."""
    bench = spark.createDataFrame([(1, prose(2, 20)), (2, prose(5, 40)), (3, "one two")], "item_id long, text string")
    rows = lambda: sorted(map(repr, decontaminate.annotate_hits(docs, bench, block_words=10)[0].collect()))
    expected = rows()
    monkeypatch.setattr(decontaminate.Sieve, "may_hold", lambda self, words: True)
    assert rows() == expected


def test_repeated_words_and_a_shared_prompt_take_little(spark):
    """Equal words in items and documents, and a prompt of 10,000 items, are no product of places and suffixes."""
    prompt = prose(50, 14)
    items = [(0, "x " * 300)] + [(k, f"{prompt} q{k}") for k in range(1, 10_001)]
    bench = decontaminate.Benchmark([(str(k), decontaminate.split_words(t)) for k, t in items], 13)
    shard = decontaminate._Shard([decontaminate.split_words(t) for t in ("x " * 200_000, f"{prompt} {prompt} end", "x " * 12)])
    tracemalloc.start()
    found = decontaminate.Found.of(shard, bench)
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
    assert found.longest.tolist() == [300, 14, 0] and [len(x) for x in found.items] == [1, 10_000, 0]


def test_decontamination_without_items_and_with_clashing_names(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    clash = docs.withColumnRenamed("lang", "n_hit").withColumnRenamed("source", "N_WORDS")
    marked, names = decontaminate.annotate_hits(clash, none)
    assert len({c.lower() for c in marked.columns}) == len(marked.columns) and marked.where(f"{names[1]} > 0").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    out = {}
    for a, (i, s) in enumerate(sets):
        out[i] = (len(s), min(j for b, (j, _) in enumerate(sets) if find(b) == find(a)))
    return out


def test_jaccard_join_equals_brute_force(spark, docs):
    rows = [(i, t) for i, t, *_ in corpus() if i is not None]
    chain = prose(20, 200).split()
    for k in range(12):  # each links with its neighbours only
        rows.append((100 + k, " ".join(chain)))
        chain[10 + 12 * k : 14 + 12 * k] = [f"c{k}x{j}" for j in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.report(table).collect()}
    assert got == brute_components(rows)
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 15] and kept.where("doc_id IS NULL").count() == 1


def test_jaccard_join_of_an_empty_table(spark, docs):
    assert jaccard_join.report(docs.limit(0)).count() == 0


def test_jaccard_join_of_random_near_copies(spark):
    r = np.random.default_rng(8)
    rows = []
    for k in range(30):
        words = prose(200 + k, int(r.integers(6, 60))).split()
        for _ in range(int(r.integers(1, 6))):
            own = words.copy()
            for at in r.integers(0, len(own), int(r.integers(0, 3))):
                own[at] = f"x{r.integers(0, 9)}"
            rows.append((len(rows), " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.report(table).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("rounds", [0, 2])
def test_jaccard_join_of_a_large_group_in_blocks(spark, monkeypatch, rounds):
    """Copies of one text that differ so much that only some link, dealt to units by blocks of few sets."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    r, base, rows = np.random.default_rng(9), prose(300, 100).split(), []
    for k in range(60):
        own = base.copy()
        for at in r.integers(0, len(own), int(r.integers(0, 7))):
            own[at] = f"y{r.integers(0, 5)}"
        rows.append((k, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.report(table).collect()}
    assert got == brute_components(rows) and 2 < len({c for _, c in got.values()}) < 60


def test_sets_with_one_number_are_told_apart(spark, monkeypatch):
    found = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 8, 3), (5, None, None)], "doc long, set long, twin long")
    apart = {x.doc: x.set for x in jaccard_join._told_apart(found).collect()}
    assert apart[1] == apart[3] != apart[2] and apart[4] == 8 and apart[5] is None


def test_keep_first_with_equal_ids_and_clashing_names(spark):
    rows = [(1, prose(30, 30), "a"), (1, prose(31, 30), "b"), (1, prose(30, 30), "a"), (2, prose(30, 30), "c"), (3, None, "d"), (3, None, "d"), (None, prose(30, 30), "e")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _doc string").selectExpr("*", "_doc AS _key", "_doc AS _nth")
    kept = jaccard_join.keep_first(table)
    assert kept.columns == table.columns
    assert sorted(((x.doc_id or 0, x["_doc"]) for x in kept.collect())) == [(0, "e"), (1, "a"), (1, "b"), (3, "d")]


def test_substring_dedup_equals_brute_force(spark, docs):
    out, _ = substring_dedup.dedup(docs.select("doc_id", "text"))
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, r.n_removed, r.kept) for r in out.collect())
    seen, want = set(), []
    for i, text, *_ in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (text or "").split()
        cover = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                cover[s : s + 20] = [True] * 20
            seen.add(key)
        want.append(((i is not None, i or 0), len(w), sum(cover), " ".join(x for x, c in zip(w, cover, strict=True) if not c)))
    assert got == sorted(want)
    assert substring_dedup.report(docs.limit(0)).count() == 0


def test_substring_dedup_keeps_columns_of_any_name(spark):
    shared = prose(60, 30)
    rows = [(k, f"{shared} {k} own", k, "x", "y") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long, twin string, n_words string")
    out, names = substring_dedup.dedup(docs)
    assert out.columns == [*docs.columns, *names] and names[0] == "_n_words"
    got = {r.doc_id: r for r in out.collect()}
    assert all((got[k]["_row"], got[k].twin, got[k].n_words) == (k, "x", "y") for k in got)
    assert got[0].n_removed == 0 and got[1].kept == "1 own" and got[1].spans[0].length == 30


def test_encoder_equals_the_library():
    encoder = Encoder(default_vocabulary())
    odd = ["a<|endoftext|>b x . .. ...", "  two\t\ttab nbsp ls\x1cfs\x85nel", "İstanbul ΣΑΣ ﬁ é ́x", "it's don't 'S 123 4.5", "", None, "<|startoftext|><|", "ÀÉß ŒUVRE x×y ªº a_b^c`d~e{f}|g", "mail@x.com +1-555 $$$ ***!!!"]
    for _ in range(2):
        for text, raw in zip(odd, encoder.encode(odd), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def ids_of(text, end):
    return [*Encoder(default_vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_token_store_round_trip(spark, docs, tmp_path):
    store = token_store.TokenStore(spark, str(tmp_path / "store")).write(docs, 2)
    want = sorted(((i is not None, i or 0), ids_of(t, 2)) for i, t, *_ in corpus())
    assert sorted(((r.doc is not None, r.doc or 0), list(r.ids)) for r in store.documents().collect()) == want
    got = sorted(store.digests().collect(), key=lambda r: r.start)
    assert [(r.doc is not None, r.doc or 0) for r in got] == [k for k, _ in want] and all(r.complete for r in got)
    start = 0
    sums = sorted((k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in want)
    assert sorted(((r.doc is not None, r.doc or 0), r.n_tokens, r.ids_crc32) for r in got) == sums
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert store.chunks().select("hash").distinct().count() == store.chunks().count()
    assert store.manifest().groupBy().sum("n_tokens").first()[0] == start
    assert token_store.report(docs.limit(0)).count() == 0


def test_token_store_finds_a_lost_chunk(spark, docs, tmp_path):
    store = token_store.TokenStore(spark, str(tmp_path / "a")).write(docs.where("doc_id = 11"), 2)
    other = token_store.TokenStore(spark, str(tmp_path / "b"))
    for name in ("recipes", "manifest", "seal"):
        getattr(store, name)().write.parquet(f"{other.path}/{name}")
    store.chunks().orderBy("hash").offset(1).write.parquet(f"{other.path}/chunks")
    assert [r.complete for r in other.digests().collect()] == [False]


def test_token_store_finds_lost_and_changed_recipes(spark, docs, tmp_path):
    rows = docs.where("doc_id IS NOT NULL").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = token_store.TokenStore(spark, str(tmp_path / "a")).write(rows, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r.part for r in store.manifest().orderBy("part").collect()]
    assert len(parts) > 2 and store.damaged_parts().count() == 0
    changed = store.recipes().where("part <> 1").withColumn("n_tokens", F.expr("n_tokens + if(part = 2 and place = 0, 1, 0)"))
    other = token_store.TokenStore(spark, str(tmp_path / "b"))
    changed.write.parquet(f"{other.path}/recipes")
    store.chunks().write.parquet(f"{other.path}/chunks")
    store.seal().write.parquet(f"{other.path}/seal")
    store.manifest().write.parquet(f"{other.path}/manifest")
    assert sorted(r.part for r in other.damaged_parts().collect()) == [1, 2]
    with pytest.raises(ValueError, match="parts"):
        other.digests()
    third = token_store.TokenStore(spark, str(tmp_path / "c"))
    store.recipes().where("part <> 1").write.parquet(f"{third.path}/recipes")
    store.manifest().where("part <> 1").write.parquet(f"{third.path}/manifest")
    store.seal().write.parquet(f"{third.path}/seal")
    assert [r.part for r in third.damaged_parts().collect()] == [-1]


def test_token_store_of_short_texts_beside_a_long_one(spark, tmp_path):
    long = prose(40, 600_000, 30_000)
    assert len(long) > 3_000_000
    for k, texts in enumerate((["text number 0"], [None], ["hi there", long, "hi there"])):
        table = spark.createDataFrame([(float(i), x) for i, x in enumerate(texts)], "doc_id double, text string").coalesce(1)
        store = token_store.TokenStore(spark, str(tmp_path / f"s{k}")).write(table, 2)
        want = [(float(i), zlib.crc32(np.array(ids_of(x, 2), "<u4").tobytes())) for i, x in enumerate(texts)]
        assert sorted((r.doc, r.ids_crc32) for r in store.digests().collect()) == want


def test_token_store_refuses_ids_that_do_not_fit(spark, docs, tmp_path):
    with pytest.raises(Exception, match="doesn't fit"):
        token_store.TokenStore(spark, str(tmp_path / "w"), width=1).write(docs, 2)


def test_crc_of_parts_is_that_of_the_whole():
    r = np.random.default_rng(1)
    parts = [r.bytes(int(n)) for n in (0, 1, 4, 400, 65_532, 4, 70_000, 8)]
    sizes = np.array([len(x) for x in parts])
    following = sizes.sum() - np.cumsum(sizes)
    got = token_store.shifted_crc(np.array([zlib.crc32(x) for x in parts]), following)
    assert int(np.bitwise_xor.reduce(got)) == zlib.crc32(b"".join(parts))
    assert (got == token_store.crc_shift(np.array([zlib.crc32(x) for x in parts], np.uint64), following).astype(np.int64)).all()


def test_cuts_depend_on_their_own_document_only():
    r = np.random.default_rng(0)
    ids = r.integers(0, 49000, 30000).astype("<u4")
    ids[20000:26000] = 5
    ends = [1, 100, 128, 129, 5000, 30000]
    for end, own, start in zip(ends, token_store.cuts(ids, ends), [0, *ends], strict=False):
        assert own[-1] == end and max(np.diff([start, *own])) <= token_store.MOST
        assert [x - start for x in own] == token_store.cuts(ids[start:end], [end - start])[0]


def test_packing_is_whole_and_tight(spark, docs):
    out = packing.report(docs, capacity=256).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in out)
    assert total == sum(len(ids_of(t, 1)) for _, t, *_ in corpus()) and len(by) <= -(-total // 256) + 1
    long = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 11)
    assert all(length == 256 for *_, length in long[:-1]) and [s for _, s, _ in long] == [256 * k for k in range(len(long))]
    assert packing.report(docs.limit(0)).count() == 0


def test_crossover_keeps_every_item_once():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 200, 300).tolist()
    order = list(range(300))
    a, b = packing.fitted(lengths, 256, order), packing.fitted(lengths, 256, order[::-1])
    for _ in range(5):
        a = packing.crossed(a, b, r)
        assert sorted(i for x in a.bins for i in x) == order
        assert all(sum(lengths[i] for i in x) + f == 256 and f >= 0 for x, f in zip(a.bins, a.free, strict=True))


def test_migration_brings_the_elite_on():
    lengths = [128] * 6
    best = [[0, 1], [2, 3], [4, 5]]
    poor = [[i] for i in range(6)]
    assert len(packing.evolve(lengths, [poor], best, 256, 1)[0]) == 3


def test_line_dedup_by_host(spark):
    rows = [(k, "h", f"menu  one\nown line {k}\n\nfooter") for k in range(30)] + [(100, "small", "menu one\nx"), (101, None, "menu one"), (102, "h", None), (103, "h", "menu one")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in line_dedup.clean_documents(docs).collect()}
    assert got[3] == "own line 3\n" and got[100] == "menu one\nx" and got[101] == "menu one" and got[102] is None and got[103] == ""
    assert line_dedup.clean_documents(docs.limit(0)).count() == 0
    clash = docs.withColumn("n_lines", docs["doc_id"]).withColumn("N_DROPPED", docs["doc_id"])
    assert line_dedup.clean_documents(clash).columns == clash.columns
    plan = line_dedup.clean_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_keeps_a_document_of_which_a_third_are_copies(spark):
    copied = "first line of the copied\nsecond line of it"
    rows = [(k, "h", f"menu\nown line {k}") for k in range(60)] + [(100 + k, "h", copied) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in line_dedup.clean_documents(docs).collect()}
    assert got == {k: copied if k >= 100 else f"own line {k}" for k, *_ in rows}


def test_line_dedup_judges_small_hosts(spark):
    rows = [(k, "small", f"menu\nown line {k}") for k in range(5)] + [(10 + k, "two", f"shared\nown line {k}") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in line_dedup.clean_documents(docs).collect()}
    assert got == {i: f"own line {i}" if i < 10 else t for i, _, t in rows}


def test_line_dedup_divides_by_all_pages_of_the_host(spark):
    rows = [(k, "copies", "first\nsecond") for k in range(40)]
    # 36 copies of one page hold the note, and so do two others: 38 of 70 pages; the tip is on 3 distinct ones of 70
    rows += [(100 + k, "h", "note\nlong story") for k in range(36)] + [(200 + k, "h", f"{'note' if k < 2 else 'tip' if k < 5 else 'none'}\nown {k}") for k in range(34)]
    rows += [(300 + k, "two", f"shared\nown {k % 2}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in line_dedup.clean_documents(docs).collect()}
    assert all(got[k] == "first\nsecond" for k in range(40))  # one distinct page
    assert got[100] == "long story" and got[200] == "own 0" and got[202] == "tip\nown 2" and got[205] == "own 5"
    assert all(got[i] == t for i, host, t in rows if host == "two")  # two distinct pages


def test_line_dedup_by_shuffle_gives_the_same(spark, monkeypatch):
    rows = [(k, "h", f"menu\nown line {k}\nfooter") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    first = sorted(map(tuple, line_dedup.clean_documents(docs).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert sorted(map(tuple, line_dedup.clean_documents(docs).collect())) == first


def test_licences_are_found_and_inherited(spark):
    rows = [
        ("a/LICENSE", "The MIT License (MIT)"), ("a/b/x", "alpha beta gamma delta epsilon zeta eta theta\nReleased under the MIT License.\nmore lines of other words are here"), ("a/b/c/y", "nothing here"), ("z", "nothing"),
        ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/q", None), (None, "This work is licensed under the GNU General Public License, version 3."), ("a/r", "general words about some version that nobody gives away"),
    ]
    docs = spark.createDataFrame(rows, "path string, text string")
    out, _ = licenses.scan(docs, "path")
    got = {r.path: (r.licence, r.origin, r.directory) for r in out.collect()}
    assert got["a/LICENSE"] == ("MIT", "file", None) and got["a/b/x"] == ("MIT", "header", None)
    assert got["a/b/c/y"] == ("Apache-2.0", "inherited", "a/b") and got["a/q"] == ("MIT", "inherited", "a")
    assert got["z"] == (None, "none", None) and got[None][0] == "GPL-3.0-only" and got["a/r"] == ("MIT", "inherited", "a")
    assert licenses.scan(docs.limit(0), "path")[0].count() == 0


def brute_inheritance(rows, own):
    """licence, origin, directory of each (path, text), by walking up the directories."""
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else "."
    given = {}
    for (path, _), found in zip(rows, own, strict=True):
        if path is not None and found[2]:
            given.setdefault(folder(path), []).append(found[2])
    given = {d: min(set(x), key=lambda n: (-x.count(n), n)) for d, x in given.items()}
    out = []
    for (path, _), found in zip(rows, own, strict=True):
        if found[2] or found[0]:
            out.append((found[2] or found[0], "file" if found[2] else "header", None))
            continue
        at = None if path is None else folder(path)
        while at is not None and at not in given:
            at = at.rsplit("/", 1)[0] if "/" in at else None if at in (".", "") or path.startswith("/") else "."
        out.append((given[at], "inherited", at) if at is not None else (None, "none", None))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_licence_query_equals_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(licenses, "BROADCAST_DIRECTORIES", -1)
    texts = licenses.licence_texts()
    words = "plain words of a file that say nothing"
    rows = [
        ("LICENSE", texts["MIT"]), ("src/x.py", words), ("src/deep/er/y.py", words), ("top.py", words), ("/LICENSE", texts["BSD-2-Clause"]), ("/abs/x", words), ("/y", words),
        ("lib/LICENSE", texts["Apache-2.0"]), ("lib/COPYING", texts["MIT"]), ("lib/MIT", texts["MIT"]), ("lib/z", None), ("lib/z", None), ("lib/sub/LICENSE", "This code is not released under the MIT License."),
        ("lib/long", words * 50_000), ("lib/h", f"Released under the MIT License.\n{words}\n{words}"), (None, words), ("", ""), ("g/LICENSE", texts["GPL-2.0-only"]), ("g/x", words),
    ]
    docs = spark.createDataFrame([(p, t, k, "keep", k) for k, (p, t) in enumerate(rows)], "path string, text string, _dir int, licence string, file int")
    out, names = licenses.scan(docs, "path")
    assert out.columns == [*docs.columns, *names] and names[0] == "_licence"
    got = {r["_dir"]: tuple(r[n] for n in (names[0], names[2], names[3])) for r in out.collect()}
    want = brute_inheritance(rows, licenses.own_licences([t for _, t in rows], licenses.Templates(licenses.TEMPLATES), licenses.LicenceTexts(texts)))
    assert [got[k] for k in range(len(rows))] == want
    assert got[1] == got[2] == ("MIT", "inherited", ".") and got[5] == ("BSD-2-Clause", "inherited", "") and got[10] == ("MIT", "inherited", "lib") and got[12][1] == "inherited"
    assert {r["file"] for r in out.where("licence = 'keep'").collect()} == set(range(len(rows)))


def test_licence_report_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(f"{r.source or '-'}/{r.lang or '-'}/{r.doc_id}", r.text) for r in docs.orderBy("doc_id").collect()]
    rows_out = {r.path: (r.licence, r.origin, r.directory) for r in licenses.report(docs).collect()}
    want = brute_inheritance(rows, licenses.own_licences([t for _, t in rows], licenses.Templates(licenses.TEMPLATES), licenses.LicenceTexts(licenses.licence_texts())))
    assert [rows_out[p] for p, _ in rows] == want


def scanned(*texts):
    return licenses.own_licences(list(texts), licenses.Templates(licenses.TEMPLATES), licenses.LicenceTexts(licenses.licence_texts()))


def test_spdx_expressions():
    want = {
        "// SPDX-License-Identifier: MIT": "MIT", "/* spdx-license-identifier: apache-2.0 */": "Apache-2.0", "# SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later", "SPDX-License-Identifier: lgpl-2.1": "LGPL-2.1-only",
        "<!-- SPDX-License-Identifier: (MIT OR Apache-2.0) -->": "(MIT OR Apache-2.0)", "SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0\nint x;": "GPL-2.0-only WITH Classpath-exception-2.0",
        "SPDX-License-Identifier: NONE": None, "SPDX-License-Identifier:": None, "no statement": None, "SPDX-License-Identifier: LicenseRef-Own": "LicenseRef-Own",
    }
    found = scanned(*want)
    assert [r[0] for r in found] == list(want.values())
    assert [r[1] for r in found] == [1.0 if x else 0.0 for x in want.values()]
    assert found[4][4] == ["Apache-2.0", "MIT"] and found[5][4] == ["Classpath-exception-2.0", "GPL-2.0-only"]


def test_copyright_lines_and_prefaces_in_front_of_licence_texts():
    texts = licenses.licence_texts()
    holders = "".join(f"Copyright (c) {2000 + k} Holder Number {k} of Some Town and All Their Heirs\n" for k in range(14))
    preface = "".join(f"Line {k} of what this project has to say about itself, at some length, first.\n" for k in range(40))
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "MPL-2.0", "GPL-2.0-only", "GPL-3.0-only", "AGPL-3.0-only", "LGPL-2.1-only", "CC-BY-SA-4.0", "CC0-1.0"):
        assert [r[2] for r in scanned(holders + texts[name], holders + "\n" + texts[name])] == [name, name], name
    for name in ("Apache-2.0", "GPL-3.0-only", "AGPL-3.0-only", "MPL-2.0", "CC-BY-SA-4.0"):  # with a title of their own
        assert scanned(preface + "\n" + holders + "\n" + texts[name])[0][2] == name
    ((*_, file, _, stated),) = scanned(prose(90, 30_000, 2000) + "\n\nReleased under the MIT License.\n\n" + prose(91, 30_000, 2000))
    assert file is None and stated == ["MIT"]  # a long text with a notice is no licence file


def test_several_licences_of_one_file():
    ((header, _, _, _, stated),) = scanned("Released under the MIT License.\n\nLicensed under the Apache License, Version 2.0.\n")
    assert header in stated and stated == ["Apache-2.0", "MIT"]


def test_directories_inherit_behind_a_preface(spark):
    texts = licenses.licence_texts()
    holders = "".join(f"Copyright 20{k:02d} Author {k}\n" for k in range(14))
    rows = [("a/LICENSE", holders + texts["MIT"]), ("a/b/c.py", "code"), ("a/d.py", "# SPDX-License-Identifier: Apache-2.0\ncode"), ("e/f", "code")]
    got = {r.path: (r.licence, r.origin, r.stated) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string"), "path")[0].collect()}
    assert got["a/LICENSE"][:2] == ("MIT", "file") and got["a/b/c.py"] == ("MIT", "inherited", []) and got["e/f"] == (None, "none", [])
    assert got["a/d.py"] == ("Apache-2.0", "header", ["Apache-2.0"])


def test_sequence_numbers_of_large_items(spark):
    """Items are numbered by partitions: of a million of them, too."""
    items = spark.createDataFrame([((1 << 62) + k, 4096 if k % 2 else 1000) for k in range(10)], "item long, length int")
    got = packing.pack(items).collect()
    assert len({r.sequence_id for r in got}) == 7 and sorted(r.item for r in got) == [(1 << 62) + k for k in range(10)]


def test_denials_bear_no_licence():
    own, whole = licenses.Templates(licenses.TEMPLATES), licenses.LicenceTexts(licenses.licence_texts())
    texts = ["This code is not released under the MIT License.", "It isn't licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0."]
    assert [(r[0], r[2]) for r in licenses.own_licences(texts, own, whole)] == [(None, None), (None, None), ("Apache-2.0", "Apache-2.0")]


def test_whole_licence_files_are_found_and_inherited(spark):
    texts = licenses.licence_texts()
    real = [n for n in texts if n != "AGPL-3.0-only" and (not n.startswith("CC-BY") or n == "CC-BY-SA-4.0")]
    filled = {n: re.sub("<[^>\\n]*>", "2024 Some Person", texts[n]) for n in real}
    affero = texts["GPL-3.0-only"].replace("GNU GENERAL", "GNU AFFERO GENERAL", 1)
    filled |= {"AGPL-3.0-only": affero, "CC-BY-NC-ND-4.0": texts["CC-BY-SA-4.0"].replace("Attribution-ShareAlike", "Attribution-NonCommercial-NoDerivatives", 1)}
    rows = [r for n, t in filled.items() for r in ((f"{n}/LICENSE", t), (f"{n}/src/x", "plain words of a file"))]
    docs = spark.createDataFrame([*rows, ("one/LICENSE", texts["GPL-2.0-only"].replace("Version 2,", "Version 1,", 1))], "path string, text string")
    got = {r.path: (r.licence, r.origin) for r in licenses.scan(docs, "path")[0].collect()}
    for n in filled:
        assert got[f"{n}/LICENSE"] == (n, "file") and got[f"{n}/src/x"] == (n, "inherited"), n
    assert got["one/LICENSE"][1] != "file"


def test_headers_agree_in_version_and_variant():
    own, whole = licenses.Templates(licenses.TEMPLATES), licenses.LicenceTexts(licenses.licence_texts())
    filler = "\n\n" + prose(1, 100)
    lines = {
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-only", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0-only", "This work is licensed under the GNU General Public License, version 1.": None,
        "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY-SA 3.0.": None,
    }
    got = licenses.own_licences([x + filler for x in lines], own, whole)
    assert [r[0] for r in got] == list(lines.values()) and all(r[2] is None for r in got)


def test_cosine_equals_brute_force():
    import math
    from collections import Counter

    own = licenses.Templates(licenses.TEMPLATES)
    rows = [(n, Counter(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower()))) for n, ts in licenses.TEMPLATES.items() for t in ts]
    df = Counter(t for _, c in rows for t in c)
    idf = lambda t: math.log((1 + len(rows)) / (1 + df.get(t, 0))) + 1
    unit = Counter("released under an mit licence of 4.0 kind".split())
    norm = lambda c: math.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items()))
    best = max((sum(unit[t] * c[t] * idf(t) ** 2 for t in unit if t in c) / norm(unit) / norm(c), n) for n, c in rows)
    name, cosine = own.best(unit)
    assert name == best[1] and abs(cosine - best[0]) < 1e-9


def test_quality_learns_and_keeps_to_its_rows(spark):
    r = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(400):
        good = k % 3 > 0
        words = prose(k, int(r.integers(5, 80))).split()
        rows.append((k, " ".join(words if good else [w.upper() + "!!" for w in words]), None, None, None))
        labels.append((k, int(good)))
    rows += [(1000, None, "en", "s", 5), (1001, "", None, None, None), (None, "w1 w2", None, None, None)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (1000, None), (None, 1), (5, 1)], "doc_id long, quality int")
    out = {x.doc_id: x for x in quality.report(docs, marks).collect()}
    assert len(out) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in out.values())
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert {k for k, x in out.items() if k is not None and k < 400 and x.held_out} == set(held)
    assert np.mean([out[k].predicted == int(k % 3 > 0) for k in held]) > 0.95
    flipped = marks.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    again = {x.doc_id: x.score for x in quality.report(docs, flipped).collect()}
    assert all(abs(again[k] - x.score) < 1e-12 for k, x in out.items())
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns and quality.report(docs.limit(0), marks.limit(0)).count() == 0


def test_pairs_in_linear_time_equal_the_sum_over_pairs():
    r = np.random.default_rng(1)
    machine = quality.Machine(0.3, r.normal(size=20), r.normal(size=(20, 4)))
    numbers, values = np.array([1, 4, 7, 2, 3]), r.normal(size=5)
    got = machine.logits(np.array([0, 3]), numbers, values)
    for (a, z), x in zip(((0, 3), (3, 5)), got, strict=True):
        n, v = numbers[a:z], values[a:z]
        want = 0.3 + (machine.weights[n] * v).sum()
        want += sum(machine.factors[n[i]] @ machine.factors[n[j]] * v[i] * v[j] for i in range(len(n)) for j in range(i))
        assert abs(want - x) < 1e-9


def test_language_codes(spark):
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    r = np.random.default_rng(2)
    rows = []
    for k in range(300):
        lang = ["aa", "bb", "cc"][k % 3]
        rows.append((k, " ".join("".join(r.choice(list(letters[lang]), 5)) for _ in range(int(r.integers(2, 40)))), lang if k % 10 else None, "s", 1))
    rows += [(900, None, "aa", "s", 0), (901, "123 !!", "aa", "s", 0), (None, "abc", "aa", "s", 0), (902, "", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {x.doc_id: x for x in language_id.report(docs).collect()}
    assert out[900].lang_pred == out[901].lang_pred == out[902].lang_pred == "und" and out[900].score == 0 and out[901].ambiguous
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(out[k].held_out for k in held) and np.mean([out[k].lang_pred == ["aa", "bb", "cc"][k % 3] for k in held]) > 0.95
    assert {x.lang_pred for x in language_id.report(docs.withColumn("lang", docs["lang"].substr(5, 1)).where("doc_id < 0")).collect()} == set()
    assert {x.lang_pred for x in language_id.report(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()} == {"und"}


def test_codewords_are_far_apart():
    for n in (2, 4, 9):
        code = language_id.codewords(n)
        assert len({tuple(x) for x in code}) == n
    assert min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]) >= 5
