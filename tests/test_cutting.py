"""Words cut from the bytes of a batch against the JVM's expressions."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundspark.functions import cutting
from groundspark.functions import text as tx
from groundspark.functions.vectors import hash_embedding
from groundspark.operators import chunking

#: A text with every character of the basic plane between letters, in pieces, and odd ones.
TEXTS = ["".join(f"a{chr(c)}b" for c in range(at, at + 512) if not 0xD800 <= c < 0xE000) for at in range(0, 0x10000, 512)]
TEXTS += ["", None, " ", "x", "end ", " begin", "touch", "ing", "　", "é", "a b  c", "\x85", "𝒳 y\U0001f600z", "one  two\n\nthree\tfour five"] + ["w " * n for n in range(1, 40)]


@pytest.mark.parametrize(("cut", "column"), [
    (cutting.between_blanks, lambda: tx.words(F.lower("text"))),
    (cutting.letters_and_digits, lambda: F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), 0)),
])
def test_words_are_those_of_the_jvm(spark, cut, column):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string").select("n", F.lower("text").alias("low"), column().alias("w")).orderBy("n").collect()
    low = pa.array(["skipped", *(r.low for r in rows)], pa.string()).slice(1)
    words, sizes = cut(low)
    assert words.to_pylist() == [w for r in rows for w in r.w] and sizes.tolist() == [len(r.w) for r in rows]
    for kind in (pa.large_string(), pa.string()):
        none, sizes = cut(pa.array([], kind))
        assert len(none) == len(sizes) == 0
    assert cut(low.cast(pa.large_string()))[0].equals(words)


@pytest.mark.parametrize(("target", "overlap"), [(5, 2), (1, 0), (200, 40)])
def test_windows_join_the_words_of_the_jvm(spark, target, overlap):
    got = spark.createDataFrame([(t,) for t in TEXTS], "text string").select(tx.words(F.col("text")).alias("w"), chunking.token_windows(F.col("text"), target, overlap).alias("p")).collect()
    step = target - overlap
    for r in got:
        n = len(r.w)
        starts = range(0, 1 + max(0, -(-(n - target) // step)) * step, step) if n else []
        assert r.p == [" ".join(r.w[i : i + target]) for i in starts]


def test_only_texts_go_to_python(spark):
    """Neither words of chunks nor of texts to embed are cut in the JVM and sent as lists."""
    docs = spark.createDataFrame([("d", "t", "u", "s", "a b", "text")], "doc_id string, title string, url string, space string, body string, content_type string")
    chunks = chunking.chunk_documents(docs, 200, 40)
    plan = chunks.where("chunk_id LIKE 'd%'").select(hash_embedding(F.col("text")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan.split("content_type")[0] and "ArrowEvalPython" in plan


def test_single_spaced_is_all_words(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "text string").select(F.array_join(tx.words(F.col("text")), " ").alias("a"), cutting.single_spaced(F.col("text")).alias("b")).collect()
    assert all(r.a == r.b for r in got)
