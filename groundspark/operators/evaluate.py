"""Evaluation: graded question sets, recall sweeps, leaks, presentation flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.operators.confidence import THRESHOLD
from groundspark.operators.guards import CODE, SENTENCE_END

# Openers that flag an answer as editorial.
FLAGGED_OPENERS = ["based on the provided context", "based on the context", "according to the provided", "the provided context", "based on the information provided"]
LONG_ANSWER, LONG_SENTENCE = 2600, 25
#: Slices of the chunks of one title.
TITLE_SLICES = 16
# Patterns of marks, of an end in mid-sentence, of double spaces and of stray signs.
MARK = r"\[([0-9]{1,9})\]"
OPEN_END = r"(?s)[^.!?\"'`)\]:]$"
DOUBLE_SPACE = r"\S[ \t]{2,}\S"
ARTIFACT = r"(?<!\S)\[\s*\]|(?<!\S)\(\s*\)|[ \t][.,;]|\.\.(?!\.)"


def grade(cases: DataFrame, answers: DataFrame, grounded: DataFrame | None = None) -> DataFrame:
    """K1: cases (id, category, expect_any, expect_escalate) with the verdict on their answers (id, answer, escalated): OK-ESCALATED, WRONG,
    ABSTAINED, REVIEW, GROUNDING?, PASS, or ERROR where there is no answer. grounded (id, grounded) is optional."""
    out = cases.join(answers.select("id", "answer", "escalated"), "id", "left")
    if grounded is None:
        out = out.withColumn("grounded", F.lit(None).cast("boolean"))
    else:
        out = out.join(grounded.select("id", "grounded"), "id", "left")
    low = F.lower(F.coalesce("answer", F.lit("")))
    hit = (F.size("expect_any") == 0) | F.exists("expect_any", lambda e: F.contains(low, F.lower(e)))
    verdict = (
        F.when(F.col("escalated").isNull(), "ERROR").when(F.col("expect_escalate") & F.col("escalated"), "OK-ESCALATED")
        .when(F.col("expect_escalate"), "WRONG").when(F.col("escalated"), "ABSTAINED").when(~hit, "REVIEW")
        .when(F.col("grounded") == F.lit(False), "GROUNDING?").otherwise("PASS")
    )
    return out.select("id", "category", "escalated", "grounded", verdict.alias("verdict"))


def grounded_check(cases: DataFrame, cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """K2: id, grounded: whether any expected fact is in the chunks of a cited title (cited: id, title).

    Each different fact meets the chunks of a title once, however many cases ask for it; texts are dealt by title and
    slice, so a title that many pages share is several tasks, and only the outcome leaves them."""
    facts = cases.where("category = 'in_scope'").select("id", F.explode("expect_any").alias("fact"))
    asked = facts.join(cited.select("id", "title"), "id").select("id", "title", F.lower("fact").alias("fact"))
    pairs = asked.select("title", "fact").distinct().select("title", "fact", F.explode(F.array(*map(F.lit, range(TITLE_SLICES)))).alias("slice"))
    texts = chunks.select("title", "text", F.pmod(F.xxhash64("text"), F.lit(TITLE_SLICES)).cast("int").alias("slice"))
    judged = pairs.join(texts, ["title", "slice"]).groupBy("title", "slice", "fact").agg(F.bool_or(F.contains(F.lower("text"), F.col("fact"))).alias("found"))
    judged = judged.groupBy(F.col("title").alias("_title"), F.col("fact").alias("_fact")).agg(F.bool_or("found").alias("found"))
    return asked.join(judged, (F.col("title") == F.col("_title")) & F.col("fact").eqNullSafe(F.col("_fact"))).groupBy("id").agg(F.bool_or("found").alias("grounded"))


def summary(graded: DataFrame) -> DataFrame:
    """K3: category, verdict, cases with totals (null), and whether nothing is WRONG."""
    counts = graded.rollup("category", "verdict").agg(F.count("*").alias("cases"), (F.count_if(F.col("verdict") == "WRONG") == 0).alias("sound"))
    return counts.select("category", "verdict", "cases", "sound")


def recall_sweep(titles: DataFrame, hits: DataFrame, scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """K4: question_id, title, confidence, found: titles asked as questions find their own page with enough confidence."""
    own = hits.join(titles.select("question_id", F.col("title").alias("_asked")), "question_id").where(F.col("title") == F.col("_asked")).select("question_id").distinct().withColumn("own", F.lit(True))
    out = titles.join(scored.select("question_id", "confidence"), "question_id").join(own, "question_id", "left")
    return out.select("question_id", "title", "confidence", (F.coalesce("own", F.lit(False)) & (F.col("confidence") >= threshold)).alias("found"))


def richest_titles(chunks: DataFrame, n: int, skip: list[str] | None = None) -> DataFrame:
    """K5: the n titles with the most text, but for those to skip."""
    rows = chunks.where(~F.col("title").isin(skip)) if skip else chunks
    return rows.groupBy("title").agg(F.sum(F.length("text")).alias("chars")).orderBy(F.desc("chars"), "title").limit(n)


def scoping_leaks(probes: DataFrame, gated: DataFrame) -> DataFrame:
    """K6: kind, probes, leaks: probes (question_id, kind) that had to escalate and didn't."""
    joined = probes.join(gated.select("question_id", "escalate"), "question_id", "left")
    return joined.groupBy("kind").agg(F.count("*").alias("probes"), F.count_if(~F.coalesce("escalate", F.lit(True))).alias("leaks"))


def _marks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(MARK), 1), lambda m: m.cast("int"))


def _gaps(text: Column) -> Column:
    """Whether the distinct marks aren't 1, 2, 3 and so on."""
    used = F.array_distinct(_marks(text))
    return F.coalesce(F.array_max(used) != F.size(used), F.lit(False)) | F.array_contains(used, 0)


def _in_prose(text: Column, pattern: str) -> Column:
    return F.exists(F.split(F.regexp_replace(text, CODE, "\uE002"), "\uE002"), lambda part: part.rlike(pattern))


def _repeats(text: Column) -> Column:
    long = F.filter(F.transform(F.split(text, SENTENCE_END), F.trim), lambda s: F.length(s) > LONG_SENTENCE)
    return F.size(long) != F.size(F.array_distinct(long))


#: K7: each flag with its test on the answer and the number of its citations, in the order of reports.
FLAGS = {
    "MARKER>SOURCES": lambda text, n: F.coalesce(F.array_max(_marks(text)), F.lit(0)) > n,
    "MARKERS_NONCONTIGUOUS": lambda text, n: _gaps(text),
    "TRUNCATED_MIDSENTENCE": lambda text, n: F.regexp_replace(text, r"(?U)\s+$", "").rlike(OPEN_END),
    "EDITORIAL_OPENER": lambda text, n: F.lower(F.ltrim(text)).rlike(f"^(?:{'|'.join(FLAGGED_OPENERS)})"),
    "DOUBLE_SPACE": lambda text, n: _in_prose(text, DOUBLE_SPACE),
    "PUNCT_ARTIFACT": lambda text, n: _in_prose(text, ARTIFACT),
    "REPEATED_SENTENCE": lambda text, n: _repeats(text),
    "VERY_LONG": lambda text, n: F.length(text) > LONG_ANSWER,
}


def quality_flags(answer: Column, n_citations: Column) -> Column:
    """K7: array of flags on an answer's presentation."""
    text = F.coalesce(answer, F.lit(""))
    return F.array_compact(F.array(*[F.when(test(text, n_citations), flag) for flag, test in FLAGS.items()]))


def flag_summary(flagged: DataFrame, column: str = "flags") -> DataFrame:
    """K8: flag, answers."""
    return flagged.select(F.explode(column).alias("flag")).groupBy("flag").agg(F.count("*").alias("answers"))
