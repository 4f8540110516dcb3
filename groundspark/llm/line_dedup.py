"""Line dedup by site-relative frequency, in DataFrame operations only.

A line that more than a share of a host's pages hold is boilerplate there and is dropped from all of that host's pages.
Every page counts, copies too; but a line must also stand on some distinct pages, so that a document that was copied
often is no boilerplate. Pages of a host with the same lines travel as one with their number, and lines are counted as
hashes with partial sums before the shuffle. A host's boilerplate is small by construction: its lines per page divided
by the ratio bound the number of lines above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import Scratch, fresh_names

#: Share of the host's pages above which a line is dropped, and distinct pages that must hold it at least.
RATIO, LEAST_HOLDERS = 0.1, 3
#: Boilerplate lines (8 bytes each) that may be broadcast with their hosts; beyond, pages are joined by a shuffle.
BROADCAST_LINES = 200_000
#: Salts over which a host's pages are dealt in that shuffle.
SALTS = 32

#: What is no text, what ends a line in HTML, and tags. Each begins with "<", so that other characters cost little.
NOT_TEXT = r"(?is)<(?:script[^>]*>.*?</script>|style[^>]*>.*?</style>|!--.*?-->)"
LINE_END = r"(?i)<(?:/(?:p|div|li|h[1-6]|title|footer|nav|tr|article|section)|br[^>]*)>"
TAG = r"<[^>]*>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def html_text(html: Column) -> Column:
    """Text of a page: one line for each block element, tags and scripts out, common entities replaced."""
    text = F.regexp_replace(F.regexp_replace(html, NOT_TEXT, ""), LINE_END, "\n")
    text = F.regexp_replace(text, TAG, "")
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)", 1))
    return F.when(found != "", found)


def trimmed_lines(text: Column) -> Column:
    """The text's lines, trimmed and with runs of blanks as one; done on the whole text, not line by line."""
    text = F.regexp_replace(text, r"[ \t\r]+", " ")
    text = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return F.split(F.trim(text), "\n")


def line_hashes(lines: Column) -> Column:
    """Hash of each line; null for a blank one."""
    return F.transform(lines, lambda x: F.when(x != "", F.xxhash64(x)))


def boilerplate(pages: DataFrame, ratio: float, scratch: Scratch) -> DataFrame:
    """host, drop (hashes of the host's lines above the ratio), from pages with columns host and hashes. The ratio is
    over all pages; a line on fewer than LEAST_HOLDERS distinct ones isn't above it."""
    pages = pages.where(F.col("host").isNotNull()).select("host", F.array_compact("hashes").alias("hashes"))
    pages = pages.groupBy("host", F.xxhash64("hashes").alias("page")).agg(F.first(F.array_distinct("hashes")).alias("hashes"), F.count("*").alias("copies"))
    pages = scratch.write(pages, "distinct-pages")
    totals = pages.groupBy(F.col("host").alias("h")).agg(F.sum("copies").alias("total"))
    held = pages.select("host", "copies", F.explode("hashes").alias("line")).groupBy("host", "line")
    counts = held.agg(F.sum("copies").alias("n"), F.count("*").alias("holders")).where(F.col("holders") >= LEAST_HOLDERS)
    above = counts.join(totals, F.col("host") == F.col("h")).where(F.col("n") > ratio * F.col("total"))
    return above.groupBy("host").agg(F.collect_set("line").alias("drop"))


def _without_boilerplate(pages: DataFrame, ratio: float, scratch: Scratch) -> DataFrame:
    """pages with columns host, lines and hashes (one for each line): appends kept, the lines that stay."""
    found = scratch.write(boilerplate(pages.select("host", "hashes"), ratio, scratch), "boilerplate")
    scratch.drop("distinct-pages")
    total = found.agg(F.coalesce(F.sum(F.size("drop")), F.lit(0)).alias("n")).first()["n"]
    if total <= BROADCAST_LINES:
        joined = pages.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("hashes"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")
    gone = lambda i: F.coalesce(F.array_contains("drop", F.get("hashes", i)), F.lit(False))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~gone(i)))
    return joined.withColumn("kept", kept).drop("drop")


def drop_lines(docs: DataFrame, host: Column, text_col: str, ratio: float = RATIO) -> tuple[DataFrame, list[str]]:
    """Replace text_col by the text without boilerplate lines; returns the table and the names of two more columns.

    The added columns are the counts of non-blank lines and of dropped ones. Lines are compared trimmed, with runs of
    blanks as one; blank lines are never counted or dropped, and kept lines stay as they are. Rows without host or with
    null text keep everything; a line on fewer than LEAST_HOLDERS distinct pages stays, so hosts of fewer distinct pages
    keep all. Repeated rows count each; a document whose lines all go keeps an empty text. Other columns may have any name.
    """
    n_lines, n_dropped = fresh_names(docs, ["n_lines", "n_dropped"])
    scratch = Scratch(docs.sparkSession, "lines")
    # the table's own columns travel in one, so that none can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias("_"))
    hashes = line_hashes(trimmed_lines(F.col(text_col)))
    pages = docs.select(host.alias("host"), F.split(text_col, "\n").alias("lines"), hashes.alias("hashes"), row.alias("row"))
    out = _without_boilerplate(pages, ratio, scratch)
    there = F.col("lines").isNotNull()
    total = F.when(there, F.size(F.array_compact("hashes"))).otherwise(0).cast("long")
    dropped = F.when(there, F.size("lines") - F.size("kept")).otherwise(0).cast("long")
    own = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*own, total.alias(n_lines), dropped.alias(n_dropped)), [n_lines, n_dropped]


def clean_documents(docs: DataFrame, host_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """Documents with their columns, text without the boilerplate lines of their host."""
    out, _ = drop_lines(docs, F.col(host_col), text_col, **options)
    return out.select(*docs.columns)


def report(pages: DataFrame) -> DataFrame:
    """page_id, host, n_lines, n_dropped and text of every page, blank lines out; null html has no lines and no text."""
    scratch = Scratch(pages.sparkSession, "page-lines")
    lines = F.array_remove(trimmed_lines(html_text(F.col("html"))), "")
    # the HTML is read and each line hashed once: both the counts and the result start from what is written here
    texts = pages.select("page_id", host_of(F.col("url")).alias("host"), lines.alias("lines")).withColumn("hashes", line_hashes(F.col("lines")))
    out = _without_boilerplate(scratch.write(texts, "lines"), RATIO, scratch)
    there = F.col("lines").isNotNull()
    total = F.when(there, F.size("lines")).otherwise(0).cast("long").alias("n_lines")
    dropped = F.when(there, F.size("lines") - F.size("kept")).otherwise(0).cast("long").alias("n_dropped")
    return out.select("page_id", "host", total, dropped, F.array_join("kept", "\n").alias("text"))


REPORT_SQL = r"""
WITH raw AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
           '(?i)</(p|div|li|h[1-6]|title|footer|nav|tr|article|section)>|<br[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t
  FROM pages),
texts AS (
  SELECT page_id, host, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM raw),
split AS (
  SELECT page_id, host, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM texts),
lines AS (
  SELECT page_id, host, pos, trim(regexp_replace(line, '[ \t\r]+', ' ', 'g'), ' ') AS line FROM split WHERE trim(regexp_replace(line, '[ \t\r]+', ' ', 'g'), ' ') <> ''),
whole AS (
  SELECT r.page_id, r.host, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos), '') AS t
  FROM raw r LEFT JOIN lines l USING (page_id) WHERE r.host IS NOT NULL GROUP BY r.page_id, r.host),
totals AS (SELECT host, count(*) AS total FROM whole GROUP BY host),
held AS (SELECT l.host, l.line, count(DISTINCT l.page_id) AS n, count(DISTINCT w.t) AS holders FROM lines l JOIN whole w ON l.host = w.host AND l.page_id = w.page_id GROUP BY l.host, l.line),
bad AS (SELECT h.host, h.line FROM held h JOIN totals t ON h.host = t.host WHERE h.n > 0.1 * t.total AND h.holders >= 3),
marked AS (SELECT l.*, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.host = b.host AND l.line = b.line),
told AS (
  SELECT page_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY page_id)
SELECT r.page_id, r.host, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN r.t IS NOT NULL THEN coalesce(text, '') END AS text
FROM raw r LEFT JOIN told USING (page_id)
"""
