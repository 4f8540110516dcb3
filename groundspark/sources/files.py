"""Documents from files and landed wiki exports; question sets; reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.sources.scratch import written

# File types that are read, folders that never are.
MARKDOWN, PLAIN, HTML, PDF = ["md", "markdown", "rst"], ["txt", "text", "log"], ["html", "htm"], ["pdf"]
SKIP_DIRS = [".git", ".hg", ".svn", ".bzr", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".idea", ".vscode", "dist", "build"]
MAX_BYTES = 10 << 20
#: Share of replacement and control characters above which bytes aren't text.
GARBAGE = 0.05
#: Characters by which CP1252 differs from ISO-8859-1, what they are there, and characters that are counted as garbage.
C1 = "".join(map(chr, range(0x80, 0xA0)))
C1_CP1252 = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
BAD = "\ufffd" + "".join(chr(c) for c in range(32) if chr(c) not in "\t\n\r")
WIKI = (
    "results ARRAY<STRUCT<id: STRING, title: STRING, body: STRUCT<storage: STRUCT<value: STRING>>, space: STRUCT<key: STRING>, "
    "metadata: STRUCT<labels: STRUCT<results: ARRAY<STRUCT<name: STRING>>>>, version: STRUCT<`when`: STRING>, "
    "ancestors: ARRAY<STRUCT<id: STRING>>, _links: STRUCT<webui: STRING, base: STRING>>>"
)
GOLDEN = "cases ARRAY<STRUCT<id: STRING, category: STRING, question: STRING, expect_any: ARRAY<STRING>, expect_escalate: BOOLEAN>>"
QUESTION_CHARS, ANSWER_CHARS = 2000, 20000


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def content_type(path: Column) -> Column:
    """A3: html, markdown or text by file name."""
    ext = extension(path)
    return F.when(ext.isin(HTML), "html").when(ext.isin(MARKDOWN), "markdown").otherwise("text")


def _cp1252(content: Column) -> Column:
    """Text of bytes in CP1252, null if more than GARBAGE of it is replacement and control characters."""
    text = F.translate(F.decode(content, "ISO-8859-1"), C1, C1_CP1252)
    good = F.length(F.translate(text, BAD, ""))
    return F.when((F.length(text) - good) / F.length(text) <= GARBAGE, text)


def decode_bytes(content: Column) -> Column:
    """A2: text of a file's bytes, null if they are none: UTF-16 by its mark, UTF-8, else CP1252 with few bad characters."""
    mark = F.hex(F.substring(content, 1, 2))
    wide = F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16"))
    bare = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 1 << 30)).otherwise(content)
    utf8 = F.try_validate_utf8(bare.cast("string"))
    return F.when(F.length(content) == 0, "").otherwise(F.replace(F.coalesce(wide, utf8, _cp1252(content)), F.lit("\0"), F.lit("")))


def _listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder. By default Spark lists every folder in a task of its own, up to 10,000 at a level; here as many
    folders share a task as leave two for each core."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    finally:
        spark.conf.set(key, before)


def scan_files(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A1: every file below a folder but for hidden and junk folders: doc_id (relative path), title, url, space, content_type,
    body, status (ok, unsupported, too large, undecodable, no text, empty).

    Files that are too large aren't opened: Spark is asked for their names alone. Those of no supported type aren't decoded.
    """
    raw = _listed_files(spark, folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/")
    relative = F.substring(path, len(root) + 1, 1 << 30)
    parts = F.split(relative, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    visible = ~F.exists(folders, lambda d: F.startswith(d, F.lit(".")) | d.isin(SKIP_DIRS))
    known = extension(F.col("path")).isin(MARKDOWN + PLAIN + HTML + PDF)
    is_pdf = extension(F.col("path")).isin(PDF)
    columns = [relative.alias("doc_id"), F.regexp_extract(relative, r"([^/]+?)(\.[^./]*)?$", 1).alias("title"), F.concat(F.lit("file://"), path).alias("url"), F.lit("files").alias("space"), content_type(F.col("path")).alias("content_type")]
    body = F.when(known & ~is_pdf, decode_bytes(F.col("content")))
    small, cores = raw.where(visible & (F.col("length") <= max_bytes)), spark.sparkContext.defaultParallelism
    # Spark counts 4 MB for opening a file, so few small ones fill a task; eight such tasks' files go to one.
    small = small.coalesce(max(4 * cores, small.rdd.getNumPartitions() // 8))
    read = small.select(*columns, body.alias("body"), known.alias("_k"), is_pdf.alias("_p"))
    # Each body is decoded for one expression: null if undecodable, else whether it is empty.
    judged = F.coalesce(F.elt((F.trim("body") == "").cast("int") + 1, F.lit("ok"), F.lit("empty")), F.lit("undecodable"))
    read = read.withColumn("status", F.when(~F.col("_k"), "unsupported").when(F.col("_p"), "no text").otherwise(judged)).drop("_k", "_p")
    large = raw.where(visible & (F.col("length") > max_bytes)).coalesce(2 * cores)
    return read.unionByName(large.select(*columns, F.lit(None).cast("string").alias("body"), F.when(known, "too large").otherwise("unsupported").alias("status")))


def skip_report(scanned: DataFrame) -> DataFrame:
    """A4: files that were skipped, by reason."""
    return scanned.where("status <> 'ok'").groupBy(F.col("status").alias("reason")).agg(F.count("*").alias("files"))


def scan_wiki_export(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """A5: pages of landed JSON listings: doc_id (host:page), title, url, body, space, labels, updated, content_type, parent; a page
    without body has a null one: it isn't ingested but counts as seen."""
    pages = spark.read.schema(WIKI).option("multiLine", "true").json(path).select(F.explode("results").alias("p")).where("trim(p.id) <> ''")
    host = F.lower(F.regexp_extract(F.lit(base_url), r"^[a-z]+://(?:[^@/]*@)?([^/:]+)", 1))
    page = F.trim("p.id")
    base = F.rtrim(F.coalesce("p._links.base", F.lit(base_url)))
    web = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace("p._links.webui", "^/+", ""))
    url = F.when(F.coalesce("p._links.webui", F.lit("")) != "", web).otherwise(F.concat(F.lit(base_url), F.lit("/pages/viewpage.action?pageId="), page))
    labels = F.filter(F.transform(F.coalesce("p.metadata.labels.results", F.array().cast("array<struct<name:string>>")), lambda x: x["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    body = F.when(F.coalesce("p.body.storage.value", F.lit("")) != "", F.col("p.body.storage.value"))
    return pages.select(F.concat(host, F.lit(":"), page).alias("doc_id"), F.when(F.coalesce("p.title", F.lit("")) == "", page).otherwise(F.col("p.title")).alias("title"), url.alias("url"), body.alias("body"), F.coalesce("p.space.key", F.lit("")).alias("space"), labels.alias("labels"), F.coalesce("p.version.when", F.lit("")).alias("updated"), F.lit("html").alias("content_type"), F.concat(host, F.lit(":"), F.try_element_at("p.ancestors", F.lit(-1))["id"]).alias("parent"))


def subtree(pages: DataFrame, root: str) -> DataFrame:
    """doc_id, depth of a root page (by id or exact title) and all pages below it, however deep. pages: doc_id, title,
    parent. A page that is its own ancestor, by whatever loop, is listed once, at its least depth.

    Level by level: the children of the last level that haven't been seen, each level written to the shared folder.
    """
    links = pages.select("doc_id", "parent").where("doc_id <> parent")
    level = written(pages.where((F.col("doc_id") == root) | (F.col("title") == root)).select("doc_id").distinct().withColumn("depth", F.lit(0)), "subtree-0")
    seen, depth = level, 0
    while not level.isEmpty():
        depth += 1
        above = level.select(F.col("doc_id").alias("parent"))
        below = links.join(above, "parent", "left_semi").select("doc_id").distinct().join(seen, "doc_id", "left_anti")
        level = written(below.withColumn("depth", F.lit(depth)), f"subtree-{depth}")
        seen = seen.union(level)
    return seen


def cap_docs(docs: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """The first n documents, and whether that is all of them (else nothing may be pruned)."""
    return docs.orderBy("doc_id").limit(n), docs.limit(n + 1).count() <= n


def union_sources(sources: dict[str, DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """Documents of all sources that can be read, with their source's name, and a report (source, docs, error)."""
    spark = SparkSession.getActiveSession()
    out, report = None, []
    for name, docs in sources.items():
        try:
            n = docs.count()
        except Exception as e:  # noqa: BLE001 - a failing source is reported, the others go on
            report.append((name, 0, type(e).__name__))
            continue
        report.append((name, n, None))
        docs = docs.withColumn("source", F.lit(name))
        out = docs if out is None else out.unionByName(docs, allowMissingColumns=True)
    return out, spark.createDataFrame(report, "source string, docs long, error string")


def scan_golden(spark: SparkSession, path: str) -> DataFrame:
    """A10: id, category, question, expect_any, expect_escalate of a question set; missing lists are empty, flags false."""
    cases = spark.read.schema(GOLDEN).option("multiLine", "true").json(path).select(F.explode("cases").alias("c")).select("c.*")
    return cases.withColumn("expect_any", F.coalesce("expect_any", F.array().cast("array<string>"))).withColumn("expect_escalate", F.coalesce("expect_escalate", F.lit(False)))


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Rows and totals as JSON lines in two folders."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def validate_questions(df: DataFrame) -> DataFrame:
    """Rows (question, verdict, answer) with the reason for which they are rejected, or null."""
    question = F.coalesce("question", F.lit(""))
    reason = (
        F.when(F.trim(question) == "", "blank question").when(F.length(question) > QUESTION_CHARS, "question too long")
        .when(F.col("verdict").isNotNull() & ~F.col("verdict").isin("up", "down"), "unknown verdict")
        .when(F.length("answer") > ANSWER_CHARS, "answer too long")
    )
    return df.withColumn("rejected", reason)


def newest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
