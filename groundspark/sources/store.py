"""The chunk table as a sink and source: Parquet in buckets of documents, of which a marker names the current files."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.sources.scratch import deleted, listed, put_if_absent

#: Buckets of a new store: the parts that a commit rewrites or leaves alone.
BUCKETS = 256
#: Markers whose snapshots clean() leaves, and seconds that a folder must be old to go: none that a writer still fills.
KEPT_MARKERS, LEAST_AGE = 2, 24 * 3600


class Conflict(Exception):
    """Another commit has changed some of the same buckets since the rows were read; read again and repeat."""


class ChunkStore:
    """chunks and hashes under a path on any file system that Spark reads, both partitioned by doc_bucket.

    A commit writes the buckets that it touches into a folder of its own, and then the next marker, which names the folder
    of every bucket. A marker's file is only ever created, never replaced: of two writers with the same number one fails,
    takes the other's marker as its base and tries the next number, or raises Conflict where both changed a bucket.
    Readers take the newest marker, so a job that fails in between changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self._new = spark, path.rstrip("/"), buckets

    def _marker(self) -> dict | None:
        """The newest marker: seq, snapshot, buckets, done (stream -> its last batch), folders (name -> modulus of its
        buckets, and the store's buckets that it holds)."""
        names = sorted(n for n, _ in listed(self.spark, f"{self.path}/markers") if n.endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.path}/markers/{names[-1]}", wholetext=True).first()[0]) if names else None

    @property
    def buckets(self) -> int:
        found = self._marker()
        return found["buckets"] if found else self._new

    def seq(self) -> int:
        """Number of the newest commit, -1 before the first: what commit() takes as the base of rows read from now on."""
        found = self._marker()
        return found["seq"] if found else -1

    def current(self) -> str | None:
        """Name of the current snapshot."""
        found = self._marker()
        return found["snapshot"] if found else None

    def bucket(self, doc_id: Column, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(buckets or self.buckets)).cast("int")

    def buckets_of(self, docs: DataFrame) -> list[int]:
        """The buckets of some documents (doc_id)."""
        return sorted(r[0] for r in docs.select(self.bucket(F.col("doc_id")).alias("b")).distinct().collect())

    def commit(self, chunks: DataFrame, hashes: DataFrame | Callable[[DataFrame], DataFrame], batch: str = "", buckets: list[int] | None = None, base: int | None = None) -> str:
        """Write both tables and make them current; a batch that is committed already is not written again. hashes may be a
        function of the chunks that have been written.

        buckets: those that the tables hold all documents of; all others stay as they are. Without it the tables are the
        whole store. base: seq() from before the replaced rows were read (the newest commit if they weren't read); if
        another commit has changed one of the buckets since, Conflict is raised. A batch named `stream:number` is
        committed if that stream has this number or a later one. Rows of a bucket may be written by several tasks.
        """
        last = self._marker()
        stream, number = _named(batch)
        if batch and last and last["done"].get(stream, -1) >= number:
            return last["snapshot"]
        start, modulus = (last["seq"] if last else -1) if base is None else base, last["buckets"] if last else self._new
        name = f"snapshot-{uuid.uuid4().hex[:12]}"
        for table, rows in (("chunks", chunks), ("hashes", hashes)):
            rows = rows(self.spark.read.schema(chunks.schema).parquet(f"{self.path}/{name}/chunks")) if callable(rows) else rows
            rows = rows.withColumn("doc_bucket", self.bucket(F.col("doc_id"), modulus))
            rows = rows if buckets is None else rows.where(F.col("doc_bucket").isin(buckets))
            # adaptive execution cuts a large bucket into several tasks
            rows.hint("rebalance", "doc_bucket").write.partitionBy("doc_bucket").parquet(f"{self.path}/{name}/{table}")
            self.spark.createDataFrame([], rows.drop("doc_bucket").schema).write.parquet(f"{self.path}/{name}/schema/{table}")
        while True:
            last = self._marker()
            if batch and last and last["done"].get(stream, -1) >= number:
                return last["snapshot"]
            held = last["buckets"] if last else modulus
            chosen = set(range(held)) if buckets is None else _refined(buckets, modulus, held)
            changed = {b for s, own in (last["changes"] if last else {}).items() if int(s) > start for b in own}
            if changed & chosen:
                raise Conflict(f"commits after {start} changed buckets {sorted(changed & chosen)[:5]}")
            if self._put(last, name, modulus, chosen, {stream: number} if batch else {}):
                return name

    def _put(self, last: dict | None, name: str, modulus: int, chosen: set[int], done: dict, buckets: int | None = None) -> bool:
        """Create the next marker; False if there is one already."""
        seq, held = (last["seq"] + 1, last["buckets"]) if last else (0, modulus)
        folders = {f: [m, [b for b in own if b not in chosen]] for f, (m, own) in (last["folders"] if last else {}).items()}
        folders = {f: x for f, x in folders.items() if x[1]} | ({name: [modulus, sorted(chosen)]} if chosen else {})
        changes = {s: own for s, own in (last["changes"] if last else {}).items() if int(s) > seq - 100} | {str(seq): sorted(chosen)}
        if buckets and buckets != held:  # each bucket b becomes b, b + held, b + 2 * held, ...
            split = lambda own: sorted(_refined(own, held, buckets))
            folders, changes = {f: [m, split(own)] for f, (m, own) in folders.items()}, {s: split(own) for s, own in changes.items()}
        found = {"seq": seq, "snapshot": name or last["snapshot"], "buckets": buckets or held, "done": (last["done"] if last else {}) | done, "folders": folders, "changes": changes}
        return put_if_absent(self.spark, f"{self.path}/markers/{seq:012d}.json", json.dumps(found))

    def grow(self, factor: int = 2) -> int:
        """Split every bucket; returns the new number. No file is rewritten: a commit writes its buckets at the new number,
        readers of a part of an older bucket filter its file."""
        while True:
            last = self._marker()
            if last is None:
                self._new *= factor
                return self._new
            if self._put(last, "", last["buckets"], set(), {}, last["buckets"] * factor):
                return last["buckets"] * factor

    def clean(self, keep: int = KEPT_MARKERS, least_age: float = LEAST_AGE) -> list[str]:
        """Delete folders that none of the newest markers names, and older markers; returns the folders. Younger ones
        stay, for a writer may not have committed them yet."""
        markers = sorted(n for n, _ in listed(self.spark, f"{self.path}/markers") if n.endswith(".json"))
        used = {f for n in markers[-keep:] for f in json.loads(self.spark.read.text(f"{self.path}/markers/{n}", wholetext=True).first()[0])["folders"]}
        old = time.time() - least_age
        gone = [n for n, at in listed(self.spark, self.path) if n.startswith("snapshot-") and n not in used and at <= old]
        for n in markers[:-keep]:
            deleted(self.spark, f"{self.path}/markers/{n}")
        for n in gone:
            deleted(self.spark, f"{self.path}/{n}")
        return gone

    def _table(self, table: str, buckets: list[int] | None) -> DataFrame:
        marker, out = self._marker(), None
        for folder, (modulus, held) in marker["folders"].items():
            wanted = held if buckets is None else [b for b in held if b in set(buckets)]
            if not wanted:
                continue
            schema = self.spark.read.parquet(f"{self.path}/{folder}/schema/{table}").schema.add("doc_bucket", "integer")
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/{table}").where(F.col("doc_bucket").isin(sorted({b % modulus for b in wanted})))
            if modulus != marker["buckets"]:
                rows = rows.withColumn("doc_bucket", self.bucket(F.col("doc_id"), marker["buckets"])).where(F.col("doc_bucket").isin(wanted))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:  # no folder holds these buckets
            folder = next(iter(marker["folders"]))
            schema = self.spark.read.parquet(f"{self.path}/{folder}/schema/{table}").schema.add("doc_bucket", "integer")
            out = self.spark.createDataFrame([], schema)
        return out

    def chunks(self, buckets: list[int] | None = None) -> DataFrame:
        """The current chunks; of some buckets only those files are read."""
        return self._table("chunks", buckets)

    def hashes(self, buckets: list[int] | None = None) -> DataFrame:
        return self._table("hashes", buckets).drop("doc_bucket")


def _named(batch: str) -> tuple[str, int]:
    found = re.fullmatch(r"(.*):(\d+)", batch, re.S)
    return (found[1], int(found[2])) if found else (batch, 0)


def _refined(buckets, old: int, new: int) -> set[int]:
    """Buckets of a number as those of a multiple of it."""
    return {b + k * old for b in buckets for k in range(new // old)}
