"""Token ids of documents in a content-addressed store.

A rolling hash over the last ids cuts each document's id stream where its content says so, so equal passages give equal
chunks. A chunk is named by the hash of its ids and stored once; a document is a recipe, the list of its chunks with
a Merkle root over their names. Recipes are written in ascending order of document, a part to a file; a manifest holds
for each part a Merkle root over its documents (in blocks of BLOCK_DOCS, then over the blocks' roots), and a seal the
root over all parts. Reading starts with the seal: lost or changed files are found before any document is rebuilt.

    <path>/recipes/*.parquet   part, place (in the part), before (tokens before it in the part), doc, n_tokens, chunks
                               (list of hash, count and place), root; parts and places in order of doc
    <path>/chunks/*.parquet    hash, n, payload: little-endian ids of `width` bytes; one row for each hash
    <path>/manifest/*.parquet  part, first document, documents, tokens, root over the documents
    <path>/seal/*.parquet      parts, documents, tokens, root over the parts: one row
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundspark.llm.common import deleted, flat_rows, shared_folder
from groundspark.llm.encode import Encoder, default_vocabulary

#: Ids in the rolling hash, and in a chunk: on average, at least and at most.
ROLL, MEAN, LEAST, MOST = 8, 512, 128, 4096
#: Hashes that a task remembers, to send equal chunks on once.
REMEMBERED = 200_000
#: Documents under one node of the lowest level of a part's Merkle tree.
BLOCK_DOCS = 1024
_MIX = np.array([pow(0x9E3779B1, i + 1, 1 << 32) for i in range(ROLL)], np.uint32)


def cuts(ids: np.ndarray, ends: list[int]) -> list[list[int]]:
    """For each of the documents that lie in ids one after another up to their ends: the ends of its chunks.

    A chunk ends where the rolling hash of the last ids is 0 modulo MEAN, but is no shorter than LEAST (but for the
    last one) and no longer than MOST. The hash is computed over all documents at once: as LEAST is larger than ROLL, no
    cut depends on what stands before its document.
    """
    rolled = np.zeros(len(ids), np.uint32)
    for i in range(min(ROLL, len(ids))):
        rolled[i:] += (ids[: len(ids) - i] + np.uint32(1)) * _MIX[i]
    found = np.flatnonzero((rolled >> np.uint32(9)) % np.uint32(MEAN) == 0) + 1
    places = np.searchsorted(found, ends, side="right").tolist()
    found, out, last, at = found.tolist(), [], 0, 0
    for end, to in zip(ends, places, strict=True):
        own = []
        if end - last > LEAST:
            for stop in [*found[at:to], end]:
                while stop - last > MOST:
                    last += MOST
                    own.append(last)
                if stop - last >= LEAST and stop < end:
                    own.append(stop)
                    last = stop
        if last < end or not own:
            own.append(end)
        last, at = end, to
        out.append(own)
    return out


CHUNKS = "chunks array<struct<hash:binary,n:int,at:int>>"


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves, paired level by level; an odd one out goes up unpaired."""
    level = list(leaves) or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@F.pandas_udf(T.BinaryType())
def merkle_root(leaves: pd.Series) -> pd.Series:
    return pd.Series([merkle([bytes(x) for x in own]) for own in leaves])


def name_of(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


class TokenStore:
    """A store at a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, width: int = 2) -> None:
        self.spark, self.path, self.width = spark, path.rstrip("/"), width

    def write(self, docs: DataFrame, end_id: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> TokenStore:
        """Encode every whole text, append end_id, and write recipes, chunks and manifest.

        A null text has only the end id. Rows with equal or null ids each have a recipe (nulls first; equal ids in the
        order of their roots). Other columns are ignored; an empty table gives an empty store.
        """
        vocabulary, width = vocabulary or default_vocabulary(), self.width
        kind = dict(docs.dtypes)[id_col]
        schema = f"doc {kind}, n_tokens long, {CHUNKS}, root binary, hash binary, n int, payload binary"

        def make():
            encoder, end, seen = Encoder(vocabulary), np.array([end_id], "<u4").tobytes(), set()

            def rows(texts: list[str | None], part: pa.RecordBatch) -> pa.RecordBatch:
                raws = [raw + end for raw in encoder.encode(texts)]
                tokens = [len(raw) // 4 for raw in raws]
                ids = np.frombuffer(b"".join(raws), "<u4")
                if width < 4 and len(ids) and int(ids.max()) >> (8 * width):
                    raise ValueError(f"id {ids.max()} doesn't fit in {width} bytes")
                packed = ids.astype(f"<u{width}").tobytes()
                recipe_ends, recipe_names, recipe_sizes, recipe_places, roots, names, sizes, payloads, last = [0], [], [], [], [], [], [], [], 0
                for own in cuts(ids, np.cumsum(tokens).tolist()):
                    first = last
                    for stop in own:
                        recipe_places.append(last - first)
                        payload = packed[last * width : stop * width]
                        name = name_of(payload)
                        recipe_names.append(name)
                        recipe_sizes.append(stop - last)
                        if name not in seen:
                            if len(seen) > REMEMBERED:
                                seen.clear()
                            seen.add(name)
                            names.append(name)
                            sizes.append(stop - last)
                            payloads.append(payload)
                        last = stop
                    roots.append(merkle(recipe_names[recipe_ends[-1] :]))
                    recipe_ends.append(len(recipe_names))
                a, b = len(texts), len(names)
                docs_ = pa.concat_arrays([part.column(0), pa.nulls(b, part.column(0).type)])
                row = pa.StructArray.from_arrays([pa.array(recipe_names, pa.binary()), pa.array(recipe_sizes, pa.int32()), pa.array(recipe_places, pa.int32())], names=["hash", "n", "at"])
                recipes = pa.ListArray.from_arrays(pa.array([*recipe_ends[:-1], *[None] * b, recipe_ends[-1]], pa.int32()), row)
                return pa.RecordBatch.from_arrays(
                    [docs_, pa.array([*tokens, *[None] * b], pa.int64()), recipes, pa.array([*roots, *[None] * b], pa.binary()), pa.array([*[None] * a, *names], pa.binary()), pa.array([*[None] * a, *sizes], pa.int32()), pa.array([*[None] * a, *payloads], pa.binary())],
                    names=["doc", "n_tokens", "chunks", "root", "hash", "n", "payload"],
                )

            return rows

        landing = f"{self.path}/landing"
        flat_rows(docs.select(id_col, text_col), text_col, schema, make).write.option("compression", "zstd").parquet(landing)
        landed = self.spark.read.schema(schema).parquet(landing)
        order = ["doc", "root"]
        recipes = landed.where(F.col("root").isNotNull()).select("doc", "n_tokens", "chunks", "root")
        recipes = recipes.repartitionByRange(*order).sortWithinPartitions(*order)

        def placed(batches):
            part, place, before = TaskContext.get().partitionId(), 0, 0
            for batch in batches:
                n, tokens = batch.num_rows, batch.column(1).to_numpy()
                starts = before + np.cumsum(tokens) - tokens
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), pa.array(starts, pa.int64()), *batch.columns], names=["part", "place", "before", *batch.schema.names])
                place, before = place + n, before + int(tokens.sum())

        recipes.mapInArrow(placed, f"part int, place long, before long, doc {kind}, n_tokens long, {CHUNKS}, root binary").write.parquet(f"{self.path}/recipes")
        chunks = landed.where(F.col("hash").isNotNull()).select("hash", "n", "payload")
        chunks.dropDuplicates(["hash"]).write.option("compression", "zstd").parquet(f"{self.path}/chunks")
        self._rooted_parts().write.parquet(f"{self.path}/manifest")
        self._sealed().write.parquet(f"{self.path}/seal")
        deleted(self.spark, landing)
        return self

    def recipes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/recipes")

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def seal(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/seal")

    def _rooted_parts(self) -> DataFrame:
        """One row for each part of the recipes, in the form of the manifest, from what the recipe files hold now.

        A leaf is the hash of a document's root, its tokens and those before it; a node never has more than BLOCK_DOCS
        documents or one part's blocks, and how the files are read in parts changes nothing.
        """
        leaf = F.unhex(F.sha2(F.concat(F.col("root"), F.encode(F.format_string("|%d|%d|%d", "place", "n_tokens", "before"), "utf-8")), 256))
        docs = self.recipes().select("part", F.floor(F.col("place") / BLOCK_DOCS).alias("block"), "doc", "n_tokens", F.struct("place", leaf.alias("leaf")).alias("x"))
        blocks = docs.groupBy("part", "block").agg(F.array_sort(F.collect_list("x"))["leaf"].alias("x"), F.min("doc").alias("first_doc"), F.count("*").alias("n"), F.sum("n_tokens").alias("m"))
        blocks = blocks.select("part", "first_doc", "n", "m", F.struct("block", merkle_root("x").alias("root")).alias("x"))
        parts = blocks.groupBy("part").agg(F.array_sort(F.collect_list("x"))["root"].alias("x"), F.min("first_doc").alias("first_doc"), F.sum("n").alias("n_docs"), F.sum("m").alias("n_tokens"))
        return parts.select("part", "first_doc", "n_docs", "n_tokens", merkle_root("x").alias("root"))

    def _sealed(self) -> DataFrame:
        """One row over all parts of the manifest; 0 parts for an empty store."""
        rows = self.manifest().agg(F.array_sort(F.collect_list(F.struct("part", "root")))["root"].alias("x"), F.count("*").alias("n_parts"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
        return rows.select("n_parts", "n_docs", "n_tokens", merkle_root("x").alias("root"))

    def damaged_parts(self) -> DataFrame:
        """Parts whose recipe files are lost or differ from the manifest; part -1 stands for the manifest itself."""
        now, then = self._rooted_parts(), self.manifest()
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n_docs", "n_tokens", "root")]
        both = now.alias("a").join(then.alias("b"), F.col("a.part") == F.col("b.part"), "full").where(~(same[0] & same[1] & same[2]))
        seals = self._sealed().exceptAll(self.seal()).select(F.lit(-1).alias("part"))
        return both.select(F.coalesce("a.part", "b.part").alias("part")).union(seals)

    def digests(self) -> DataFrame:
        """Read every file back: doc, start (tokens of all documents before it), n_tokens, ids_crc32, complete.

        A recipe file that is lost or changed raises ValueError, for its documents' number and order can't be told.
        Each chunk is read once and checked against its name; a document's crc32 is combined from those of its
        chunks (crc32 is linear over appended bytes), so that no payload is shuffled. complete is false where a chunk
        is missing or damaged, the counts disagree, or the Merkle root isn't that of the recipe.
        """
        lost = [r["part"] for r in self.damaged_parts().limit(10).collect()]
        if lost:
            raise ValueError(f"recipe files differ from the manifest: parts {lost}")
        width, kind = self.width, dict(self.recipes().dtypes)["doc"]

        @F.pandas_udf("struct<crc:long,good:boolean>")
        def check(names: pd.Series, counts: pd.Series, payloads: pd.Series) -> pd.DataFrame:
            crc = [zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4").tobytes()) for p in payloads]
            good = [name_of(p) == bytes(h) and len(p) == width * n for h, n, p in zip(names, counts, payloads, strict=True)]
            return pd.DataFrame({"crc": crc, "good": good})

        @F.pandas_udf("long")
        def shifted(crc: pd.Series, following: pd.Series) -> pd.Series:
            return pd.Series(shifted_crc(crc.to_numpy(np.int64), 4 * following.to_numpy(np.int64)))

        def listed(batches):
            """A row for each chunk of each recipe, with the tokens that follow it in its document."""
            for batch in batches:
                lists = batch.column("chunks")
                owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                chunks = lists.flatten()
                names, n, at = (chunks.field(k) for k in range(3))
                n, at = n.to_numpy().astype(np.int64), at.to_numpy().astype(np.int64)
                tokens, edges = batch.column("n_tokens").to_numpy(), np.searchsorted(owner, np.arange(batch.num_rows + 1))
                raws, fit = names.to_pylist(), []
                for k, root in enumerate(batch.column("root").to_pylist()):
                    a, b = int(edges[k]), int(edges[k + 1])
                    ends = np.cumsum(n[a:b])
                    fit.append(b > a and int(ends[-1]) == tokens[k] and bool((ends - n[a:b] == at[a:b]).all()) and merkle(raws[a:b]) == root)
                own = pa.array(owner)
                columns = [batch.column(c).take(own) for c in ("part", "place", "before", "doc", "n_tokens")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(fit, bool)[owner]), names, pa.array(tokens[owner] - at - n, pa.int64())], names=["part", "place", "before", "doc", "n_tokens", "fits", "hash", "following"])

        stored = self.chunks().select("hash", check("hash", "n", "payload").alias("c")).select("hash", "c.crc", "c.good")
        parts = self.recipes().mapInArrow(listed, f"part int, place long, before long, doc {kind}, n_tokens long, fits boolean, hash binary, following long")
        joined = parts.join(stored, "hash", "left").withColumn("crc", shifted(F.coalesce("crc", F.lit(0)), "following"))
        whole = joined.groupBy("part", "place", "before", "doc", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.min(F.col("fits") & F.coalesce("good", F.lit(False))).alias("complete"))
        # a row for each recipe file: few
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = self.manifest().select(F.col("part").alias("_part"), F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("_start"))
        whole = whole.join(F.broadcast(starts), F.col("part") == F.col("_part"))
        return whole.select("doc", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "complete")

    def documents(self) -> DataFrame:
        """Rebuild every document: doc, ids (array of long). A missing chunk fails the job."""
        width = self.width

        @F.pandas_udf("array<long>")
        def joined(parts: pd.Series) -> pd.Series:
            return pd.Series([np.concatenate([np.frombuffer(x["payload"], f"<u{width}") for x in sorted(p, key=lambda x: x["pos"])]).astype(np.int64) for p in parts])

        recipes = self.recipes().select("doc", "part", "place", F.posexplode("chunks").alias("pos", "chunk"))
        found = recipes.select("doc", "part", "place", "pos", "chunk.hash").join(self.chunks(), "hash", "left")
        found = found.withColumn("payload", F.when(F.col("payload").isNull(), F.raise_error(F.lit("a chunk is missing"))).otherwise(F.col("payload")))
        return found.groupBy("part", "place", "doc").agg(F.collect_list(F.struct("pos", "payload")).alias("parts")).select("doc", joined("parts").alias("ids"))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over two elements, modulo that of crc32, lowest power in the highest bit."""
    out, a = np.zeros_like(b), a.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(0xEDB88320), np.uint64(0))
    return out


#: Bytes up to which zeros are appended one by one; beyond, lengths are doubled.
_ZEROS = memoryview(bytes(1 << 16))


def shifted_crc(crc: np.ndarray, following: np.ndarray) -> np.ndarray:
    """crc_shift for many rows, of which most are followed by little."""
    out, zero = crc.astype(np.int64), {}
    far = np.flatnonzero(following > len(_ZEROS))
    for i in np.flatnonzero((following > 0) & (following <= len(_ZEROS))).tolist():
        n = int(following[i])
        if n not in zero:
            zero[n] = zlib.crc32(_ZEROS[:n])
        out[i] = zlib.crc32(_ZEROS[:n], int(crc[i])) ^ zero[n]
    if len(far):
        out[far] = crc_shift(crc[far].astype(np.uint64), following[far]).astype(np.int64)
    return out


def crc_shift(crc: np.ndarray, following: np.ndarray) -> np.ndarray:
    """What a part's crc32 contributes to that of the whole when so many bytes follow it."""
    power = np.full(len(crc), 1 << 31, np.uint64)
    step = np.array([1 << 23], np.uint64)  # x to the 8th: one byte
    left = following.astype(np.uint64)
    while left.any():
        power = np.where(left & np.uint64(1), _times(power, np.repeat(step, len(power))), power)
        step = _times(step, step)
        left = left >> np.uint64(1)
    return _times(power, crc)


def report(docs: DataFrame, end_id: int = 2) -> DataFrame:
    """One row per document, in the form of query op6: written to a store in the shared folder and read back."""
    spark = docs.sparkSession
    store = TokenStore(spark, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}").write(docs, end_id)
    read = store.digests()
    checked = F.when(F.col("complete"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document can't be rebuilt")).cast("long"))
    return read.select(F.col("doc").alias("doc_id"), "start", "n_tokens", checked.alias("ids_crc32"))
