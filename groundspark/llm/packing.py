"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens. Pieces are dealt to blocks of bounded size; for every block a few
islands each evolve a population of packings: crossover injects whole well-filled bins of one parent into the other,
bins that hold an injected piece again are opened, and the displaced pieces are put back by best fit, longest first.
Between epochs each island's best packing moves on to the next island. Bins that stay loose are opened and their
pieces packed again, together with those of other blocks, until one block is left or a turn closes hardly any of them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import flat_rows, written
from groundspark.llm.encode import Encoder, default_vocabulary

CAPACITY = 4096
BLOCK = 8192
ISLANDS, POPULATION, CROSSOVERS, EPOCHS = 3, 4, 6, 2
#: Bins with more than this share free are packed again with other blocks' ones.
LOOSE = 0.01
#: Share of a turn's pieces that must get into tight bins for another turn.
WORTHWHILE = 0.02


class Packing:
    """Bins of item numbers with their free space; best fit finds the tightest bin through a bit mask of free spaces."""

    def __init__(self, lengths: np.ndarray, capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int] | None] = []
        self.free: list[int] = []
        self.by_free: dict[int, list[int]] = {}
        self.mask = 0

    def _offer(self, b: int) -> None:
        free = self.free[b]
        if free > 0:
            same = self.by_free.setdefault(free, [])
            if not same:
                self.mask |= 1 << free
            same.append(b)

    def add_bin(self, items: list[int]) -> None:
        self.bins.append(items)
        self.free.append(self.capacity - sum(self.lengths[i] for i in items))
        self._offer(len(self.bins) - 1)

    def best_fit(self, items: list[int]) -> None:
        for i in items:
            need = self.lengths[i]
            above = self.mask >> need
            if above:
                free = need + (above & -above).bit_length() - 1
                same = self.by_free[free]
                b = same.pop()
                if not same:
                    self.mask ^= 1 << free
                self.bins[b].append(i)
                self.free[b] = free - need
                self._offer(b)
            else:
                self.add_bin([i])

    def fitness(self) -> float:
        return sum(((self.capacity - f) / self.capacity) ** 2 for f in self.free) / max(1, len(self.bins))


def fitted(lengths: list[int], capacity: int, order: list[int]) -> Packing:
    out = Packing(lengths, capacity)
    out.best_fit(order)
    return out


def crossed(a: Packing, b: Packing, rng: np.random.Generator) -> Packing:
    """a with some of b's fullest bins injected; a's loosest bins are opened besides."""
    order = np.argsort(np.array(b.free) + rng.random(len(b.free)) * b.capacity * 0.02)
    chosen = [b.bins[k] for k in order[: max(1, int(len(order) * rng.uniform(0.1, 0.5)))]]
    given = {i for x in chosen for i in x}
    loose = set(np.argsort(a.free)[-max(1, len(a.free) // 50) :].tolist())
    out, displaced = Packing(a.lengths, a.capacity), []
    for k, items in enumerate(a.bins):
        if k in loose or any(i in given for i in items):
            displaced += [i for i in items if i not in given]
        else:
            out.add_bin(items.copy())
    for items in chosen:
        out.add_bin(items.copy())
    out.best_fit(sorted(displaced, key=lambda i: (-a.lengths[i], i)))
    return out


def evolve(lengths: list[int], population: list[list[list[int]]], incoming: list[list[int]] | None, capacity: int, seed: int) -> list[list[list[int]]]:
    """One epoch on one island; packings are lists of bins, best first. It ends as soon as no packing can be smaller."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(lengths) // capacity)

    def made(bins: list[list[int]]) -> Packing:
        out = Packing(lengths, capacity)
        for x in bins:
            out.add_bin(list(x))
        return out

    pool = [made(x) for x in population]
    if not pool:
        exact = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
        pool = [fitted(lengths, capacity, exact)]
        while len(pool) < POPULATION and len(pool[0].bins) > bound:
            keys = np.array(lengths) * rng.uniform(0.8, 1.2, len(lengths))
            pool.append(fitted(lengths, capacity, np.argsort(-keys, kind="stable").tolist()))
    if incoming:
        pool.append(made(incoming))
    rank = lambda p: (len(p.bins), -p.fitness())
    pool.sort(key=rank)
    for _ in range(CROSSOVERS):
        if len(pool[0].bins) <= bound or len(pool) < 2:
            break
        i, j = rng.choice(len(pool), 2, replace=False)
        pool.append(crossed(pool[i], pool[j], rng))
        pool.sort(key=rank)
        del pool[POPULATION:]
    return [p.bins for p in pool[:POPULATION]]


def _flat(bins: list[list[int]]) -> bytes:
    """A packing as bytes: for every bin its size, then its items."""
    return np.array([x for b in bins for x in (len(b), *b)], "<i4").tobytes()


def _bins(raw: bytes | None) -> list[list[int]]:
    data, out, at = np.frombuffer(raw or b"", "<i4").tolist(), [], 0
    while at < len(data):
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return out


def _epoch(state: DataFrame, capacity: int, seed: int) -> DataFrame:
    """Evolve every island; state: block, island, items, lengths, population, incoming."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                population = [_bins(x) for x in row["population"]]
                new = evolve(row["lengths"], population, _bins(row["incoming"]), capacity, seed + 7919 * row["island"] + row["block"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([row["items"]], pa.list_(pa.int64())), pa.array([row["lengths"]], pa.list_(pa.int32())), pa.array([[_flat(x) for x in new]], pa.list_(pa.binary())), pa.array([len(new[0])], pa.int32())],
                    names=["block", "island", "items", "lengths", "population", "n_bins"],
                )

    return state.mapInArrow(run, "block long, island int, items array<long>, lengths array<int>, population array<binary>, n_bins int")


def pack_blocks(items: DataFrame, count: int, capacity: int, level: int) -> DataFrame:
    """Pack items (item, length) block by block: item, block, bin, offset, free (of the item's bin)."""
    blocks = max(1, -(-count // BLOCK))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)))
    grouped = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("x"))
    state = grouped.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("x.item").alias("items"), F.col("x.length").alias("lengths"))
    state = state.withColumn("population", F.array().cast("array<binary>")).withColumn("incoming", F.lit(None).cast("binary")).repartition("block", "island")
    for epoch in range(EPOCHS):
        state = written(_epoch(state, capacity, seed=1000 * level + epoch), f"islands-{level}-{epoch}")
        if epoch < EPOCHS - 1:
            elite = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("incoming"))
            state = state.drop("n_bins").join(elite, ["block", "island"])
    best = state.groupBy("block").agg(F.min_by(F.struct("items", "lengths", F.col("population")[0].alias("bins")), F.struct("n_bins", "island")).alias("b")).select("block", "b.*")

    def placed(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out: list[list[int]] = [[], [], [], []]
                for k, b in enumerate(_bins(row["bins"])):
                    at = 0
                    for i in b:
                        out[0].append(row["items"][i])
                        out[1].append(k)
                        out[2].append(at)
                        at += row["lengths"][i]
                    out[3] += [capacity - at] * len(b)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([row["block"]] * len(out[0]), pa.int64()), *(pa.array(x, pa.int64()) for x in out[1:])], names=["item", "block", "bin", "offset", "free"])

    return best.mapInArrow(placed, "item long, block long, bin long, offset long, free long")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack items (item long, length int; lengths from 1 to capacity) into sequences: item, sequence_id, offset.

    Sequences are gapless from offset 0. Items that fill a sequence have one of their own. Items must be distinct;
    an empty table gives no rows.
    """
    # numbers below 0 for these, so that items of any size don't overflow
    full = items.where(F.col("length") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, level = items.where(F.col("length") < capacity).select("item", "length"), [full], 0
    count = rest.count()
    while count:
        placed = written(pack_blocks(rest, count, capacity, level), f"packed-{level}")
        sequence = ((F.col("block") * BLOCK * 16 + F.col("bin")) * 1024 + level).alias("sequence_id")
        close = F.col("free") <= int(capacity * LOOSE)
        # the blocks of a turn are dealt anew, so what one turn can't close the next may; if it closes nothing, none will
        last = count <= BLOCK or (level > 0 and placed.where(close).count() < WORTHWHILE * count)
        tight = F.lit(True) if last else close
        done.append(placed.where(tight).select("item", sequence, "offset"))
        if last:
            break
        rest = written(rest.join(placed.where(~tight).select("item"), "item"), f"loose-{level}")
        count, level = rest.count(), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pieces(docs: DataFrame, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encode whole texts, append end_id and cut what is longer than capacity: doc, piece, start, length, ids_crc32.

    A null text has only the end id; repeated and null document ids each give their own pieces.
    """
    vocabulary = vocabulary or default_vocabulary()
    schema = f"doc {dict(docs.dtypes)[id_col]}, piece int, start long, length int, ids_crc32 long"

    def make():
        encoder, end = Encoder(vocabulary), np.array([end_id], "<u4").tobytes()

        def rows(texts: list[str | None], part: pa.RecordBatch) -> pa.RecordBatch:
            owner, number, start, length, crc = [], [], [], [], []
            for d, raw in enumerate(encoder.encode(texts)):
                raw += end
                for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                    piece = raw[at : at + 4 * capacity]
                    owner.append(d)
                    number.append(p)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
            return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())], names=["doc", "piece", "start", "length", "ids_crc32"])

        return rows

    return flat_rows(docs.select(id_col, text_col), text_col, schema, make)


def report(docs: DataFrame, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, in the form of query op7. An empty table has no pieces; see `pieces` for null and repeated rows."""
    numbered = written(pieces(docs, end_id, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    packed = pack(numbered.select("item", "length"), capacity)
    out = numbered.join(packed, "item")
    return out.select(F.col("doc").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
