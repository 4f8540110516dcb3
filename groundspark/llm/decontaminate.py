"""Benchmark decontamination with suffix arrays over shards of the training documents.

Every Arrow slice of documents is a shard: its words become a suffix array (of word suffixes), and every suffix of
every benchmark item is binary-searched in it. The range that shares a whole window gives all locations of that
window. Longest verbatim matches start from these locations: each is looked up in a suffix array of the other side, by
doubling the length, so a location costs the logarithm of the lengths however often its words repeat. A document lies
wholly within one shard, so nothing is shuffled; the benchmark travels to the tasks in blocks of a bounded number of
words, one after another. Before several blocks a sieve of all their windows, of a bounded size, goes over the documents
once: the blocks then pass only over the texts that it leaves, and leave rows for texts that are hit only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import Scratch, annotate, flat_rows, fresh_names
from groundspark.llm.hashed import WordHashes, mix, runs

WINDOW = 13
#: Words of benchmark text in one broadcast block (about 100 MB as Python objects at most); it is one pass over the texts.
BLOCK_WORDS = 500_000
#: Bits of the sieve for a word of the benchmark, its bits at most (64 MB), and the bits of one window. A fuller sieve
#: leaves more texts to the blocks, which find the same in them.
SIEVE_WORD, SIEVE_BITS, PROBES = 64, 1 << 29, 8
#: Texts hit by a benchmark of several blocks that are broadcast with their spans; beyond, documents are joined by a shuffle.
BROADCAST_HITS = 100_000
#: A-Z folded; every other ASCII character but digits and lower-case letters ends a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class _Numbers(dict):
    """Word -> its number; 0 for a word that no item has."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Suffixes:
    """Suffix array over arrays of word numbers, 0 standing for a word that no item has and for a text's end.

    Suffixes that begin with 0 can't match and aren't kept. Several words are packed in one 63-bit key; suffixes are
    sorted key by key, ties only, until `depth` words.
    """

    def __init__(self, ids: np.ndarray, bits: int, depth: int) -> None:
        self.bits, self.per = bits, max(1, 63 // bits)
        levels = -(-depth // self.per)
        padded = np.concatenate([ids.astype(np.int64), np.zeros((levels + 1) * self.per, np.int64)])
        self.ids = padded
        keys = np.zeros(len(ids) + levels * self.per, np.int64)
        for j in range(self.per):
            keys = (keys << bits) | padded[j : j + len(keys)]
        self.keys = keys
        where = np.flatnonzero(ids)
        order = where[np.argsort(keys[where], kind="stable")]
        tied = np.arange(len(order))
        group = keys[order]
        for level in range(1, levels):
            if not len(tied):
                break
            new = np.empty(len(tied), bool)
            new[:1] = True
            new[1:] = (group[1:] != group[:-1]) | (tied[1:] != tied[:-1] + 1)
            label = np.cumsum(new)
            keep = np.bincount(label)[label] > 1
            tied, label = tied[keep], label[keep]
            at = order[tied]
            key = keys[at + level * self.per]
            ranked = np.lexsort((key, label))
            order[tied] = at[ranked]
            key = key[ranked]
            # a pair of labels as one number: equal only within a label and key
            _, group = np.unique(key, return_inverse=True)
            group = label * (group.max(initial=0) + 1) + group
        self.order = order

    def _bound(self, low: np.ndarray, high: np.ndarray, value: np.ndarray, level: int) -> np.ndarray:
        """First place in [low, high) whose key at the level is not less than value."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            key = self.keys[self.order[np.where(open_, mid, 0)] + level * self.per]
            less = open_ & (key < value)
            low = np.where(less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low

    def find(self, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with the first lengths[i] numbers of queries[i] (padded with 0)."""
        low = np.zeros(len(queries), np.int64)
        high = np.full(len(queries), len(self.order), np.int64)
        for level in range(-(-int(lengths.max(initial=0)) // self.per)):
            part = queries[:, level * self.per : (level + 1) * self.per]
            key = np.zeros(len(queries), np.int64)
            for j in range(self.per):
                key = (key << self.bits) | (part[:, j] if j < part.shape[1] else 0)
            used = np.clip(lengths - level * self.per, 0, self.per)
            rest = (self.per - used) * self.bits
            floor = (key >> rest) << rest
            first = self._bound(low, high, floor, level)
            last = self._bound(first, high, floor + (np.int64(1) << rest) - (used == self.per), level) if (used < self.per).any() else None
            exact = self._bound(first, high, floor + 1, level)
            end = exact if last is None else np.where(used == self.per, exact, last)
            active = used > 0
            low, high = np.where(active, first, low), np.where(active, end, high)
        return low, high


class Longest:
    """Suffix array of a text of numbers (0 ends an item), with the rank of every run of 1, 2, 4, ... numbers.

    at(other, places) gives for each place of another text the longest run from there on that the text holds, of `most`
    numbers at most, and one of its starts in the text. A run with a 0 matches nothing.
    """

    def __init__(self, text: np.ndarray, most: int) -> None:
        self.ranks, self.pairs = [text.astype(np.int32)], []
        while 1 << len(self.ranks) <= 2 * most:
            key = self._pairs(self.ranks[-1], 1 << (len(self.ranks) - 1))
            kinds, rank = np.unique(key, return_inverse=True)
            self.pairs.append(kinds)
            self.ranks.append((rank + 1).astype(np.int32))
        self.order = np.argsort(self.ranks[-1], kind="stable")

    @staticmethod
    def _pairs(rank: np.ndarray, step: int) -> np.ndarray:
        after = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), rank.dtype)])
        return (rank.astype(np.int64) << 31) | after

    def at(self, other: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = [other.astype(np.int64)]
        for level, kinds in enumerate(self.pairs):
            first = names[-1]
            after = np.concatenate([first[1 << level :], np.zeros(min(1 << level, len(first)), np.int64)])
            key = (first << 31) | after
            found = np.minimum(np.searchsorted(kinds, key), len(kinds) - 1)
            names.append(np.where((first > 0) & (after > 0) & (kinds[found] == key), found + 1, 0))
        low, high, length = np.zeros(len(places), np.int64), np.full(len(places), len(self.order), np.int64), np.zeros(len(places), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            at = places + length
            name = np.where(at < len(other), names[level][np.minimum(at, len(other) - 1)], 0)
            first = self._bound(low, high, length, name, level)
            last = self._bound(first, high, length, name + 1, level)
            longer = (name > 0) & (first < last)
            low, high = np.where(longer, first, low), np.where(longer, last, high)
            length += longer * (1 << level)
        return length, self.order[np.minimum(low, len(self.order) - 1)]

    def _bound(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, value: np.ndarray, level: int) -> np.ndarray:
        """First place of the order in [low, high) whose suffix has no smaller rank than value behind its first numbers."""
        low, high, rank = low.copy(), high.copy(), self.ranks[level]
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            at = self.order[np.where(open_, mid, 0)] + length
            found = np.where(at < len(rank), rank[np.minimum(at, len(rank) - 1)], 0)
            less = open_ & (found < value)
            low = np.where(less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low


class Benchmark:
    """A block of items: the windows with their items, and the items' text for longest matches."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        vocabulary = _Numbers()
        coded = [(item, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]) for item, words in items if words]
        self.vocabulary = vocabulary
        self.bits = max(1, int(len(vocabulary) + 1).bit_length())
        self.depth = window
        self.items = sorted({item for item, _ in coded})
        number = {x: i for i, x in enumerate(self.items)}
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, ids in coded:
            for i in range(max(1, len(ids) - window + 1)):
                windows.setdefault(tuple(ids[i : i + window]), set()).add(number[item])
        self.lengths = np.array([len(x) for x in windows], np.int64)
        self.queries = np.zeros((len(windows), window), np.int64)
        for i, x in enumerate(windows):
            self.queries[i, : len(x)] = x
        # windows that the same items hold share one array of them
        groups: dict[tuple[int, ...], int] = {}
        self.window_items = np.array([groups.setdefault(tuple(sorted(x)), len(groups)) for x in windows.values()], np.int64)
        self.groups = list(groups)
        self.text = np.array([x for _, ids in coded for x in [*ids, 0]] or [0], np.int64)
        self.most = max((len(ids) for _, ids in coded), default=1)
        self.suffix_item = np.array([number[item] for item, ids in coded for _ in ids], np.int64)
        self.suffix_start = np.array([i for _, ids in coded for i in range(len(ids))], np.int64)
        starts = np.cumsum([0, *(len(ids) + 1 for _, ids in coded)])
        self.suffix_at = np.array([s + i for s, (_, ids) in zip(starts, coded, strict=False) for i in range(len(ids))], np.int64)
        self.longest = Longest(self.text, self.most)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: the index of the range and the place, for every place of every range."""
    n = high - low
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class _Shard:
    def __init__(self, words: list[list[bytes]]) -> None:
        self.counts = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.counts + 1) - self.counts - 1
        self.words = words

    def suffixes(self, bench: Benchmark, number: dict[bytes, int]) -> tuple[np.ndarray, Suffixes]:
        n = int(self.counts.sum() + len(self.counts))
        ids = np.zeros(n, np.int64)
        for start, words in zip(self.starts.tolist(), self.words, strict=True):
            ids[start : start + len(words)] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        return ids, Suffixes(ids, bench.bits, bench.depth)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1


def _texts_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Benchmark]:
    """The benchmark as blocks; the driver reads the items as a stream and holds one block at a time."""
    items, n, any_ = [], 0, False
    for row in _texts_of(benchmark, item_col, text_col).toLocalIterator():
        words = split_words(row.text)
        if not words:
            continue
        items.append((row.item, words))
        n += len(words)
        if n >= block_words:
            yield Benchmark(items, window)
            items, n, any_ = [], 0, True
    if items or not any_:
        yield Benchmark(items, window)


class Sieve:
    """Which texts may hold a window of an item: bits for the hashes of all windows, of a bounded size. None is missed."""

    def __init__(self, window: int, words: int) -> None:
        self.size = min(SIEVE_BITS, max(1 << 16, 1 << (SIEVE_WORD * words - 1).bit_length()))
        self.window, self.bits, self.lengths = window, np.zeros(self.size // 8, np.uint8), set()

    def _bits_of(self, hashes: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
        place = mix(hashes + np.uint64(probe + 1)) & np.uint64(self.size - 1)
        return (place >> np.uint64(3)).astype(np.int64), (place & np.uint64(7)).astype(np.uint8)

    def add(self, words: np.ndarray) -> None:
        """The windows of an item, from its words' hashes."""
        length = min(len(words), self.window)
        self.lengths.add(length)
        windows = runs(words, length)
        for probe in range(PROBES):
            byte, bit = self._bits_of(windows, probe)
            np.bitwise_or.at(self.bits, byte, np.uint8(1) << bit)

    def may_hold(self, words: np.ndarray) -> bool:
        for length in sorted(self.lengths, reverse=True):
            left = runs(words, length)
            for probe in range(PROBES):
                byte, bit = self._bits_of(left, probe)
                left = left[((self.bits[byte] >> bit) & 1).astype(bool)]
                if not len(left):
                    break
            if len(left):
                return True
        return False


def sieved(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of which the text may hold a window of the benchmark, in one pass: all that do, and hardly any other.

    Null and word-free texts hold none. The driver reads the items as a stream and holds the sieve alone.
    """
    items, hashes = _texts_of(benchmark, item_col, bench_text), WordHashes()
    # a word and the character behind it: two bytes at least
    sieve = Sieve(window, (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2 + 1)
    for row in items.toLocalIterator():
        words = split_words(row.text)
        if words:
            sieve.add(hashes.of(words))
    sent = docs.sparkSession.sparkContext.broadcast(sieve)
    (name,) = fresh_names(docs, ["may_hold"])

    def make():
        own = WordHashes()

        def judge(texts: list[str | None], _: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([sent.value.may_hold(own.of(split_words(t))) for t in texts], pa.bool_())]

        return judge

    return annotate(docs, text_col, [(name, "boolean")], make).where(F.col(name)).drop(name)


@dataclass
class Found:
    """What a block's windows hit in a shard: spans of covered words (document, first word and the word behind the last),
    the items and the longest match of every document, and the shard's words as the block's numbers."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    items: list[set[str]]
    longest: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, shard: _Shard, bench: Benchmark) -> Found:
        ids, array = shard.suffixes(bench, bench.vocabulary)
        low, high = array.find(bench.queries, bench.lengths)
        query, place = _spread(low, high)
        at, length = array.order[place], bench.lengths[query]
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover) > 0, [False]]).astype(np.int8)))
        first, end = edge[::2], edge[1::2]
        doc = shard.document(first)
        items: list[set[str]] = [set() for _ in shard.words]
        longest = np.zeros(len(shard.words), np.int64)
        if len(at):
            kinds = np.unique(np.stack([shard.document(at), bench.window_items[query]]), axis=1)
            for d, group in kinds.T.tolist():
                items[d].update(bench.items[i] for i in bench.groups[group])
            # a match lies within the covered words: only these are looked up, spans set apart by 0
            sizes = end - first + 1
            shift = np.cumsum(sizes) - sizes - first
            part = np.zeros(int(sizes.sum()), np.int64)
            own = np.arange(len(part) - len(sizes)) + np.repeat(np.arange(len(sizes)), sizes - 1)
            part[own] = ids[own - np.repeat(shift, sizes - 1)]
            starts, back = np.unique(at, return_inverse=True)
            matched, _ = bench.longest.at(part, starts + shift[np.searchsorted(first, starts, side="right") - 1])
            # what begins here and is shorter than a window counts where it is the whole of an item
            shorter = np.zeros(len(starts), np.int64)
            np.maximum.at(shorter, back, length)
            np.maximum.at(longest, shard.document(starts), np.where(matched >= bench.window, matched, shorter))
        return cls(doc, first - shard.starts[doc], end - shard.starts[doc], items, longest, ids)


FIELDS = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("longest_match", "long")]


def annotate_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[str]]:
    """Append what of each document the benchmark contains; returns the table and the names of the five new columns.

    n_words, n_hit (words inside an occurrence of a window: `window` consecutive words of an item, or the whole of a
    shorter item), n_items (items with an occurring window), items_sha256 (of their ids, sorted as strings, joined by
    commas), longest_match (words of the longest verbatim match of at least one window, else 0). Names that the table
    has already get underscores in front.
    Null and word-free texts have 0 words. Items without id or words are left out; equal item ids count once.
    Repeated documents are each judged. An empty benchmark hits nothing.
    A benchmark of one block takes one pass without a shuffle. Of several, a sieve of all windows takes one, each block
    one over the texts that it leaves, and what they hit is joined.
    """
    names = fresh_names(docs, [n for n, _ in FIELDS])
    fields = [(n, t) for n, (_, t) in zip(names, FIELDS, strict=True)]
    blocks = blocks_of(benchmark, item_col, bench_text, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(first)

        def make():
            def judge(texts: list[str | None], _: pa.RecordBatch) -> list[pa.Array]:
                shard = _Shard([split_words(t) for t in texts])
                found = Found.of(shard, sent.value)
                n_hit = np.bincount(found.doc, found.end - found.start, len(texts)).astype(np.int64)
                return _columns(shard.counts, n_hit, found.items, found.longest)

            return judge

        return annotate(docs, text_col, fields, make), names

    spark, text = docs.sparkSession, F.col(text_col)
    scratch, parts = Scratch(spark, "decontaminate"), []
    near = scratch.write(sieved(docs.select(text.alias("text")), benchmark, "text", item_col, bench_text, window), "near")
    for k, block in enumerate(chain((first, second), blocks)):
        sent = spark.sparkContext.broadcast(block)
        del block
        parts.append(scratch.write(_hit_texts(near, sent, k), f"block-{k}"))
        sent.destroy()
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    # texts of equal hashes have equal hits: a row for each text and block
    hits = found.dropDuplicates(["key", "twin", "block"]).groupBy("key", "twin").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("longest").alias("longest"))
    hits = scratch.write(hits, "hits")
    few = hits.count() <= BROADCAST_HITS
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).alias("_")).alias("row")
    keyed = docs.select(whole, text.alias("text"), *_text_keys(text))
    joined = keyed.join(F.broadcast(hits) if few else hits, ["key", "twin"], "left").select("row", "text", "spans", "items", "longest")

    def make_last():
        def judge(texts: list[str | None], part: pa.RecordBatch) -> list[pa.Array]:
            counts = np.array([len(split_words(t)) for t in texts], np.int64)
            n_hit = np.zeros(len(texts), np.int64)
            items, longest = part.column(3).to_pylist(), part.column(4).to_pylist()
            for k, spans in enumerate(part.column(2).to_pylist()):
                at = 0
                for span in sorted(spans or (), key=lambda s: (s["start"], s["end"])):
                    n_hit[k] += max(0, span["end"] - max(at, span["start"]))
                    at = max(at, span["end"])
            return _columns(counts, n_hit, [x or () for x in items], np.array([x or 0 for x in longest], np.int64))

        return judge

    marked = annotate(joined, "text", [(n, t) for n, t in FIELDS], make_last)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return marked.select(*own, *(F.col(n).alias(new) for new, (n, _) in zip(names, FIELDS, strict=True))), names


def _columns(counts: np.ndarray, n_hit: np.ndarray, items: list, longest: np.ndarray) -> list[pa.Array]:
    digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    return [pa.array(counts), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array(longest)]


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("key"), F.xxhash64(text, F.lit(1)).alias("twin")]


def _hit_texts(texts: DataFrame, sent: Broadcast, block: int) -> DataFrame:
    """The texts that a block hits: two hashes of the text, spans (words from start to before end), items, longest."""
    schema = "key long, twin long, block long, spans array<struct<start:long,end:long>>, items array<string>, longest long"

    def make():
        def rows(texts: list[str | None], part: pa.RecordBatch) -> pa.RecordBatch:
            shard = _Shard([split_words(t) for t in texts])
            found = Found.of(shard, sent.value)
            hit, first = np.unique(found.doc, return_index=True)
            edges = pa.array(np.append(first, len(found.doc)), pa.int32())
            spans = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(found.start), pa.array(found.end)], names=["start", "end"]))
            own = pa.array(hit)
            return pa.RecordBatch.from_arrays([part.column(1).take(own), part.column(2).take(own), pa.array(np.full(len(hit), block)), spans, pa.array([sorted(found.items[d]) for d in hit], pa.list_(pa.string())), pa.array(found.longest[hit])], names=["key", "twin", "block", "spans", "items", "longest"])

        return rows

    return flat_rows(texts.select("text", *_text_keys(F.col("text"))), "text", schema, make)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Longest verbatim match of every benchmark suffix over all shards, with its location: item_id, item_start,
    n_words, doc_id, doc_start (words from 0). Suffixes without a match of a whole window have no row. A shard gives
    for each suffix one of its longest matches; of equally long ones of several shards the smallest (doc_id, doc_start)
    is taken. Null and word-free texts match nothing; rows with equal ids are each looked at, null ids come first. An
    empty benchmark or table gives no rows. Of several blocks each passes over the texts that a sieve leaves."""
    spark, kind, scratch, parts = docs.sparkSession, dict(docs.dtypes)[id_col], Scratch(docs.sparkSession, "longest"), []
    schema = f"item_id string, item_start long, n_words long, doc_id {kind}, doc_start long"
    docs, blocks = docs.select(id_col, text_col), blocks_of(benchmark, item_col, bench_text, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        docs = scratch.write(sieved(docs, benchmark, text_col, item_col, bench_text, window), "near")
    for k, block in enumerate(chain((first,), () if second is None else (second,), blocks)):
        sent = spark.sparkContext.broadcast(block)

        def make(sent=sent):
            def rows(texts: list[str | None], part: pa.RecordBatch) -> pa.RecordBatch:
                shard, bench = _Shard([split_words(t) for t in texts]), sent.value
                found, suffixes = Found.of(shard, bench), bench.suffix_at
                length, place = Longest(found.ids, bench.most).at(bench.text, suffixes) if len(found.doc) else (np.zeros(len(suffixes), np.int64), suffixes)
                left = _left(bench)
                keep = np.flatnonzero((length >= bench.window) | ((length > 0) & (length == left) & (bench.suffix_start == 0)))
                doc = shard.document(place[keep])
                out = [pa.array([bench.items[i] for i in bench.suffix_item[keep]], pa.string()), pa.array(bench.suffix_start[keep]), pa.array(length[keep]), part.column(0).take(pa.array(doc)), pa.array(place[keep] - shard.starts[doc])]
                return pa.RecordBatch.from_arrays(out, names=["item_id", "item_start", "n_words", "doc_id", "doc_start"])

            return rows

        parts.append(scratch.write(flat_rows(docs, text_col, schema, make), f"block-{k}"))
        sent.destroy()
    best = parts[0]
    for part in parts[1:]:
        best = best.union(part)
    key = F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_start")
    top = best.groupBy("item_id", "item_start").agg(F.min(key).alias("m"))
    return top.select("item_id", "item_start", (-F.col("m.n")).alias("n_words"), "m.doc_id", "m.doc_start")


def _left(bench: Benchmark) -> np.ndarray:
    """Words of its item from each suffix on."""
    ends = np.flatnonzero(bench.text == 0)
    return ends[np.searchsorted(ends, bench.suffix_at)] - bench.suffix_at


def is_contaminated(n_hit: str, n_words: str):
    """At least a twentieth of the words are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that aren't contaminated, with their columns. Null and word-free texts stay, repeated rows are each
    judged; a benchmark of one block takes one pass without a shuffle, see annotate_hits for several."""
    marked, (n_words, n_hit, *_) = annotate_hits(docs, benchmark, text_col, **options)
    return marked.where(~is_contaminated(n_hit, n_words)).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document, in the form of query op1."""
    marked, _ = annotate_hits(docs.select("doc_id", "text"), benchmark)
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", is_contaminated("n_hit", "n_words").alias("contaminated"), "longest_match")


REPORT_SQL = r"""
WITH dw AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
items AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + 12) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM items),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n),
hits AS (SELECT d.doc_id, d.s, d.n, i.item_id FROM starts d JOIN items i ON list_slice(d.w, d.s, d.s + d.n - 1) = i.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id),
follow AS (
  SELECT h.doc_id, h.s, row_number() OVER (PARTITION BY h.doc_id, h.item_id, h.k - h.s ORDER BY h.s) - h.s AS run, h.item_id, h.k - h.s AS shift
  FROM (SELECT DISTINCT d.doc_id, d.s, b.item_id, b.k FROM (SELECT doc_id, w, s, n FROM starts) d
        JOIN (SELECT item_id, k, list_slice(w, k, k + least(13, len(w)) - 1) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS k FROM bw WHERE len(w) > 0)) b
        ON list_slice(d.w, d.s, d.s + d.n - 1) = b.win) h),
longest AS (
  SELECT doc_id, max(n) AS m FROM (SELECT doc_id, count(*) - 1 + any_value(least(13, l.n)) AS n FROM follow JOIN (SELECT item_id, len(w) AS n FROM bw) l USING (item_id) GROUP BY doc_id, item_id, shift, run) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated, coalesce(m, 0)::BIGINT AS longest_match
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
