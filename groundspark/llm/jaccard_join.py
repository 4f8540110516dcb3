"""Exact Jaccard join of documents on word shingles by a token-group matrix.

1. Every document becomes a set of hashed shingles; equal sets are one set from here on. A set brings its prefix: the
   tokens of which a partner of enough similarity must hold one, rare tokens first.
2. Similar sets are partitioned into groups: of the sets that share a prefix token and are about as large, each is
   compared with the first one only; what is verified as similar is one group (their links connect it).
3. The token-group matrix is worked on in units: the sets of a token, with their groups, in one task; a token of very
   many sets is dealt to one unit for each pair of its blocks that aren't of one group. A unit compares sizes and positions first. Of what is
   left it takes each set as a query to the groups: the group's token union (in bins: one bit for the hash of each
   token) bounds the overlap, only groups that can still hold a partner are opened, and then the same bound holds for
   each member. No pair leaves a unit: it returns its sets that still have a possible partner, each with the likeliest.
4. The likeliest pairs are verified exactly, and groups that a link joins are merged. After some rounds hardly a link
   between groups is left to find; whatever the bounds still leave between groups is then verified pair by pair.
5. Groups that verified links join are one component.

Copies and near copies never meet pair by pair: equal sets are one, and sets of one group aren't compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundspark.llm.common import Scratch, flat_rows, fresh_names, sampled
from groundspark.llm.components import components
from groundspark.llm.hashed import WordHashes, runs

SHINGLE = 5
#: Two sets link when PERCENT * size of union <= 100 * size of intersection.
PERCENT = 80
#: Documents sampled for common tokens, in how many of them a token must be at least, and tokens kept at most: those of
#: the largest counts. What is kept changes the order of prefixes and so the work, never the result.
SAMPLE_DOCS, COMMON, COMMON_KEPT = 20_000, 2, 1_000_000
#: Set numbers or tokens that may be broadcast (8 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bins for each token at least, in the coarse rows that most comparisons need and in the fine ones that few still need;
#: a set has up to twice as many.
COARSE, FINE = 2, 8
#: Sets of a token in one block; rounds of merging groups by likeliest pairs.
BLOCK, ROUNDS = 1024, 2
#: Bytes of bins that a unit compares at a time.
COMPARED = 16 << 20
#: Copies of a small table to be joined with a side of which one key may hold most rows.
SALTS = 32
REMEMBERED = 50_000


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z folded."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingle_set(words: list[bytes], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of fewer words the whole sequence is one; no words, none."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(runs(hashes.of(words), min(size, len(words))) ^ np.uint64(0 if len(words) >= size else len(words)))


def set_number(tokens: np.ndarray, seed: int = 0) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes(), seed)).view(np.int64))


def bins_of(tokens: np.ndarray, each: int) -> bytes:
    """Bins of a set, `each` for a token at least: their number is a power of two."""
    count = max(64, 1 << int(each * len(tokens) - 1).bit_length())
    bits = np.zeros(count, bool)
    bits[(tokens % np.uint64(count)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


class Bins:
    """Bins of several sets, folded to whatever width a comparison needs."""

    def __init__(self, raws: list[bytes]) -> None:
        self.rows = [np.frombuffer(x, np.uint64) for x in raws]
        self.words = np.array([len(x) for x in self.rows], np.int64)

    def at(self, rows: np.ndarray, words: int) -> np.ndarray:
        out = np.empty((len(rows), words), np.uint64)
        for k, r in enumerate(rows.tolist()):
            raw = self.rows[r]
            while len(raw) > words:
                raw = raw[: len(raw) // 2] | raw[len(raw) // 2 :]
            out[k] = raw
        return out

    def missing(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At least so many tokens of set a[k] aren't in set b[k], and the other way round: bins that the other lacks."""
        out = np.zeros((2, len(a)), np.int64)
        width = np.minimum(self.words[a], self.words[b])
        for words in np.unique(width).tolist():
            some = np.flatnonzero(width == words)
            used, at = np.unique(np.concatenate([a[some], b[some]]), return_inverse=True)
            own, left, right = self.at(used, words), at[: len(some)], at[len(some) :]
            step = max(1, COMPARED // (8 * words))
            for k in range(0, len(some), step):
                x, y = own[left[k : k + step]], own[right[k : k + step]]
                out[0, some[k : k + step]] = np.bitwise_count(x & ~y).sum(1)
                out[1, some[k : k + step]] = np.bitwise_count(y & ~x).sum(1)
        return out[0], out[1]

    def unions(self, owner: np.ndarray, count: int) -> Bins:
        """Bins of the unions of the sets with the same owner (0 to count - 1, each with a set at least)."""
        words = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(words, owner, self.words)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=count))
        out = Bins([])
        for k, (end, width) in enumerate(zip(ends.tolist(), words.tolist(), strict=True)):
            out.rows.append(np.bitwise_or.reduce(self.at(order[ends[k - 1] if k else 0 : end], width), axis=0))
        out.words = words
        return out


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that sets of sizes n and m must share to link."""
    return -(-percent * (n + m) // (100 + percent))


@F.pandas_udf(T.BooleanType())
def may_link(n: pd.Series, bins: pd.Series, m: pd.Series, others: pd.Series, percent: pd.Series) -> pd.Series:
    """Whether the bins leave room for enough shared tokens, seen from both sets."""
    both, k = Bins([*bins, *others]), np.arange(len(n))
    x, y = both.missing(k, k + len(n))
    n, m = n.to_numpy().astype(np.int64), m.to_numpy().astype(np.int64)
    return pd.Series(np.minimum(n - x, m - y) >= least_overlap(n, m, percent.to_numpy()))


@F.pandas_udf(T.BooleanType())
def linked(a: pd.Series, b: pd.Series, percent: pd.Series) -> pd.Series:
    """Exact test on two sets' tokens."""
    out = np.zeros(len(a), bool)
    for i, (x, y, p) in enumerate(zip(a, b, percent, strict=True)):
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        both = len(np.intersect1d(x, y, assume_unique=True))
        out[i] = 100 * both >= int(p) * (len(x) + len(y) - both)
    return pd.Series(out)


def _common_tokens(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of several documents of a bounded sample, sorted, and in how many documents of it each is."""
    some = docs.where(sampled(F.col("doc"), min(1.0, SAMPLE_DOCS / max(1, docs.count()))))

    def make():
        hashes = WordHashes()

        def rows(texts: list[str | None], _: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle_set(split_words(t), hashes, size) for t in texts]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["token"])

        return rows

    counted = flat_rows(some, "text", "token long", make).groupBy("token").agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= COMMON)
    counted = counted.persist()
    try:
        steps = sorted(counted.groupBy("n").agg(F.count("*").alias("tokens")).collect(), key=lambda r: -r["n"])
        least, total = COMMON, 0
        for step in steps:
            total += step["tokens"]
            if total > COMMON_KEPT:
                least = step["n"] + 1
                break
        kept = counted.where(F.col("n") >= least).toArrow()
    finally:
        counted.unpersist()
    tokens, counts = kept["token"].to_numpy().view(np.uint64), kept["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc, key (a hash of its text), set (a number that equal sets share; null if empty), twin (a
    second number of the set), n and prefix.

    The prefix stands at the first row at least that a task sees of a set. It is in the order of the tokens' counts in
    the sample, then of the tokens.
    """
    common = docs.sparkSession.sparkContext.broadcast(_common_tokens(docs, size))
    schema = f"doc {dict(docs.dtypes)['doc']}, key long, set long, twin long, n int, prefix array<long>"

    def make():
        hashes, seen = WordHashes(), set()
        known, counts = common.value

        def rows(texts: list[str | None], part: pa.RecordBatch) -> pa.RecordBatch:
            numbers, twins, sizes, prefixes = [], [], [], []
            for text in texts:
                tokens = shingle_set(split_words(text), hashes, size)
                n = len(tokens)
                number = set_number(tokens) if n else None
                sizes.append(n)
                numbers.append(number)
                twins.append(set_number(tokens, 1) if n else None)
                if not n or number in seen:
                    prefixes.append(None)
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add(number)
                often = np.zeros(n, np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    often = np.where(known[place] == tokens, counts[place], 0)
                order = tokens[np.argsort(often, kind="stable")]
                prefixes.append(order[: n - -(-percent * n // 100) + 1].view(np.int64))
            return pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(numbers, pa.int64()), pa.array(twins, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc", "key", "set", "twin", "n", "prefix"]
            )

        return rows

    return flat_rows(docs.select("doc", "text", F.xxhash64("text").alias("key")), "text", schema, make)


def _told_apart(found: DataFrame) -> DataFrame:
    """found, where different sets with one number (64 bits can do that in very large tables) get numbers of their own."""
    twice = found.where(F.col("set").isNotNull()).groupBy("set").agg(F.min("twin").alias("lo"), F.max("twin").alias("hi")).where("lo <> hi").select(F.col("set").alias("_twice"))
    if twice.isEmpty():
        return found.drop("twin")
    found = found.join(twice, F.col("set") == F.col("_twice"), "left")
    return found.withColumn("set", F.when(F.col("_twice").isNull(), F.col("set")).otherwise(F.xxhash64("set", "twin"))).drop("_twice", "twin")


def _size_class(n: Column, percent: int) -> Column:
    """Sets that can link are in the same class or in adjoining ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")


def fits(n, rest, m, other_rest, percent: int, least):
    """Sizes that can link, and enough tokens from a shared one on in both orders; for columns and for arrays."""
    return (100 * n >= percent * m) & (100 * m >= percent * n) & ((100 + percent) * least(rest, other_rest) >= percent * (n + m))


#: What can be had from a set's tokens: columns of _contents.
CONTENTS = {"tokens": lambda x: x.astype("<u8").tobytes(), "coarse": lambda x: bins_of(x, COARSE), "fine": lambda x: bins_of(x, FINE)}


def _contents(docs: DataFrame, wanted: DataFrame, representative: DataFrame, size: int, scratch: Scratch, name: str, columns: list[str]) -> DataFrame:
    """set and its tokens (8 bytes each) or bins for the wanted sets from the text of one document each; written."""
    ids = representative.join(wanted, "set").select(F.col("at.doc").alias("_doc"), F.col("at.key").alias("_key"), F.col("set").alias("_set"))
    ids = scratch.write(ids, f"ids-{name}")
    few = ids.count() <= BROADCAST_IDS
    here = F.col("doc").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_key"))
    texts = docs.join(F.broadcast(ids) if few else ids, here).select("_set", "text")

    def make():
        hashes = WordHashes()

        def rows(texts: list[str | None], part: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle_set(split_words(t), hashes, size) for t in texts]
            return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(map(CONTENTS[c], found), pa.binary()) for c in columns)], names=["set", *columns])

        return rows

    made = scratch.write(flat_rows(texts, "text", ", ".join(["set long", *(f"{c} binary" for c in columns)]), make), f"contents-{name}")
    scratch.drop(f"ids-{name}")
    if made.groupBy("set").count().where("count > 1").isEmpty():
        return made
    # rows of equal id and text are there several times
    once = scratch.write(made.dropDuplicates(["set"]), f"contents-{name}-once")
    scratch.drop(f"contents-{name}")
    return once


def _verified(docs: DataFrame, pairs: DataFrame, representative: DataFrame, size: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Of pairs (a, b) those that link, written."""
    pairs = scratch.write(pairs, f"pairs-{name}")
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    tokens = _contents(docs, wanted, representative, size, scratch, name, ["tokens"])
    left, right = (tokens.select(F.col("set").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    tested = pairs.join(left, "a").join(right, "b").where(linked("ta", "tb", F.lit(percent)))
    return scratch.write(tested.select("a", "b"), f"links-{name}")


def _units(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Deal rows (token, set, group, ...) to units: token, lo, hi, block. A unit has all sets of a token, or two of its blocks.

    Of a token of very many sets each large group has blocks of its own, which meet those of other groups only: what is
    one group already is dealt to no unit, and a large group beside few other sets once.
    """
    # tokens of very many sets and their large groups are few; written, so that their rows needn't meet in one task
    large = scratch.write(rows.groupBy("token").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK).select("token"), f"large-{name}")
    groups = rows.join(large, "token", "left_semi").groupBy("token", "group").agg(F.count("*").alias("_n"))
    groups = scratch.write(groups.withColumn("_own", F.when(F.col("_n") > BLOCK, F.ceil(F.col("_n") / BLOCK).cast("int"))), f"groups-of-{name}")
    blocks = groups.groupBy(F.col("token").alias("_token")).agg(F.ceil(F.coalesce(F.sum(F.when(F.col("_own").isNull(), F.col("_n"))), F.lit(0)) / BLOCK).cast("int").alias("_light"), F.coalesce(F.sum("_own"), F.lit(0)).cast("int").alias("_heavy"))
    blocks = scratch.write(blocks, f"blocks-{name}")
    before = Window.partitionBy("token").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    heavy = groups.where("_own IS NOT NULL").select(F.col("token").alias("_t"), F.col("group").alias("_g"), "_own", F.coalesce(F.sum("_own").over(before), F.lit(0)).cast("int").alias("_first"))
    heavy = scratch.write(heavy, f"heavy-{name}")

    dealt = rows.join(blocks, F.col("token") == F.col("_token"), "left").join(heavy, (F.col("token") == F.col("_t")) & (F.col("group") == F.col("_g")), "left")
    first, light = F.col("_light") + F.col("_first"), F.coalesce("_light", F.lit(1))
    spread = F.xxhash64("set")
    dealt = dealt.withColumn("block", F.when(F.col("_own").isNull(), F.pmod(spread, F.greatest(light, F.lit(1)))).otherwise(first + F.pmod(spread, F.col("_own"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), light + F.coalesce("_heavy", F.lit(0)) - 1), lambda w: F.col("_own").isNull() | (w < first) | (w >= first + F.col("_own")))
    dealt = dealt.withColumn("_with", F.explode(others))
    return dealt.withColumns({"lo": F.least("block", "_with"), "hi": F.greatest("block", "_with")}).drop("_token", "_light", "_heavy", "_t", "_g", "_own", "_first", "_with")


class Unit:
    """Some whole units: rows in their order, and all pairs of rows of one unit and different groups."""

    def __init__(self, table: pa.Table, percent: int) -> None:
        self.table, self.percent = table, percent
        self.set, self.n, self.rest, self.group = (table[c].to_numpy().astype(np.int64) for c in ("set", "n", "rest", "group"))
        keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("token", "lo", "hi")])
        starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
        sizes = np.diff(np.append(starts, len(self.set)))
        self.unit = np.repeat(np.arange(len(starts)), sizes)
        block, across = table["block"].to_numpy(), keys[1] != keys[2]
        end = np.repeat(starts + sizes, sizes)
        many = end - np.arange(len(end)) - 1
        parts, at = [], 0
        # about as many pairs at a time as one large unit has
        while at < len(many):
            to = at + max(1, int(np.searchsorted(np.cumsum(many[at:]), BLOCK * BLOCK)))
            own = many[at:to]
            a = np.repeat(np.arange(at, at + len(own)), own)
            b = np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own) + a + 1
            keep = (self.group[a] != self.group[b]) & (~across[a] | (block[a] != block[b]))
            keep &= fits(self.n[a], self.rest[a], self.n[b], self.rest[b], percent, np.minimum)
            parts.append((a[keep], b[keep]))
            at += len(own)
        self.a, self.b = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))

    def open_groups(self, bins: Bins) -> None:
        """Drop the pairs of a query and a group whose token union can't hold a partner of it."""
        kinds, owner = np.unique(np.stack([self.unit, self.group]), axis=1, return_inverse=True)
        owner = owner.ravel()
        several = np.bincount(owner) > 1
        if not len(self.a) or not several.any():
            return
        # unions follow the rows in one list of bins
        members = np.flatnonzero(several[owner])
        place = np.cumsum(several) - 1
        unions = Bins([])
        some = Bins([])
        some.rows, some.words = [bins.rows[r] for r in members.tolist()], bins.words[members]
        unions = some.unions(place[owner[members]], int(several.sum()))
        both = Bins([])
        both.rows, both.words = bins.rows + unions.rows, np.concatenate([bins.words, unions.words])
        keep = np.ones(len(self.a), bool)
        for query, other in ((self.a, self.b), (self.b, self.a)):
            asked = np.flatnonzero(several[owner[other]])
            if len(asked):
                pair, back = np.unique(query[asked] * len(several) + owner[other[asked]], return_inverse=True)
                asking, group = np.divmod(pair, len(several))
                lacks, _ = both.missing(asking, len(bins.rows) + place[group])
                n = self.n[asking]
                keep[asked] &= (n - lacks >= -(-self.percent * n // 100))[back]
        self.a, self.b = self.a[keep], self.b[keep]

    def bound(self, bins: Bins) -> np.ndarray:
        """Keep the pairs whose bins leave room for enough shared tokens; returns how likely each of them looks."""
        n, m = self.n[self.a], self.n[self.b]
        need = least_overlap(n, m, self.percent)
        x, y = bins.missing(self.a, self.b)
        keep = np.minimum(n - x, m - y) >= need
        self.a, self.b = self.a[keep], self.b[keep]
        return ((n + m - x - y) / (2 * need))[keep]


def _few_units(batches: list[pa.RecordBatch], percent: int) -> Iterator[Unit]:
    """The whole units of the batches, of as many pairs at a time as one large unit has: so many stay in memory."""
    table = pa.Table.from_batches(batches)
    keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("token", "lo", "hi")])
    ends = np.append(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, table.num_rows)
    sizes = np.diff(ends, prepend=0)
    pairs = np.cumsum(sizes * (sizes - 1) // 2)
    at = start = 0
    while at < len(ends):
        done = pairs[at - 1] if at else 0
        at = max(at + 1, int(np.searchsorted(pairs, done + 2 * BLOCK * BLOCK, "right")))
        yield Unit(table.slice(start, ends[at - 1] - start), percent)
        start = ends[at - 1]


def _whole_units(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[Unit]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("token", "lo", "hi")])
        first = int(np.flatnonzero((keys != keys[:, -1:]).any(0)).max(initial=-1)) + 1
        same = held and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in ("token", "lo", "hi"))
        if held and not same:
            yield from _few_units(held, percent)
            held = []
        if first:
            yield from _few_units([*held, batch.slice(0, first)], percent)
            held = []
        held.append(batch.slice(first))
    if held:
        yield from _few_units(held, percent)


def _worked(rows: DataFrame, groups: DataFrame, schema: str, work, scratch: Scratch, name: str, bins: DataFrame | None = None) -> DataFrame:
    """Deal rows (token, set, n, rest) with their groups, and their bins if given, to units and work on these."""
    labelled = rows.join(groups, F.col("set") == F.col("node"), "left").withColumn("group", F.coalesce("label", "set")).drop("node", "label")
    dealt = _units(labelled, scratch, name)
    columns = ["token", "lo", "hi", "block", "set", "n", "rest", "group"]
    if bins is not None:
        dealt, columns = dealt.join(bins.withColumnRenamed("set", "_set"), F.col("set") == F.col("_set")), [*columns, "bins"]
    dealt = dealt.select(*columns).repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    return dealt.mapInArrow(work, schema)


ROWS = "token long, set long, n int, rest int"


def _asked(rows: DataFrame, groups: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The rows that have a partner of another group which fits in size and position."""

    def work(batches):
        for unit in _whole_units(batches, percent):
            some = np.union1d(unit.a, unit.b)
            yield unit.table.select(["token", "set", "n", "rest"]).take(pa.array(some)).combine_chunks().to_batches()[0] if len(some) else _no_rows(ROWS)

    return _worked(rows, groups, ROWS, work, scratch, "asked").distinct()


def _no_rows(schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [tuple(f.split()) for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([], kinds[t]) for _, t in fields], names=[n for n, _ in fields])


def _opened(rows: DataFrame, groups: DataFrame, bins: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The rows that have a partner of another group which the bounds leave, with the likeliest one."""
    schema = f"{ROWS}, best long, score double"

    def work(batches):
        for unit in _whole_units(batches, percent):
            own = Bins(unit.table["bins"].to_pylist())
            unit.open_groups(own)
            score = unit.bound(own)
            a, b, score = np.concatenate([unit.a, unit.b]), np.concatenate([unit.b, unit.a]), np.concatenate([score, score])
            order = np.lexsort((unit.set[b], -score, a))
            rows, first = np.unique(a[order], return_index=True)
            if not len(rows):
                yield _no_rows(schema)
                continue
            found = unit.table.select(["token", "set", "n", "rest"]).take(pa.array(rows)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(unit.set[b[order][first]]), pa.array(score[order][first])], names=["token", "set", "n", "rest", "best", "score"])

    return _worked(rows, groups, schema, work, scratch, name, bins)


def _left_over(rows: DataFrame, groups: DataFrame, bins: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """All pairs of sets of different groups that the bounds leave: a, b (a < b)."""

    def work(batches):
        sent: set[tuple[int, int]] = set()
        for unit in _whole_units(batches, percent):
            own = Bins(unit.table["bins"].to_pylist())
            unit.open_groups(own)
            unit.bound(own)
            x, y = unit.set[unit.a], unit.set[unit.b]
            found = set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True)) - sent
            if len(sent) > REMEMBERED:
                sent = set()
            sent |= found
            a, b = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _worked(rows, groups, "a long, b long", work, scratch, "left", bins).distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Similar sets: one row per document (doc, key, set, n), and set -> component for sets with a link to another one.

    Documents link where 100 * intersection >= percent * union of their shingles (of `size` words; a shorter text is
    one). A null or word-free text has an empty set and links with nothing. Sets that links connect, however many share
    a token, are one component; links within a group that is connected already aren't listed. Equal sets are linked by
    being one.
    """
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession, "jaccard")
    found = _told_apart(scratch.write(sets(docs, size, percent), "sets"))
    some = found.where(F.col("prefix").isNotNull())
    representative = some.groupBy("set").agg(F.min(F.struct("doc", "key")).alias("at"))

    # tokens of several sets; all others are counted map-side and go
    shared = some.select("set", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("set").alias("lo"), F.max("set").alias("hi"))
    shared = scratch.write(shared.where("lo <> hi").select("token"), "shared")
    few = shared.count() <= BROADCAST_IDS
    listed = some.select("set", "n", F.posexplode("prefix").alias("pos", "token")).join(F.broadcast(shared) if few else shared, "token")
    listed = listed.select("token", "set", "n", (F.col("n") - F.col("pos")).alias("rest")).distinct()
    listed = scratch.write(listed, "listed")

    # groups: each set with the first one of its size class that shares a token
    by_class = listed.withColumn("class", _size_class(F.col("n"), percent))
    first = scratch.write(by_class.groupBy("token", "class").agg(F.min(F.struct("set", "n", "rest")).alias("first")), "first")
    near = by_class.join(first, ["token", "class"]).where(F.col("set") != F.col("first.set"))
    near = near.where(fits(F.col("n"), F.col("rest"), F.col("first.n"), F.col("first.rest"), percent, F.least))
    near = near.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("first.set").alias("b"), F.col("first.n").alias("nb")).distinct()
    bins = _contents(docs, listed.select("set").distinct(), representative, size, scratch, "bins", ["coarse", "fine"])
    left, right = (bins.select(F.col("set").alias(x), F.col("coarse").alias(f"bins{x}")) for x in "ab")
    near = near.join(left, "a").join(right, "b").where(may_link("na", "binsa", "nb", "binsb", F.lit(percent))).select("a", "b")
    links = _verified(docs, near, representative, size, percent, scratch, "near")
    groups = components(links, "groups")
    scratch.drop("shared", "first", "pairs-near", "contents-near")

    # the matrix: units of a token's sets and groups
    rows = scratch.write(_asked(listed, groups, percent, scratch), "asked")
    scratch.drop("listed")
    coarse, fine = (bins.select("set", F.col(c).alias("bins")) for c in ("coarse", "fine"))
    for turn in range(ROUNDS):
        opened = scratch.write(_opened(rows, groups, fine if turn else coarse, percent, scratch, f"opened-{turn}"), f"opened-{turn}")
        rows = opened.select("token", "set", "n", "rest").distinct()
        if opened.isEmpty():
            break
        best = opened.groupBy("set").agg(F.max_by("best", F.struct("score", "best")).alias("best"))
        pairs = best.select(F.least("set", "best").alias("a"), F.greatest("set", "best").alias("b")).distinct()
        new = _verified(docs, pairs, representative, size, percent, scratch, f"round-{turn}")
        if new.isEmpty():
            break
        links = links.union(new)
        groups = components(links, f"groups-{turn}")
    if not rows.isEmpty():
        new = _verified(docs, _left_over(rows, groups, fine, percent, scratch), representative, size, percent, scratch, "left")
        if not new.isEmpty():
            groups = components(links.union(new), "joined")
    scratch.drop("asked")
    return found.select("doc", "key", "set", "n"), groups.select(F.col("node").alias("set"), F.col("label").alias("component"))


def _least_of(found: DataFrame, merged: DataFrame, what: Column) -> DataFrame:
    """set and the least value of `what` in its component, for the sets of documents with an id."""
    per_set = found.where(F.col("set").isNotNull() & F.col("doc").isNotNull()).groupBy("set").agg(F.min(what).alias("least"))
    # one component may hold a third of all sets: its least value is counted up map-side and dealt out salted
    per_component = per_set.join(merged, "set").groupBy("component").agg(F.min("least").alias("all"))
    salted = per_component.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked_sets = merged.withColumn("_salt", F.pmod(F.xxhash64("set"), F.lit(SALTS)).cast("int")).join(salted, ["component", "_salt"]).select("set", "all")
    return per_set.join(linked_sets, "set", "left").select("set", F.coalesce("all", "least").alias("least"))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc, n_shingles, component_id (the least document reachable by links, itself included).

    A row without id has the least id of its component too, and null where none has an id; rows with equal ids each
    have their result.
    """
    found, merged = join(docs, id_col, text_col, **options)
    # written, so that a set of very many documents can be split in this join
    least = Scratch(docs.sparkSession, "jaccard-least").write(_least_of(found, merged, F.col("doc")), "least")
    out = found.join(least, "set", "left")
    return out.select("doc", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document, in the form of query op3."""
    return labelled(docs.select("doc_id", "text")).withColumnRenamed("doc", "doc_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with its columns: the least id, and of its texts that of the least hash.

    Of equal rows (id and text) one stays; rows with one id and different texts are documents of their own. Rows
    without id, and those with an empty set, stay.
    """
    names = fresh_names(docs, ["_doc", "_key", "_nth"])
    found, merged = join(docs, id_col, text_col, **options)
    least = _least_of(found, merged, F.struct("doc", "key")).select("least.*")
    empty = found.where(F.col("set").isNull() & F.col("doc").isNotNull()).select("doc", "key")
    kept = least.union(empty).select(F.col("doc").alias(names[0]), F.col("key").alias(names[1])).distinct()
    same = (F.col(id_col) == F.col(names[0])) & (F.xxhash64(text_col) == F.col(names[1]))
    rows = docs.join(kept, same, "left_semi")
    again = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.lit(0))
    rows = rows.withColumn(names[2], F.row_number().over(again)).where(F.col(names[2]) == 1).drop(names[2])
    return rows.unionByName(docs.where(F.col(id_col).isNull()))


REPORT_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, s, s + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM words UNION SELECT r.doc_id, l.b FROM reach r JOIN edges l ON r.other = l.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, r.component_id
FROM words w LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON w.doc_id = r.doc_id
"""
