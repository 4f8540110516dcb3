"""Lexical retrieval from a stored inverted index: matching, cover density and top-k, block of chunks by block.

The index has a row for each block of chunks and word: the word's places in that block as two packed arrays in order of
chunk and place, and `best`, the most places in one chunk. A search reads the rows of asked words only, brings those of
a block together, and answers all questions on a block before the next one: rarest words first, so that most blocks end
at an empty intersection; blocks whose best possible score is below a question's k-th best so far are skipped. Only
the best chunks of a task leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundspark.functions.cutting import letters_and_digits
from groundspark.functions.text import STOP_WORDS
from groundspark.operators.lexical import chunk_text, fallback_words, query_terms
from groundspark.operators.vectors import Nearest, question_blocks, vector_ids
from groundspark.sources.scratch import written

#: Chunks of a block, and questions that a search answers with one reading of the index: few at a time, and many.
BLOCK_CHUNKS, QUESTION_BLOCK, MANY = 2048, 50_000, 400_000
#: Questions up to which full matches and fallback are found in one pass; of more, only those that match nothing fall back.
TOGETHER = 500
#: Needed words of a question that are looked up in all blocks at once, questions that this is done for in one step, and found
#: chunks up to which places are cut out of a block's lists.
NEEDED, STEP, FEW = 24, 20_000, 16
#: Pairs of a question and a chunk that are scored in one step.
PAIRS = 50_000
#: The row of a block that lists its chunks, and the one that lists those that filters keep; no word is like these.
IDS, KEPT = "", "-"
INDEX = "block long, term string, best int, chunks array<int>, places array<int>, ids array<string>"
_PLACE, _SHORT_PLACE = 32, 31


def _packed(block: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The index rows of a block."""
    order = pa.array(np.argsort(np.array(ids.to_pylist(), object), kind="stable"))
    ids = ids.take(order)
    words, sizes = letters_and_digits(texts.take(order))
    coded = words.dictionary_encode()
    terms = coded.dictionary
    used = pc.sort_indices(terms).to_numpy()
    used = used[~pc.is_in(terms, value_set=_STOPS).to_numpy(zero_copy_only=False)[used]]
    rank = np.full(len(terms), -1)
    rank[used] = np.arange(len(used))
    term = rank[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64)
    chunk = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    place = (np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    keep = np.flatnonzero(term >= 0)
    keep = keep[np.argsort(term[keep].astype(np.uint16 if len(used) < 1 << 16 else np.int64), kind="stable")]  # short keys are sorted by their digits
    term, chunk, place = term[keep], chunk[keep], place[keep]
    starts = np.searchsorted(term, np.arange(len(used) + 1))
    best = np.zeros(0, np.int32)
    if len(term):
        same = np.flatnonzero(np.diff(term.astype(np.int64) << 32 | chunk, prepend=-1))  # first place of each (term, chunk)
        best = np.maximum.reduceat(np.diff(same, append=len(term)), np.searchsorted(term[same], np.arange(len(used))))
    n = len(used) + 1
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(0, starts), pa.int32()), pa.array(values))
    own = pa.ListArray.from_arrays(pa.array(np.append(0, np.full(n, len(ids))), pa.int32()), ids.cast(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.concat_arrays([pa.array([IDS], pa.string()), terms.take(pa.array(used)).cast(pa.string())]), pa.array(np.append(0, best).astype(np.int32)), lists(chunk), lists(place), own], names=["block", "term", "best", "chunks", "places", "ids"])


_STOPS = pa.array(STOP_WORDS)


def build_index(chunks: DataFrame, block: int = BLOCK_CHUNKS) -> DataFrame:
    """INDEX of chunks (chunk_id, title, text), whose ids are unique; nothing is shuffled. ids are in the row IDS only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                rows += held[-1].num_rows
                while rows >= block:
                    both = pa.Table.from_batches(held).combine_chunks()
                    yield _packed(number, *(c.combine_chunks() for c in both.slice(0, block).columns))
                    number, held, rows = number + 1, both.slice(block).to_batches(), rows - block
        if rows:
            yield _packed(number, *(c.combine_chunks() for c in pa.Table.from_batches(held).columns))

    return chunks.select("chunk_id", chunk_text()).mapInArrow(run, INDEX)


def stored_index(chunks: DataFrame, block: int = BLOCK_CHUNKS) -> DataFrame:
    """The index written once, each file in order of words."""
    return written(build_index(chunks, block).sortWithinPartitions("term"), "index")


@dataclass
class Asked:
    """A question: groups of alternatives that must match, excluded parts, words that score, words of the fallback. A part
    is a list of (place, word)."""

    groups: dict[int, list[list[tuple[int, str]]]] = field(default_factory=dict)
    excluded: list[list[tuple[int, str]]] = field(default_factory=list)
    wanted: list[str] = field(default_factory=list)
    loose: list[str] = field(default_factory=list)


def _parsed(ids: list, terms: pa.Table, loose: pa.Table) -> list[Asked]:
    at = {q: k for k, q in enumerate(ids)}
    out, parts = [Asked() for _ in ids], {}
    for r in terms.to_pylist():
        parts.setdefault((at[r["question_id"]], r["grp"], r["n"], r["kind"]), []).append((r["place"], r["term"]))
    for (k, grp, _, kind), words in sorted(parts.items()):
        if kind == "not":
            out[k].excluded.append(words)
        else:
            out[k].groups.setdefault(grp, []).append(words)
            out[k].wanted.extend(w for _, w in words)
    for q in out:
        q.wanted = list(dict.fromkeys(q.wanted))
    for r in loose.to_pylist():
        out[at[r["question_id"]]].loose.append(r["term"])
    return out


class Block:
    """The asked words of one block of chunks; chunks are numbers in order of their ids."""

    def __init__(self) -> None:
        self.ids: list[str] = []
        self.kept: np.ndarray | None = None
        self.places: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.best: dict[str, int] = {}
        self.holders: dict[str, np.ndarray] = {}

    def holding(self, term: str) -> np.ndarray:
        if term not in self.holders:
            self.holders[term] = np.unique(self.places[term][0])
        return self.holders[term]

    def within(self, term: str, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """A word's chunks and places, of a few chunks (in order) only theirs."""
        chunks, places = self.places[term]
        if among is None or len(among) > FEW:
            return chunks, places
        ends = zip(np.searchsorted(chunks, among).tolist(), np.searchsorted(chunks, among, "right").tolist(), strict=True)
        cuts = [slice(a, z) for a, z in ends if z > a]
        if len(cuts) == 1:
            return chunks[cuts[0]], places[cuts[0]]
        return (np.concatenate([chunks[c] for c in cuts]), np.concatenate([places[c] for c in cuts])) if cuts else (_NONE, _NONE)

    def part(self, words: list[tuple[int, str]], among: np.ndarray | None = None) -> np.ndarray:
        """Chunks, all or some of those given, with a word, or with words at their distances from one another."""
        if any(w not in self.places for _, w in words):
            return _NONE
        if len(words) == 1:
            return self.holding(words[0][1])
        found = None
        for place, word in sorted(words, key=lambda x: len(self.places[x[1]][0])):
            chunks, places = self.within(word, among)
            keys = (chunks.astype(np.int64) << _PLACE) + places - place + (1 << 31)
            found = keys if found is None else np.intersect1d(found, keys, assume_unique=True)
            if not len(found):
                return _NONE
        return np.unique((found >> _PLACE).astype(np.int32))

    def matches(self, q: Asked, among: np.ndarray | None = None) -> np.ndarray:
        """Chunks, of those given, where every group has a part and no excluded part is."""
        size = lambda parts: sum(min(len(self.places[w][0]) if w in self.places else 0 for _, w in p) for p in parts)
        found = among
        for parts in sorted(q.groups.values(), key=size):
            own = self.part(parts[0], among)
            for p in parts[1:]:
                own = np.union1d(own, self.part(p, among))
            found = own if found is None else np.intersect1d(found, own, assume_unique=True)
            if not len(found):
                return _NONE
        for p in q.excluded if found is not None else ():
            found = np.setdiff1d(found, self.part(p, among), assume_unique=True)
        return _NONE if found is None else found

    def covers(self, q: Asked, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks, of those given, with a positive score, and the score: the sum over minimal covers of 1 / (1 + words
        between). A cover is the shortest stretch with all words that ends at a place and begins as late as possible."""
        if not len(chunks) or any(w not in self.places for w in q.wanted):
            return _NONE, np.zeros(0)
        mask = np.zeros(len(self.ids), bool)
        mask[chunks] = True
        keys, owner = [], []
        for k, word in enumerate(q.wanted):
            chunk, place = self.within(word, chunks)
            own = mask[chunk]
            keys.append((chunk[own].astype(np.int64) << _PLACE) + place[own])
            owner.append(np.full(len(keys[-1]), k))
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        left = np.full(len(keys), np.iinfo(np.int64).max)
        for k in range(len(q.wanted)):  # last place of each word so far; the least of them is the left end
            left = np.minimum(left, np.maximum.accumulate(np.where(owner == k, keys, -1)))
        chunk = keys >> _PLACE
        first = (left >> _PLACE == chunk) & (left > np.append(-1, left[:-1]))  # a new left end within the chunk
        gap = np.maximum(0, keys - left + 1 - len(q.wanted))
        score = np.bincount(chunk[first], 1 / (1 + gap[first]), minlength=len(self.ids))
        found = np.flatnonzero(score > 0)
        return found.astype(np.int32), score[found]

    def counts(self, q: Asked) -> tuple[np.ndarray, np.ndarray]:
        """Chunks with any word of the fallback, and how many places those have."""
        there = [self.places[w][0] for w in q.loose if w in self.places]
        if not there:
            return _NONE, np.zeros(0)
        n = np.bincount(np.concatenate(there), minlength=len(self.ids))
        found = np.flatnonzero(n)
        return found.astype(np.int32), n[found].astype(float)


_NONE = np.zeros(0, np.int32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks from rows in order of block."""
    number, block = None, Block()
    for batch in batches:
        numbers, terms, best = (batch.column(i).to_pylist() for i in range(3))
        for i, (n, term) in enumerate(zip(numbers, terms, strict=True)):
            if n != number:
                if number is not None:
                    yield block
                number, block = n, Block()
            if term == IDS:
                block.ids = batch.column(5)[i].as_py()
            elif term == KEPT:
                block.kept = batch.column(3)[i].values.to_numpy()
            else:
                block.places[term] = (batch.column(3)[i].values.to_numpy(), batch.column(4)[i].values.to_numpy())
                block.best[term] = best[i]
    if number is not None:
        yield block


class Best:
    """The k-th best score of every question among those seen; without k none is ever too low."""

    def __init__(self, pool: int | None, n: int) -> None:
        self.pool, self.floor, self.held = pool, np.full(n, -np.inf), {}

    def chosen(self, k: int, chunks: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a block's chunks those that may be among the best: by rounded score, equal ones in order of their number."""
        if self.pool is None:
            return chunks, scores
        rough = np.round(scores, 9)
        some = np.flatnonzero(rough >= self.floor[k])
        some = some[np.lexsort((chunks[some], -rough[some]))][: self.pool]
        both = np.append(self.held.get(k, ()), rough[some])
        if len(both) >= self.pool:
            both = np.partition(both, len(both) - self.pool)[-self.pool :]
            self.floor[k] = both.min()
        self.held[k] = both
        return chunks[some], scores[some]


def answered(asked: list[Asked], blocks: Iterator[Block], pool: int | None, scored: bool, filtered: bool) -> Iterator[tuple[int, list, np.ndarray | None, bool]]:
    """(question's number, chunk ids, scores, strict) for each question and block. strict: all groups match. A question that
    has matched anywhere has a strict entry, perhaps without chunks. Without `scored`, matches only."""
    strict, loose, seen = Best(pool, len(asked)), Best(pool, len(asked)), set()
    for block in blocks:
        kept = np.isin(np.arange(len(block.ids)), block.kept) if filtered and block.kept is not None else np.full(len(block.ids), not filtered)

        def ranked(best: Best, k: int, chunks: np.ndarray, scores: np.ndarray, block=block, kept=kept) -> tuple[list[str], np.ndarray]:
            chunks, scores = best.chosen(k, chunks[kept[chunks]], scores[kept[chunks]])
            return [block.ids[c] for c in chunks], scores

        for k, q in enumerate(asked):
            # a cover has a place of every word, and each new one another left end
            most = sum(block.best.get(w, 0) for w in q.wanted) - len(q.wanted) + 1
            if (k not in seen or most >= strict.floor[k] - 1e-9) and len(found := block.matches(q)):
                if not scored:
                    yield k, [block.ids[c] for c in found], None, True
                    continue
                chunks, scores = ranked(strict, k, *block.covers(q, found))
                if k not in seen or chunks:
                    yield k, chunks, scores, True
                seen.add(k)
            if scored and k not in seen and sum(block.best.get(w, 0) for w in q.loose) >= max(1, loose.floor[k] - 1e-9):
                chunks, scores = ranked(loose, k, *block.counts(q))
                if chunks:
                    yield k, chunks, scores, False


@dataclass
class Needs:
    """What questions need at least, as numbers of words: `need` has a row for each question, the rarest words first, filled up
    with the number after the last word, which every chunk has. `plain` questions have groups of one part, each a word or one
    of the phrases (words and their places, filled up with -1), and exclude nothing; they are matched all at once."""

    number: dict[str, int]
    terms: list[str]
    need: np.ndarray
    plain: np.ndarray
    wanted: np.ndarray
    sizes: np.ndarray
    phrases: np.ndarray
    shifts: np.ndarray
    n_phrases: np.ndarray
    grouped: np.ndarray


def _needs(asked: list[Asked], words: list[str]) -> Needs:
    number = {w: k for k, w in enumerate(words)}
    rows = [(k, grp, n, place, number[w]) for k, q in enumerate(asked) for grp, parts in q.groups.items() for n, part in enumerate(parts) for place, w in part]
    return _gathered(len(asked), *np.array(rows, np.int64).reshape(-1, 5).T, np.array([bool(q.excluded) for q in asked], bool), words)


def _needs_of_terms(ids: pa.Array, terms: pa.Table) -> tuple[Needs, dict[int, Asked]]:
    """Needs of questions from the rows of query_terms, and the questions that aren't plain by number."""
    column = lambda name: terms[name].combine_chunks()
    coded = column("term").dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    words = coded.dictionary.take(order).to_pylist()
    number = np.zeros(len(words), np.int64)
    number[order.to_numpy()] = np.arange(len(words))
    question = pc.index_in(column("question_id"), value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
    excluding = pc.equal(column("kind"), "not").to_numpy(zero_copy_only=False).astype(bool)
    excludes = np.zeros(len(ids), bool)
    excludes[question[excluding]] = True
    rows = [column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("grp", "n", "place")]
    needs = _gathered(len(ids), *(x[~excluding] for x in (question, *rows, number[coded.indices.to_numpy()])), excludes, words)
    other = np.flatnonzero(~needs.plain)
    parsed = _parsed(ids.take(pa.array(other)).to_pylist(), terms.filter(pa.array(~needs.plain[question])), pa.table({"question_id": [], "term": []}))
    return needs, dict(zip(other.tolist(), parsed, strict=True))


def _gathered(n: int, question: np.ndarray, grp: np.ndarray, part: np.ndarray, place: np.ndarray, word: np.ndarray, excludes: np.ndarray, words: list[str]) -> Needs:
    """Needs of n questions from their words (by number) with group, part and place, but for excluded parts."""
    order = np.lexsort((place, part, grp, question))
    question, grp, part, place, word = (x[order] for x in (question, grp, part, place, word))
    n_words, changed = max(1, len(words)), lambda *columns: np.append(True, np.any([np.diff(c) != 0 for c in columns], axis=0))[: len(question)]
    of_part, of_group = np.cumsum(changed(question, grp, part)) - 1, np.cumsum(changed(question, grp)) - 1
    first = np.flatnonzero(np.diff(of_part, prepend=-1))
    single = np.bincount(of_group[first])[of_group] == 1
    plain = ~excludes
    plain[question[~single]] = False
    pairs = np.unique(question * n_words + word)
    owner, own = np.divmod(np.unique((question * n_words + word)[single]), n_words)
    common, sizes = np.bincount(own, minlength=n_words), np.bincount(owner, minlength=n)
    order = np.lexsort((common[own], owner))  # the rarest words of a question first
    owner, own = owner[order], own[order]
    at = np.arange(len(own)) - (np.cumsum(sizes) - sizes)[owner]
    need = np.full((n, max(1, min(NEEDED, sizes.max(initial=0)))), len(words), np.int32)
    need[owner[at < NEEDED], at[at < NEEDED]] = own[at < NEEDED]
    plain &= sizes <= NEEDED
    rows = np.flatnonzero((np.bincount(of_part)[of_part] > 1) & plain[question])
    rows = rows[np.lexsort((common[word[rows]], of_part[rows]))]  # the first one's places are tried
    phrase = np.cumsum(np.diff(of_part[rows], prepend=-1) != 0) - 1
    begins = np.flatnonzero(np.diff(phrase, prepend=-1))
    at = np.arange(len(rows)) - begins[phrase]
    phrases, shifts = (np.full((len(begins), max(2, at.max(initial=0) + 1)), -1, np.int64) for _ in range(2))
    phrases[phrase, at], shifts[phrase, at] = word[rows], place[rows]
    return Needs(
        {w: k for k, w in enumerate(words)}, words, need, plain, pairs % n_words, np.bincount(pairs // n_words, minlength=n), phrases, shifts,
        np.bincount(question[rows[begins]], minlength=n), np.bincount(question, minlength=n) > 0,
    )


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start up to its end, and of which row they are."""
    n = ends - starts
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + starts[row], row


class _Lists:
    """A block's places by word."""

    def __init__(self, number: dict[str, int], row: np.ndarray, ends: np.ndarray, chunks: np.ndarray, places: np.ndarray) -> None:
        self.number, self.row, self.ends, self.chunks, self.places = number, row, ends, chunks, places

    def __contains__(self, term: str) -> bool:
        return self.row[self.number[term]] >= 0

    def __getitem__(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        k = self.row[self.number[term]]
        own = slice(self.ends[k], self.ends[k + 1])
        return self.chunks[own], self.places[own]


class FlatBlock(Block):
    """A block whose lists stay in one piece, with a line of bits for each word: the chunks that have it. It answers for all
    questions at once."""

    def __init__(self, rows: pa.Table, needs: Needs) -> None:
        super().__init__()
        terms = rows["term"].combine_chunks()
        special = pc.is_in(terms, value_set=pa.array([IDS, KEPT]))
        for r in rows.filter(special).to_pylist():
            if r["term"] == IDS:
                self.ids = r["ids"]
            else:
                self.kept = np.array(r["chunks"], np.int32)
        rows = rows.filter(pc.invert(special))
        term = pc.index_in(rows["term"].combine_chunks(), value_set=pa.array(needs.terms, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
        lists = rows["chunks"].combine_chunks()
        chunks, places = lists.flatten().to_numpy(), rows["places"].combine_chunks().flatten().to_numpy()
        ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
        n, width = len(needs.terms), -(-max(1, len(self.ids)) // 64) * 8
        row = np.full(n + 1, -1)
        row[term] = np.arange(len(term))
        row[n] = len(term)
        self.places, self.row = _Lists(needs.number, row, ends, chunks, places), row
        self.most = np.zeros(n, np.int64)
        self.most[term] = rows["best"].to_numpy()
        self.bits = np.zeros((len(term) + 1, width), np.uint8)
        self.bits[-1] = 255
        of = np.repeat(np.arange(len(term)), np.diff(ends))
        self.keys = (of * max(1, len(self.ids)) + chunks << _SHORT_PLACE) + places  # of all places, in order
        byte = of * width + (chunks >> 3)
        if len(byte):  # lists are in order of chunk, so the places of a byte are next to each other
            first = np.flatnonzero(np.diff(byte, prepend=-1))
            self.bits.reshape(-1)[byte[first]] = np.bitwise_or.reduceat((1 << (chunks & 7)).astype(np.uint8), first)
        # where the places of a word in a chunk begin: as many chunks as have bits before it in all lines
        ones = np.bitwise_count(self.bits[:-1]).reshape(-1)
        self.before = np.cumsum(ones, dtype=np.int32) - ones
        self.begins = np.append(np.flatnonzero(np.diff(self.keys >> _SHORT_PLACE, prepend=-1)), len(self.keys))

    def candidates(self, needs: Needs, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Questions, of some, and chunks that have all of their needed words, in this order."""
        there, found = self.row >= 0, [(_NONE, _NONE)]
        for k in range(needs.need.shape[1]):
            some = some[there[needs.need[some, k]]]
        for at in range(0, len(some), STEP):
            own = some[at : at + STEP]
            held = self.bits[self.row[needs.need[own, 0]]]
            for k in range(1, needs.need.shape[1]):
                held &= self.bits[self.row[needs.need[own, k]]]
                left = held.any(1)
                own, held = own[left], held[left]
            eights = np.ascontiguousarray(held).view(np.uint64)
            question, eight = np.nonzero(eights)
            of, bit = np.nonzero(np.unpackbits(eights[question, eight].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            chunk = eight[of] * 64 + bit
            there = chunk < len(self.ids)
            found.append((own[question[of[there]]], chunk[there].astype(np.int32)))
        return np.concatenate([q for q, _ in found]), np.concatenate([c for _, c in found])

    def lists(self, term: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the places of words in chunks begin and end among all keys."""
        row = self.row[term]
        at = np.where(row < 0, len(self.bits) - 2, row) * self.bits.shape[1] + (chunk >> 3)
        bit = (1 << (chunk & 7)).astype(np.uint8)
        line = np.where(row < 0, 0, self.bits.reshape(-1)[at])
        first = self.before[at] + np.bitwise_count(line & (bit - 1))
        return self.begins[first], self.begins[first + (line & bit > 0)]

    def with_phrases(self, needs: Needs, question: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """Whether chunks have all phrases of their plain questions."""
        ends = np.cumsum(needs.n_phrases)
        phrase, pair = _spans(ends[question] - needs.n_phrases[question], ends[question])
        out = np.ones(len(question), bool)
        if not len(phrase):
            return out
        at, item = _spans(*self.lists(needs.phrases[phrase, 0], chunk[pair]))
        place = (self.keys[at] & (1 << _SHORT_PLACE) - 1) - needs.shifts[phrase[item], 0]
        for j in range(1, needs.phrases.shape[1]):
            word, due = needs.phrases[phrase[item], j], place + needs.shifts[phrase[item], j]
            key = (self.row[word] * max(1, len(self.ids)) + chunk[pair[item]] << _SHORT_PLACE) + due
            there = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
            ok = (word < 0) | (due >= 0) & there
            item, place = item[ok], place[ok]
        held = np.zeros(len(phrase), bool)
        held[item] = True
        out[pair[~held]] = False
        return out

    def all_covers(self, needs: Needs, question: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """covers() of many pairs of a question and a chunk that has all of its words."""
        score, ends = np.zeros(len(question)), np.cumsum(needs.sizes)
        for n in np.unique(needs.sizes[question]).tolist():
            pairs = np.flatnonzero(needs.sizes[question] == n)
            if n == 1:  # each place is a cover
                begins, after = self.lists(needs.wanted[ends[question[pairs]] - 1], chunk[pairs])
                score[pairs] = after - begins
                continue
            for own in np.split(pairs, range(PAIRS, len(pairs), PAIRS)):
                words = needs.wanted[(ends[question[own]] - n)[:, None] + np.arange(n)]
                at, item = _spans(*self.lists(words.ravel(), np.repeat(chunk[own], n)))
                keys = (item // n << _PLACE) + (self.keys[at] & (1 << _SHORT_PLACE) - 1)
                order = np.argsort(keys)
                keys, owner = keys[order], item[order] % n
                left = np.full(len(keys), np.iinfo(np.int64).max)
                for k in range(n):
                    left = np.minimum(left, np.maximum.accumulate(np.where(owner == k, keys, -1)))
                pair = keys >> _PLACE
                first = (left >> _PLACE == pair) & (left > np.append(-1, left[:-1]))
                gap = np.maximum(0, keys - left + 1 - n)
                score[own] = np.bincount(pair[first], 1 / (1 + gap[first]), minlength=len(own))
        return score


def _flat_blocks(batches: Iterator[pa.RecordBatch], needs: Needs) -> Iterator[FlatBlock]:
    """Blocks from rows in order of block."""
    number, held = None, []
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, z in zip(ends, ends[1:], strict=False):
            if z > a and blocks[a] != number:
                if held:
                    yield FlatBlock(pa.Table.from_batches(held), needs)
                number, held = blocks[a], []
            if z > a:
                held.append(batch.slice(a, z - a))
    if held:
        yield FlatBlock(pa.Table.from_batches(held), needs)


def strict_answers(asked: list[Asked] | dict[int, Asked], needs: Needs, blocks: Iterator[FlatBlock], pool: int, filtered: bool) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
    """Questions' numbers, chunk ids and scores of full matches: at the end the best of all blocks, before that an entry without
    a chunk for those that only chunks match that filters leave out. asked: the questions that aren't plain, at least."""
    best, seen = Nearest(pool, len(needs.need)), np.zeros(len(needs.need), bool)
    ends = np.cumsum(needs.sizes)
    for block in blocks:
        kept = np.isin(np.arange(len(block.ids)), block.kept) if filtered and block.kept is not None else np.full(len(block.ids), not filtered)
        sums, floor = np.append(0, np.cumsum(block.most[needs.wanted])), best.floor
        most = sums[ends] - sums[ends - needs.sizes] - needs.sizes + 1
        question, chunk = block.candidates(needs, np.flatnonzero(needs.grouped & (~seen | (most >= floor - 1e-9))))
        plain = needs.plain[question]
        other, pairs = question[~plain], [(question[plain], chunk[plain])]
        full = block.with_phrases(needs, *pairs[0])
        pairs[0] = tuple(x[full] for x in pairs[0])
        for q, among in zip(np.unique(other).tolist(), np.split(chunk[~plain], np.flatnonzero(np.diff(other)) + 1), strict=False):
            found = block.matches(asked[q], among)
            pairs.append((np.full(len(found), q), found))
        question, chunk = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if not len(question):
            continue
        score = block.all_covers(needs, question, chunk)
        some = np.flatnonzero(kept[chunk] & (score > 0) & (np.round(score, 9) >= floor[question]))
        bare = np.unique(question[~seen[question]])  # matched for the first time
        seen[question] = True
        bare = bare[~np.isin(bare, question[some])]
        best.wait(question[some], score[some], vector_ids(pa.array(block.ids, pa.string()))[chunk[some]])
        if best.held > max(PAIRS, len(best.question)):
            best.settle()
        if len(bare):
            yield bare, pa.nulls(len(bare), pa.string()), pa.nulls(len(bare), pa.float64())
    found = best.batch(pa.array(np.arange(len(seen))))
    yield found.column(0).to_numpy(), found.column(1), found.column(2)


def _kept(index: DataFrame, keep: DataFrame) -> DataFrame:
    """A row KEPT for each block with the numbers of the chunks that are kept."""
    there = index.where(F.col("term") == IDS).select("block", F.posexplode("ids").alias("at", "chunk_id")).join(keep.select("chunk_id"), "chunk_id", "left_semi")
    rows = there.groupBy("block").agg(F.collect_list("at").alias("chunks"))
    return rows.select("block", F.lit(KEPT).alias("term"), F.lit(0).alias("best"), "chunks", F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("ids"))


def _found(questions: DataFrame, index: DataFrame, pool: int | None, keep: DataFrame | None = None, scored: bool = True, block: int = QUESTION_BLOCK) -> DataFrame:
    """question_id, chunk_id, lex_score, strict, as answered() tells."""
    out = None
    rows = index if keep is None else index.unionByName(_kept(index, keep))
    many = scored and pool is not None and questions.limit(TOGETHER + 1).count() > TOGETHER
    for some in question_blocks(questions, ["question_id", "question"], max(block, MANY) if many else block):
        if many:
            part = written(_answers(some, rows, pool, keep is not None, True, True), "strict")
            left = written(some.join(part.select("question_id").distinct(), "question_id", "left_anti"), "left")
            for few in question_blocks(left, ["question_id", "question"], block) if not left.isEmpty() else ():
                part = part.unionByName(_answers(few, rows, pool, keep is not None, True))
        else:
            part = _answers(some, rows, pool, keep is not None, scored)
        out = part if out is None else out.unionByName(part)
    return out


def _answers(questions: DataFrame, rows: DataFrame, pool: int | None, filtered: bool, scored: bool, strict: bool = False) -> DataFrame:
    """_found of one block of questions; `strict`: full matches only, of many questions."""
    spark, kind = questions.sparkSession, dict(questions.dtypes)["question_id"]
    ids = questions.select("question_id").distinct().toArrow()["question_id"].combine_chunks()
    terms, needs = query_terms(questions).toArrow(), None
    if strict:
        needs, asked = _needs_of_terms(ids, terms)
        words = needs.terms
    else:
        loose = questions.select("question_id", F.explode(fallback_words(F.col("question"))).alias("term")).where(~F.col("term").isin(STOP_WORDS))
        asked = _parsed(ids.to_pylist(), terms, loose.toArrow())
        words = sorted({w for q in asked for w in (*q.wanted, *q.loose, *(w for p in q.excluded for _, w in p))})
    # the words of one block of questions
    needed = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array([*words, IDS, KEPT], pa.string())})))
    sent = spark.sparkContext.broadcast((ids, asked, needs))

    def batch(ids: pa.Array, which: np.ndarray, chunks: pa.Array, scores: pa.Array, strict: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(which)), chunks, scores, pa.array(np.full(len(which), strict))], names=["question_id", "chunk_id", "lex_score", "strict"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, needs = sent.value
        if needs is not None:
            for found in strict_answers(asked, needs, _flat_blocks(batches, needs), pool, filtered):
                yield batch(ids, *found, True)
        else:
            for k, chunks, scores, full in answered(asked, _blocks(batches), pool, scored, filtered):
                n = max(1, len(chunks))
                yield batch(ids, np.full(n, k), pa.array(chunks or [None], pa.string()), pa.array(scores if scores is not None and len(scores) else [None] * n, pa.float64()), full)

    own = rows.join(needed, "term", "left_semi").select("block", "term", "best", "chunks", "places", "ids")
    # a number of its own, for little data isn't little work here
    return own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block").mapInArrow(run, f"question_id {kind}, chunk_id string, lex_score double, strict boolean")


def matched(questions: DataFrame, index: DataFrame) -> DataFrame:
    """D3: question_id, chunk_id where every group of a web-style question has a part that matches, and no excluded part
    does. A part is a word, or the words of a phrase (or of one hyphenated word) next to each other."""
    return _found(questions, index, None, scored=False).select("question_id", "chunk_id")


def cover_density(questions: DataFrame, index: DataFrame) -> DataFrame:
    """question_id, chunk_id, lex_score of all chunks: for full matches the sum over minimal covers of 1 / (1 + words
    between); for questions that nothing matches, the number of places of their fallback words."""
    return _decided(_found(questions, index, None)).select("question_id", "chunk_id", "lex_score")


def _decided(found: DataFrame) -> DataFrame:
    """Fallback rows go where a question has a full match anywhere."""
    any_strict = F.max("strict").over(Window.partitionBy("question_id"))
    return found.withColumn("_any", any_strict).where((F.col("strict") == F.col("_any")) & F.col("chunk_id").isNotNull())


def search(questions: DataFrame, index: DataFrame, pool: int, keep: DataFrame | None = None, block: int = QUESTION_BLOCK) -> DataFrame:
    """question_id, chunk_id, lex_score, rank: the best `pool` chunks of each question by score, equal ones by
    chunk_id. keep (chunk_id) filters what is ranked, but not which questions fall back."""
    found = _found(questions, index, max(pool, 1), keep, block=block)
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("lex_score", 9)), "chunk_id")
    best = _decided(found).select("question_id", "chunk_id", "lex_score", F.row_number().over(order).alias("rank"))
    return best.where(F.col("rank") <= pool)
