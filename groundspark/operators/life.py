"""The life cycle of curated answers as a fold of small tables.

An event is a table: for each status before it, the status after it and whether it was accepted. Tables compose, so events
are composed slice by slice of ranges of id and order, and then the slices of an id: no task holds all events of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("", "pending", "approved", "rejected", "revoked", "quarantined")
KINDS = ("submit", "approve", "reject", "revoke", "quarantine")
_NONE, _PENDING, _APPROVED, _REJECTED, _REVOKED, _QUARANTINED = range(len(STATUSES))


def _after(kind: str, eyes: bool, status: int) -> int | None:
    """Status behind an event; None if it is refused."""
    if kind == "submit":
        return _PENDING if status == _NONE else None
    if kind == "approve":
        return _APPROVED if status == _APPROVED or status != _NONE and eyes else None
    if kind == "reject":
        return None if status in (_NONE, _APPROVED) else _REVOKED if status == _REVOKED else _REJECTED
    return {"revoke": _REVOKED, "quarantine": _QUARANTINED}[kind] if status == _APPROVED else None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For event number 2 * kind + eyes (the last two: other kinds) and each status: status after it, and 1 if accepted."""
    to = np.tile(np.arange(len(STATUSES)), (2 * len(KINDS) + 2, 1))
    accepted = np.zeros_like(to)
    for k, kind in enumerate(KINDS):
        for eyes in (0, 1):
            for s in range(len(STATUSES)):
                after = _after(kind, bool(eyes), s)
                if after is not None:
                    to[2 * k + eyes, s], accepted[2 * k + eyes, s] = after, 1
    return to, accepted


_TO, _ACCEPTED = _tables()


def composed(ids: np.ndarray, to: np.ndarray, accepted: np.ndarray, events: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One row for each run of equal ids: its tables one after another, in rounds that halve each run.

    to, accepted: rows x statuses; events: how many events a row stands for."""
    while len(ids) > 1:
        first = np.append(True, ids[1:] != ids[:-1])
        place = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
        pairs = np.flatnonzero((place[1:] % 2 == 1) & ~first[1:])
        if not len(pairs):
            break
        after = to[pairs]
        accepted[pairs] += np.take_along_axis(accepted[pairs + 1], after, 1)
        to[pairs] = np.take_along_axis(to[pairs + 1], after, 1)
        events[pairs] += events[pairs + 1]
        keep = np.ones(len(ids), bool)
        keep[pairs + 1] = False
        ids, to, accepted, events = ids[keep], to[keep], accepted[keep], events[keep]
    return ids, to, accepted, events


def _fold(kind: str, final: bool):
    """Rows in order of id -> one row for each id of the partition: its composed table, or in the end status and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, width = TaskContext.get().partitionId(), None, len(STATUSES)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            if final:
                to, accepted = (np.array(batch.column(i).flatten(), np.int64).reshape(-1, width) for i in (1, 2))
                events = np.array(batch.column(3), np.int64)
            else:
                event = batch.column(1).to_numpy()
                to, accepted, events = _TO[event], _ACCEPTED[event], np.ones(len(event), np.int64)
            codes = ids.dictionary_encode(null_encoding="encode")
            names, number = codes.dictionary, codes.indices.to_numpy().astype(np.int64)
            if held is not None:
                same = names[number[0]].as_py() == held[0].as_py()
                at = number[0] if same else -1
                number, to, accepted, events = np.append(at, number), np.vstack([held[1], to]), np.vstack([held[2], accepted]), np.append(held[3], events)
            number, to, accepted, events = composed(number, to, accepted, events)
            names = [held[0] if k < 0 else names[k] for k in number]
            held = (names[-1], to[-1:], accepted[-1:], events[-1])
            if len(number) > 1:
                yield told(names[:-1], to[:-1], accepted[:-1], events[:-1], part)
        if held is not None:
            yield told([held[0]], held[1], held[2], np.array([held[3]]), part)

    def told(names: list, to: np.ndarray, accepted: np.ndarray, events: np.ndarray, part: int) -> pa.RecordBatch:
        ids = pa.array([x.as_py() for x in names], pa.int64() if kind in ("bigint", "long") else pa.int32() if kind == "int" else pa.string())
        if final:
            status = [STATUSES[s] for s in to[:, _NONE]]
            return pa.RecordBatch.from_arrays([ids, pa.array(status), pa.array(accepted[:, _NONE].astype(np.int32)), pa.array((events - accepted[:, _NONE]).astype(np.int32))], names=["id", "status", "accepted", "refused"])
        lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), t))
        return pa.RecordBatch.from_arrays([ids, lists(to, pa.int32()), lists(accepted, pa.int64()), pa.array(events), pa.array(np.full(len(ids), part, np.int32))], names=["id", "to", "accepted", "events", "slice"])

    return run


def sliced(events: DataFrame, four_eyes: bool = True, slices: int | None = None) -> DataFrame:
    """id, to, accepted, events, slice: the composed table of an id's events in each slice of ranges of id and order."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    eyes = F.lit(not four_eyes) | ((plain(F.col("approver")) != "") & (plain(F.col("approver")) != plain(F.col("author"))))
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i))), F.coalesce("kind", F.lit(""))), F.lit(len(KINDS)))
    order = ["id", "seq", "kind", "author", "approver"]
    n = slices or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", (2 * kind + eyes.cast("int")).cast("int").alias("event"))
    name = dict(events.dtypes)["id"]
    return dealt.mapInArrow(_fold(name, final=False), f"id {name}, to array<int>, accepted array<long>, events long, slice int")


def candidate_state(events: DataFrame, four_eyes: bool = True, slices: int | None = None) -> DataFrame:
    """I8: id, status, accepted, refused after all of a candidate's events (id, seq, kind, author, approver) in order of seq.

    Approving again changes nothing; with four eyes an approver must be named and not be the author; what is approved
    can't be rejected, only revoked. Events of unknown kinds are refused. Ids are whole numbers or strings."""
    parts, name = sliced(events, four_eyes, slices), dict(events.dtypes)["id"]
    own = parts.repartition("id").sortWithinPartitions("id", "slice").select("id", "to", "accepted", "events")
    return own.mapInArrow(_fold(name, final=True), f"id {name}, status string, accepted int, refused int")
