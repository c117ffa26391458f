"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens, dealt in grains of ``grain`` tokens; a
window (sequence) has ``window / grain`` slots.  Deficit round-robin serves, at
each slot, the queue that is furthest behind its target share; what a queue is
owed carries on to the next window.  In closed form the g-th grain of a queue
of weight w falls due at virtual time (2g + 1) / 2w, so its slot number is the
number of grains of all queues due before it (earlier names first at ties): a
range-partitioned sort of the grains ranks them, for any number of queues.

A task cuts its documents into grains as it tokenises them, once.  What is left
open at its end meets the rest of its source, which is cut again; the end of a
source (under ``grain`` tokens) falls due as its last grain and shares a grain
with the ends due next.  Only the last shared grain of each range is short, and
these are laid side by side in the final windows.

Defined cases: null and empty texts are the end id alone; a null source is a
queue of its own; documents of any length are cut freely; repeated rows are
packed as often as they occur; an empty table gives no row; other columns are
ignored.  ``targets`` maps sources to shares; the default is the share of each
source in the corpus, so that all queues run dry together; a source that
``targets`` leaves out comes last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_resident, shuffle_parts, stored
from .word_tokens import tokenizer

WINDOW, GRAIN, END_ID = 2048, 256, 1
OPEN = 4096  # sources with open grains a task holds
ROWS = 1500  # texts tokenised together
SHARES = 1 << 20
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
ROW = f"task int, queue string, grain long, at long, {PIECE}, ids binary"
PLACED = f"due double, lot string, at long, {PIECE}, queue string"
RANKED = f"part int, rank long, at long, {PIECE}, queue string"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
_SCHEMA, _PLACED = (pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in x.split(", ")]) for x in (ROW, PLACED))


class _Queue:
    __slots__ = ("fill", "number", "open")

    def __init__(self):
        self.number, self.fill, self.open = 0, 0, []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


class _Cutter:
    """Cuts token streams into grains; full grains become rows, and what is left over rows without a grain that carry their ids."""

    def __init__(self, task: int, grain: int):
        self.task, self.grain, self.queues, self.rows = task, grain, {}, []

    def add(self, name: str, doc: int | None, start: int, ids: bytes, total: int) -> None:
        q = self.queues.setdefault(name, _Queue())
        at, n = 0, len(ids) // 4
        while at < n:
            take = min(n - at, self.grain - q.fill)
            q.open.append((q.fill, doc, start + at, take, ids[4 * at: 4 * (at + take)], total))
            q.fill += take
            at += take
            if q.fill == self.grain:
                for where, d, first, k, x, whole in q.open:
                    self.rows.append((self.task, name, q.number, where, d, first, k, zlib.crc32(x), whole, None))
                q.number, q.fill, q.open = q.number + 1, 0, []

    def leave(self) -> None:
        """What is open is left over."""
        for name, q in self.queues.items():
            for where, doc, start, n, ids, total in q.open:
                self.rows.append((self.task, name, None, where, doc, start, n, zlib.crc32(ids), total, ids))
            q.fill, q.open = 0, []

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield _batch(self.rows)
            self.rows = []


def cut(model_file: str, grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = tokenizer(model_file), np.array([END_ID], "<u4").tobytes()
        cutter = _Cutter(TaskContext.get().partitionId(), grain)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = words.batch(part.column(2).to_pylist())
                for doc, source, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), ids, strict=True):
                    cutter.add("\x00null" if source is None else source, doc, 0, x + end, len(x) // 4 + 1)
                if sum(1 for q in cutter.queues.values() if q.open) > OPEN:
                    cutter.leave()
                yield from cutter.batches()
        cutter.leave()
        yield from cutter.batches()

    return run


def cut_left(grain: int, first: int):
    """Cuts what tasks left over, by source: rows sorted by queue, task and place.  Only the end of a source is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_resident()
        task, last, cutter = first + TaskContext.get().partitionId(), None, None
        for b in batches:
            for r in b.to_pylist():
                if r["queue"] != last:
                    if cutter:
                        cutter.leave()
                        yield from cutter.batches()
                    last, cutter = r["queue"], _Cutter(task, grain)
                cutter.add(r["queue"], r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
            if cutter:
                yield from cutter.batches()
        if cutter:
            cutter.leave()
            yield from cutter.batches()

    return run


def slots(grain: np.ndarray, queue: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The slot of each queue's g-th grain: how many grains fall due before it, earlier queues first at ties.

    Grain g of a queue of weight w falls due at (2g + 1) / 2w.
    """
    due, own = 2 * grain + 1, weights[queue]
    total = np.zeros(len(grain), np.int64)
    for other in range(len(sizes)):
        # grains h of the other queue with (2h + 1) * own < due * weight, or equal for earlier queues
        x = due * weights[other] + (other < queue)
        before = (x - 1 + own) // (2 * own)
        total += np.where(queue == other, grain, np.minimum(before, sizes[other]))
    return total


def share(grain: int):
    """Lays the ends of sources in grains, in their order; a grain falls due with its first piece, a last short one never (null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, fill, lot, rows = TaskContext.get().partitionId(), 0, 0, [], []

        def close(due: float | None) -> None:
            rows.extend((due, f"\x00ends {part:06d} {number:012d}", *x) for x in lot)
            lot.clear()

        def send() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PLACED, strict=True)], schema=_PLACED)
                rows.clear()

        due = None
        for b in batches:
            for r in b.to_pylist():
                ids, pos, n = r["ids"], 0, r["length"]
                while pos < n:
                    due = due if lot else r["due"]
                    take = min(n - pos, grain - fill)
                    lot.append((fill, r["doc_id"], r["start"] + pos, take, zlib.crc32(ids[4 * pos: 4 * (pos + take)]), r["doc_tokens"], r["queue"]))
                    pos, fill = pos + take, fill + take
                    if fill == grain:
                        close(due)
                        number, fill = number + 1, 0
            yield from send()
        close(None)
        yield from send()

    return run


def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each grain in its range: rows sorted by due time and lot."""
    drop_resident()
    part, number, last = TaskContext.get().partitionId(), -1, None
    for b in batches:
        if b.num_rows:
            out = np.empty(b.num_rows, np.int64)
            for i, key in enumerate(zip(b.column("due").to_pylist(), b.column("lot").to_pylist(), strict=True)):
                number += key != last
                out[i], last = number, key
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), pa.array(out), b.column("at"), *(b.column(k) for k in _NAMES), b.column("queue")],
                                             names=["part", "rank", "at", *_NAMES, "queue"])


def pack(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         window: int = WINDOW, grain: int = GRAIN, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source queue."""
    spark = docs.sparkSession
    parts, per = shuffle_parts(spark), window // grain
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                          F.col(text_col).cast("string").alias("text"))
    first = stored(columns.mapInArrow(cut(model_file, grain), ROW), "pack-pieces")
    tasks = (first.agg(F.max("task")).first()[0] or 0) + 1
    again = stored(first.where("grain IS NULL").repartition(parts, "queue").sortWithinPartitions("queue", "task", "doc_id", "start", "at")
                   .mapInArrow(cut_left(grain, tasks), ROW), "pack-left")
    full = first.where("grain IS NOT NULL").unionByName(again.where("grain IS NOT NULL")).drop("ids")
    ends = again.where("grain IS NULL")

    # The due time of each grain: (2g + 1) / 2w, with w the source's target, or its tokens in full grains and its end.
    counts = full.groupBy("queue", "task").agg((F.max("grain") + 1).alias("grains"))
    before = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("queue", "task", F.coalesce(F.sum("grains").over(before), F.lit(0)).alias("base"))
    sizes = (counts.select("queue", "grains", F.lit(0).alias("rest")).unionByName(ends.select("queue", F.lit(0).alias("grains"), F.col("length").alias("rest")))
             .groupBy("queue").agg(F.sum("grains").alias("grains"), F.sum("rest").alias("rest")))
    if targets:
        aim = spark.createDataFrame([(k, float(v) / sum(targets.values())) for k, v in targets.items() if v > 0], "queue string, share double")
        sizes = sizes.join(aim, "queue", "left").withColumn("weight", F.coalesce("share", F.lit(1 / SHARES)))
    else:
        sizes = sizes.withColumn("weight", F.col("grains") + F.col("rest") / F.lit(float(grain)))
    due = (2 * F.col("number") + 1) / (2 * F.col("weight"))
    pieces = full.join(base, ["queue", "task"]).withColumn("number", F.col("grain") + F.col("base")).join(sizes.select("queue", "weight"), "queue")
    pieces = pieces.select(due.alias("due"), "queue", "at", *_NAMES)
    # The end of a source, less than a grain, shares a grain with those that fall due next.
    tails = stored(ends.join(sizes, "queue").withColumn("number", F.col("grains")).select(due.alias("due"), "queue", "at", *_NAMES, "ids")
                   .repartitionByRange(parts, "due", "queue").sortWithinPartitions("due", "queue", "at").mapInArrow(share(grain), PLACED), "pack-ends")
    pieces = pieces.select("due", F.col("queue").alias("lot"), "at", *_NAMES, "queue").unionByName(tails.where("due IS NOT NULL"))

    # A grain's slot is its rank by (due, lot): a range-partitioned sort, and the grains of the ranges before.
    ranked = stored(pieces.repartitionByRange(parts, "due", "lot").sortWithinPartitions("due", "lot", "at").mapInArrow(rank, RANKED), "pack-ranks")
    many = {r["part"]: r["n"] for r in ranked.groupBy("part").agg((F.max("rank") + 1).alias("n")).collect()}
    total, start = 0, {}
    for k in sorted(many):
        start[k], total = total, total + many[k]
    windows = -(-total // per)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                slot = b.column("rank").to_numpy() + np.array([start[k] for k in b.column("part").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in _NAMES), pa.array(slot // per), pa.array(slot % per * grain + b.column("at").to_numpy()), b.column("queue")],
                                                 names=[*_NAMES, "sequence_id", "offset", "queue"])

    result = f"{PIECE}, sequence_id long, offset long, queue string"

    def side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One grain a range of ends, shorter than a full one: rows sorted by range and place.
        drop_resident()
        sequence, used, last, shift = windows, 0, None, 0
        for b in batches:
            where, seq = [], []
            for lot, at, n, whole in zip(b.column("lot").to_pylist(), b.column("at").to_pylist(), b.column("length").to_pylist(), b.column("whole").to_pylist(), strict=True):
                if lot != last:
                    if used + whole > window:
                        sequence, used = sequence + 1, 0
                    last, shift, used = lot, used, used + whole
                where.append(shift + at)
                seq.append(sequence)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in _NAMES), pa.array(seq, pa.int64()), pa.array(where, pa.int64()), b.column("queue")],
                                             names=[*_NAMES, "sequence_id", "offset", "queue"])

    left = tails.where("due IS NULL")
    whole = left.groupBy("lot").agg(F.sum("length").alias("whole"))
    tail = left.join(whole, "lot").repartition(1).sortWithinPartitions("lot", "at").mapInArrow(side_by_side, result)
    return ranked.mapInArrow(place, result).unionByName(tail)
