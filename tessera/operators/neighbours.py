"""Nearest neighbours among all rows under distances that skip missing values, in pruned blocks.

The distance of two rows goes by the columns that both have, scaled up to all:
sqrt(sum of squares / shared * all).  Rows are grouped by which columns they have
and cut, in the order of their widest column, into blocks with a bounding box,
so of two blocks the shared columns are known and their boxes bound all distances
between them from below.  A block of rows with gaps first meets its nearest
blocks, until each gap has k neighbours; the k-th distances then tell which
other blocks can hold a nearer one, and only these are met.  The result is that
of comparing all pairs; ties go by the rows' numbers.  Equal rows are equally far,
so of equal reference rows only the k first can be among the nearest, and equal
rows with gaps are looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.shared import stored

ROWS, PART = 2048, 512  # rows of a block; rows with gaps that meet a block at once
BOXES = 200_000  # boxes of blocks that a task holds; more blocks are made longer instead
FIRST = 4  # blocks met at first beyond those that hold k neighbours


def numbered(df: DataFrame, columns: list[str], number: str) -> DataFrame:
    """Rows (number, x): ``number`` orders ties; missing values, NaN and infinities are NaN."""
    nan = F.lit(float("nan"))
    return df.select(F.col(f"`{number}`").cast("long").alias("number"), F.array(*[F.coalesce(finite(c), nan) for c in columns]).alias("x"))


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def blocks(rows: DataFrame, width: int, wide: list[int], size: int = ROWS) -> DataFrame:
    """Blocks of rows with the same columns there: block, pattern (a text of 0 and 1), n, low, high, numbers and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def put(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            x = _matrix(table["x"].combine_chunks(), width)
            with np.errstate(all="ignore"):
                low, high = np.where(np.isnan(x[0]), 0.0, x.min(0)), np.where(np.isnan(x[0]), 0.0, x.max(0))
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([made]), table["pattern"].combine_chunks()[:1], pa.array([len(x)]), pa.array([low.tolist()]), pa.array([high.tolist()]),
                                               pa.array([table["number"].to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                                              names=["block", "pattern", "n", "low", "high", "numbers", "x"])

        for batch in batches:
            at = 0
            names = batch.column(2).to_pylist()
            while at < len(names):
                have = sum(b.num_rows for b in held)
                end = at
                while end < len(names) and names[end] == names[at] and have + end - at < size:
                    end += 1
                if held and (held[0].column(2)[0].as_py() != names[at] or have >= size):
                    yield put(pa.Table.from_batches(held))
                    held = []
                    continue
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield put(pa.Table.from_batches(held))

    pattern = F.array_join(F.transform("x", lambda v: F.when(F.isnan(v), "0").otherwise("1")), "")
    first = F.lit(0.0)
    for i in reversed(wide):  # the widest column that a row has
        first = F.when(~F.isnan(F.get("x", F.lit(i))), F.get("x", F.lit(i))).otherwise(first)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("pattern", pattern).withColumn("at", first).repartitionByRange(parts, "pattern", "at").sortWithinPartitions("pattern", "at")
    return dealt.select("number", "x", "pattern").mapInArrow(run, "block long, pattern string, n long, low array<double>, high array<double>, numbers binary, x binary")


def _there(pattern: str) -> np.ndarray:
    return np.frombuffer(pattern.encode(), np.uint8) == ord("1")


class Boxes:
    """The boxes of all reference blocks."""

    def __init__(self, rows: list, width: int):
        self.block = np.array([r["block"] for r in rows], np.int64)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.low, self.high = (np.array([r[c] for r in rows], float).reshape(-1, width) for c in ("low", "high"))
        self.there = np.array([_there(r["pattern"]) for r in rows], bool).reshape(-1, width)

    def bound(self, there: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least squared distance of a block's rows to each reference block; infinite where no column is shared."""
        shared = self.there & there
        gap = np.maximum(0.0, np.maximum(self.low - high, low - self.high))
        n = shared.sum(1)
        total = np.where(shared, gap * gap, 0.0).sum(1)
        return np.where(n > 0, total / np.maximum(n, 1) * len(there), np.inf) * (1 - 1e-12)


def _pairs_first(boxes: Boxes, k: int):
    """For each block with gaps and each missing column, the nearest blocks that hold k neighbours, and a few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            for block, pattern, low, high in zip(*(b.column(c).to_pylist() for c in ("block", "pattern", "low", "high")), strict=True):
                there = _there(pattern)
                bound = boxes.bound(there, np.array(low), np.array(high))
                order = np.argsort(bound, kind="stable")
                order = order[np.isfinite(bound[order])]
                chosen: set[int] = set()
                for j in np.flatnonzero(~there):
                    own = order[boxes.there[order, j]]
                    enough = int(np.searchsorted(np.cumsum(boxes.n[own]), k)) + 1 + FIRST
                    chosen.update(own[:enough].tolist())
                left += [block] * len(chosen)
                right += boxes.block[sorted(chosen)].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["block", "other"])

    return run


def _pairs_rest(boxes: Boxes):
    """Blocks with gaps and every other block that may be nearer than ``limits``, the largest k-th squared distance of each missing column (null: fewer than k so far)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right, bounds = [], [], []
            for block, pattern, low, high, limits, met in zip(*(b.column(c).to_pylist() for c in ("block", "pattern", "low", "high", "limits", "met")), strict=True):
                there = _there(pattern)
                bound = boxes.bound(there, np.array(low), np.array(high))
                limit = np.array([np.inf if v is None else v for v in (limits or [None] * len(there))], float)
                reach = np.zeros(len(bound), bool)
                for j in np.flatnonzero(~there):
                    reach |= boxes.there[:, j] & (bound <= limit[j]) & np.isfinite(bound)
                other = boxes.block[reach & ~np.isin(boxes.block, np.array(met or [], np.int64))]
                left += [block] * len(other)
                right += other.tolist()
                bounds += [limits] * len(other)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(bounds, pa.list_(pa.float64()))], names=["block", "other", "limits"])

    return run


def _meet(width: int, k: int):
    """Pairs of blocks to the k nearest of each (row, missing column), none beyond the block's limit: number, gap, and arrays of squared distances, numbers and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pattern, x, numbers, other_pattern, y, others, limits in zip(*(b.column(c).to_pylist() for c in ("pattern", "x", "numbers", "other_pattern", "y", "others", "limits")), strict=True):
                there, holds = _there(pattern), _there(other_pattern)
                shared = np.flatnonzero(there & holds)
                gaps = np.flatnonzero(~there & holds)
                q, r = np.frombuffer(x).reshape(-1, width), np.frombuffer(y).reshape(-1, width)
                numbers, others = np.frombuffer(numbers, np.int64), np.frombuffer(others, np.int64)
                for at in range(0, len(q), PART):
                    some = q[at: at + PART]
                    apart = np.zeros((len(some), len(r)))
                    for c in shared:  # column by column, so that sums don't depend on the block
                        apart += (some[:, c: c + 1] - r[:, c]) ** 2
                    apart = apart / len(shared) * width
                    order = np.argsort(others, kind="stable")
                    if limits and len(gaps):  # only what may be near is sorted
                        order = order[(apart <= max(np.inf if limits[j] is None else limits[j] for j in gaps)).any(0)[order]]
                    near = order[np.argsort(apart[:, order], 1, kind="stable")[:, :k]]
                    d = np.take_along_axis(apart, near, 1)
                    for j in gaps:
                        limit = limits[j] if limits and limits[j] is not None else np.inf
                        some = d <= limit  # sorted, so the first ones of each row
                        many = some.sum(1)
                        own = many > 0
                        offsets = pa.array(np.concatenate(([0], np.cumsum(many[own]))).astype(np.int32))
                        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[some])) for v in (d, others[near], r[near, j])]
                        yield pa.RecordBatch.from_arrays([pa.array(numbers[at: at + PART][own]), pa.array(np.full(int(own.sum()), j, np.int32)), *lists], names=["number", "gap", "d", "other", "value"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each (number, gap), by distance and then number."""
    each = found.select("number", "gap", F.explode(F.arrays_zip("d", "other", "value")).alias("r")).select("number", "gap", "r.*")
    place = F.row_number().over(Window.partitionBy("number", "gap").orderBy("d", "other"))
    return each.withColumn("place", place).where(F.col("place") <= k)


def _firsts(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of equal rows, by number; tasks drop the others before they are shuffled."""
    place = F.row_number().over(Window.partitionBy("x").orderBy("number"))
    return rows.withColumn("place", place).where(F.col("place") <= k).drop("place")


def nearest(queries: DataFrame, reference: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Of every row of ``queries`` (number, x) and each of its missing columns the k nearest rows of ``reference`` that have it: number, gap, d (squared), other, value, place."""
    width = len(columns)
    reference = stored(_firsts(reference, k), "points")
    spread = reference.agg(*[F.stddev_pop(F.when(~F.isnan(F.get("x", F.lit(i))), F.get("x", F.lit(i)))).alias(f"s{i}") for i in range(width)], F.count("*").alias("n")).first()
    wide = sorted(range(width), key=lambda i: -(spread[f"s{i}"] or 0.0))
    size = max(ROWS, -(-spread["n"] // BOXES))
    gaps = stored(blocks(queries.where(F.exists("x", F.isnan)), width, wide, ROWS), "gaps")
    held = stored(blocks(reference, width, wide, size), "reference")
    boxes = Boxes(held.select("block", "pattern", "n", "low", "high").collect(), width)  # at most BOXES and one a pattern and task
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(pairs: DataFrame) -> DataFrame:
        left = gaps.select("block", "pattern", "x", "numbers")
        right = held.select(F.col("block").alias("other"), F.col("pattern").alias("other_pattern"), F.col("x").alias("y"), F.col("numbers").alias("others"))
        both = pairs.join(left, "block").join(right, "other").repartition(parts, "block", "other")
        return both.select("pattern", "x", "numbers", "other_pattern", "y", "others", "limits").mapInArrow(_meet(width, k), "number long, gap int, d array<double>, other array<long>, value array<double>")

    pairs = stored(gaps.select("block", "pattern", "low", "high").mapInArrow(_pairs_first(boxes, k), "block long, other long"), "pairs")
    first = stored(_best(met(pairs.withColumn("limits", F.lit(None).cast("array<double>"))), k), "near")
    own = gaps.select("block", "pattern", "numbers").mapInArrow(_members, "block long, number long, pattern string")
    kth = first.groupBy("number", "gap").agg(F.max("d").alias("d"), F.count("*").alias("n"))
    need = own.withColumn("gap", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).where(F.substring("pattern", F.col("gap") + 1, F.lit(1)) == "0")
    reach = need.join(kth, ["number", "gap"], "left").groupBy("block", "gap").agg(F.max(F.when(F.col("n") >= k, F.col("d")).otherwise(float("inf"))).alias("limit"))
    limits = reach.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gap", "limit"))).alias("by"))
    limits = limits.select("block", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.element_at("by", j)).alias("limits"))
    before = pairs.groupBy("block").agg(F.collect_list("other").alias("met"))  # a few blocks each
    rest = gaps.select("block", "pattern", "low", "high").join(limits, "block", "left").join(before, "block", "left").mapInArrow(_pairs_rest(boxes), "block long, other long, limits array<double>")
    more = _best(met(stored(rest, "pairs")), k)
    both = first.drop("place").unionByName(more.drop("place"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("number", "gap").orderBy("d", "other"))).where(F.col("place") <= k)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, pattern, numbers in zip(*(b.column(c).to_pylist() for c in ("block", "pattern", "numbers")), strict=True):
            numbers = np.frombuffer(numbers, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), block)), pa.array(numbers), pa.array([pattern] * len(numbers))], names=["block", "number", "pattern"])


def impute(df: DataFrame, reference: DataFrame, columns: list[str], k: int, medians: list[float]) -> DataFrame:
    """``df`` with ``columns`` filled: the mean of the k nearest reference rows (number, x) that have the value, weighted by 1 / distance.

    Rows at distance 0 stand for all others; without a neighbour the median does.
    Rows without gaps pass; only the others meet the reference and are joined.
    """
    nan = F.lit(float("nan"))
    x = F.array(*[F.coalesce(F.col(f"`{c}`"), nan) for c in columns])
    rows = stored(df.withColumns({c: finite(c) for c in columns}).withColumn("__x", x), "rows")
    points = stored(rows.where(F.exists("__x", F.isnan)).select(F.col("__x").alias("x")).distinct().withColumn("number", F.monotonically_increasing_id()), "holes")
    near = nearest(points.select("number", "x"), reference, columns, k)
    same = F.col("d") == 0
    value = F.when(F.max(same.cast("int")) == 1, F.avg(F.when(same, F.col("value")))).otherwise(F.sum(F.when(~same, F.col("value") / F.sqrt("d"))) / F.sum(F.when(~same, 1 / F.sqrt("d"))))
    filled = near.groupBy("number", "gap").agg(value.alias("value")).groupBy("number").pivot("gap", list(range(len(columns)))).agg(F.first("value"))
    filled = points.join(filled, "number").select(F.col("x").alias("__x"), *[F.col(f"`{i}`").alias(f"__fill_{i}") for i in range(len(columns))])
    hole = F.lit(False)
    for c in columns:
        hole = hole | F.col(f"`{c}`").isNull()
    done = rows.where(hole).join(filled, "__x", "left").withColumns(
        {c: F.coalesce(F.col(f"`{c}`"), F.col(f"__fill_{i}"), F.lit(float(medians[i]) if medians[i] is not None else None).cast("double")) for i, c in enumerate(columns)})
    back = [F.col(f"`{c}`") for c in df.columns]
    return rows.where(~hole).select(*back).unionByName(done.select(*back))
