"""Helpers shared by the operators: shared tables, sorted groups, components.

Intermediate results that cut lineage are Parquet tables in the folder named by
``spark.checkpoint.dir``; every executor can read them, so a lost executor
costs only the tasks that it ran.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is set and everything runs on this machine, a folder of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = getattr(spark, "_own_shared_dir", None)
        if named is None:
            named = spark._own_shared_dir = "file://" + tempfile.mkdtemp(prefix="shared-")
            warnings.warn(f"spark.checkpoint.dir is not set: intermediate tables go to {named}", stacklevel=2)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this session's part of the shared folder, which goes when the driver's JVM ends."""
    own = f"{shared_dir(spark)}/session-{spark.sparkContext.applicationId}"
    if getattr(spark, "_own_session_dir", None) != own:
        spark._own_session_dir = own
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # what a write has shuffled goes with its end, not with the driver's next garbage collection


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder once and read back: cuts lineage, survives lost executors."""
    path, conf = fresh_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(TIDY, None)
    conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(TIDY) if before is None else conf.set(TIDY, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``; only for tables that no later result reads."""
    jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


_resident: dict[str, object] = {}


def resident(name: str, make: Callable[[], object]) -> object:
    """A worker's one model with large caches, kept between tasks; the one of another operator goes first."""
    if name not in _resident:
        drop_resident()
        _resident[name] = make()
    return _resident[name]


def drop_resident() -> None:
    """Frees the model that an earlier operator left in this worker, and gives the memory back."""
    if _resident:
        _resident.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BITMAPS = 8192  # bitmaps of 4 KB and of 32,768 ids each that may be broadcast: 32 MB


def bitmaps(ids: DataFrame, name: str) -> DataFrame | None:
    """``ids`` (one long column without nulls) as a broadcast table of bitmaps, exact; None where ids lie so far apart that these are too many.

    An id of a dense range takes a bit here, and some dozen bytes in a broadcast
    join, so texts needn't be shuffled to be told apart by their ids.
    """
    c = F.col(ids.columns[0])
    made = stored(ids.groupBy(F.bitmap_bucket_number(c).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(c)).alias("__bits")), name) if (
        ids.select(F.bitmap_bucket_number(c).alias("b")).distinct().limit(BITMAPS + 1).count() <= BITMAPS) else None
    return None if made is None else F.broadcast(made)


def among(df: DataFrame, column: str, marked: DataFrame, wanted: bool = True) -> DataFrame:
    """The rows of ``df`` whose id is in bitmaps; with ``wanted`` False those whose id isn't, nulls too."""
    place = F.bitmap_bit_position(F.col(f"`{column}`"))
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    met = df.join(marked, F.bitmap_bucket_number(F.col(f"`{column}`")) == F.col("__bucket"), "left").where(held if wanted else ~held)
    return met.select(*(F.col(f"`{c}`") for c in df.columns))


def clustered(df: DataFrame, by: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of equal ``by`` in one task and next to each other, sorted by ``order``."""
    return df.repartition(shuffle_parts(df.sparkSession), *by).sortWithinPartitions(*(order or by))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal keys in sorted batches.  Groups must be bounded by the caller."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], pa.Table | None],
               schema: str, arrow: pa.Schema) -> DataFrame:
    """``work`` over every group of equal ``keys``; many small groups share a task and its output batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.Table] = []
        rows = 0
        for group in groups(batches, keys):
            made = work(group)
            if made is not None and made.num_rows:
                out.append(made)
                rows += made.num_rows
            if rows >= 20_000:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out, rows = [], 0
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
        yield pa.RecordBatch.from_pylist([], schema=arrow)

    return clustered(df, keys, order).mapInArrow(run, schema)


def by_runs(batches: Iterator[pa.RecordBatch], change: Callable, work: Callable) -> Iterator[pa.RecordBatch]:
    """``work`` over the columns of sorted batches, whole runs at a time.

    ``change(columns)`` marks the rows whose run differs from the row before;
    ``work`` gets the columns and the start of each run.  The last run of a
    batch waits for the next one.
    """
    held = None
    for batch in chain(batches, [None]):
        if batch is None:
            if held is None or not len(held[0]):
                return
            columns = held
        else:
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate((h, c)) for h, c in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
        new = change(columns)
        new[0] = True
        starts = np.flatnonzero(new)
        if batch is not None:
            held = [c[starts[-1]:] for c in columns]
            columns, starts = [c[: starts[-1]] for c in columns], starts[:-1]
        if len(starts):
            made = work(columns, starts)
            if made.num_rows:
                yield made


def differs(*arrays: np.ndarray) -> np.ndarray:
    """Where any of the arrays differs from its value before."""
    new = np.zeros(len(arrays[0]), bool)
    for x in arrays:
        new[1:] |= x[1:] != x[:-1]
    return new


HUB, SALTS = 1024, 64  # neighbours of a hub at least; parts that its edges are dealt into
FEW_EDGES = 1_000_000  # edges (16 bytes each) up to which one task contracts what is left; beyond, all tasks do


def _with_least(edges: DataFrame, at: str, other: str, hub: int) -> DataFrame:
    """``edges`` with m, the smallest ``other`` of each ``at``.

    The minima come from partial aggregation and are joined back.  The edges of
    a hub are dealt into ``SALTS`` parts for that; at most edges / ``hub`` nodes
    are hubs, which bounds what is broadcast.
    """
    least = edges.groupBy(at).agg(F.min(other).alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") >= hub).select(F.col(at).alias("hub")))
    salted = edges.join(hubs, edges[at] == hubs["hub"], "left").withColumn("salt", F.when(F.col("hub").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))).drop("hub")
    parts = F.when(F.col("n") >= hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(least.select(at, "m", F.explode(parts).alias("salt")), [at, "salt"]).drop("salt")


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From edges (a, b): the stars (a, b) of their components, b the smallest node."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)  # hang the roots of both ends under the smaller one
        np.minimum.at(new, root[y], low)
        while not (new == new[new]).all():  # then every node under its root
            new = new[new]
        if (new == root).all():
            break
        root = new
    away = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[root[away]])], names=["a", "b"])


def components(edges: DataFrame, name: str = "components", few: int = FEW_EDGES) -> DataFrame:
    """Connected components of edges (u, v): one row (node, root) per node, root the smallest node reachable.

    Alternates the large-star and small-star contractions until nothing changes,
    or so few edges are left that one task contracts them.  Null ends and
    self-loops add nothing.
    """
    a, b = F.col("a"), F.col("b")
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), name)
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    state = now.select(mark.alias("m")).first()["m"]
    while state["n"]:
        if state["n"] <= few:
            # Every step keeps all nodes on an edge, and which of them are connected.
            now = stored(now.repartition(1).mapInArrow(contracted, "a long, b long"), name)
            break
        hub = max(HUB, state["n"] // 4096)
        both = now.select(a.alias("u"), b.alias("v")).union(now.select(b.alias("u"), a.alias("v")))
        large = _with_least(both, "u", "v", hub).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        pairs = _with_least(large, "a", "b", hub).select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        then = stored(pairs.where("a <> b").distinct(), name)
        after = then.select(mark.alias("m")).first()["m"]
        done, state = after == state, after
        forget(now)
        now = then
        if done:
            break
    return now.select(a.alias("node"), b.alias("root")).union(now.select(b.alias("node"), b.alias("root")).distinct())


class Forest:
    """Union-find over the numbers 0..n-1; the root of a set is its smallest number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.up[y] = x
        return True
