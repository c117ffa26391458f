"""Intermediate tables in the folder that the cluster shares, and sums of matrices over partitions."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FAN = 32  # partial matrices that one task adds up


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without it gets one of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = getattr(spark, "_engine_shared_dir", None)
        if named is None:
            named = spark._engine_shared_dir = "file://" + tempfile.mkdtemp(prefix="tables-")
            warnings.warn(f"spark.checkpoint.dir is not set: intermediate tables go to {named}", stacklevel=2)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this session's part of the shared folder, which goes when the driver's JVM ends."""
    own = f"{shared_dir(spark)}/engine-{spark.sparkContext.applicationId}"
    if getattr(spark, "_engine_session_dir", None) != own:
        spark._engine_session_dir = own
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def total(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], combine: Callable[[list[np.ndarray]], np.ndarray] = sum) -> np.ndarray | None:
    """What ``combine`` makes of the partitions' matrices, ``FAN`` at a time on the executors; the driver gets a few at most."""

    def put(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, float).tobytes()], pa.binary()), pa.array([list(x.shape)], pa.list_(pa.int64()))], names=["x", "shape"])

    def get(row) -> np.ndarray:
        return np.frombuffer(row["x"]).reshape(row["shape"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = partial(batches)
        if x is not None:
            yield put(x)

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for row in b.to_pylist():
                held = get(row) if held is None else combine([held, get(row)])
        if held is not None:
            yield put(held)

    schema = "x binary, shape array<long>"
    parts, n = rows.mapInArrow(first, schema), rows.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.repartition(n).mapInArrow(more, schema)
    found = [get(r) for r in parts.collect()]
    return None if not found else found[0] if len(found) == 1 else combine(found)
