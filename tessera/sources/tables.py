"""Table sources and sinks by suffix, folders of labelled files, raw samples, texts by path, prediction inputs."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..errors import DataError

SUFFIXES = (".csv", ".tsv", ".parquet", ".pq", ".orc", ".json", ".jsonl", ".ndjson", ".feather", ".xlsx", ".xls", ".pkl", ".pickle")
LOCAL_BYTES = 512 << 20  # the largest file that a format without a Spark source is read from
FOLDER_TASKS = 4  # tasks a core that read or write a folder of many small files


def _size(spark: SparkSession, path: str) -> int:
    """Bytes of what is at a path; raises if nothing is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(p):
        raise DataError(f"{path} is not there")
    return system.getContentSummary(p).getLength()


def load_table(spark: SparkSession, path: str | DataFrame, trusted: bool = False) -> DataFrame:
    """CSV, TSV, Parquet, ORC, JSON (records or columns), Feather, Excel (if pandas can) and, trusted only, pickle.

    Feather, Excel and pickle have no Spark source: their files go through the
    driver, up to ``LOCAL_BYTES``.
    """
    if isinstance(path, DataFrame):
        return path
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in SUFFIXES:
        raise DataError(f"unknown table suffix {suffix!r}")
    if suffix in (".pkl", ".pickle") and not trusted:
        raise DataError("a pickle runs code when it is read: pass trusted=True for files of your own")
    size = _size(spark, path)
    if suffix in (".csv", ".tsv"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if suffix == ".tsv" else ",")
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(path)
    if suffix == ".orc":
        return spark.read.orc(path)
    if suffix == ".json":
        return _json(spark, path, size)
    if suffix in (".jsonl", ".ndjson"):
        return spark.read.json(path)
    if size > LOCAL_BYTES:
        raise DataError(f"{path} has {size} bytes; {suffix} files go through the driver, up to {LOCAL_BYTES}")
    local = path.removeprefix("file://")
    if suffix == ".feather":
        import pyarrow.feather

        return spark.createDataFrame(pyarrow.feather.read_table(local))
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(local) if suffix in (".xlsx", ".xls") else pd.read_pickle(local))


def _json(spark: SparkSession, path: str, size: int) -> DataFrame:
    """An array of records, or an object of columns: {column: [values]} or {column: {row: value}}.

    Arrays are zipped by the executors; objects by row, whose schema names every
    row, go through the driver, up to ``LOCAL_BYTES``.
    """
    text = spark.read.text(path, wholetext=True)
    head = text.select(F.substring(F.ltrim("value"), 1, 1)).first()
    if head is None or head[0] != "{":
        return spark.read.json(path, multiLine=True)
    names = text.select(F.json_object_keys("value")).first()[0]
    if names and text.select(F.substring(F.ltrim(F.get_json_object("value", "$['" + names[0] + "']")), 1, 1)).first()[0] == "[":
        table = spark.read.json(path, multiLine=True)
        if any(not isinstance(table.schema[c].dataType, ArrayType) for c in names):
            return table
        if table.where(" OR ".join(f"size(`{c}`) <> size(`{names[0]}`)" for c in names)).limit(1).count():
            raise DataError(f"the columns of {path} differ in length")
        return table.select(F.inline(F.arrays_zip(*[F.col(f"`{c}`") for c in names])))
    if size > LOCAL_BYTES:
        raise DataError(f"{path} has {size} bytes; objects by row go through the driver, up to {LOCAL_BYTES}")
    whole = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not all(isinstance(v, list | dict) for v in whole.values()):
        return spark.read.json(path, multiLine=True)
    columns = {k: list(v.values()) if isinstance(v, dict) else v for k, v in whole.items()}
    if len({len(v) for v in columns.values()}) != 1:
        raise DataError(f"the columns of {path} differ in length")
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))


def load_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, content and label (the parent folder's name) of files below a folder.

    Spark plans a task for every 32 small files; ``FOLDER_TASKS`` a core at most read them here.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.coalesce(max(64, FOLDER_TASKS * spark.sparkContext.defaultParallelism)).select("path", "content", F.element_at(F.split("path", "/"), -2).alias("label"))


def write_texts(df: DataFrame, folder: str, by: str, column: str) -> int:
    """Every text as a file of its own, with a newline at its end, below ``folder`` in ``<by>=<value>``; how many.

    Each task opens the files of its own rows by the file system that the folder
    names, as ``read_texts`` does: Spark's writer spends a checksum file, a change
    of mode and a move on each.  A task that runs again writes the same names.
    """
    root = folder.removeprefix("file://") if folder.startswith("file:///") else folder

    def run(batches):
        from pyarrow import RecordBatch, array, fs
        from pyspark import TaskContext

        system, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), re.sub("^file:/+", "/", root))
        task, n, made = TaskContext.get().partitionId(), 0, set()
        for b in batches:
            for value, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = re.sub(r"""[\x00-\x1f"#%'*/:=?\\{\[\]^\x7f]""", lambda m: f"%{ord(m[0]):02X}", value) or "__HIVE_DEFAULT_PARTITION__"  # as Spark names folders
                at = f"{top}/{by}={name}"
                if at not in made:
                    system.create_dir(at, recursive=True)
                    made.add(at)
                with system.open_output_stream(f"{at}/part-{task:05d}-{n}.txt") as f:
                    f.write(text.encode() + b"\n")
                n += 1
        yield RecordBatch.from_arrays([array([n], "int64")], names=["n"])

    return df.select(by, column).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def raw_samples(spark: SparkSession, data, y=None, modality: str = "text") -> DataFrame:
    """Samples of one modality, as a frame of id, sample and (with ``y``) label.

    Texts and paths are strings, media bytes or nested lists of numbers; arrays
    become lists, and audio given as (rate, samples) a struct.
    """
    samples = [data] if isinstance(data, str | bytes) or modality == "audio" and isinstance(data, tuple) else list(data)
    if not samples:
        raise DataError("no samples")
    if y is not None and len(y) != len(samples):
        raise DataError(f"{len(y)} labels for {len(samples)} samples")

    def plain(x):
        if isinstance(x, tuple) and modality == "audio":
            return {"rate": int(x[0]), "samples": np.asarray(x[1], float).ravel().tolist()}
        return x if isinstance(x, str | bytes) else np.asarray(x, float).tolist()

    rows = [(i, plain(x)) for i, x in enumerate(samples)]
    first = rows[0][1]
    depth = 0
    while isinstance(first, list):
        depth, first = depth + 1, first[0] if first else 0.0
    kind = "string" if isinstance(first, str) else "binary" if isinstance(first, bytes) else "struct<rate: int, samples: array<double>>" if isinstance(first, dict) else "array<" * depth + "double" + ">" * depth
    df = spark.createDataFrame(rows, f"id long, sample {kind}")
    return df if y is None else append_target(df, y, "id")


def append_target(df: DataFrame, y: list, key: str, name: str = "label") -> DataFrame:
    """``df`` with the values ``y`` in the order of ``key``, one a row."""
    n = df.count()
    if len(y) != n:
        raise DataError(f"{len(y)} targets for {n} rows")
    if name in df.columns:
        raise DataError(f"{name} is there already")
    values = [v.item() if hasattr(v, "item") else v for v in y]
    given = df.sparkSession.createDataFrame(list(enumerate(values)), f"__i long, `{name}` {'double' if isinstance(values[0], float) else 'long' if isinstance(values[0], int) else 'string'}")
    place = F.row_number().over(Window.orderBy(key)) - 1  # as many rows as the driver was given values
    return df.withColumn("__i", place).join(given, "__i").drop("__i")


def _read_path(path: str, most: int) -> str:
    """A file's text by the file system that its path names: whole, or of a long file the head, the middle and the tail."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), re.sub("^file:/+", "/", path))
    with system.open_input_file(name) as f:
        size, part = f.size(), most // 3
        if size <= 4 * most:  # at most four bytes a character
            return f.read().decode("utf-8", "replace")
        pieces = []
        for at in (0, size // 2 - 2 * part, size - 4 * part):
            f.seek(at)
            pieces.append(f.read(4 * part).decode("utf-8", "ignore"))
    return pieces[0][:part] + "\n…\n" + pieces[1][:part] + "\n…\n" + pieces[2][-part:]


def read_texts(df: DataFrame, column: str, most: int = 200_000) -> DataFrame:
    """Text of a column of strings, bytes or file paths (``path:`` before them): bytes by UTF-8, long texts by head, middle and tail.

    Each task opens the paths of its own rows; of one that can't be read the text
    is null, and ``<column>__error`` says why.
    """
    from ..functions.text import bounded

    if dict(df.dtypes)[column] == "binary":
        return df.withColumn(column, bounded(F.expr(f"decode(`{column}`, 'UTF-8')"), most))
    c = F.col(f"`{column}`")
    if df.where(c.startswith("path:")).isEmpty():
        return df.withColumn(column, bounded(c, most))

    @F.pandas_udf("text string, error string")
    def opened(paths: pd.Series) -> pd.DataFrame:
        out = []
        for p in paths:
            try:
                out.append((_read_path(p, most), None) if p is not None else (None, None))
            except (OSError, ValueError) as e:
                out.append((None, f"{type(e).__name__}: {e}"[:300]))
        return pd.DataFrame(out, columns=["text", "error"], dtype=object)

    read = df.withColumn("__read", opened(F.when(c.startswith("path:"), F.expr(f"substring(`{column}`, 6)"))))
    return read.withColumns({column: bounded(F.when(c.startswith("path:"), F.col("__read.text")).otherwise(c), most), f"{column}__error": F.col("__read.error")}).drop("__read")


def checked(df: DataFrame) -> DataFrame:
    if len(set(df.columns)) != len(df.columns):
        raise DataError("column names repeat")
    if df.isEmpty():
        raise DataError("the table is empty")
    return df


def prediction_input(spark: SparkSession, x, columns: list[str]) -> DataFrame:
    """A DataFrame from a DataFrame, a path, one dict, a list of dicts, one value or row of values, a list of rows, or an array of one or two dimensions."""
    return single_or_many(spark, x, columns)[0]


def single_or_many(spark: SparkSession, x, columns: list[str]) -> tuple[DataFrame, bool]:
    """``prediction_input``, and whether it was one sample."""
    if isinstance(x, DataFrame):
        return checked(x), False
    if isinstance(x, str) and os.path.splitext(x)[1].lower() in SUFFIXES:
        return checked(load_table(spark, x)), False
    if hasattr(x, "to_dict") and hasattr(x, "columns"):  # a pandas frame
        if not len(x):
            raise DataError("no rows to predict")
        return spark.createDataFrame(x), False
    if isinstance(x, np.ndarray):
        if x.ndim > 2 or not x.size:
            raise DataError(f"an array of shape {x.shape}")
        x = x.tolist()
    one = isinstance(x, dict | str | bytes | int | float) or not isinstance(x, list | tuple) or bool(x) and not isinstance(x[0], dict | list | tuple | np.ndarray)
    rows = [x] if one else list(x)
    if not rows:
        raise DataError("no rows to predict")
    if isinstance(rows[0], dict):
        return spark.createDataFrame(rows), one
    rows = [tuple(r) if isinstance(r, list | tuple | np.ndarray) else (r,) for r in rows]
    if any(len(r) != len(columns) for r in rows):
        raise DataError(f"a row has {len(columns)} values")
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], columns), one


def write_predictions(df: DataFrame, path: str, kind: str = "csv") -> None:
    df.write.mode("overwrite").format(kind).option("header", True).save(path)


def predictions_text(df: DataFrame, kind: str = "csv", most: int = 100_000) -> str:
    """Predictions as one CSV or JSON text, of at most ``most`` rows; more are to be written."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise DataError(f"over {most} predictions: write them")
    return rows.to_csv(index=False) if kind == "csv" else rows.to_json(orient="records", date_format="iso")
