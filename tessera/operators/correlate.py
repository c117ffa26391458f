"""Correlations of many columns as blocked matrix products, and equal columns by fingerprints.

Of each pair the rows count that have both values.  With x the values (0 where
missing) and m what is there, the sums of a pair are entries of four products,
m'm, x'm, (x*x)'m and x'x, so a batch of rows costs four products a tile of
columns instead of one aggregate a pair.  Tiles of ``TILE`` columns meet in one
task each, which turns their sums into rows; nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite

TILE = 256  # columns of a tile: sums of 2 MB
HELD = 256 << 20  # bytes of sums that a task holds; with more columns the rows are read again
FLAT = 1e-13  # share of a column's square sum below which its variance is rounding


def _sums(columns: int, pairs: list[tuple[int, int]], centre: np.ndarray):
    """Adds up the four products of each pair of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]).reshape(-1, columns) - centre
            there = (~np.isnan(x)).astype(float)
            x = np.where(there > 0, x, 0.0)
            for i, j in pairs:
                a, z = slice(i * TILE, (i + 1) * TILE), slice(j * TILE, (j + 1) * TILE)
                made = np.stack((there[:, a].T @ there[:, z], x[:, a].T @ there[:, z], (x[:, a] ** 2).T @ there[:, z], there[:, a].T @ x[:, z], there[:, a].T @ (x[:, z] ** 2), x[:, a].T @ x[:, z]))
                held[i, j] = made if (i, j) not in held else held[i, j] + made
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int32()), pa.array([j for _, j in held], pa.int32()), pa.array([s.tobytes() for s in held.values()], pa.binary())], names=["i", "j", "sums"])

    return run


def _pairs(columns: int):
    """From the sums of pairs of tiles to rows (first, second, corr), numbers of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.frombuffer(s)
                held[i, j] = held[i, j] + s if (i, j) in held else s
        for (i, j), s in held.items():
            wide = [min(TILE, columns - k * TILE) for k in (i, j)]
            n, a, aa, z, zz, az = s.reshape(6, *wide)
            many = np.maximum(n, 1.0)
            va, vz = aa - a * a / many, zz - z * z / many
            flat = (va <= FLAT * aa) | (vz <= FLAT * zz) | (n == 0)
            with np.errstate(all="ignore"):
                corr = np.where(flat, np.nan, (az - a * z / many) / np.sqrt(va * vz))
            first, second = np.meshgrid(np.arange(wide[0]) + i * TILE, np.arange(wide[1]) + j * TILE, indexing="ij")
            some = first < second
            value = corr[some]
            yield pa.RecordBatch.from_arrays([pa.array(first[some].astype(np.int32)), pa.array(second[some].astype(np.int32)), pa.array(value, mask=np.isnan(value))], names=["a", "b", "corr"])

    return run


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of every pair of columns: first, second, corr, null where a side is constant."""
    d = len(columns)
    tiles = -(-d // TILE)
    pairs = [(i, j) for i in range(tiles) for j in range(i, tiles)]
    rows = df.select(*[finite(c).alias(f"x{i}") for i, c in enumerate(columns)])
    means = rows.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)]).first()
    centre = np.array([means[f"m{i}"] or 0.0 for i in range(d)])
    per = max(1, HELD // (6 * 8 * TILE * TILE))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = None
    for at in range(0, len(pairs), per):
        some = pairs[at: at + per]
        sums = rows.mapInArrow(_sums(d, some, centre), "i int, j int, sums binary").repartition(min(len(some), parts), "i", "j")
        part = sums.mapInArrow(_pairs(d), "a int, b int, corr double")
        out = part if out is None else out.unionByName(part)
    names = F.array(*[F.lit(c) for c in columns])
    return out.select(F.get(names, F.col("a")).alias("first"), F.get(names, F.col("b")).alias("second"), "corr")


def fingerprints(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """Two order-free sums of 64-bit hashes of (row, value) of each column, null a value: equal columns have equal sums."""
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null"))
    rows = df.select(F.monotonically_increasing_id().alias("__row"), *[value(c).alias(f"v{i}") for i, c in enumerate(columns)])
    mark = lambda i, seed: F.sum(F.xxhash64(F.lit(seed), "__row", f"v{i}").cast("decimal(38,0)"))
    out = {}
    for at in range(0, len(columns), 200):
        some = range(at, min(at + 200, len(columns)))
        row = rows.agg(*[mark(i, s).alias(f"h{i}_{s}") for i in some for s in (1, 2)]).first()
        out |= {columns[i]: (row[f"h{i}_1"], row[f"h{i}_2"]) for i in some}
    return out


def equal_columns(df: DataFrame, columns: list[str]) -> list[tuple[str, str]]:
    """Pairs of columns that are equal in every row (nulls equal): those of equal fingerprints, verified against the first of them."""
    by: dict[tuple, list[str]] = {}
    for c, mark in fingerprints(df, columns).items():
        by.setdefault(mark, []).append(c)
    heads = [(g[0], c) for g in by.values() for c in g[1:]]
    if not heads:
        return []
    text = lambda c: F.col(f"`{c}`").cast("string")
    row = df.agg(*[F.sum(F.when(text(a).eqNullSafe(text(b)), 0).otherwise(1)).alias(f"p{i}") for i, (a, b) in enumerate(heads)]).first()
    same = {g[0]: [g[0]] for g in by.values()}
    for i, (a, b) in enumerate(heads):
        if not row[f"p{i}"]:
            same[a].append(b)
    place = {c: i for i, c in enumerate(columns)}
    return sorted(((a, b) for g in same.values() for k, a in enumerate(g) for b in g[k + 1:]), key=lambda p: (place[p[0]], place[p[1]]))
