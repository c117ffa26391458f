"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors of one label compare by cosine.  Equal vectors form one class first.  A
class's unit vector x is quantised once, as ``s * q`` with int8 q; with
e = |x - s q| the product of two quantised vectors is off by at most
``e_x + (1 + e_x) e_y``.  The classes of a label are dealt into blocks of
``block`` vectors, and every pair of blocks is one task, a tile:

1. Codes, scales and errors alone go to the tiles.  A pair whose product less its
   bound reaches the threshold is a link; one whose product plus its bound stays
   below is none.
2. The vectors of the other pairs, and only these, go to their tile once more in
   double precision, and these pairs alone are computed again.

So no pair at or above the threshold is lost, and none below it links.  A tile
returns each vector's link count and a spanning forest of its links, never the
pairs.

Defined cases: null label, null or empty vectors, zero vectors, and null or
non-finite components link with nothing (n_links 0, own component); vectors of
other lengths don't compare; equal rows link; a cosine equal to the threshold
links; rows with a null vec_id are left out; very long vectors are compared
whole; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, map_groups, stored

THRESHOLD, BLOCK = 0.98, 4096
PIECE = 1024  # vectors of each side multiplied at a time
FAR_LABELS = 100_000  # labels whose sizes may be broadcast; beyond, the join shuffles
_OUT = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and error norm of each unit vector."""
    scale = np.maximum(np.abs(unit).max(1), 1e-300) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return codes, scale, error


class Quantised:
    """Some quantised vectors, with slices."""

    def __init__(self, codes: np.ndarray, scale: np.ndarray, error: np.ndarray):
        # Products of int8 codes are whole numbers below 2**24 in float32 up to 1040 dimensions; beyond, float64.
        self.codes = codes.astype(np.float32 if codes.shape[1] <= 1040 else np.float64)
        self.scale, self.error = scale, error

    def bounds(self, other: Quantised, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Approximate products of two slices, and by how much they are off at most."""
        product = (self.codes[a] @ other.codes[b].T) * self.scale[a, None] * other.scale[None, b]
        return product, self.error[a, None] + (1 + self.error[a, None]) * other.error[None, b] + 1e-9


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosine of each pair (a[i], b[j]) in double precision."""
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    out = np.empty(len(i))
    for at in range(0, len(i), 50_000):
        x, y = i[at: at + 50_000], j[at: at + 50_000]
        out[at: at + 50_000] = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y])
    return out


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges between numbers that connect what a link matrix of ``left`` and ``right`` numbers connects."""
    row, column = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        low = np.minimum(row, np.where(links, column[None, :], top).min(1))
        high = np.minimum(column, np.where(links, low[:, None], top).min(0))
        if (low == row).all() and (high == column).all():
            break
        row, column = low, high
    for ends, label in ((left, row), (right, column)):
        apart = ends != label
        yield from zip(ends[apart].tolist(), label[apart].tolist(), strict=True)


class Tile:
    """Two blocks of vectors (or one twice): who links, pieces of both sides at a time."""

    def __init__(self, group: pa.Table):
        self.ids, self.copies, self.block = (group[c].to_numpy() for c in ("cid", "copies", "block"))
        self.i, self.j = group["i"][0].as_py(), group["j"][0].as_py()
        self.left = np.flatnonzero(self.block == self.i)
        self.right = self.left if self.i == self.j else np.flatnonzero(self.block == self.j)
        self.links = np.zeros(len(self.ids), np.int64)
        self.forest = Forest(len(self.ids))

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Numbers of the vectors on both sides, each pair of vectors once; whether they are the same."""
        for a in range(0, len(self.left), PIECE):
            for b in range(a if self.i == self.j else 0, len(self.right), PIECE):
                yield self.left[a: a + PIECE], self.right[b: b + PIECE], self.i == self.j and a == b

    def add(self, left: np.ndarray, right: np.ndarray, same: bool, found: np.ndarray) -> None:
        """Links between the numbers ``left`` and ``right``; the upper triangle counts where both are the same."""
        if same:
            found = np.triu(found, 1)
        if found.any():
            self.links[left] += found @ self.copies[right]
            self.links[right] += found.T @ self.copies[left]
            for x, y in _forest(found, left, right):
                self.forest.join(x, y)

    def result(self) -> pa.Table | None:
        some = np.flatnonzero(self.links)
        if not len(some):
            return None
        roots = np.array([self.forest.root(x) for x in some.tolist()])
        apart = roots != some
        u = np.concatenate((self.ids[some], self.ids[some[apart]]))
        v = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(self.ids[roots[apart]], pa.int64())])
        return pa.table({"u": u, "v": v, "links": np.concatenate((self.links[some], np.zeros(int(apart.sum()), np.int64)))})


def _quantised(group: pa.Table, dims: int) -> Quantised:
    codes = np.frombuffer(b"".join(group["codes"].to_pylist()), np.int8).reshape(-1, dims)
    return Quantised(codes, group["scale"].to_numpy(), group["error"].to_numpy())


def _sure(threshold: float):
    """Links that the quantised vectors prove; links -1 for each vector with a pair that they leave open."""

    def run(group: pa.Table) -> pa.Table | None:
        tile = Tile(group)
        q = _quantised(group, group["dims"][0].as_py())
        open_ = np.zeros(len(tile.ids), bool)
        for left, right, same in tile.pieces():
            product, off = q.bounds(q, left, right)
            sure = product - off >= threshold
            left_open = (product + off >= threshold) & ~sure
            if same:
                left_open = np.triu(left_open, 1)
            open_[left] |= left_open.any(1)
            open_[right] |= left_open.any(0)
            tile.add(left, right, same, sure)
        found, marked = tile.result(), tile.ids[open_]
        columns = {"u": marked, "v": pa.nulls(len(marked), pa.int64()), "links": np.full(len(marked), -1)}
        out = pa.table(columns) if found is None else pa.concat_tables([found, pa.table(columns)])
        for name in ("i", "j"):
            out = out.append_column(name, pa.array(np.full(out.num_rows, getattr(tile, name), np.int32)))
        return out

    return run


def _open(threshold: float):
    """Links of the pairs that the quantised vectors leave open, in double precision."""

    def run(group: pa.Table) -> pa.Table | None:
        tile = Tile(group)
        flat = np.frombuffer(b"".join(group["vector"].to_pylist()), np.float64).reshape(len(tile.ids), -1)
        q = _quantised(group, flat.shape[1])
        for left, right, same in tile.pieces():
            product, off = q.bounds(q, left, right)
            found = (product + off >= threshold) & (product - off < threshold)
            i, j = np.nonzero(found)
            found[i, j] = exact(flat[left], flat[right], i, j) >= threshold
            tile.add(left, right, same, found)
        return tile.result()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label and the bytes of the vector in doubles: null for what links with nothing."""
    for b in batches:
        lists = b.column(1)
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null is NaN, -0 is 0
        offsets = lists.offsets.to_numpy()
        ok = b.column(2).is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) > 0)
        out = []
        for good, at, end in zip(ok.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            v = values[at:end]
            norm = v @ v if good else np.nan
            if good and not 1e-290 < norm < 1e290 and np.isfinite(v).all() and v.any():  # its direction is what counts
                v, norm = v / np.abs(v).max() + 0.0, 1.0
            out.append(v.tobytes() if np.isfinite(norm) and norm > 0 else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["vec_id", "label", "vector"])


_CODED = "cid long, copies long, label string, dims int, codes binary, scale double, error double"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes with the codes, scale and error of their vectors instead of these."""
    for b in batches:
        dims = b.column("dims").to_numpy()
        codes, scale, error = np.empty(b.num_rows, object), np.empty(b.num_rows), np.empty(b.num_rows)
        for n in np.unique(dims):
            some = np.flatnonzero(dims == n)
            flat = np.frombuffer(b"".join(b.column("vector").take(pa.array(some)).to_pylist()), np.float64).reshape(len(some), -1)
            q, scale[some], error[some] = quantise(flat / np.sqrt((flat * flat).sum(1))[:, None])
            for i, x in zip(some.tolist(), q, strict=True):
                codes[i] = x.tobytes()
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cid", "copies", "label", "dims")), pa.array(codes.tolist(), pa.binary()), pa.array(scale), pa.array(error)],
                                         names=["cid", "copies", "label", "dims", "codes", "scale", "error"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"),
                          F.col(label_col).cast("string").alias("label")).where("vec_id IS NOT NULL")
    rows = stored(rows.mapInArrow(_packed, "vec_id long, label string, vector binary")
                  .withColumn("key", F.sha2(F.concat(F.encode(F.concat(F.col("label"), F.lit("\x00")), "UTF-8"), "vector"), 256)), "vectors")
    good = rows.where("vector IS NOT NULL AND label IS NOT NULL")
    classes = good.groupBy("key").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = stored(classes.withColumn("dims", (F.length("vector") / 8).cast("int")), "vector-classes")
    coded = stored(classes.select("cid", "copies", "label", "dims", "vector").mapInArrow(_coded, _CODED), "vector-codes")
    # A label is a group of unbounded size: only its number of vectors is gathered.
    group = ["label", "dims"]
    blocks = stored(classes.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "vector-labels")
    sized = (coded.join(F.broadcast(blocks) if blocks.count() <= FAR_LABELS else blocks, group)
             .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")))
    tiles = (sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks"))
    by = [*group, "i", "j"]
    first = stored(map_groups(tiles, by, [*by, "cid"], _sure(threshold), "u long, v long, links long, i int, j int",
                              pa.schema([*_OUT, ("i", pa.int32()), ("j", pa.int32())])), "vector-sure")
    left = first.where("links = -1").select(F.col("u").alias("cid"), "i", "j")
    again = left.join(sized.drop("blocks"), "cid").join(classes.select("cid", "vector"), "cid")
    second = map_groups(again, by, [*by, "cid"], _open(threshold), "u long, v long, links long", _OUT)
    found = stored(first.where("links >= 0").select("u", "v", "links").unionByName(second), "vector-links")
    counts = found.where("v IS NULL").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("others"))
    roots = components(found.where("v IS NOT NULL").select("u", "v"), "vector-components").withColumnRenamed("node", "cid")
    named = (classes.select("key", "cid", "copies").join(counts, "cid", "left").join(roots, "cid", "left")
             .select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("component_id")))
    linked = good.join(named, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL OR label IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
