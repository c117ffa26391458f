"""Boosted trees on histograms: classes under softmax, categories by ordered statistics, rankings by LambdaRank, in rounds that can stop.

The features are cut into at most ``BINS`` ranges by a quantile sketch; code 0 is
missing.  Rows travel once into blocks (one byte a cell), which stay cached.  A
level of a round's trees, one a class, is one pass: each task adds up gradients
of its blocks by (feature, class, node, bin), the sums of a feature meet in one
task, which looks for that feature's best split of every node, and only those
splits reach the driver.  So neither rows nor histograms are gathered, and what
is shuffled depends on features, classes and nodes, not on rows.

* **Categories** become ordered target statistics: the mean target of the rows of
  the same code in earlier blocks of an order by hash, with the overall mean as a
  prior; new rows get the mean of all.  A row never sees its own target.
* **Rankings** use LambdaRank: within a group each pair of different labels pulls
  by what swapping it would change in NDCG.  A group of over ``GROUP`` rows is
  dealt into parts by hash, and its pairs are those inside the parts.
* **Stopping.** Rows marked as held out train nothing; their loss is known after
  each round, ``patience`` rounds without gain end the fit, and the best round is
  kept.  A deadline ends it where the next round wouldn't fit.
* **Contributions** are path-dependent tree SHAP values, exact by the polynomial
  of each leaf's path.
"""

from __future__ import annotations

import base64
import json
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.storagelevel import StorageLevel

from ..errors import DataError, UnsupportedLearnerError

BINS, BLOCK, GROUP = 63, 8192, 1000  # ranges of a feature; rows of a block, about; rows of a group whose pairs meet
ORDERED, PRIOR = 16, 1.0  # blocks of the order of categories' statistics, and the weight of the prior
CODES = 200_000  # different codes of all categories, at most: they are part of the fitted state
STEPS = 16  # rounds between two caches of the scores
CELLS = 4_000_000  # cells of a cached partition, about
LOCAL = 3_000_000  # cells up to which all rounds run in one task; results don't depend on it
PATIENCE = 30
KINDS = ("binary", "multiclass", "regression", "ranking")


# ---- trees

@dataclass
class Tree:
    """A tree as a heap: the children of node i are 2i + 1 and 2i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.uint8), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def nodes(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row reaches in ``levels`` steps, from codes [features, rows]."""
        node, rows = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
        for _ in range(levels):
            f = self.feature[node]
            x = codes[np.maximum(f, 0), rows]
            right = np.where(x == 0, ~self.missing_left[node], x > self.bin[node])
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(codes, (len(self.feature) + 1).bit_length() - 2)]

    def to_dict(self) -> dict:
        pack = lambda x: base64.b64encode(x.tobytes()).decode()
        return {"feature": pack(self.feature), "bin": pack(self.bin), "missing_left": pack(self.missing_left), "value": pack(self.value), "cover": pack(self.cover)}

    @classmethod
    def from_dict(cls, d: dict) -> Tree:
        kinds = {"feature": np.int32, "bin": np.uint8, "missing_left": bool, "value": float, "cover": float}
        return cls(**{k: np.frombuffer(base64.b64decode(d[k]), t).copy() for k, t in kinds.items()})


# ---- features as codes

@dataclass
class Coder:
    """How rows become codes: the edges of numeric features, and the statistics of categories."""

    width: int
    edges: list[list[float]]  # of each made feature
    source: list[int]  # the feature that each made feature comes from
    categories: dict[int, dict[float, list[list[float]]]] = field(default_factory=dict)  # feature -> code -> [block][statistic]; the last block holds all rows
    prior: list[float] = field(default_factory=list)

    def codes(self, x: np.ndarray, block: np.ndarray | None = None) -> np.ndarray:
        """Codes [made features, rows] of values [rows, features]; ``block`` places training rows in the order of the statistics."""
        out = np.zeros((len(self.edges), len(x)), np.uint8)
        made = 0
        for i in range(self.width):
            if i in self.categories:
                values = self._statistics(i, x[:, i], block)
            else:
                values = x[:, i: i + 1]
            for v in values.T:
                out[made] = np.where(np.isnan(v), 0, 1 + np.searchsorted(self.edges[made], v, "left"))
                made += 1
        return out

    def _statistics(self, i: int, x: np.ndarray, block: np.ndarray | None) -> np.ndarray:
        table = self.categories[i]
        known = np.array(sorted(table))
        stats = np.array([table[c] for c in known]).reshape(len(known), ORDERED + 1, len(self.prior))
        at = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
        out = np.tile(np.array(self.prior), (len(x), 1))
        if len(known):
            hit = known[at] == x
            out[hit] = stats[at[hit], ORDERED if block is None else block[hit]]
        return out


def _array(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    return c.cast("array<double>") if isinstance(df.schema[column].dataType, ArrayType) else vector_to_array(c)


def _edges(rows: DataFrame, columns: list[int]) -> dict[int, list[float]]:
    """Inner edges of features' ranges, by a sketch, some hundred features a pass."""
    points, out = F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), {}
    for at in range(0, len(columns), 100):
        some = columns[at: at + 100]
        value = lambda i: F.when(~F.isnan(F.get("x", F.lit(i))), F.get("x", F.lit(i)))
        row = rows.agg(*[F.percentile_approx(value(i), points, F.lit(2000)).alias(f"q{i}") for i in some], *[F.max(value(i)).alias(f"m{i}") for i in some]).first()
        out |= {i: [e for e in sorted(set(row[f"q{i}"] or [])) if e < row[f"m{i}"]] for i in some}
    return out


def _encode(rows: DataFrame, width: int, categories: list[int], kind: str, classes: int) -> Coder:
    """A coder fitted on rows (x, label, weight, part)."""
    numeric = [i for i in range(width) if i not in categories]
    edges = _edges(rows, numeric)
    targets = [F.when(F.col("label") == k, 1.0).otherwise(0.0) for k in range(classes)] if kind == "multiclass" else [F.col("label")]
    coder = Coder(width, [], [])
    if categories:
        sums = [F.sum(t * F.col("weight")) for t in targets]
        total = rows.agg(F.sum("weight").alias("n"), *[s.alias(f"t{j}") for j, s in enumerate(sums)]).first()
        coder.prior = [total[f"t{j}"] / (total["n"] or 1.0) for j in range(len(targets))]
        each = (rows.select("label", "weight", "part", F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.get("x", F.lit(i)).alias("code")) for i in categories])).alias("c"))
                .where(~F.isnan("c.code")).groupBy("c.feature", "c.code", "part").agg(F.sum("weight").alias("n"), *[s.alias(f"t{j}") for j, s in enumerate(sums)]))
        counts = each.limit(CODES * ORDERED + 1).collect()
        if len(counts) > CODES * ORDERED:
            raise DataError(f"categories of over {CODES} codes: group the rare ones first")
        raw: dict[int, dict[float, np.ndarray]] = {i: {} for i in categories}
        for r in counts:
            raw[r["feature"]].setdefault(r["code"], np.zeros((ORDERED, 1 + len(targets))))[r["part"]] += [r["n"], *[r[f"t{j}"] for j in range(len(targets))]]
        prior = np.array(coder.prior)
        for i, table in raw.items():
            coder.categories[i] = {}
            for code, s in table.items():
                before = np.concatenate((np.zeros((1, s.shape[1])), np.cumsum(s, 0)))  # of earlier blocks; the last row is all
                coder.categories[i][code] = ((before[:, 1:] + PRIOR * prior) / (before[:, :1] + PRIOR)).tolist()
    for i in range(width):
        if i not in coder.categories:
            coder.edges.append(edges[i])
            coder.source.append(i)
            continue
        for j in range(len(targets)):
            values = sorted({v[j] for stats in coder.categories[i].values() for v in stats} | {coder.prior[j]})
            cuts = [(a + b) / 2 for a, b in zip(values[:-1], values[1:], strict=True)]
            if len(cuts) > BINS - 1:
                cuts = [cuts[int(k * len(cuts) / (BINS - 1))] for k in range(BINS - 1)]
            coder.edges.append(cuts)
            coder.source.append(i)
    return coder


# ---- gradients

def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(0))
    return e / e.sum(0)


def lambdas(score: np.ndarray, label: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient, curvature and pairwise loss of each row; groups lie side by side, groups of like sizes go together."""
    g, h, loss = np.zeros(len(score)), np.zeros(len(score)), np.zeros(len(score))
    starts = np.cumsum(sizes) - sizes
    for bits in range(1, int(sizes.max(initial=1)).bit_length() + 1):
        which = np.flatnonzero((sizes > 2 ** (bits - 1)) & (sizes <= 2 ** bits))
        wide = 2 ** bits
        for at in range(0, len(which), max(1, 2_000_000 // wide ** 2)):
            some = which[at: at + max(1, 2_000_000 // wide ** 2)]
            place = np.arange(wide)
            mask = place < sizes[some][:, None]
            rows = np.where(mask, starts[some][:, None] + place, 0)
            y, s = np.where(mask, label[rows], -np.inf), np.where(mask, score[rows], -np.inf)
            rank = np.argsort(np.argsort(-s, 1, kind="stable"), 1)
            gain = np.where(mask, y - np.where(mask, y, np.inf).min(1, keepdims=True), 0.0)
            discount = 1 / np.log2(rank + 2.0)
            ideal = (-np.sort(-gain, 1) / np.log2(place + 2.0)).sum(1)
            better = mask[:, :, None] & mask[:, None, :] & (gain[:, :, None] > gain[:, None, :])
            swap = np.where(better, np.abs((gain[:, :, None] - gain[:, None, :]) * (discount[:, :, None] - discount[:, None, :])), 0.0) / np.where(ideal > 0, ideal, 1.0)[:, None, None]
            apart = np.where(better, np.where(mask, score[rows], 0.0)[:, :, None] - np.where(mask, score[rows], 0.0)[:, None, :], 0.0)
            pull = 1 / (1 + np.exp(np.clip(apart, -50, 50)))
            up, curve = swap * pull, swap * pull * (1 - pull)
            np.add.at(g, rows[mask], (up.sum(1) - up.sum(2))[mask])
            np.add.at(h, rows[mask], (curve.sum(1) + curve.sum(2))[mask])
            np.add.at(loss, rows[mask], (swap * np.log1p(np.exp(-np.clip(apart, -50, 50)))).sum(2)[mask])
    return g, h, loss


@dataclass
class Block:
    codes: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    held: np.ndarray
    sizes: np.ndarray
    score: np.ndarray
    number: int

    def gradients(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients and curvatures [classes, rows], and each row's loss."""
        s, y, w = self.score, self.label, self.weight
        if kind == "regression":
            return (w * (s[0] - y))[None], w[None], w * (s[0] - y) ** 2
        if kind == "binary":
            p = 1 / (1 + np.exp(-np.clip(s[0], -40, 40)))
            return (w * (p - y))[None], (w * p * (1 - p))[None], -w * np.where(y == 1, np.log(np.maximum(p, 1e-15)), np.log(np.maximum(1 - p, 1e-15)))
        if kind == "multiclass":
            p = _softmax(s)
            own, k = y.astype(int), len(s)
            g = p.copy()
            g[own, np.arange(len(y))] -= 1
            return w * g, w * p * (1 - p) * k / (k - 1), -w * np.log(np.maximum(p[own, np.arange(len(y))], 1e-15))
        g, h, loss = lambdas(s[0], y, self.sizes)
        return (w * g)[None], (w * np.maximum(h, 1e-12))[None], w * loss


COLUMNS = ("number", "codes", "label", "weight", "held", "sizes", "score")
BLOCKS_DDL = "number long, codes binary, label binary, weight binary, held binary, sizes binary, score binary"


def _block_rows(blocks: list[Block]) -> pa.RecordBatch:
    blob = lambda name: pa.array([np.ascontiguousarray(getattr(b, name)).tobytes() for b in blocks], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([b.number for b in blocks], pa.int64()), *(blob(c) for c in COLUMNS[1:])], names=list(COLUMNS))


def _read_blocks(batches: Iterator[pa.RecordBatch], width: int, base: list[float]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            number, codes, label, weight, held, sizes, score = (batch.column(i)[row] for i in range(7))
            y = np.frombuffer(label.as_buffer())
            raw = np.frombuffer(score.as_buffer())
            yield Block(np.frombuffer(codes.as_buffer(), np.uint8).reshape(width, len(y)), y, np.frombuffer(weight.as_buffer()), np.frombuffer(held.as_buffer(), bool),
                        np.frombuffer(sizes.as_buffer(), np.int64), raw.reshape(-1, len(y)).copy() if len(raw) else np.repeat(np.array(base)[:, None], len(y), 1), number.as_py())


def _added(block: Block, rounds: list[list[Tree]]) -> Block:
    for trees in rounds:
        for k, t in enumerate(trees):
            block.score[k] += t.predict(block.codes)
    return block


# ---- the fitted model

def _matrix(x: pa.Array) -> np.ndarray:
    """An array column of equal lengths as [rows, values]."""
    return np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(len(x), -1)


def _lists(x: np.ndarray) -> pa.Array:
    """A column of (nested) arrays of the shape of ``x`` beyond its first axis."""
    out = pa.array(np.ascontiguousarray(x, float).ravel())
    for n in reversed(x.shape[1:]):
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, n, dtype=np.int32)), out)
    return out


class _Shares(list):
    def toArray(self) -> np.ndarray:
        return np.array(self)


@dataclass
class BoostedModel:
    """Transforms like a Spark learner: adds prediction, and for classes probability."""

    kind: str
    coder: Coder
    base: list[float]
    rounds: list[list[Tree]]
    gains: list[float]
    features_col: str = "features"
    losses: list[float] = field(default_factory=list)
    stopped: str = "all rounds"

    def setFeaturesCol(self, name: str) -> BoostedModel:
        self.features_col = name
        return self

    @property
    def featureImportances(self) -> _Shares:
        """Each feature's share of the gain of all splits."""
        total = np.zeros(self.coder.width)
        np.add.at(total, self.coder.source, self.gains)
        return _Shares(total / max(total.sum(), 1e-12))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores [classes, rows] of values [rows, features]."""
        codes = self.coder.codes(x)
        out = np.repeat(np.array(self.base)[:, None], len(x), 1)
        for trees in self.rounds:
            for k, t in enumerate(trees):
                out[k] += t.predict(codes)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        model, kind = self, self.kind

        @F.arrow_udf("array<double>")
        def scores(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.list_(pa.float64()))
            raw = model.raw(_matrix(x))
            if kind == "binary":
                p = 1 / (1 + np.exp(-np.clip(raw[0], -40, 40)))
                raw = np.stack((1 - p, p))
            elif kind == "multiclass":
                raw = _softmax(raw)
            return _lists(raw.T)

        out = df.withColumn("__scores", scores(_array(df, self.features_col)))
        if kind in ("regression", "ranking"):
            return out.withColumn("prediction", F.get("__scores", F.lit(0))).drop("__scores")
        said = F.array_position("__scores", F.array_max("__scores")).cast("double") - 1
        return out.withColumns({"prediction": said, "probability": array_to_vector("__scores")}).drop("__scores")

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Tree SHAP values [classes, rows, features + 1]; the last is the expected score, and a row's sum is its score."""
        codes = self.coder.codes(x)
        made = np.zeros((len(self.base), len(self.coder.edges), len(x)))
        expected = np.array(self.base)
        for trees in self.rounds:
            for k, t in enumerate(trees):
                expected[k] += shap(t, codes, made[k])
        out = np.zeros((len(self.base), len(x), self.coder.width + 1))
        for j, i in enumerate(self.coder.source):
            out[:, :, i] += made[:, j]
        out[:, :, -1] = expected[:, None]
        return out

    def explain(self, df: DataFrame, name: str = "contributions") -> DataFrame:
        """``df`` with each row's tree SHAP values, an array a class of features and, last, the expected score."""
        model = self

        @F.arrow_udf("array<array<double>>")
        def values(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.list_(pa.list_(pa.float64())))
            return _lists(model.contributions(_matrix(x)).transpose(1, 0, 2))

        return df.withColumn(name, values(_array(df, self.features_col)))

    def to_dict(self) -> dict:
        c = self.coder
        return {"kind": self.kind, "base": self.base, "gains": self.gains, "features_col": self.features_col, "losses": self.losses, "stopped": self.stopped,
                "coder": {"width": c.width, "edges": c.edges, "source": c.source, "prior": c.prior, "categories": {str(i): [[k, v] for k, v in t.items()] for i, t in c.categories.items()}},
                "rounds": [[t.to_dict() for t in trees] for trees in self.rounds]}

    @classmethod
    def from_dict(cls, d: dict) -> BoostedModel:
        c = d["coder"]
        coder = Coder(c["width"], c["edges"], c["source"], {int(i): {k: v for k, v in t} for i, t in c["categories"].items()}, c["prior"])
        return cls(d["kind"], coder, d["base"], [[Tree.from_dict(t) for t in trees] for trees in d["rounds"]], d["gains"], d["features_col"], d["losses"], d["stopped"])


def shap(tree: Tree, codes: np.ndarray, out: np.ndarray) -> float:
    """Adds a tree's path-dependent SHAP values to ``out`` [features, rows]; returns its expected value.

    Of each leaf's path every feature has a share z, that of the rows that go the
    path's way, and o, whether the row itself goes it.  A set S of known features
    reaches the leaf by the product of o in S and z outside; the weights of all
    sets of one size come from the coefficients of the product of (z + o t).
    """
    expected = 0.0
    stack: list[tuple[int, dict[int, tuple[float, np.ndarray]]]] = [(0, {})]
    while stack:
        node, path = stack.pop()
        f = int(tree.feature[node])
        if f >= 0:
            x = codes[f]
            right = np.where(x == 0, ~tree.missing_left[node], x > tree.bin[node])
            for child, goes in ((2 * node + 1, ~right), (2 * node + 2, right)):
                z, o = path.get(f, (1.0, np.ones(codes.shape[1], bool)))
                share = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.5
                stack.append((child, path | {f: (z * share, o & goes)}))
            continue
        m, value = len(path), tree.value[node]
        expected += value * math.prod(z for z, _ in path.values())
        if not m or not value:
            continue
        parts = [(g, z, o.astype(float)) for g, (z, o) in path.items()]
        for g, z, o in parts:
            poly = np.zeros((m, codes.shape[1]))
            poly[0] = 1.0
            for h, zh, oh in parts:
                if h != g:
                    shifted = np.zeros_like(poly)
                    shifted[1:] = poly[:-1] * oh
                    poly = poly * zh + shifted
            weight = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])
            out[g] += value * (weight @ poly) * (o - z)
    return expected


# ---- fitting

@dataclass
class Boosting:
    """An untrained learner; ``fit`` reads the columns named here."""

    kind: str = "binary"
    trees: int = 20
    depth: int = 5
    step: float = 0.1
    first_step: float | None = None  # of the first round: whole for a regression, whose first tree then tells what a tree can; else as the others
    min_rows: int = 20
    subsample: float = 1.0
    ridge: float = 1.0
    classes: int = 2
    seed: int = 42
    categories: list[int] = field(default_factory=list)
    patience: int = PATIENCE
    deadline: object | None = None  # with left(), seconds
    features_col: str = "features"
    label_col: str = "label"
    weight_col: str | None = None
    held_col: str | None = None
    group_col: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise UnsupportedLearnerError(self.kind)

    def setFeaturesCol(self, name: str) -> Boosting:
        self.features_col = name
        return self

    def setWeightCol(self, name: str) -> Boosting:
        self.weight_col = name
        return self

    def setValidationIndicatorCol(self, name: str) -> Boosting:
        self.held_col = name
        return self

    # ---- rows into blocks

    def _rows(self, df: DataFrame) -> DataFrame:
        one = lambda c, value: F.col(f"`{c}`") if c else F.lit(value)
        part = F.pmod(F.xxhash64(F.lit(self.seed), F.monotonically_increasing_id()), F.lit(ORDERED)).cast("int")
        rows = df.select(_array(df, self.features_col).alias("x"), F.col(f"`{self.label_col}`").cast("double").alias("label"), one(self.weight_col, 1.0).cast("double").alias("weight"),
                         one(self.held_col, False).cast("boolean").alias("held"), one(self.group_col, 0).alias("grp"), part.alias("part"))
        return rows.where("label IS NOT NULL AND x IS NOT NULL")

    def _together(self, rows: DataFrame) -> DataFrame:
        """Rows of a group next to each other; a group of over ``GROUP`` rows as parts by hash."""
        large = rows.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("grp", F.ceil(F.col("n") / (GROUP * 0.75)).cast("int").alias("parts"))
        large = large.persist()
        large = F.broadcast(large) if large.count() <= 1_000_000 else large
        dealt = rows.join(large, "grp", "left").withColumn("deal", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("x", "label", "part"), F.col("parts"))))
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return dealt.repartition(n, "grp", "deal").sortWithinPartitions("grp", "deal").withColumn("grp", F.xxhash64("grp", "deal")).drop("deal", "parts")

    def _blocks(self, rows: DataFrame, coder: Coder, ranked: bool) -> DataFrame:
        from pyspark import TaskContext

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            held: list[pa.RecordBatch] = []
            count = 0

            def made(table: pa.Table) -> pa.RecordBatch:
                nonlocal number
                n = table.num_rows
                flat = table["x"].combine_chunks()
                x = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)
                get = lambda c: table[c].to_numpy()
                g = get("grp")
                cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if ranked else np.zeros(1, np.int64)
                block = Block(coder.codes(x, get("part")), get("label").astype(float), get("weight").astype(float), get("held").astype(bool), np.diff(np.append(cuts, n)).astype(np.int64), np.zeros(0), number)
                number += 1
                return _block_rows([block])

            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                count += batch.num_rows
                if count < BLOCK:
                    continue
                table = pa.Table.from_batches(held)
                if ranked:  # the last group may go on
                    g = table["grp"].to_numpy()
                    same = np.flatnonzero(g != g[-1])
                    cut = int(same[-1]) + 1 if len(same) else 0
                else:
                    cut = table.num_rows
                if cut:
                    for a in range(0, cut, 4 * BLOCK) if not ranked else (0,):
                        yield made(table.slice(a, min(4 * BLOCK, cut - a) if not ranked else cut))
                held, count = table.slice(cut).to_batches(), table.num_rows - cut
            if count:
                yield made(pa.Table.from_batches(held))

        return rows.select("x", "label", "weight", "held", "grp", "part").mapInArrow(run, BLOCKS_DDL)

    # ---- one level

    def _sums(self, blocks: Iterator[Block], width: int, classes: int, growing: list[Tree], level: int, round_: int, judge: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gradients by [feature, class, 3, node and bin], and the held rows' loss and weight."""
        first, nodes = 2 ** level - 1, 2 ** level
        size = nodes * (BINS + 1)
        sums, loss = np.zeros((width, classes, 3, size)), np.zeros(2)
        for block in blocks:
            g, h, each = block.gradients(self.kind)
            if judge:
                loss += (each[block.held].sum(), block.weight[block.held].sum())
            use = ~block.held
            if self.subsample < 1:
                use &= np.random.default_rng((self.seed, round_, block.number)).random(len(use)) < self.subsample
            for k in range(classes):
                node = growing[k].nodes(block.codes, level)
                some = np.flatnonzero(use & (node >= first))
                at = (node[some] - first) * (BINS + 1)
                gk, hk = g[k][some], h[k][some]
                for f in range(width):
                    where = at + block.codes[f][some]
                    sums[f, k, 0] += np.bincount(where, gk, size)
                    sums[f, k, 1] += np.bincount(where, hk, size)
                    sums[f, k, 2] += np.bincount(where, minlength=size)
        return sums, loss

    def _splits(self, s: np.ndarray, classes: int, nodes: int) -> np.ndarray:
        """One feature's best split of every node [class, node, 9]: gain, bin, missing left, and the sums of the left side and of all."""
        s = s.reshape(classes, 3, nodes, BINS + 1).transpose(1, 0, 2, 3)
        every, missing = s.sum(-1), s[..., 0]
        left = np.cumsum(s[..., 1:], -1)[..., :-1]  # missing right
        both = np.stack((left, left + missing[..., None]), -1)  # ..., bins, missing left or not
        rest = every[..., None, None] - both
        score = lambda x: x[0] ** 2 / (x[1] + self.ridge)
        gain = score(both) + score(rest) - score(every)[..., None, None]
        gain = np.where((both[2] >= self.min_rows) & (rest[2] >= self.min_rows), gain, -np.inf).reshape(classes, nodes, -1)
        top = gain.argmax(-1)
        pick = np.take_along_axis(both.reshape(3, classes, nodes, -1), top[None, ..., None], -1)[..., 0]
        return np.stack((np.take_along_axis(gain, top[..., None], -1)[..., 0], top // 2 + 1, top % 2, *pick, *every), -1)

    def _level(self, blocks: DataFrame, parts: int, width: int, base: list[float], pending: list, growing: list[Tree], level: int, round_: int, judge: bool) -> tuple[np.ndarray, np.ndarray]:
        """Every feature's best splits [feature, class, node, 9], and the held rows' loss and weight."""
        classes, nodes, plain = len(base), 2 ** level, self._plain()

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (_added(b, pending) for b in _read_blocks(batches, width, base))
            sums, loss = plain._sums(rows, width, classes, growing, level, round_, judge)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width, dtype=np.int32)), pa.array([loss.tobytes(), *(s.tobytes() for s in sums)], pa.binary())], names=["feature", "sums"])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for f, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    s = np.frombuffer(s.as_buffer())
                    total[f] = total[f] + s if f in total else s
            out = [s.tobytes() if f < 0 else plain._splits(s, classes, nodes).tobytes() for f, s in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(out, pa.binary())], names=["feature", "splits"])

        size = width * classes * nodes * (BINS + 1) * 24 * parts
        sums = blocks.mapInArrow(partial, "feature int, sums binary").repartition(max(1, min(width, int(size // 32e6) + 1)), "feature")
        found = {r["feature"]: np.frombuffer(r["splits"]) for r in sums.mapInArrow(best, "feature int, splits binary").collect()}
        loss = found.pop(-1)
        return np.stack([found[f].reshape(classes, nodes, 9) for f in range(width)]), loss

    def _plain(self) -> Boosting:
        """This learner without its deadline, whose clock is the driver's."""
        return replace(self, deadline=None)

    def _rounds(self, width: int, classes: int, level, advance, left) -> tuple[list[list[Tree]], list[float], list[float], str]:
        """The rounds, the gain of each feature's splits, the held rows' loss before each round, and why they ended.

        ``level(pending, growing, level, round, judge)`` gives the splits;
        ``advance(pending)`` is asked after each round and says which rounds it
        hasn't put into the scores; ``left()`` are the seconds that remain.
        """
        rounds: list[list[Tree]] = []
        gains, losses, pending, stopped, slowest = np.zeros(width), [], [], "all rounds", 0.0
        first = self.first_step if self.first_step is not None else 1.0 if self.kind == "regression" else self.step
        for r in range(self.trees + 1):
            last = r == self.trees  # only the loss
            if last and not self.held_col:
                break
            if rounds and not last and left() < 1.5 * slowest:
                stopped = "deadline"
                break
            start = time.monotonic()
            growing, over = [Tree.empty(self.depth) for _ in range(classes)], last
            for depth in range(self.depth):
                splits, loss = level(pending, growing, depth, r, bool(self.held_col) and depth == 0)
                if depth == 0 and self.held_col and loss[1] > 0:
                    losses.append(float(loss[0] / loss[1]))
                    if len(losses) - 1 - int(np.argmin(losses)) >= self.patience:
                        stopped, over = "held-out loss", True
                top = splits[..., 0].argmax(0)
                if over or not self._grow(growing, np.take_along_axis(splits, top[None, ..., None], 0)[0], top, depth, gains, self.step if rounds else first):
                    break
            if over:
                break
            rounds.append(growing)
            pending = advance([*pending, growing])
            slowest = max(slowest, time.monotonic() - start)
        if losses:
            rounds = rounds[: int(np.argmin(losses))]
        return rounds, gains.tolist(), losses, stopped

    def _in_one_task(self, blocks: DataFrame, width: int, base: list[float]) -> tuple:
        """All rounds over few blocks, by the same steps, in one task."""
        plain, seconds = self._plain(), math.inf if self.deadline is None else self.deadline.left()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends = time.monotonic() + seconds
            held = list(_read_blocks(batches, width, base))

            def level(pending, growing, depth, r, judge):
                sums, loss = plain._sums(iter(held), width, len(base), growing, depth, r, judge)
                return np.stack([plain._splits(s, len(base), 2 ** depth) for s in sums]), loss

            def advance(pending):
                for b in held:
                    _added(b, pending)
                return []

            rounds, gains, losses, stopped = plain._rounds(width, len(base), level, advance, lambda: ends - time.monotonic())
            made = json.dumps({"rounds": [[t.to_dict() for t in trees] for trees in rounds], "gains": gains, "losses": losses, "stopped": stopped})
            yield pa.RecordBatch.from_arrays([pa.array([made])], names=["made"])

        made = json.loads(blocks.coalesce(1).mapInArrow(run, "made string").first()["made"])
        return [[Tree.from_dict(t) for t in trees] for trees in made["rounds"]], made["gains"], made["losses"], made["stopped"]

    def fit(self, df: DataFrame) -> BoostedModel:
        ranked = self.kind == "ranking"
        if ranked and not self.group_col:
            raise DataError("a ranking needs a group")
        rows = self._rows(df).persist(StorageLevel.MEMORY_AND_DISK)  # read by the sketch, the statistics and the blocks
        first = rows.select(F.size("x").alias("n")).first()
        if first is None:
            rows.unpersist()
            raise DataError("no rows to train on")
        classes = self.classes if self.kind == "multiclass" else 1
        train = rows.where(~F.col("held"))
        coder = _encode(train, first["n"], [i for i in self.categories if i < first["n"]], self.kind, classes)
        base, width = self._base(train, classes), len(coder.edges)
        blocks = self._blocks(self._together(rows) if ranked else rows, coder, ranked).persist(StorageLevel.MEMORY_AND_DISK)
        cells = (blocks.agg(F.sum(F.octet_length("label") / 8)).first()[0] or 0) * width * classes
        rows.unpersist()
        cached = [blocks]
        if cells <= LOCAL:
            rounds, gains, losses, stopped = self._in_one_task(blocks, width, base)
        else:
            parts = max(1, min(blocks.rdd.getNumPartitions(), math.ceil(cells / CELLS)))

            def level(pending, growing, depth, r, judge):
                return self._level(cached[-1].coalesce(parts), parts, width, base, pending, growing, depth, r, judge)

            def advance(pending):
                if len(pending) < STEPS:
                    return pending
                cached.append(self._advance(cached[-1], width, base, pending))
                cached.pop(0).unpersist()
                return []

            rounds, gains, losses, stopped = self._rounds(width, classes, level, advance, lambda: math.inf if self.deadline is None else self.deadline.left())
        for b in cached:
            b.unpersist()
        return BoostedModel(self.kind, coder, base, rounds, gains, self.features_col, losses, stopped)

    def _base(self, train: DataFrame, classes: int) -> list[float]:
        """The scores before the first round."""
        total = train.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("y"),
                          *[F.sum(F.when(F.col("label") == k, F.col("weight")).otherwise(0.0)).alias(f"c{k}") for k in range(classes)]).first()
        n = total["n"] or 1.0
        if self.kind == "ranking":
            return [0.0]
        if self.kind == "regression":
            return [(total["y"] or 0.0) / n]
        if self.kind == "multiclass":
            return [math.log(max((total[f"c{k}"] or 0.0) / n, 1e-6)) for k in range(classes)]
        p = min(1 - 1e-6, max(1e-6, (total["y"] or 0.0) / n))
        return [math.log(p / (1 - p))]

    def _grow(self, growing: list[Tree], split: np.ndarray, feature: np.ndarray, level: int, gains: np.ndarray, step: float) -> bool:
        """Puts the splits into the trees; whether any node was split."""
        any_ = False
        first = 2 ** level - 1
        for k, tree in enumerate(growing):
            for j in range(2 ** level):
                gain, bin_, missing_left, gl, hl, cl, g, h, c = split[k, j]
                node = first + j
                if level and (tree.feature[(node - 1) // 2] < 0 or not c):
                    continue
                if not level:
                    tree.cover[0], tree.value[0] = c, -step * g / (h + self.ridge)
                if not gain > 1e-10:
                    continue
                any_ = True
                tree.feature[node], tree.bin[node], tree.missing_left[node] = feature[k, j], bin_, missing_left
                gains[feature[k, j]] += gain
                for child, (a, b, n) in ((2 * node + 1, (gl, hl, cl)), (2 * node + 2, (g - gl, h - hl, c - cl))):
                    tree.value[child], tree.cover[child] = -step * a / (b + self.ridge), n
        return any_

    def _advance(self, blocks: DataFrame, width: int, base: list[float], pending: list[list[Tree]]) -> DataFrame:
        """The blocks with the pending rounds in their scores, cached; what a lost executor held is computed again."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _read_blocks(batches, width, base):
                yield _block_rows([_added(block, pending)])

        after = blocks.mapInArrow(run, BLOCKS_DDL).persist(StorageLevel.MEMORY_AND_DISK)
        after.count()
        return after
