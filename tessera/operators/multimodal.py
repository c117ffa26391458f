"""Columns of text, images, audio and video: which they are, their features within a budget, a supervised adapter, and a cache."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError
from ..functions import media, textcount
from ..functions.columns import exact_quantiles, finite
from ..functions.shared import total
from . import profile, rank
from .text import fit_lexical

MODALITIES = ("text", "image", "audio", "video")
EXTENSIONS = {"image": ("png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "webp", "pgm", "ppm"), "audio": ("wav", "mp3", "flac", "ogg", "m4a", "aac", "wma"),
              "video": ("mp4", "avi", "mov", "mkv", "webm", "mpeg", "mpg", "m4v"), "text": ("txt", "md", "html", "rst")}
LEAST_TAUGHT = 20  # rows with a target that an adapter needs
SEEN, VOTE = 24, 0.7  # values that vote on a column's modality, and the share that decides
#: How a budget is shared, and its bounds.
WEIGHTS, LEAST, MOST, FLOOR = {"text": 0.40, "image": 0.24, "audio": 0.18, "video": 0.18}, 32, 16384, 16


# ---- modalities

def value_modality(value) -> str | None:
    """What one value is, by its suffix, type, first bytes or shape."""
    if isinstance(value, str):
        suffix = value.rsplit(".", 1)[-1].lower() if "." in value[-6:] and len(value) < 4096 and "\n" not in value else ""
        return next((m for m, known in EXTENSIONS.items() if suffix in known), None)
    if isinstance(value, bytes | bytearray):
        head = bytes(value[:12])
        if head[:4] in (b"\x89PNG", b"GIF8") or head[:3] == b"\xff\xd8\xff" or head[:2] in (b"P5", b"P6", b"BM"):
            return "image"
        if head[:4] == b"RIFF" and head[8:] == b"WAVE" or head[:4] in (b"fLaC", b"OggS") or head[:3] == b"ID3":
            return "audio"
        return "video" if head[4:8] == b"ftyp" or head[:4] == b"\x1aE\xdf\xa3" else None
    if isinstance(value, tuple) and len(value) == 2 and np.ndim(value[0]) == 0:
        return "audio" if np.ndim(value[1]) <= 2 and np.size(value[1]) and np.ndim(value[1]) < 3 else "video"
    if isinstance(value, dict) and "frames" in value:
        return "video"
    shape = np.shape(value)
    if len(shape) == 1 and len(value) >= 256:
        return "audio"
    if len(shape) == 2 or len(shape) == 3 and shape[2] in (1, 3, 4):
        return "image"
    return "video" if len(shape) in (3, 4) else None


def series_modality(df: DataFrame, column: str) -> str | None:
    """What a column holds: the first told values vote on media; else long or wordy texts are text."""
    values = [r[0] for r in df.select(column).where(F.col(f"`{column}`").isNotNull()).limit(SEEN).collect()]
    votes = [value_modality(v) for v in values]
    for m in ("image", "audio", "video"):
        if values and votes.count(m) >= VOTE * len(values):
            return m
    if dict(df.dtypes)[column] == "string" and values and profile.text_like(df, [column]).first()["is_text"]:
        return "text"
    return None


def resolve_modalities(df: DataFrame, given: str | dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> dict[str, str]:
    """The modality of each column that has one: as given (one for all, or by column), the rest by their values."""
    kinds = dict(df.dtypes)
    if isinstance(given, str):
        given = {c: given for c in df.columns if c not in skip and (kinds[c] in ("string", "binary") or kinds[c].startswith("array"))}
    given = dict(given or {})
    if bad := {c: m for c, m in given.items() if m not in (*MODALITIES, "tabular") or c not in df.columns}:
        raise ConfigError(f"no such column or modality: {bad}")
    for c in df.columns:
        if c not in given and c not in skip and (kinds[c] in ("string", "binary") or kinds[c].startswith("array")) and (found := series_modality(df, c)):
            given[c] = found
    return {c: m for c, m in given.items() if m != "tabular"}


# ---- budget

@dataclass(frozen=True)
class Budget:
    total: int
    by_modality: dict
    by_column: dict

    def limit_for(self, modality: str, present: list[str], columns: int = 1) -> int:
        """What a column of a modality may have: the modality's share of what is there, dealt evenly over its columns."""
        if modality in self.by_modality:
            return max(1, self.by_modality[modality] // max(1, columns))
        share = WEIGHTS[modality] / sum(WEIGHTS[m] for m in set(present) | {modality})
        return max(FLOOR, int(self.total * share) // max(1, columns))


def resolve_budget(asked: str | int | dict = "auto", speed: float = 0.5) -> Budget:
    """``auto`` is 256 + 768 * speed features; a number; or total, by_modality and by_column."""
    if not 0 <= speed <= 1:
        raise ConfigError("speed lies between 0 and 1")
    parts = asked if isinstance(asked, dict) else {"total": asked}
    if bad := set(parts) - {"total", "by_modality", "by_column"}:
        raise ConfigError(f"a budget has no {sorted(bad)}")
    total = parts.get("total", "auto")
    total = int(256 + 768 * speed) if total == "auto" else total
    if not isinstance(total, int) or not LEAST <= total <= MOST:
        raise ConfigError(f"a budget lies between {LEAST} and {MOST}")
    caps = {**parts.get("by_modality", {}), **parts.get("by_column", {})}
    if any(not isinstance(v, int) or v < 1 for v in caps.values()) or set(parts.get("by_modality", {})) - set(MODALITIES):
        raise ConfigError("caps are positive numbers of features by modality or column")
    return Budget(total, dict(parts.get("by_modality", {})), dict(parts.get("by_column", {})))


# ---- features

def text_names() -> list[str]:
    return list(textcount.NAMES)


@dataclass
class TextExtractor:
    """Handcrafted features first, then lexical factors with what is left of the limit.

    ``embed`` maps a text column to an array column, for a model of one's own;
    it gets 85 % of the rest (``auto``) or 55 % (``hybrid``), by their leading
    principal components.
    """

    limit: int
    mode: str = "auto"
    lexical: object | None = None
    components: np.ndarray | None = None
    centre: np.ndarray | None = None
    handcrafted: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame, key: str, column: str, embed=None) -> TextExtractor:
        self.handcrafted = text_names()[: self.limit]
        rest = self.limit - len(self.handcrafted)
        deep = int(rest * {"auto": 0.85, "hybrid": 0.55, "classical": 0.0}[self.mode]) if embed is not None else 0
        if deep:
            self.centre, self.components = principal(df.select(embed(F.col(f"`{column}`")).alias("x")), "x", deep)
        if rest - deep > 1:
            self.lexical = fit_lexical(df, key, column, dims=min(rest - deep, 256))
        return self

    def transform(self, df: DataFrame, key: str, column: str, embed=None) -> DataFrame:
        """``df`` with an array column ``<column>__features``."""
        c = F.coalesce(F.col(f"`{column}`"), F.lit(""))
        out = df.withColumn("__a", F.slice(textcount.handcrafted(F.col(f"`{column}`")), 1, len(self.handcrafted)))
        parts = ["__a"]
        if self.components is not None:
            out, parts = out.withColumn("__e", project(embed(c), self.centre, self.components)), [*parts, "__e"]
        if self.lexical is not None:
            out, parts = self.lexical.transform(out, column, "__l"), [*parts, "__l"]
        return out.withColumn(f"{column}__features", F.concat(*parts)).drop(*parts)


def principal(df: DataFrame, column: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading components [dims, width] of an array column, from sums of products."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.stat import Summarizer

    rows = df.where(F.col(column).isNotNull()).select(array_to_vector(column).alias("v"))
    width = len(rows.first()["v"])
    model = PCA(k=min(dims, width), inputCol="v", outputCol="o").fit(rows)
    return rows.select(Summarizer.mean(F.col("v"))).first()[0].toArray(), model.pc.toArray().T


def project(x: Column, centre: np.ndarray, components: np.ndarray) -> Column:
    """The components of an array column, as dot products."""
    moved = F.zip_with(x, F.array(*[F.lit(float(c)) for c in centre]), lambda a, c: a.cast("double") - c)
    return F.array(*[F.aggregate(F.zip_with(moved, F.array(*[F.lit(float(v)) for v in row]), lambda a, v: a * v), F.lit(0.0), lambda s, p: s + p) for row in components])


def embedding_features(train: DataFrame, column: str, embed, dims: int) -> Column:
    """The leading components of a model's vectors: ``embed`` maps the column to an array column (a pandas UDF over text, images or audio); fitted on ``train``."""
    centre, components = principal(train.select(embed(F.col(f"`{column}`")).alias("x")), "x", dims)
    return project(embed(F.col(f"`{column}`")), centre, components)


def media_names(modality: str, limit: int) -> list[str]:
    return media.feature_order(modality)[:limit]


def media_features(df: DataFrame, column: str, modality: str, limit: int, policy: str = "zero", **shape) -> DataFrame:
    """``df`` with ``<column>__features``, the first ``limit`` of the modality's feature order, and ``<column>__error``."""
    made = {"image": media.image, "audio": media.audio, "video": media.video}[modality](column, policy=policy, **shape)
    at = [media.NAMES[modality].index(n) for n in media_names(modality, limit)]
    out = df.withColumn("__m", made)
    return out.withColumns({f"{column}__features": F.array(*[F.get("__m.features", F.lit(i)) for i in at]), f"{column}__error": F.col("__m.error")}).drop("__m")


def cached_features(df: DataFrame, column: str, compute, path: str) -> DataFrame:
    """``df`` with ``<column>__features``, computed once per content: a Parquet table keyed by SHA-256 holds what is known, and only the rest is computed and added."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[column]
    body = F.col(f"`{column}`") if kind in ("string", "binary") else F.to_json(F.struct(f"`{column}`"))
    keyed = df.withColumn("__key", F.when(F.col(f"`{column}`").isNotNull(), F.sha2(body.cast("binary"), 256)))
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None
    fresh = keyed.where("__key IS NOT NULL").dropDuplicates(["__key"]).select("__key", column)
    if known is not None:
        fresh = fresh.join(known.select("__key"), "__key", "left_anti")
    compute(fresh).select("__key", f"{column}__features").write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path), "__key", "left").drop("__key")


# ---- ranking within a budget, and the supervised adapter

def rank_within_budget(df: DataFrame, columns: list[str], targets: list[str], classification: bool, limit: int) -> list[str]:
    """The columns of greatest log1p(variance) + log1p(largest F over targets), indicators of missing sources always; ties in their order."""
    flags = [c for c in columns if c.endswith("source_missing")]
    rest = [c for c in columns if c not in flags]
    variance = {r["column_name"]: r["variance"] or 0.0 for r in rank.variance_ranking(df, rest).collect()}
    best = dict.fromkeys(rest, 0.0)
    for t in targets:
        for r in (rank.anova_f if classification else rank.regression_f)(df, rest, t).collect():
            if r["f"] is not None and math.isfinite(r["f"]):
                best[r["column_name"]] = max(best[r["column_name"]], r["f"])
    order = sorted(rest, key=lambda c: -round(math.log1p(max(variance[c], 0.0)) + math.log1p(max(best[c], 0.0)), 9))
    chosen = set((flags + order)[: max(limit, len(flags))])
    return [c for c in columns if c in chosen]


@dataclass
class Adapter:
    """Partial least squares: a few directions of the features that go with the target, added as features."""

    columns: list[str]
    fill: list[float]
    centre: list[float]
    scale: list[float]
    weights: list[list[float]]  # [component, column]

    def transform(self, df: DataFrame, name: str = "pls") -> DataFrame:
        x = [(F.coalesce(finite(c), F.lit(m)) - a) / s for c, m, a, s in zip(self.columns, self.fill, self.centre, self.scale, strict=True)]
        return df.withColumns({f"{name}_{i:04d}": sum((v * float(w) for v, w in zip(x, row, strict=True)), F.lit(0.0)) for i, row in enumerate(self.weights)})


def adapter_size(limit: int, width: int) -> int:
    return max(2, min(24, limit // 5, width // 3))


def fit_adapter(df: DataFrame, columns: list[str], target: str, classes: list[str] | None = None, components: int | None = None, limit: int = 128) -> Adapter:
    """Components from one pass that sums products of features and target (one column a class); the deflation needs only these sums.

    Rows without a (finite) target teach nothing.  With fewer than ``LEAST_TAUGHT``
    rows that do, fewer than two columns, or one value of the target, the adapter
    has no component and leaves a frame as it is.
    """
    k = components or adapter_size(limit, len(columns))
    told = F.col(f"`{target}`").isNotNull() if classes else finite(target).isNotNull()
    if len(columns) < 2 or df.where(told).limit(LEAST_TAUGHT).count() < LEAST_TAUGHT:
        return Adapter(columns, [0.0] * len(columns), [0.0] * len(columns), [1.0] * len(columns), [])
    middle = exact_quantiles(df, {c: finite(c) for c in columns}, [0.5])
    fill = [(middle[c] or [0.0])[0] or 0.0 for c in columns]
    y = [F.when(F.col(f"`{target}`").cast("string") == c, 1.0).otherwise(0.0) for c in classes] if classes else [finite(target)]
    rows = df.where(told).select(*[F.coalesce(finite(c), F.lit(m)).alias(f"x{i}") for i, (c, m) in enumerate(zip(columns, fill, strict=True))], *[v.alias(f"y{i}") for i, v in enumerate(y)])

    def run(batches):
        found = None
        for b in batches:
            z = np.column_stack([np.ones(b.num_rows), *(c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns)])
            found = z.T @ z if found is None else found + z.T @ z
        return found

    d = len(columns)
    g = total(rows, run)
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    spread[spread < 1e-12] = 1.0
    cov = cov / np.outer(spread, spread)
    xx, xy = cov[:d, :d], cov[:d, d:].copy()
    directions: list[np.ndarray] = []
    loadings: list[np.ndarray] = []
    for _ in range(min(k, d)):
        if np.abs(xy).max() < 1e-10:
            break
        w = np.linalg.svd(xy, full_matrices=False)[0][:, 0]
        r = w.copy()
        for p, other in zip(loadings, directions, strict=True):
            r -= (p @ w) * other
        t = r @ xx @ r
        if t < 1e-12:
            break
        p = xx @ r / t
        q = r @ cov[:d, d:] / t
        xy = xy - t * np.outer(p, q)
        directions.append(r)
        loadings.append(p)
    return Adapter(columns, fill, mean[:d].tolist(), spread[:d].tolist(), [r.tolist() for r in directions])


@dataclass
class MultimodalPipeline:
    """Feature blocks of all columns with a modality, side by side with the rest, ranked within the budget."""

    budget: Budget
    given: str | dict | None = None
    policy: str = "zero"
    modalities: dict = field(default_factory=dict)
    extractors: dict = field(default_factory=dict)
    names: dict = field(default_factory=dict)
    kept: list = field(default_factory=list)
    adapter: Adapter | None = None
    shapes: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, key: str, target: str | None = None, classes: list[str] | None = None, speed: float = 0.5) -> MultimodalPipeline:
        self.modalities = resolve_modalities(df, self.given, (key, *([target] if target else [])))
        present = list(self.modalities.values())
        for c, m in self.modalities.items():
            limit = self.budget.by_column.get(c) or self.budget.limit_for(m, present, present.count(m))
            if m == "text":
                self.extractors[c] = TextExtractor(limit, "classical").fit(df, key, c)
                self.names[c] = [*self.extractors[c].handcrafted, *(f"lsa_{i:04d}" for i in range(self.extractors[c].lexical.dims if self.extractors[c].lexical else 0))]
            else:
                self.names[c] = media_names(m, limit)
        columns = self.columns
        if target and columns:
            flat = self._blocks(df, key)
            self.kept = rank_within_budget(flat, columns, [target], classes is not None, self.budget.total)
            if speed >= 0.6 and df.limit(80).count() >= 80:
                self.adapter = fit_adapter(flat, self.kept, target, classes, limit=self.budget.total)
        else:
            self.kept = columns[: self.budget.total]
        return self

    @property
    def columns(self) -> list[str]:
        return [x for c, names in self.names.items() for x in (*(f"{c}__{n}" for n in names), f"{c}__source_missing")]

    @property
    def groups(self) -> dict[str, list[str]]:
        """The kept columns of each modality, for specialists and for modality dropout."""
        out: dict[str, list[str]] = {}
        for c, m in self.modalities.items():
            out.setdefault(f"modality:{m}", []).extend(x for x in self.kept if x.startswith(f"{c}__"))
        return out

    def _blocks(self, df: DataFrame, key: str) -> DataFrame:
        for c, m in self.modalities.items():
            df = df.withColumn(f"{c}__source_missing", F.col(f"`{c}`").isNull().cast("int"))
            df = self.extractors[c].transform(df, key, c) if m == "text" else media_features(df, c, m, len(self.names[c]), self.policy, **self.shapes.get(c, {})).drop(f"{c}__error")
            df = df.withColumns({f"{c}__{n}": F.get(f"{c}__features", F.lit(i)) for i, n in enumerate(self.names[c])}).drop(f"{c}__features")
        return df

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        """The columns without a modality, and the kept features."""
        out = self._blocks(df, key)
        if self.adapter:
            out = self.adapter.transform(out)
        extra = [c for c in out.columns if c.startswith("pls_")] if self.adapter else []
        return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in self.modalities], *self.kept, *extra)

