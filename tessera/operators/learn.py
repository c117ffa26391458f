"""Learners (boosted trees of this library, forests and linear models of pyspark.ml): fit, predict, calibrate, out-of-fold predictions, bundles and reports.

``fit`` keeps its rows apart: the threshold is tuned on a probe of the training
rows, calibration and conformal sets use rows that no learner has seen, and the
metrics come from a holdout that nothing has chosen by.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError, NotFittedError, UnsupportedLearnerError
from ..functions.columns import cut_points, exact_quantiles, finite, numeric_columns, place_within
from ..functions.shared import fresh_path
from . import decide, metrics, profile, tuning, validate
from . import rows as row_filters
from .boosting import PATIENCE, BoostedModel, Boosting
from .clean import Cleaner, LabelEncoder
from .quality import audit
from .split import calibration_split, folds, search_sample, split, split_group, split_random, split_stratified, validation_folds

TASKS = ("binary", "multiclass", "regression", "ranking", "multilabel", "multioutput_regression")
LEARNERS = ("auto", "gbt", "forest", "linear")
CLASSES = ("binary", "multiclass", "multilabel")
ARCHIVE, OWN_CLASSES = ".zip", "org.apache.spark.ml."  # suffix of a bundle in one file; classes that are made without being trusted
BUNDLE, MOST_FILES, MOST_BYTES = 3, 2000, 4 << 30  # bundle format; limits of what is read back


@dataclass
class FitConfig:
    target: str | list[str] = ""
    task: str = "auto"
    learner: str = "auto"
    key: str = ""
    group: str | None = None
    time: str | None = None
    split: str = "auto"
    test_size: float = 0.2
    seed: int = 42
    trees: int = 20
    depth: int = 5
    optimize_threshold: bool = True
    objective: str = "f1"
    calibration: str = "none"
    conformal: str | bool = "auto"
    alpha: float = 0.1
    class_weight: str | None = "auto"
    early_stopping: bool = False
    patience: int = PATIENCE
    trials: int = 0
    clean: str = "minimal"
    leakage: str = "warn"
    fill: str = "median"
    distribution: str = "none"
    scaling: str = "none"
    seconds: float | None = None
    features: list[str] | None = None

    def __post_init__(self):
        choices = {"task": ("auto", *TASKS), "learner": LEARNERS, "calibration": ("none", "sigmoid", "isotonic", "auto"), "conformal": ("auto", True, False),
                   "class_weight": ("auto", None), "split": ("auto", "random", "temporal", "group", "stratified_group"), "clean": ("auto", "minimal", "none"),
                   "leakage": ("drop", "warn", "ignore", "error"), "fill": ("median", "mean", "constant", "knn", "iterative"), "distribution": ("none", "auto", "log1p"),
                   "scaling": ("none", "standard", "minmax", "robust"), "objective": (*decide.OBJECTIVES, "roc_auc")}
        for name, values in choices.items():
            if getattr(self, name) not in values:
                raise ConfigError(f"{name} is one of {values}")
        for name in ("test_size", "alpha"):
            if not 0 < getattr(self, name) < 1:
                raise ConfigError(f"{name} lies between 0 and 1")
        if self.trees < 1 or not 1 <= self.depth <= 30 or self.trials < 0 or self.seconds is not None and self.seconds <= 0:
            raise ConfigError("trees, depth, trials or seconds out of range")
        if not self.target or not self.key:
            raise ConfigError("target and key are needed")


def estimator(task: str, family: str, classes: int = 2, trees: int = 20, seed: int = 42, params: dict | None = None):
    """An untrained learner of a family, on columns features and label."""
    p = {**tuning.default_params(family), **(params or {})}
    opts = {"featuresCol": "features", "labelCol": "label"}
    numeric = task in ("regression", "ranking", "multioutput_regression")
    if not numeric and task not in CLASSES:
        raise UnsupportedLearnerError(task)
    if family == "linear":
        if numeric:
            return LinearRegression(regParam=p["ridge"], elasticNetParam=p["elastic"], **opts)
        return LogisticRegression(regParam=p["ridge"], elasticNetParam=p["elastic"], **opts)
    if family == "gbt":
        kind = "ranking" if task == "ranking" else "regression" if numeric else "multiclass" if classes > 2 else "binary"
        return Boosting(kind, trees=trees, depth=p["depth"], step=p.get("step", 0.1), min_rows=p["min_rows"], subsample=p["subsample"], classes=classes, seed=seed)
    tree = {"maxDepth": p["depth"], "minInstancesPerNode": p["min_rows"], "subsamplingRate": p["subsample"], "seed": seed, **opts}
    return (RandomForestRegressor if numeric else RandomForestClassifier)(numTrees=trees, **tree)


def build(task: str, learner: str, config: FitConfig, classes: int = 2, params: dict | None = None, categories: list[int] = (), group: str | None = None, deadline=None):
    """The configured learner; boosted trees take the categories among the features, a ranking's group, and the deadline."""
    family = "gbt" if learner == "auto" else learner
    own = {} if family == "linear" else {"depth": config.depth, "min_rows": 1, "subsample": 1.0}
    made = estimator(task, family, classes, config.trees, config.seed, {**own, **(params or {})})
    if isinstance(made, Boosting):
        made.categories, made.group_col, made.deadline, made.patience = list(categories), group if made.kind == "ranking" else None, deadline, config.patience
        if config.early_stopping:
            made.setValidationIndicatorCol("held")
    return made


def _between(edges: list[float], values: list[float]):
    """Linear interpolation between steps, constant beyond them, in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(np.interp(x, edges, values))

    return run


@dataclass
class Calibrator:
    """Probabilities as they turn out, by class: a sigmoid of the log-odds (slope, offset) or the steps of an isotonic fit."""

    method: str
    parts: list = field(default_factory=list)

    def apply(self, p: Column, k: int = 0) -> Column:
        """The calibrated probability; null where there is none."""
        part = self.parts[k]
        if self.method == "sigmoid":
            q = F.when(p.isNotNull(), F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p)))
            return 1 / (1 + F.exp(-(part[0] * F.log(q / (1 - q)) + part[1])))
        edges, values = part
        if len(edges) < 2:
            return F.lit(float(values[0]) if values else 0.5) + 0 * p
        return F.when(p.isNotNull(), _between(edges, values)(p))

    def apply_all(self, p: Column) -> Column:
        """All classes one against the rest, then brought to sum to 1."""
        each = [self.apply(F.get(p, F.lit(k)), k) for k in range(len(self.parts))]
        total = sum(each, F.lit(0.0))
        return F.array(*[x / F.when(total > 0, total).otherwise(1.0) for x in each])  # no lambda: these can't hold the steps' UDF


def fit_calibrator(df: DataFrame, columns: list[tuple[str, str]], method: str = "auto") -> Calibrator:
    """One part for each (0/1 label, probability); auto is isotonic from 1200 rows on.  A label of one kind has its share as constant."""
    if method == "auto":
        method = "isotonic" if df.count() >= 1200 else "sigmoid"
    shares = df.agg(*[F.avg(F.col(y).cast("double")).alias(f"s{i}") for i, (y, _) in enumerate(columns)]).first()
    parts = []
    for i, (y, p) in enumerate(columns):
        share = shares[f"s{i}"]
        if share in (0.0, 1.0, None):
            parts.append((0.0, 40.0 if share else -40.0) if method == "sigmoid" else ([0.0], [share or 0.0]))
        elif method == "sigmoid":
            parts.append(calibrate_sigmoid(df, y, p))
        else:
            m = calibrate_isotonic(df, y, p)
            parts.append((m.boundaries.toArray().tolist(), m.predictions.toArray().tolist()))
    return Calibrator(method, parts)


@dataclass
class FittedModel:
    config: FitConfig
    task: str
    cleaner: Cleaner
    learners: dict = field(default_factory=dict)
    classes: list[str] = field(default_factory=list)
    threshold: float | dict = 0.5
    calibrator: Calibrator | None = None
    conformal: float | dict | None = None
    ood: dict = field(default_factory=dict)
    ood_threshold: float = 0.35
    drift: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)

    @property
    def residual(self) -> float | None:
        return self.conformal if isinstance(self.conformal, float) else None

    def _scored(self, df: DataFrame, keep: list[str]) -> DataFrame:
        if not self.learners:
            raise NotFittedError("fit first")
        out = self.cleaner.transform(df, keep=keep)
        return self._learners(VectorAssembler(inputCols=self.cleaner.outputs, outputCol="features", handleInvalid="keep").transform(out))

    def _learners(self, out: DataFrame) -> DataFrame:
        for name, learner in self.learners.items():
            out = learner.transform(out).withColumnRenamed("prediction", f"raw_{name}")
            if "probability" in out.columns:
                out = out.withColumn(f"p_{name}", vector_to_array("probability")).drop("probability", "rawPrediction")
        return out

    def _probabilities(self, out: DataFrame) -> DataFrame:
        """Calibrated: p (binary), p (array, multiclass) or p_<label> as numbers (multilabel)."""
        c = self.calibrator
        if self.task == "binary":
            p = F.element_at("p_label", 2)
            return out.withColumn("p", c.apply(p) if c else p)
        if self.task == "multiclass":
            return out.withColumn("p", c.apply_all(F.col("p_label")) if c else F.col("p_label"))
        for k, t in enumerate(self.learners):
            p = F.element_at(f"p_{t}", 2)
            out = out.withColumn(f"p_{t}", c.apply(p, k) if c else p)
        return out

    def predict(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """``keep`` columns and prediction(s): one projection after the learners, nothing on the driver."""
        if both := {c: f"__kept_{i}" for i, c in enumerate(keep) if c in self.cleaner.outputs}:  # kept as they are, beside the features made of them
            out = self.predict(df.withColumns({new: F.col(f"`{c}`") for c, new in both.items()}), [both.get(c, c) for c in keep])
            return out.withColumnsRenamed({new: c for c, new in both.items()})
        out = self._scored(df, list(keep))
        if self.task in CLASSES:
            out = self._probabilities(out)
        if self.task == "binary":
            return out.select(*keep, F.when(F.col("p") >= self.threshold, F.lit(self.classes[1])).otherwise(self.classes[0]).alias("prediction"), F.col("p").alias("probability"))
        if self.task == "multiclass":
            names = F.array(*[F.lit(c) for c in self.classes])
            return out.select(*keep, F.get(names, F.array_position("p", F.array_max("p")).cast("int") - 1).alias("prediction"), F.col("p").alias("probability"))
        if self.task == "multilabel":
            return out.select(*keep, *[(F.col(f"p_{t}") >= self.threshold[t]).cast("int").alias(f"prediction_{t}") for t in self.learners],
                              *[F.col(f"p_{t}").alias(f"probability_{t}") for t in self.learners])
        names = list(self.learners)
        return out.select(*keep, *[F.col(f"raw_{t}").alias("prediction" if len(names) == 1 else f"prediction_{t}") for t in names])

    def predict_ranked(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """A ranking's scores, and each row's place in its group, found in ranges of the score."""
        out = self.predict(df, [*keep, *([self.config.group] if self.config.group not in keep else [])])
        part = -F.size(F.filter(cut_points(out, "prediction"), lambda e: e <= F.col("prediction")))
        return place_within(out, [self.config.group], [F.desc("prediction"), *map(F.col, keep)], part, "rank")

    def predict_interval(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        if self.task != "regression" or self.residual is None:
            raise DataError("intervals need a regression with a conformal quantile")
        return self.predict(df, keep).withColumns(decide.interval("prediction", self.residual))

    def predict_sets(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """The classes that may be true, at the level that was fitted."""
        if self.task not in ("binary", "multiclass") or self.conformal is None:
            raise DataError("sets need a classifier with a conformal quantile")
        out = self.predict(df, keep)
        p = F.array(1 - F.col("probability"), F.col("probability")) if self.task == "binary" else F.col("probability")
        return out.withColumn("classes", decide.prediction_set(p, self.classes, self.conformal))

    def ood_scores(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        score = decide.ood_score(self.ood)
        return df.select(*keep, score.alias("ood_score"), (score >= self.ood_threshold).alias("out_of_distribution"))

    def drift_report(self, df: DataFrame) -> dict:
        """Drift of each feature against the training rows, and overall."""
        each = decide.numeric_drift(self.drift["numeric"], df) if self.drift.get("numeric") else []
        each += [decide.categorical_drift(ref, df, c) for c, ref in self.drift.get("categorical", {}).items()]
        value, how = decide.overall_drift([x["score"] for x in each])
        return {"overall": value, "severity": how, "columns": [x | {"severity": decide.severity(x["score"])} for x in each]}

    # ---- bundles

    def save(self, spark: SparkSession, path: str) -> None:
        """A folder, local or shared: learners by their own writers, the metadata, and a manifest with the SHA-256 and size of every file.

        A path that ends in ``.zip`` gets all of it as one archive.
        """
        if path.endswith(ARCHIVE):
            folder = fresh_path(spark, "bundle")
            self.save(spark, folder)
            return pack(spark, folder, path)
        boosted = []
        for name, learner in self.learners.items():
            if isinstance(learner, BoostedModel):
                old, system = _file(spark, f"{path}/learner_{name}")
                system.delete(old, True)
                write_text(spark, f"{path}/learner_{name}/part-trees.json", json.dumps(learner.to_dict()))
                boosted.append(name)
            else:
                PipelineModel([learner]).write().overwrite().save(f"{path}/learner_{name}")
        cleaner = json.loads(self.cleaner.to_json())
        if "path" in (cleaner["state"].get("impute") or {}):  # the rows that neighbours are looked for among
            spark.read.parquet(cleaner["state"]["impute"]["path"]).write.mode("overwrite").parquet(f"{path}/neighbours")
            cleaner["state"]["impute"]["path"] = ""
        meta = {"version": BUNDLE, "config": asdict(self.config), "task": self.task, "cleaner": cleaner, "classes": self.classes, "threshold": self.threshold,
                "calibrator": asdict(self.calibrator) if self.calibrator else None, "conformal": self.conformal, "ood": self.ood, "ood_threshold": self.ood_threshold,
                "drift": self.drift, "metrics": self.metrics, "notes": self.notes, "learners": list(self.learners), "boosted": boosted}
        write_text(spark, f"{path}/metadata.json", json.dumps(meta, sort_keys=True))
        write_text(spark, f"{path}/manifest.json", json.dumps(_digests(spark, path), sort_keys=True))

    @classmethod
    def load(cls, spark: SparkSession, path: str, trusted: bool = False) -> FittedModel:
        """A bundle, a folder or an archive, whose files are those of its manifest, none more, less or changed.

        Reading a learner makes objects of the classes that its metadata names.
        Boosted trees are plain data; of others only Spark's own classes are made,
        unless the bundle is ``trusted``.
        """
        if path.endswith(ARCHIVE):
            folder = fresh_path(spark, "bundle")
            unpack(spark, path, folder)
            return cls.load(spark, folder, trusted)
        try:
            same = json.loads(read_text(spark, f"{path}/manifest.json")) == _digests(spark, path)
        except (PySparkException, Py4JJavaError, ValueError) as e:
            raise DataError("the bundle can't be read") from e
        if not same:
            raise DataError("the bundle's files don't match its manifest")
        meta = json.loads(read_text(spark, f"{path}/metadata.json"))
        if meta["version"] != BUNDLE:
            raise DataError(f"bundle version {meta['version']}")
        foreign = [] if trusted else sorted({c for n in meta["learners"] if n not in meta["boosted"] for c in _classes(spark, f"{path}/learner_{n}")
                                             if not c.startswith(OWN_CLASSES)})
        if foreign:
            raise DataError(f"the bundle's learners are made of {foreign}: pass trusted=True for a bundle of your own")
        learners = {n: BoostedModel.from_dict(json.loads(read_text(spark, f"{path}/learner_{n}/part-trees.json"))) if n in meta["boosted"] else PipelineModel.load(f"{path}/learner_{n}").stages[0] for n in meta["learners"]}
        if "path" in (meta["cleaner"]["state"].get("impute") or {}):
            meta["cleaner"]["state"]["impute"]["path"] = f"{path}/neighbours"
        return cls(FitConfig(**meta["config"]), meta["task"], Cleaner(**meta["cleaner"]), learners, meta["classes"], meta["threshold"],
                   Calibrator(**meta["calibrator"]) if meta["calibrator"] else None, meta["conformal"], {k: tuple(v) for k, v in meta["ood"].items()}, meta["ood_threshold"],
                   meta["drift"], meta["metrics"], meta["notes"])


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The files below a folder, by their paths from it, in order, with their sizes."""
    root, system = _file(spark, path)
    start, found, each = len(system.makeQualified(root).toUri().getPath().rstrip("/")) + 1, [], system.listFiles(root, True)
    while each.hasNext():
        if len(found) == MOST_FILES:
            raise DataError(f"a bundle has at most {MOST_FILES} files")
        one = each.next()
        found.append((one.getPath().toUri().getPath()[start:], one.getLen()))
    return sorted(found)


def _classes(spark: SparkSession, path: str) -> set[str]:
    """The classes that a written learner's metadata name."""
    found = [json.loads(read_text(spark, f"{path}/{name}")) for name, size in _files(spark, path) if size and "/part-" in name and name.split("/")[-2] == "metadata"]
    if not found or not all(isinstance(x.get("class"), str) for x in found):
        raise DataError("a learner's metadata name no class")
    return {x["class"] for x in found}


def pack(spark: SparkSession, folder: str, path: str) -> None:
    """A folder as one ZIP archive, streamed by the file systems' own streams; written beside the target, then takes its place."""
    zips, copy = spark._jvm.java.util.zip, spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    (new, system), (old, _) = _file(spark, path + ".new"), _file(spark, path)
    out = zips.ZipOutputStream(system.create(new, True))
    try:
        for name, _size in _files(spark, folder):
            entry = zips.ZipEntry(name)
            entry.setTime(0)  # equal folders give equal archives
            out.putNextEntry(entry)
            source, disk = _file(spark, f"{folder}/{name}")
            stream = disk.open(source)
            try:
                copy(stream, out, 1 << 16, False)
            finally:
                stream.close()
            out.closeEntry()
    finally:
        out.close()
    system.delete(old, False)
    if not system.rename(new, old):
        raise DataError(f"can't write {path}")


def unpack(spark: SparkSession, path: str, folder: str) -> None:
    """The archive's files below a new folder: none outside it, none twice, within the limits of a bundle whatever their headers say."""
    copy = spark._jvm.org.apache.commons.io.IOUtils.copyLarge
    source, system = _file(spark, path)
    if not system.exists(source):
        raise DataError(f"{path} is missing")
    stream, seen, left = spark._jvm.java.util.zip.ZipInputStream(system.open(source)), set(), MOST_BYTES
    try:
        while (entry := stream.getNextEntry()) is not None:
            name = entry.getName()
            if entry.isDirectory():
                continue
            if name in seen or "\\" in name or ":" in name or any(part in ("", ".", "..") for part in name.split("/")):
                raise DataError(f"the archive holds {name!r}, which isn't a path below the bundle, or holds it twice")
            seen.add(name)
            if len(seen) > MOST_FILES:
                raise DataError(f"a bundle has at most {MOST_FILES} files")
            target, disk = _file(spark, f"{folder}/{name}")
            out = disk.create(target, False)
            try:
                copy(stream, out, 0, left + 1)
            finally:
                out.close()
            left -= disk.getFileStatus(target).getLen()
            if left < 0:
                raise DataError(f"a bundle has at most {MOST_BYTES} bytes")
    except Py4JJavaError as e:
        raise DataError("the archive can't be read") from e
    finally:
        stream.close()
    if not {"manifest.json", "metadata.json"} <= seen:
        raise DataError("the archive is no bundle")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the target, then takes its place."""
    (new, system), (old, _) = _file(spark, path + ".new"), _file(spark, path)
    out = system.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(old, False)
    if not system.rename(new, old):
        raise DataError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise DataError(f"{path} is missing")
    return rows[0][0]


def _digests(spark: SparkSession, path: str) -> dict[str, list]:
    """SHA-256 and size of every file of a bundle but its manifest, read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(~F.col("path").endswith("/manifest.json"))
    seen = files.select("path", "length").where(~F.col("path").rlike(r"/[._][^/]*\.crc$")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).first()
    if (seen["n"] or 0) > MOST_FILES or (seen["bytes"] or 0) > MOST_BYTES:
        raise DataError(f"a bundle has at most {MOST_FILES} files and {MOST_BYTES} bytes")
    root = path.rstrip("/").split("/")[-1]
    rows = files.select("path", "length", F.sha2("content", 256).alias("digest")).collect()
    return {r["path"].split(f"/{root}/", 1)[-1]: [r["digest"], r["length"]] for r in rows}


# ---- fitting

def _numbered(df: DataFrame, target: str, task: str, classes: list[str], name: str) -> DataFrame:
    if task in ("binary", "multiclass"):
        return LabelEncoder(classes).transform(df, target, name).withColumn(name, F.col(name).cast("double"))
    return df.withColumn(name, F.col(target).cast("double"))


def _weighted(df: DataFrame, label: str, task: str, config: FitConfig) -> tuple[DataFrame, bool]:
    """``df`` with a column weight, where classes are so uneven that they get one."""
    found = tuning.class_weights(df, label) if config.class_weight == "auto" and task in CLASSES else None
    if not found:
        return df, False
    weight = F.lit(1.0)
    for k, w in found.items():
        weight = F.when(F.col(label) == k, w).otherwise(weight)
    return df.withColumn("weight", weight), True


def _train(rows: DataFrame, label: str, task: str, config: FitConfig, classes: int, params: dict | None, categories: list[int] = (), group: str | None = None, deadline=None):
    """A learner of ``label`` on rows with features; a ranking is trained on pairs within ``group`` where the learner can."""
    made = build(task, config.learner, config, classes, params, categories, group, deadline)
    more = [c for c, wanted in (("held", config.early_stopping), (group, task == "ranking" and group)) if wanted]
    data, heavy = _weighted(rows.select("features", F.col(label).alias("label"), *more), "label", task, config)
    return made.setWeightCol("weight").fit(data) if heavy else made.fit(data)


def _search(rows: DataFrame, label: str, task: str, config: FitConfig, classes: int, deadline: tuning.Deadline, categories: list[int] = (), group: str | None = None) -> dict:
    """Parameters by baseline-aware search over the folds of a sample; where there are groups, whole groups are held out."""
    sample = search_sample(rows, config.key, label if task in ("binary", "multiclass") else None, group, seed=config.seed)
    parts = validation_folds(sample, config.key, task, label, group, seed=config.seed).persist()
    found = sorted(r[0] for r in parts.select("fold").distinct().collect() if r[0] >= 0)
    name = tuning.primary_metric(task)
    family = "gbt" if config.learner == "auto" else config.learner

    def evaluate(params: dict, k: int) -> float:
        model = _train(parts.where(F.col("fold") != found[k]), label, task, config, classes, params, categories, group)
        scored = model.transform(parts.where(F.col("fold") == found[k])).withColumnRenamed("prediction", "said")
        if "probability" in scored.columns:
            p = vector_to_array("probability")
            scored = scored.withColumn("p", F.element_at(p, 2) if classes == 2 else p)
        return metrics.compute(name, scored, label, "said", "p", classes, group)

    out = tuning.search(family, evaluate, len(found), config.trials, metrics.DIRECTION[name], config.seed, deadline)
    parts.unpersist()
    return out.params if out.tuned else {}


def fit(df: DataFrame, config: FitConfig) -> FittedModel:
    """Filter, split, clean, train, calibrate decisions, and evaluate on the holdout."""
    targets = [config.target] if isinstance(config.target, str) else list(config.target)
    deadline, spark = tuning.Deadline(config.seconds), df.sparkSession
    df = row_filters.drop_missing_targets(df, targets)
    task = profile.task_of(df, targets, config.group) if config.task == "auto" else config.task
    group = config.group if task == "ranking" or config.split in ("group", "stratified_group") or config.group else None
    validate.task_shape(df, task, targets, group) if config.task == "auto" or task != "ranking" else None
    validate.target_support(df, task, targets, config.test_size)
    features = config.features or [c for c in df.columns if c not in (*targets, config.key, group)]
    parts = split(df, config.key, task, targets, config.split, config.time, group, config.test_size, config.seed).persist()  # split once; every statistic reads these rows
    validate.after_split(parts, task, targets)
    train, test = parts.where(~F.col("is_test")).drop("is_test"), parts.where("is_test").drop("is_test")
    train = row_filters.drop_low_quality(train, skip=[*targets, config.key])

    drop: list[str] = []
    if config.clean == "auto" or config.leakage in ("drop", "error"):
        drop = validate.columns_to_drop(profile.profile(train.select(*features, *targets), targets, None, task), config.clean, config.leakage)
    cleaner = Cleaner(fill=config.fill, distribution=config.distribution, scaling=config.scaling, drop=drop, key=config.key)
    # The quantiles of all that is fitted below, at once.
    numbers, points = [c for c in numeric_columns(train) if c in features and c not in drop], sorted({*cleaner.points, *decide.OOD_POINTS, *decide.drift_points()})
    known = {c: dict(zip(points, q, strict=True)) if q else None for c, q in exact_quantiles(train, {c: finite(c) for c in numbers}, points).items()}
    cleaner.fit(train, features, targets[0] if task in ("binary", "multiclass") else None, known)
    classes = sorted(str(r[0]) for r in train.select(targets[0]).distinct().collect()) if task in ("binary", "multiclass") else []
    model = FittedModel(config, task, cleaner, classes=classes)
    many = max(2, len(classes))
    labels = {t: "label" if len(targets) == 1 else f"label_{t}" for t in targets}
    assembler = VectorAssembler(inputCols=cleaner.outputs, outputCol="features", handleInvalid="keep")

    def ready(rows: DataFrame) -> DataFrame:
        for t, name in labels.items():
            rows = _numbered(rows, t, task, classes, name)
        keep = [config.key, *labels.values(), *([group] if group else [])]
        return assembler.transform(cleaner.transform(rows, keep=keep)).select(*keep, "features")

    # Cleaned once; every learner and every choice reads these rows.
    every = ready(train)
    strata = "label" if task in ("binary", "multiclass") else None
    wants = task in CLASSES and config.calibration != "none" or config.conformal is True or config.conformal == "auto" and task not in ("ranking",)
    kept = calibration_split(every, config.key, strata, seed=config.seed) if wants else None
    if kept is None:
        every.persist()
    else:
        kept.persist()  # the cut is made once, and only these rows are kept
    rows, held = (every, None) if kept is None else (kept.where(~F.col("is_calibration")).drop("is_calibration"), kept.where("is_calibration").drop("is_calibration"))
    if config.early_stopping:
        rows = (split_group(rows, group, 0.1, config.seed + 31) if task == "ranking" else split_random(rows, config.key, 0.1, config.seed + 31)).withColumnRenamed("is_test", "held")
    categories = [i for i, c in enumerate(cleaner.outputs) if c.endswith("__code")]
    n, cells = rows.count(), len(cleaner.outputs)
    if note := tuning.memory_note(n, cells, tuning.resource_plan(spark)):
        model.notes.append(note)
    params = {t: _search(rows, name, task, config, many, deadline, categories, group) if config.trials else {} for t, name in labels.items()}
    for i, (t, name) in enumerate(labels.items()):
        own = deadline.share(1 / (len(labels) - i + (config.optimize_threshold and task in ("binary", "multilabel"))))
        model.learners["label" if len(targets) == 1 else t] = made = _train(rows, name, task, config, many, params[t], categories, group, own)
        if isinstance(made, BoostedModel):
            model.notes.append(f"{t}: {len(made.rounds)} rounds, ended by {made.stopped}")

    if task in ("binary", "multilabel"):
        model.threshold = 0.5 if task == "binary" else dict.fromkeys(targets, 0.5)
        if config.optimize_threshold and not deadline.over():
            _tune_threshold(model, rows, labels, config, params, strata, categories, deadline)
    if held is not None:
        _fit_uncertainty(model, held, labels)
    numeric = cleaner.state["numeric"]
    model.ood = decide.ood_reference(train, numeric, known) if numeric else {}
    model.ood_threshold = decide.ood_threshold(train, model.ood) if numeric else 0.35
    model.drift = {"numeric": decide.numeric_reference(train, numeric, known=known) if numeric else {}, "categorical": {c: decide.categorical_reference(train, c) for c in cleaner.state["values"]}}
    model.metrics = evaluate(model, ready(test), labels, group) | decide.ood_metrics(model.ood_scores(test), "ood_score", model.ood_threshold).first().asDict()
    for df in (every, parts, kept):
        if df is not None:
            df.unpersist()
    return model


def _tune_threshold(model: FittedModel, rows: DataFrame, labels: dict, config: FitConfig, params: dict, strata: str | None, categories: list[int], deadline: tuning.Deadline) -> None:
    """The best threshold of a probe that is trained on four fifths of the rows and judged on the last one."""
    parts = (split_stratified(rows, config.key, strata, 0.2, config.seed + 7) if strata else split_random(rows, config.key, 0.2, config.seed + 7)).persist()
    fit_rows, probe_rows = parts.where(~F.col("is_test")), parts.where("is_test")
    scored, pairs = probe_rows, []
    for i, (t, name) in enumerate(labels.items()):
        probe = _train(fit_rows, name, model.task, config, 2, params[t], categories, deadline=deadline.share(1 / (len(labels) - i)))
        scored = probe.transform(scored).withColumn(f"probe_{i}", F.element_at(vector_to_array("probability"), 2)).drop("probability", "rawPrediction", "prediction")
        pairs.append((name, f"probe_{i}"))
    if model.task == "binary":
        model.threshold = decide.best_threshold(scored, "label", "probe_0", config.objective)
    else:
        found = decide.per_label_thresholds(scored, pairs, config.objective)
        model.threshold = {t: found[name] for t, name in labels.items()}
    parts.unpersist()


def _fit_uncertainty(model: FittedModel, held: DataFrame, labels: dict) -> None:
    """Calibrator and conformal quantiles from rows that no learner has seen; what calibration changes is noted."""
    config, task, n = model.config, model.task, held.count()
    scored = model._learners(held).persist()
    if task in CLASSES and config.calibration != "none":
        raw = model._probabilities(scored)
        if task == "binary":
            pairs = [("label", "p")]
        elif task == "multiclass":
            raw = raw.withColumns({f"__y{k}": (F.col("label") == k).cast("int") for k in range(len(model.classes))} | {f"__p{k}": F.get("p", F.lit(k)) for k in range(len(model.classes))})
            pairs = [(f"__y{k}", f"__p{k}") for k in range(len(model.classes))]
        else:
            pairs = [(name, f"p_{t}") for t, name in labels.items()]
        before = _diagnostics(raw, task, labels)
        model.calibrator = fit_calibrator(raw, pairs, config.calibration)
        after = _diagnostics(model._probabilities(scored), task, labels)
        model.metrics["calibration"] = {"method": model.calibrator.method, "rows": n, "before": before, "after": after}
        model.notes.append(f"calibrated by {model.calibrator.method} on {n} rows")
    if config.conformal is True or config.conformal == "auto" and n >= 50:
        out = model._probabilities(scored) if task in CLASSES else scored
        if task == "binary":
            model.conformal = decide.conformal_quantile(out, 1 - F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p")), config.alpha)
        elif task == "multiclass":
            model.conformal = decide.conformal_quantile(out, decide.nonconformity("label", "p"), config.alpha)
        elif task == "regression":
            model.conformal = decide.conformal_quantile(out, F.abs(F.col("label") - F.col("raw_label")), config.alpha)
        elif task == "multilabel":
            model.conformal = {t: decide.conformal_quantile(out, 1 - F.when(F.col(name) == 1, F.col(f"p_{t}")).otherwise(1 - F.col(f"p_{t}")), config.alpha) for t, name in labels.items()}
        elif task == "multioutput_regression":
            model.conformal = {t: decide.conformal_quantile(out, F.abs(F.col(name) - F.col(f"raw_{t}")), config.alpha) for t, name in labels.items()}
        model.notes.append(f"conformal at {config.alpha} on {n} rows")
    scored.unpersist()


def _diagnostics(out: DataFrame, task: str, labels: dict) -> dict:
    if task == "binary":
        return metrics.log_loss(out, "label", "p").first().asDict() | metrics.ece(out, "label", "p").first().asDict()
    if task == "multiclass":
        return metrics.multiclass_probabilities(out, "label", "p").first().asDict()
    return {"brier": out.agg(F.avg(sum(((F.col(f"p_{t}") - F.col(name)) ** 2 for t, name in labels.items()), F.lit(0.0)) / len(labels))).first()[0]}


def evaluate(model: FittedModel, rows: DataFrame, labels: dict, group: str | None = None) -> dict:
    """Metrics of the holdout, with the coverage of conformal sets."""
    task, found = model.task, dict(model.metrics)
    out = model._learners(rows)
    out = (model._probabilities(out) if task in CLASSES else out).persist()
    if task == "binary":
        said = out.withColumn("said", (F.col("p") >= model.threshold).cast("int"))
        found |= metrics.binary(said, "label", "said").first().asDict() | metrics.roc_auc(out, "label", "p").first().asDict() | metrics.average_precision(out, "label", "p").first().asDict()
        found |= metrics.log_loss(out, "label", "p").first().asDict() | metrics.ece(out, "label", "p").first().asDict()
        if model.conformal is not None:
            found |= decide.set_coverage(out.withColumn("p", F.array(1 - F.col("p"), F.col("p"))), "label", "p", model.conformal).first().asDict()
    elif task == "multiclass":
        said = out.withColumn("said", (F.array_position("p", F.array_max("p")) - 1).cast("double"))
        found |= metrics.multiclass(said, "label", "said").first().asDict() | metrics.multiclass_probabilities(out, "label", "p").first().asDict()
        if model.conformal is not None:
            found |= decide.set_coverage(out, "label", "p", model.conformal).first().asDict()
    elif task == "multilabel":
        said = out.withColumns({f"said_{t}": (F.col(f"p_{t}") >= model.threshold[t]).cast("int") for t in labels})
        found |= metrics.multilabel(said, [(name, f"said_{t}") for t, name in labels.items()]).first().asDict()
        if model.conformal is not None:
            found |= decide.label_coverage(out, [(name, f"p_{t}") for t, name in labels.items()], [model.conformal[t] for t in labels]).first().asDict()
    elif task == "multioutput_regression":
        found |= metrics.multioutput(out, [(name, f"raw_{t}") for t, name in labels.items()]).first().asDict()
    else:
        found |= metrics.regression(out, "label", "raw_label").first().asDict()
        if task == "ranking" and group:
            found |= {f"ndcg_{k}": metrics.ndcg(out, group, "label", "raw_label", k).first()["ndcg"] for k in (5, 10)}
        if model.residual is not None:
            found |= decide.interval_coverage(out, "label", "raw_label", model.residual).first().asDict()
    out.unpersist()
    return found


def out_of_fold(df: DataFrame, config: FitConfig, columns: list[str], k: int = 3) -> DataFrame:
    """key, label and the out-of-fold probability of class 1 (or prediction)."""
    rows = folds(df, config.key, k, config.seed)
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    out = None
    for i in range(k):
        fitted = build(config.task, config.learner, config).fit(assembler.transform(rows.where(F.col("fold") != i)).select("features", "label"))
        scored = fitted.transform(assembler.transform(rows.where(F.col("fold") == i)))
        value = F.element_at(vector_to_array("probability"), 2) if "probability" in scored.columns else F.col("prediction")
        part = scored.select(config.key, "label", value.alias("oof"))
        out = part if out is None else out.unionByName(part)
    return out


def calibrate_sigmoid(df: DataFrame, y: str, p: str) -> tuple[float, float]:
    """(slope, offset) of a logistic regression on the log-odds; ridge 1/n."""
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col(p)))
    rows = VectorAssembler(inputCols=["z"], outputCol="features").transform(df.select(F.col(y).cast("double").alias("label"), F.log(q / (1 - q)).alias("z")))
    m = LogisticRegression(regParam=1.0 / max(1, rows.count()), standardization=False).fit(rows)
    return float(m.coefficients[0]), float(m.intercept)


def apply_sigmoid(p: str, state: tuple[float, float]):
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col(p)))
    return 1 / (1 + F.exp(-(state[0] * F.log(q / (1 - q)) + state[1])))


def calibrate_isotonic(df: DataFrame, y: str, p: str):
    return IsotonicRegression(featuresCol="features", labelCol="label").fit(df.select(F.col(y).cast("double").alias("label"), F.col(p).alias("features")))


def vote(columns: list[str], weights: list[float]):
    return sum((F.col(c) * (w / sum(weights)) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))


def stack(df: DataFrame, columns: list[str], y: str):
    """A linear meta learner on out-of-fold columns."""
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(df.withColumn("label", F.col(y).cast("double")))
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01).fit(rows)


def importance(model: FittedModel) -> list[tuple[str, float]]:
    """Shares of importance, mean over learners, largest first."""
    total: dict[str, float] = dict.fromkeys(model.cleaner.outputs, 0.0)
    for m in model.learners.values():
        if hasattr(m, "featureImportances"):
            raw = m.featureImportances.toArray()
        else:
            raw = abs(m.coefficientMatrix.toArray()).mean(0) if hasattr(m, "coefficientMatrix") else abs(m.coefficients.toArray())
        for c, x in zip(model.cleaner.outputs, raw, strict=True):
            total[c] += float(x) / max(sum(raw), 1e-12) / len(model.learners)
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))


def explain(model: FittedModel, df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``keep`` columns and, for each learner of boosted trees, the tree SHAP values of the cleaned features as ``shap_<learner>``: an array a class of (feature, value), the last the expected score."""
    out = model._scored(df, list(keep))
    if not all(isinstance(m, BoostedModel) for m in model.learners.values()):
        raise UnsupportedLearnerError("contributions need boosted trees")
    names = F.array(*[F.lit(c) for c in [*model.cleaner.outputs, "expected"]])
    for name, learner in model.learners.items():
        out = learner.explain(out, "__shap")
        out = out.withColumn(f"shap_{name}", F.transform("__shap", lambda v: F.arrays_zip(names.alias("feature"), v.alias("value")))).drop("__shap")
    return out.select(*keep, *[f"shap_{n}" for n in model.learners])


def permutation_importance(model: FittedModel, df: DataFrame, rows: int = 2000) -> list[tuple[str, float]]:
    """What the holdout's primary metric loses when a feature's values are dealt anew among at most ``rows`` rows, largest first."""
    from pyspark.sql import Window

    target = model.config.target
    if not isinstance(target, str):
        raise DataError("one target")
    some = search_sample(df, model.config.key, most=rows).persist()
    name = tuning.primary_metric(model.task) if model.task != "ranking" else "rmse"

    def score(data: DataFrame) -> float:
        out = model.predict(_numbered(data, target, model.task, model.classes, "__y"), keep=["__y"])
        if model.task in ("binary", "multiclass"):
            place = F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col("prediction")) - 1
            return metrics.compute(name, out.withColumn("said", place.cast("double")), "__y", "said", "probability", len(model.classes))
        return metrics.compute(name, out, "__y", "prediction")

    base, sign = score(some), 1.0 if metrics.DIRECTION[name] else -1.0
    out = []
    for c in model.cleaner.schema:
        by = Window.orderBy(F.xxhash64(model.config.key))  # at most ``rows`` rows
        other = Window.orderBy(F.xxhash64(F.lit(c), model.config.key))
        mixed = some.withColumn("__i", F.row_number().over(by)).drop(c).join(some.select(F.col(c), F.row_number().over(other).alias("__i")), "__i").drop("__i")
        out.append((c, sign * (base - score(mixed))))
    some.unpersist()
    return sorted(out, key=lambda x: (-x[1], x[0]))


def _bars(title: str, pairs: list[tuple[str, float]], width: int = 360) -> str:
    """A bar chart as SVG."""
    top = max([abs(v) for _, v in pairs], default=0.0) or 1.0
    bars = "".join(f"<text x='0' y='{22 * i + 15}' font-size='12'>{html.escape(str(k))}</text><rect x='180' y='{22 * i + 3}' width='{abs(v) / top * width:.1f}' height='16' fill='#47a'/>"
                   f"<text x='{186 + abs(v) / top * width:.1f}' y='{22 * i + 15}' font-size='12'>{v:.4g}</text>" for i, (k, v) in enumerate(pairs))
    return f"<h2>{html.escape(title)}</h2><svg width='{width + 260}' height='{22 * len(pairs) + 4}'>{bars}</svg>"


def report(model: FittedModel, df: DataFrame, path: str) -> None:
    """JSON and HTML of metrics, importance and the audit, with charts, in a folder that may be shared."""
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else str(x)
    best = importance(model)[:20]
    body = {"task": model.task, "metrics": model.metrics, "importance": best, "notes": model.notes,
            "quality": audit(df, model.config.target if isinstance(model.config.target, str) else None).to_dict()}
    spark = df.sparkSession
    write_text(spark, f"{path}/report.json", json.dumps(body, indent=1, default=plain))
    numbers = [(k, v) for k, v in model.metrics.items() if isinstance(v, int | float) and not isinstance(v, bool) and v is not None and math.isfinite(v)]
    rows = "".join(f"<tr><td>{html.escape(str(k))}</td><td>{v:.6g}</td></tr>" for k, v in numbers)
    issues = "".join(f"<li>{html.escape(i['severity'])}: {html.escape(i['code'])} {html.escape(', '.join(i['columns']))}</li>" for i in body["quality"]["issues"])
    write_text(spark, f"{path}/report.html", f"<!DOCTYPE html><meta charset='utf-8'><title>Report</title><h1>{html.escape(model.task)}</h1><table>{rows}</table>"
               + _bars("Importance", best) + f"<h2>Quality {body['quality']['score']:.1f}</h2><ul>{issues}</ul>")


__all__ = ["Calibrator", "FitConfig", "FittedModel", "OneVsRest", "apply_sigmoid", "build", "calibrate_isotonic", "calibrate_sigmoid", "estimator", "explain", "fit", "fit_calibrator", "importance",
           "out_of_fold", "permutation_importance", "report", "stack", "vote"]
