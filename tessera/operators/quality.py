"""Data-quality audit.  Every numeric statistic of every column comes from one aggregate pass."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions.columns import empty_value, exact_quantiles, finite, is_large, missing, nulled, numeric_columns, quantiles, rate, skewness, wide_then_long

HIGH_MISSING, EMPTY_ROW, SKEWED, OUTLIERS, NUMERIC_SHARE = 0.5, 0.98, 3.0, 0.1, 0.95
WEIGHTS = {"error": 15.0, "warning": 6.0, "info": 1.5}


@dataclass
class Issue:
    code: str
    severity: str
    message: str
    columns: list[str] = field(default_factory=list)


@dataclass
class QualityReport:
    n_rows: int
    n_columns: int
    score: float
    issues: list[Issue]
    recommendations: list[str]
    summaries: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)

    def __getitem__(self, key):
        return self.to_dict()[key]


def missing_rates(df: DataFrame) -> DataFrame:
    """The share of missing values (null or NaN) of each column."""
    return wide_then_long(nulled(df), df.columns, {"missing_rate": lambda c: rate(missing(c))})


def missing_share(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The share of missing values in each row; NaN is missing."""
    kinds, columns = dict(df.dtypes), columns or df.columns
    gone = [missing(c) | F.isnan(f"`{c}`") if kinds[c] in ("float", "double") else missing(c) for c in columns]
    return sum((F.when(g, 1.0).otherwise(0.0) for g in gone), F.lit(0.0)) / F.lit(float(len(columns)))


def row_missing_quantiles(df: DataFrame) -> DataFrame:
    share = missing_share(df)
    q = quantiles(share, [0.5, 0.9, 0.99])
    return df.agg(q.alias("q"), F.max(share).alias("max"), F.sum(F.when(share >= EMPTY_ROW, 1).otherwise(0)).alias("almost_empty")).select(
        F.col("q")[0].alias("q50"), F.col("q")[1].alias("q90"), F.col("q")[2].alias("q99"), "max", F.col("almost_empty").cast("long"))


def numeric_summary(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    columns = columns or numeric_columns(df)
    points = [0.25, 0.5, 0.75]
    # Of a large table only the values near the quartiles are sorted.
    found = exact_quantiles(df, {c: finite(c) for c in columns}, points) if exact and is_large(df) else None
    told = lambda c: F.lit(None).cast("array<double>") if found[c] is None else F.array(*[F.lit(x) for x in found[c]])
    first = wide_then_long(df, columns, {
        "finite_rate": lambda c: rate(finite(c).isNotNull()), "mean": lambda c: F.avg(finite(c)), "std": lambda c: F.stddev_pop(finite(c)),
        "min": lambda c: F.min(finite(c)), "q": lambda c: told(c) if found else quantiles(finite(c), points, exact), "max": lambda c: F.max(finite(c)),
        "skew": lambda c: skewness(finite(c)), "zero_rate": lambda c: rate(F.coalesce(finite(c) == 0, F.lit(False))),
    })
    return first.select("column_name", "finite_rate", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"),
                        F.col("q")[2].alias("q75"), "max", "skew", "zero_rate")


def infinite_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return wide_then_long(df, columns, {"infinite": lambda c: F.sum(F.when(F.abs(F.col(c).cast("double")) == float("inf"), 1).otherwise(0)).cast("long")})


def fences(df: DataFrame, columns: list[str], factor: float = 1.5, exact: bool = True) -> dict[str, tuple[float, float]]:
    """Outlier fences of the columns that have one: four values and a positive inter-quartile range."""
    row = df.agg(*[F.count(finite(c)).alias(f"n{i}") for i, c in enumerate(columns)], *([] if exact else [quantiles(finite(c), [0.25, 0.75], False).alias(f"q{i}") for i, c in enumerate(columns)])).first()
    found = exact_quantiles(df, {c: finite(c) for c in columns}, [0.25, 0.75]) if exact else {c: row[f"q{i}"] for i, c in enumerate(columns)}
    out = {}
    for i, c in enumerate(columns):
        if row[f"n{i}"] >= 4 and found[c][1] > found[c][0]:
            low, high = found[c]
            out[c] = (low - factor * (high - low), high + factor * (high - low))
    return out


def outside(c: str, fence: tuple[float, float] | None):
    return F.coalesce((finite(c) < fence[0]) | (finite(c) > fence[1]), F.lit(False)) if fence else F.lit(False)


def outlier_counts(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    fence = fences(df, columns, exact=exact)
    return wide_then_long(df, columns, {"outliers": lambda c: F.sum(F.when(outside(c, fence.get(c)), 1).otherwise(0)).cast("long"),
                                        "outlier_rate": lambda c: F.try_divide(F.sum(F.when(outside(c, fence.get(c)), 1.0).otherwise(0.0)), F.count(finite(c)))})


def categorical_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cardinality and rarity: all columns unpivoted, counted once by (column, value), then summed by column."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")).select("r.*")
    counts = values.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(_by("column_name"))
    flagged = counts.withColumn("total", total)
    real = F.col("value").isNotNull()
    return flagged.groupBy("column_name").agg(
        F.sum(F.when(real, 1).otherwise(0)).cast("long").alias("cardinality"),
        F.try_divide(F.sum(F.when(real, 1.0).otherwise(0.0)), F.max("total")).alias("cardinality_ratio"),
        F.try_divide(F.sum(F.when(real & (F.col("n") < F.greatest(F.lit(2), F.ceil(F.col("total") * 0.01))), F.col("n")).otherwise(0)).cast("double"), F.max("total")).alias("rare_row_rate"),
        F.try_divide(F.sum(F.when(real & (F.col("n") == 1), 1.0).otherwise(0.0)), F.sum(F.when(real, 1).otherwise(0))).alias("singleton_share"),
        F.try_divide(F.max(F.when(real, F.col("n"))).cast("double"), F.max("total")).alias("top_share"))


def _by(c):
    from pyspark.sql import Window

    return Window.partitionBy(c)


def high_cardinality(df: DataFrame, columns: list[str], least: int = 128, ratio: float = 0.2) -> DataFrame:
    return categorical_summary(df, columns).select("column_name", ((F.col("cardinality") > least) & (F.col("cardinality_ratio") > ratio)).alias("high"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each equal set: counted, never gathered."""
    sets = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return sets.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"), F.try_divide(F.sum(F.col("__n") - 1).cast("double"), F.sum("__n")).alias("fraction"))


def text_modality(df: DataFrame, columns: list[str]) -> DataFrame:
    body = lambda c: F.when(~empty_value(c), F.length(c).cast("double"))
    return wide_then_long(df, columns, {"empty_rate": lambda c: rate(F.coalesce(empty_value(c), F.lit(True))), "mean_length": lambda c: F.avg(body(c)),
                                        "q90_length": lambda c: F.percentile(body(c), 0.9)})


def parse_rates(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The share of the told values of text columns that are numbers; 0 for columns without a value."""
    row = df.agg(*[F.try_divide(F.count(F.col(f"`{c}`").try_cast("double")), F.count(f"`{c}`")).alias(f"p{i}") for i, c in enumerate(columns)]).first() if columns else []
    return {c: row[f"p{i}"] or 0.0 for i, c in enumerate(columns)}


def shape_classes(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many kinds of value each text column mixes: number, time, truth value or text."""
    def kind(c: str) -> Column:
        x = F.trim(F.col(f"`{c}`").cast("string"))
        return (F.when(x.try_cast("double").isNotNull(), "number").when(F.lower(x).isin("true", "false"), "truth")
                .when(F.try_to_timestamp(x).isNotNull(), "time").when(x.isNotNull(), "text"))

    return wide_then_long(df, columns, {"kinds": lambda c: F.size(F.collect_set(kind(c))).cast("long")})


def unreadable_paths(df: DataFrame, column: str, sample: int = 64) -> float:
    """The share of the first told paths that can't be read; the driver looks at ``sample`` of them."""
    spark = df.sparkSession
    paths = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).limit(sample).collect()]
    hadoop = spark._jsc.hadoopConfiguration()
    bad = 0
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        bad += not path.getFileSystem(hadoop).exists(path)
    return bad / len(paths) if paths else 0.0


def target_summary(df: DataFrame, target: str, top: int = 30) -> dict:
    """Missing rate, distinct values and the commonest values of a target."""
    row = nulled(df).agg(rate(missing(target)).alias("missing"), F.count_distinct(f"`{target}`").alias("unique")).first()
    return {"missing_rate": row["missing"] or 0.0, "unique": row["unique"], "distribution": {r["value"]: r["n"] for r in target_distribution(df, target, top).collect()}}


def target_distribution(df: DataFrame, target: str, top: int = 30) -> DataFrame:
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(top)


def conflicting_patterns(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Feature patterns with more than one target value (null counts as one)."""
    kinds = F.count_distinct(target) + F.max(F.when(missing(target), 1).otherwise(0))
    return df.groupBy(*features).agg(kinds.alias("targets"), F.count("*").alias("n")).where("targets > 1")


def quality_score(errors: int, warnings: int, infos: int) -> float:
    return max(0.0, 100.0 - WEIGHTS["error"] * errors - WEIGHTS["warning"] * warnings - WEIGHTS["info"] * infos)


_ADVICE = {
    "duplicate_rows": "Drop repeated rows before splitting.", "high_missing_columns": "Drop or explain columns that are mostly missing.",
    "almost_empty_rows": "Drop rows that hold almost nothing.", "infinite_values": "Replace infinities before training.",
    "extreme_skew": "Transform strongly skewed columns.", "many_outliers": "Winsorize columns with many outliers.",
    "modality_missing": "Find out why media or texts are missing.", "unreadable_media_paths": "Repair paths that can't be read.", "mixed_types": "Give each column one kind of value.",
    "high_cardinality": "Group rare categories or hash them.", "conflicting_duplicate_labels": "Resolve equal rows with different targets.",
}


def audit(df: DataFrame, target: str | None = None, modalities: dict[str, str] | None = None) -> QualityReport:
    """The whole audit: a handful of aggregate jobs, only their small results on the driver.

    ``modalities`` names columns that hold text, image, audio or video; text
    columns whose values are numbers, 95 % of them at least, are audited as numbers.
    """
    media = modalities or {}
    df, kinds = nulled(df), dict(df.dtypes)
    features = [c for c in df.columns if c != target and c not in media]
    texts = [c for c in features if kinds[c] in ("string", "boolean")]
    parsed = [c for c, p in parse_rates(df, [c for c in texts if kinds[c] == "string"]).items() if p >= NUMERIC_SHARE]
    if parsed:
        df = df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in parsed})
    texts = [c for c in texts if c not in parsed]
    numeric = [c for c in numeric_columns(df, skip=(target,)) if c not in media]
    rows = lambda d: [r.asDict() for r in d.collect()]
    issues: list[Issue] = []
    found: dict = {"missing": {r["column_name"]: r["missing_rate"] for r in rows(missing_rates(df))}, "rows": row_missing_quantiles(df).first().asDict()}
    n = df.count()
    dup = duplicate_rows(df).first()
    if dup["duplicates"]:
        issues.append(Issue("duplicate_rows", "warning", f"{dup['duplicates']} repeated rows"))
    if many := [c for c, x in found["missing"].items() if x is not None and x >= HIGH_MISSING]:
        issues.append(Issue("high_missing_columns", "warning", "half of the values or more are missing", many))
    if found["rows"]["almost_empty"]:
        issues.append(Issue("almost_empty_rows", "error", f"{found['rows']['almost_empty']} rows are almost empty"))
    if numeric:
        found["numeric"] = rows(numeric_summary(df, numeric))
        if bad := [r["column_name"] for r in rows(infinite_counts(df, numeric)) if r["infinite"]]:
            issues.append(Issue("infinite_values", "error", "infinite values", bad))
        if bad := [r["column_name"] for r in found["numeric"] if abs(r["skew"] or 0.0) >= SKEWED]:
            issues.append(Issue("extreme_skew", "info", "strong skew", bad))
        if bad := [r["column_name"] for r in rows(outlier_counts(df, numeric)) if (r["outlier_rate"] or 0.0) >= OUTLIERS]:
            issues.append(Issue("many_outliers", "warning", "many outliers", bad))
    if texts:
        found["categorical"] = rows(categorical_summary(df, texts))
        if bad := [r["column_name"] for r in found["categorical"] if r["cardinality"] > 128 and (r["cardinality_ratio"] or 0.0) > 0.2]:
            issues.append(Issue("high_cardinality", "warning", "very many categories", bad))
        if bad := [r["column_name"] for r in rows(shape_classes(df, [c for c in texts if kinds[c] == "string"] or texts)) if r["kinds"] > 1]:
            issues.append(Issue("mixed_types", "info", "several kinds of value", bad))
    for c, kind in media.items():
        gone = df.agg(rate(F.coalesce(empty_value(c, kinds[c]), F.lit(True)))).first()[0] or 0.0
        found.setdefault("modalities", {})[c] = {"modality": kind, "empty_rate": gone}
        if kind == "text" and kinds[c] == "string":
            found["modalities"][c] |= text_modality(df, [c]).first().asDict()
        if gone > 0.1:
            issues.append(Issue("modality_missing", "warning", "a tenth or more is missing", [c]))
        if kind != "text" and kinds[c] == "string" and unreadable_paths(df, c):
            issues.append(Issue("unreadable_media_paths", "error", "paths can't be read", [c]))
    if target:
        found["target"] = target_summary(df, target)
        if features and (patterns := conflicting_patterns(df, features, target).count()):
            issues.append(Issue("conflicting_duplicate_labels", "error", f"{patterns} patterns with different targets"))
    count = lambda s: sum(i.severity == s for i in issues)
    advice = list(dict.fromkeys(_ADVICE[i.code] for i in issues if i.code in _ADVICE))
    return QualityReport(n, len(df.columns), quality_score(count("error"), count("warning"), count("info")), issues, advice, found)


def enforce(report: QualityReport, policy: str) -> None:
    """``strict`` refuses data with contradicting labels or unreadable media; ``warn`` and ``report`` let it pass."""
    blocking = [i.message for i in report.issues if i.code in ("conflicting_duplicate_labels", "unreadable_media_paths")]
    if policy == "strict" and blocking:
        raise DataError("; ".join(blocking[:5]))
