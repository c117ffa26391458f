"""Row filters that run before a split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError
from ..functions.columns import nulled
from .quality import fences, missing_share, outside


def _enough(kept: int, n: int, what: str) -> None:
    """A filter may not leave under ten rows, or under a fifth."""
    if kept < max(10, int(0.2 * n)):
        raise DataError(f"{what} would leave {kept} of {n} rows")


def drop_missing_targets(df: DataFrame, targets: list[str], policy: str = "drop") -> DataFrame:
    """Rows whose targets are all told; NaN counts as missing."""
    if absent := [t for t in targets if t not in df.columns]:
        raise DataError(f"target columns {absent} are not there")
    told = F.lit(True)
    rows = nulled(df)
    for t in targets:
        told = told & F.col(f"`{t}`").isNotNull()
    if policy == "error" and rows.where(~told).limit(1).count():
        raise DataError("a target is missing")
    return rows.where(told)


def drop_low_quality(df: DataFrame, threshold: float = 0.98, skip: list[str] = (), check: bool = False) -> DataFrame:
    """Rows whose share of missing features (columns but ``skip``) is under ``threshold``; ``check`` refuses to lose nearly all."""
    features = [c for c in df.columns if c not in skip]
    if not features or threshold >= 1.0:
        return df
    kept = df.where(missing_share(df, features) < threshold)
    if check:
        n, left = df.count(), kept.count()
        if left < n:
            _enough(left, n, "the filter of almost empty rows")
    return kept


def remove_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    keep = F.lit(True)
    for c, f in fences(df, columns).items():
        keep = keep & ~outside(c, f)
    return df.where(keep)


def drop_duplicate_rows(df: DataFrame, policy: str = "drop") -> DataFrame:
    if policy not in ("drop", "keep", "error"):
        raise ConfigError("duplicate rows: drop, keep or error")
    if policy == "error" and df.groupBy(*df.columns).agg(F.count("*").alias("__n")).where("__n > 1").limit(1).count():
        raise DataError("rows repeat")
    return df.dropDuplicates() if policy == "drop" else df


def drop_conflicting(df: DataFrame, features: list[str], target: str | list[str], policy: str = "drop", check: bool = False) -> DataFrame:
    """Rows whose feature pattern has one value of every target only.

    Conflicts are found by partial aggregation and removed by an anti join that
    treats nulls as equal, so a pattern with very many rows is never gathered.
    ``keep`` and ``warn`` leave the rows; ``error`` raises; ``check`` refuses to
    lose nearly all.
    """
    if policy not in ("keep", "warn", "drop", "error"):
        raise ConfigError("conflicting labels: keep, warn, drop or error")
    if policy in ("keep", "warn") or not features:
        return df
    targets = [target] if isinstance(target, str) else list(target)
    kinds = [F.count_distinct(t) + F.max(F.when(F.col(t).isNull(), 1).otherwise(0)) for t in targets]
    bad = df.groupBy(*features).agg(F.greatest(*kinds, F.lit(0)).alias("__k")).where("__k > 1").select(*[F.col(f).alias(f"__{f}") for f in features])
    if policy == "error":
        if bad.limit(1).count():
            raise DataError("rows with equal features have different targets")
        return df
    match = F.lit(True)
    for f in features:
        match = match & F.col(f).eqNullSafe(F.col(f"__{f}"))
    out = df.join(bad, match, "left_anti")
    if check:
        _enough(out.count(), df.count(), "dropping conflicting labels")
    return out


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
