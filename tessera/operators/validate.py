"""What data must be like before it is split or trained on, and the columns that go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError
from ..functions.columns import numeric_columns

CLASSIFICATION = ("binary", "multiclass")
#: Date formats that are tried in turn, after what the engine reads by itself.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy")


def class_counts(df: DataFrame, target: str) -> dict:
    """Rows of each value of a target, nulls too."""
    return {r[target]: r["__n"] for r in df.groupBy(target).agg(F.count("*").alias("__n")).collect()}


def task_shape(df: DataFrame, task: str, targets: list[str], group: str | None = None) -> None:
    """Whether the targets can be of the task."""
    if not targets or len(set(targets)) != len(targets):
        raise DataError("targets are missing or repeat")
    if absent := [t for t in targets if t not in df.columns]:
        raise DataError(f"target columns {absent} are not there")
    if task in ("multilabel", "multioutput_regression") and len(targets) < 2:
        raise DataError(f"{task} needs two targets")
    if task not in ("multilabel", "multioutput_regression") and len(targets) != 1:
        raise DataError(f"{task} has one target")
    if task == "ranking" and (not group or group not in df.columns):
        raise ConfigError("a ranking needs a group column")
    if task in ("regression", "ranking", "multioutput_regression") and (bad := [t for t in targets if t not in numeric_columns(df)]):
        raise DataError(f"targets {bad} are not numeric")
    if task in (*CLASSIFICATION, "multilabel"):
        row = df.agg(*[F.count_distinct(F.col(t)).alias(f"c{i}") for i, t in enumerate(targets)]).first()
        for i, t in enumerate(targets):
            n = row[f"c{i}"]
            if n < 2 or n != 2 and task != "multiclass":
                raise DataError(f"{task} target {t} has {n} classes")


def target_support(df: DataFrame, task: str, targets: list[str], test: float) -> None:
    """Whether both sides of a split can hold every class."""
    if task in CLASSIFICATION:
        counts = class_counts(df, targets[0])
        if rare := {k: n for k, n in counts.items() if n < 2}:
            raise DataError(f"classes with one row can't be split: {rare}")
        n = sum(counts.values())
        held = int(-(-n * test // 1))
        if min(held, n - held) < len(counts):
            raise DataError(f"a share of {test} can't hold all {len(counts)} classes on both sides")
    elif task == "multilabel":
        bad = {t: c for t in targets if len(c := class_counts(df, t)) != 2 or min(c.values()) < 2}
        if bad:
            raise DataError(f"each label has two classes of two rows at least: {bad}")


def after_split(parts: DataFrame, task: str, targets: list[str]) -> None:
    """Whether a split left rows on both sides, and no class only in the holdout."""
    sides = {r["is_test"] for r in parts.select("is_test").distinct().collect()}
    if sides != {True, False}:
        raise DataError("the split left a side empty")
    if task in CLASSIFICATION:
        seen = parts.groupBy(targets[0]).agg(F.min(F.col("is_test").cast("int")).alias("all_held"))
        if lost := [r[targets[0]] for r in seen.where("all_held = 1").collect()]:
            raise DataError(f"classes {lost} are in the holdout only")
    elif task == "multilabel":
        row = parts.where(~F.col("is_test")).agg(*[F.count_distinct(t).alias(f"c{i}") for i, t in enumerate(targets)]).first()
        if bad := [t for i, t in enumerate(targets) if row[f"c{i}"] != 2]:
            raise DataError(f"labels {bad} have one class in training")


def mixed_dates(df: DataFrame, columns: list[str], policy: str = "strict", formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """Text columns as timestamps, each value by the first format that reads it.

    ``strict`` raises with three values that none reads; ``coerce`` makes them null.
    """
    parse = lambda c: F.coalesce(F.try_to_timestamp(F.col(f"`{c}`")), *[F.try_to_timestamp(F.col(f"`{c}`"), F.lit(f)) for f in formats])
    if policy == "strict":
        for c in columns:
            if bad := [r[0] for r in df.where(F.col(f"`{c}`").isNotNull() & parse(c).isNull()).select(c).distinct().limit(3).collect()]:
                raise DataError(f"{c} holds no times, such as {bad}")
    return df.withColumns({c: parse(c) for c in columns})


def columns_to_drop(profile: dict, mode: str = "auto", leakage: str = "warn") -> list[str]:
    """Constants, extra copies, leaking columns and id-like columns that go, in the order of the table.

    ``minimal`` keeps id-like columns, ``none`` keeps all but leaking ones;
    leakage is dropped, told (``warn``), ignored or refused (``error``).
    """
    if mode not in ("auto", "minimal", "none") or leakage not in ("drop", "warn", "ignore", "error"):
        raise ConfigError("mode: auto, minimal or none; leakage: drop, warn, ignore or error")
    leaking = list(profile.get("leakage", []))
    if leakage == "error" and leaking:
        raise DataError(f"columns {leaking} give the target away")
    gone = set(leaking if leakage == "drop" else [])
    if mode != "none":
        gone |= set(profile.get("constant", [])) | {c for group in profile.get("duplicate_groups", []) for c in group[1:]}
    if mode == "auto":
        gone |= set(profile.get("id_like", []))
    return [c for c in profile["columns"] if c in gone]


def member_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns an ensemble member reads, in its order."""
    if absent := [c for c in columns if c not in df.columns]:
        raise DataError(f"columns {absent} are not there")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def prepare_fit_input(data, target=None, y=None):
    """Which of ``target`` (columns) and ``y`` (values beside the rows) is given: exactly one."""
    if (target is None) == (y is None):
        raise ConfigError("give either target or y")
    if y is not None and not isinstance(data, DataFrame) and len(y) != len(data):
        raise DataError(f"{len(y)} targets for {len(data)} rows")
    return "y" if target is None else "target"
