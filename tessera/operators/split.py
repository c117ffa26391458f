"""Splits, folds and samples by a hash of a stable key: equal on any partitioning.

Plain splits need no shuffle.  Exact quotas (of a class, or of the first rows in
time) are cut by a histogram: counts of hash or time ranges tell the range that
holds the cut, and only that range is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError
from ..functions.columns import hash_unit, place_within, prefix_sums

RANGES = 1024  # ranges of a histogram
HOLDOUT_ROWS = 750  # rows from which one holdout takes the place of folds
SAMPLE_ROWS = 50_000  # rows that a search works on, at most


def split_random(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    return df.withColumn("is_test", hash_unit(F.col(key), f"{seed}:") < test)


def split_group(df: DataFrame, group: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole groups on one side."""
    return split_random(df, group, test, seed)


def smallest(df: DataFrame, strata: list[str], key: str, salt: str, quota: Column, name: str, below: bool = False) -> DataFrame:
    """``df`` with the flag ``name``: the ``quota`` rows of each stratum with the smallest hashes, ties by key.

    ``quota`` is an expression of ``n``, the rows of the stratum.  Rows of one
    key stay together: those of the key at the quota's end are in, or with
    ``below`` out if they go beyond it.  What is joined has one row a stratum
    and goes to all tasks, so rows aren't gathered by stratum.
    """
    rows = df.withColumns({"__h": hash_unit(F.col(key), salt), **{f"__s{i}": F.col(c) for i, c in enumerate(strata)}})
    by = [f"__s{i}" for i in range(len(strata))]
    place = F.floor(F.col("__h") * RANGES)
    counts = rows.groupBy(*by, place.alias("__b")).agg(F.count("*").alias("c"))
    own = Window.partitionBy(*by)
    upto = counts.withColumns({"n": F.sum("c").over(own), "upto": F.sum("c").over(own.orderBy("__b"))}).withColumn("q", quota + int(below))
    cuts = upto.where((F.col("upto") >= F.col("q")) & (F.col("upto") - F.col("c") < F.col("q"))).select(
        *[F.col(c).alias(f"{c}c") for c in by], F.col("__b").alias("__cut"), (F.col("q") - F.col("upto") + F.col("c")).alias("__need"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}c"))
    near = rows.select(*by, "__h", F.col(key).alias("__k")).join(F.broadcast(cuts), same & (F.floor(F.col("__h") * RANGES) == F.col("__cut")))
    order = Window.partitionBy(*by).orderBy("__h", "__k")  # one range of a stratum
    edge = near.withColumn("__r", F.row_number().over(order)).where("__r = __need").select(
        *[F.col(c).alias(f"{c}c") for c in by], F.col("__h").alias("__he"), F.col("__k").alias("__ke"))
    inside = (F.col("__h") < F.col("__he")) | ((F.col("__h") == F.col("__he")) & ((F.col(key) < F.col("__ke")) if below else (F.col(key) <= F.col("__ke"))))
    return rows.join(F.broadcast(edge), same, "left").withColumn(name, F.coalesce(inside, F.lit(below))).select(*df.columns, name)


def split_stratified(df: DataFrame, key: str, target: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """The ``test`` share of each class with the smallest hashes; at least one row a class."""
    return smallest(df, [target], key, f"{seed}:", F.greatest(F.lit(1), F.floor(F.col("n") * test)), "is_test")


def split_stratified_group(df: DataFrame, key: str, group: str, target: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole groups on one side, stratified by each group's commonest class (the smaller at ties)."""
    counts = df.groupBy(group, F.col(target).cast("string").alias("class")).agg(F.count("*").alias("c"))
    mode = counts.groupBy(group).agg(F.min(F.struct((-F.col("c")).alias("c"), "class"))["class"].alias("class"))
    chosen = split_stratified(mode, group, "class", test, seed).select(F.col(group).alias("__g"), "is_test")
    return df.join(chosen, F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")


def split_temporal(df: DataFrame, time: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """The last rows by time are the test side: all but ``round(n * (1 - test))``, at least one on each side; equal times go by the key's hash."""
    micros = F.unix_micros(F.col(f"`{time}`").cast("timestamp"))
    row = df.agg(F.count("*").alias("n"), F.count(micros).alias("told")).first()
    if row["told"] < row["n"]:
        raise DataError(f"{time} holds missing times")
    n = row["n"]
    if n < 2:
        return df.withColumn("is_test", F.lit(False))
    train = min(max(round(n * (1 - test)), 1), n - 1)
    times = prefix_sums(df.groupBy(micros.alias("t")).agg(F.count("*").cast("double").alias("c")), "t", ["c"])
    last = times.where((F.col("c_before") < train) & (F.col("c_before") + F.col("c") >= train)).first()
    need = int(train - last["c_before"])
    # Rows of the cut's time are told apart by (hash, key), without a join by key; those of one key stay on one side.
    return smallest(df.withColumn("__tied", micros == last["t"]), ["__tied"], key, f"{seed}:", F.when(F.col("__s0"), need).otherwise(0), "__first", below=True).withColumn(
        "is_test", (micros > last["t"]) | ((micros == last["t"]) & ~F.col("__first"))).drop("__first", "__tied")


def split(df: DataFrame, key: str, task: str, targets: list[str], strategy: str = "auto", time: str | None = None, group: str | None = None,
          test: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test`` by the strategy: by group for rankings and where there are groups, else by time, else stratified random."""
    if strategy == "auto":
        strategy = "group" if task == "ranking" or group else "temporal" if time else "random"
    if strategy == "temporal":
        if not time or time not in df.columns:
            raise DataError(f"the time column {time!r} is not there")
        return split_temporal(df, time, key, test, seed)
    if strategy in ("group", "stratified_group"):
        if not group:
            raise ConfigError(f"a {strategy} split needs a group column")
        if df.select(group).distinct().limit(2).count() < 2:
            raise DataError("a group split needs two groups")
        if strategy == "stratified_group" and task in ("binary", "multiclass"):
            return split_stratified_group(df, key, group, targets[0], test, seed)
        return split_group(df, group, test, seed)
    if strategy != "random":
        raise ConfigError(f"no split strategy {strategy!r}")
    return split_stratified(df, key, targets[0], test, seed) if task in ("binary", "multiclass") else split_random(df, key, test, seed)


def folds(df: DataFrame, key: str, k: int = 3, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.floor(hash_unit(F.col(key), f"{seed}:fold:") * k).cast("int"))


def stratified_folds(df: DataFrame, key: str, target: str, k: int = 3, seed: int = 42) -> DataFrame:
    """Folds whose sizes differ by one row at most in every class: the rank by hash, modulo k.  A class is ranked in ranges of the hash."""
    h = hash_unit(F.col(key), f"{seed}:fold:")
    return place_within(df, [target], [h, F.col(key)], F.floor(h * RANGES), "fold").withColumn("fold", F.pmod(F.col("fold") - 1, F.lit(k)).cast("int"))


def validation_folds(df: DataFrame, key: str, task: str, target: str | None = None, group: str | None = None, validation: str = "auto", k: int = 3, seed: int = 42) -> DataFrame:
    """``fold`` for model selection: -1 is always trained on.

    One holdout fold (0) of a fifth from ``HOLDOUT_ROWS`` rows on, or when asked
    for; else k folds, by group, stratified (at most as many as the rarest class
    has rows) or plain.
    """
    if validation not in ("auto", "kfold", "holdout"):
        raise ConfigError("validation is auto, kfold or holdout")
    n = df.count()
    grouped, classes = task == "ranking" or group, task in ("binary", "multiclass") and target
    rarest = df.groupBy(target).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0 if classes else 0
    if validation == "holdout" or validation == "auto" and n >= HOLDOUT_ROWS or classes and not grouped and rarest < 2:
        parts = split_group(df, group, 0.2, seed) if grouped else split_stratified(df, key, target, 0.2, seed) if classes and rarest >= 2 else split_random(df, key, 0.2, seed)
        return parts.withColumn("fold", F.when(F.col("is_test"), 0).otherwise(-1)).drop("is_test")
    if grouped:
        groups = df.select(group).distinct().count()
        if groups < 2:
            raise ConfigError("folds by group need two groups")
        return folds(df, group, min(k, groups), seed)
    return stratified_folds(df, key, target, min(k, rarest), seed) if classes else folds(df, key, min(k, max(2, n // 2)), seed)


def stratified_sample(df: DataFrame, key: str, target: str, share: float, seed: int = 42) -> DataFrame:
    """The share of every class, rounded, at least one row: those with the smallest hashes."""
    return smallest(df, [target], key, f"{seed}:sample:", F.greatest(F.lit(1), F.round(F.col("n") * share).cast("long")), "__in").where("__in").drop("__in")


def search_sample(df: DataFrame, key: str, target: str | None = None, group: str | None = None, most: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """At most about ``most`` rows for a search: whole groups in hash order, every class in proportion, or any rows."""
    n = df.count()
    if n <= most:
        return df
    if group:
        return df.where(hash_unit(F.col(group), f"{seed}:sample:") < most / n)
    if target:
        return stratified_sample(df, key, target, most / n, seed)
    return smallest(df, [], key, f"{seed}:sample:", F.lit(most), "__in").where("__in").drop("__in")


def calibration_holdout(df: DataFrame, key: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    return split_random(df, key, share, seed + 97).withColumnRenamed("is_test", "is_calibration")


def calibration_split(df: DataFrame, key: str, target: str | None = None, share: float = 0.15, seed: int = 42) -> DataFrame | None:
    """``is_calibration``, stratified by ``target`` if given; none with under 80 rows, or under 20 to calibrate on."""
    n = df.count()
    if n < 80 or n * share < 20:
        return None
    if target is None:
        return calibration_holdout(df, key, share, seed)
    return split_stratified(df, key, target, share, seed + 97).withColumnRenamed("is_test", "is_calibration")


def member_sample(df: DataFrame, key: str, member: int, target: str | None = None, share: float = 0.9, seed: int = 42) -> DataFrame:
    """The rows an ensemble member trains on: its own share of every class, or of all rows."""
    own = seed + 1009 * (member + 1)
    return stratified_sample(df, key, target, share, own) if target else df.where(hash_unit(F.col(key), f"{own}:sample:") < share)


def meta_split(df: DataFrame, key: str, select: float = 0.25, seed: int = 42) -> DataFrame:
    """``is_select``: the quarter that chooses between candidates, apart from the rows that fit the meta learner."""
    return split_random(df, key, select, seed + 53).withColumnRenamed("is_test", "is_select")


def three_way(df: DataFrame, key: str, meta: float = 0.2, select: float = 0.2, seed: int = 42) -> DataFrame:
    """``part``: fit, meta or select, by two cuts of one hash."""
    h = hash_unit(F.col(key), f"{seed}:")
    return df.withColumn("part", F.when(h < select, "select").when(h < select + meta, "meta").otherwise("fit"))


def modality_dropout(df: DataFrame, key: str, groups: dict[str, list[str]], rate: float = 0.08, seed: int = 42) -> DataFrame:
    """The rows, and copies of a hashed share of them with one feature group emptied."""
    names = sorted(groups)
    drawn = df.where(hash_unit(F.col(key), f"{seed + 777}:") < min(rate, 0.2)).withColumn("__g", F.floor(hash_unit(F.col(key), f"{seed + 778}:") * len(names)))
    for i, g in enumerate(names):
        for c in groups[g]:
            drawn = drawn.withColumn(c, F.when(F.col("__g") != i, F.col(c)))
    return df.unionByName(drawn.drop("__g"))
