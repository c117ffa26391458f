"""Dataset profile: constants, duplicate columns, correlation, leakage, task and column roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions.columns import finite, missing, nulled, numeric_columns, safe_corr, wide_then_long
from . import correlate

DATE_ROWS = 2000  # rows looked at to tell dates from other texts


def distinct_counts(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Non-null distinct values of each column; the sketch with ``exact=False``.

    Exact counts unpivot first, so that one shuffle of (column, value) serves all columns.
    """
    columns = columns or df.columns
    if not exact:
        return wide_then_long(df, columns, {"distinct_values": lambda c: F.approx_count_distinct(c)})
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("r")).select("r.*").distinct()
    return pairs.groupBy("column_name").agg(F.count("value").alias("distinct_values"))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with one value at most, null counting as a value: min equals max, and nulls are all or none."""
    return wide_then_long(df, df.columns, {"constant": lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True)) & (
        (F.coalesce(F.sum(F.when(missing(c), 1).otherwise(0)), F.lit(0)) == 0) | (F.count(c) == 0))})


def duplicate_column_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of columns whose values are equal in every row (nulls equal), by fingerprints."""
    return df.sparkSession.createDataFrame(correlate.equal_columns(df, columns), "first string, second string")


def duplicate_groups(df: DataFrame, columns: list[str]) -> list[list[str]]:
    """Columns that are equal in every row, in the order of the table."""
    if len(columns) < 2:
        return []
    groups: dict[str, list[str]] = {}
    home: dict[str, str] = {}
    for r in sorted(duplicate_column_pairs(df, columns).collect(), key=lambda r: (columns.index(r["first"]), columns.index(r["second"]))):
        first = home.setdefault(r["first"], r["first"])
        if r["second"] not in home:
            home[r["second"]] = first
            groups.setdefault(first, [first]).append(r["second"])
    return list(groups.values())


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass of matrix products."""
    return correlate.correlations(df, columns)


def high_correlations(df: DataFrame, columns: list[str], least: float = 0.95) -> DataFrame:
    return correlations(df, columns).where(F.abs("corr") >= least)


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    ratio = F.min("n").over(every).cast("double") / F.max("n").over(every)  # one row per class
    return counts.select("class", "n", ratio.alias("imbalance"), (ratio < 0.1).alias("imbalanced"))


def positive_counts(df: DataFrame, targets: list[str]) -> DataFrame:
    """Rows of the greater of two classes, whatever these are (1 of 0 and 1, true, the later text)."""
    tops = df.agg(*[F.max(c).alias(f"t{i}") for i, c in enumerate(targets)]).first()
    top = {c: F.lit(tops[f"t{i}"]) for i, c in enumerate(targets)}
    return wide_then_long(df, targets, {"positives": lambda c: F.sum(F.when(F.col(c) == top[c], 1).otherwise(0)).cast("long"),
                                        "rate": lambda c: F.avg(F.when(F.col(c).isNotNull(), (F.col(c) == top[c]).cast("double")))})


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean"))


def normalised(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("<missing>"))))


def leakage_exact_copy(df: DataFrame, features: list[str], target: str) -> DataFrame:
    return wide_then_long(df, features, {"copy": lambda c: F.sum(F.when(normalised(c) == normalised(target), 0).otherwise(1)) == 0})


def leakage_one_to_one(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Whether feature and target determine each other, within the sizes where that is telling."""
    n, t = df.select(F.count("*"), F.count_distinct(target)).first()
    limit = min(max(20, 5 * t), max(20, n // 2))
    # All columns unpivoted: one shuffle of distinct (column, value, class).
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("f")) for c in features])
    seen = df.select(F.col(f"`{target}`").cast("string").alias("t"), F.explode(cells).alias("r")).select("t", "r.*").where("f IS NOT NULL").distinct()
    values = seen.groupBy("column_name", "f").agg(F.count("t").alias("t"))
    each = values.groupBy("column_name").agg(F.count("*").alias("f"), F.sum("t").alias("both"))
    every = df.sparkSession.createDataFrame([(c,) for c in features], "column_name string").join(F.broadcast(each), "column_name", "left")
    rule = (F.lit(t) <= 50) & (F.col("f") <= limit) & (F.col("f") > 1) & (F.col("both") == F.col("f")) & (F.col("both") == t)
    return every.select("column_name", F.coalesce(rule, F.lit(False)).alias("mapping"))


def leakage_correlation(df: DataFrame, features: list[str], target: str, least: float = 0.98) -> DataFrame:
    codes = df.select(target).distinct().where(F.col(target).isNotNull())
    ranked = codes.withColumn("__code", F.dense_rank().over(Window.orderBy(target)).cast("double") - 1)  # one row per class
    coded = df.join(ranked, target, "left")
    return wide_then_long(coded, features, {"corr": lambda c: safe_corr(finite(c), F.col("__code"))}).withColumn("leaks", F.coalesce(F.abs("corr") >= least, F.lit(False)))


def leakage_names(features: list[str], target: str) -> list[str]:
    low = target.lower()
    return [f for f in features if len(low) >= 3 and f != target and (low in f.lower() or f.lower() in low and len(f) >= 3)]


def infer_tasks(df: DataFrame, targets: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    counts = distinct_counts(df, targets)
    textual = F.col("column_name").isin([t for t in targets if kinds[t] in ("string", "boolean")] or [""])
    return counts.select("column_name", "distinct_values", F.when(F.col("distinct_values") == 2, "binary").when(textual, "multiclass").otherwise("regression").alias("task"))


def task_of(df: DataFrame, targets: list[str], group: str | None = None) -> str:
    """The task that the targets are of: a ranking with a group and one number; several targets must be of one kind."""
    kinds = {r["column_name"]: (r["task"], r["distinct_values"]) for r in infer_tasks(df, targets).collect()}
    if low := [t for t in targets if kinds[t][1] < 2]:
        raise DataError(f"targets {low} have one value")
    tasks = [kinds[t][0] for t in targets]
    if len(targets) == 1:
        return "ranking" if group and targets[0] in numeric_columns(df) else tasks[0]
    if all(t == "binary" for t in tasks):
        return "multilabel"
    if all(t in numeric_columns(df) for t in targets):
        return "multioutput_regression"
    raise DataError("several targets must be all of two classes, or all numeric")


def id_like(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    named = [c for c in df.columns if c.lower() == "id" or c.lower().endswith("_id") or c.lower().startswith("id_") or "uuid" in c.lower() or kinds[c] in ("int", "bigint", "string")]
    n = df.count()
    return distinct_counts(df).select("column_name", ((F.lit(n) > 20) & (F.col("distinct_values") >= 0.995 * n) & F.col("column_name").isin(named or [""])).alias("id_like"))


def text_like(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = wide_then_long(df, columns, {"mean_length": lambda c: F.avg(F.length(c)), "told": lambda c: F.count(c),
                                       "space_share": lambda c: F.avg(F.when(F.col(c).rlike("[ \\t\\n]"), 1.0).when(F.col(c).isNotNull(), 0.0))})
    out = stats.join(F.broadcast(distinct_counts(df, columns)), "column_name").select(
        "column_name", "mean_length", F.try_divide(F.col("distinct_values").cast("double"), F.col("told")).alias("distinct_ratio"), "space_share")
    rule = (F.col("mean_length") >= 30) | ((F.col("mean_length") >= 12) & (F.col("distinct_ratio") >= 0.5) & (F.col("space_share") >= 0.4))
    return out.withColumn("is_text", rule)


def classify_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> dict[str, str]:
    """The role of each column: id, text, numeric, datetime or categorical; long texts go before dates."""
    kinds = {c: k for c, k in df.dtypes if c not in skip}
    some = df.select(*[F.col(f"`{c}`") for c in kinds])
    ids = {r["column_name"] for r in id_like(some).where("id_like").collect()}
    strings = [c for c, k in kinds.items() if k == "string"]
    texts = {r["column_name"] for r in text_like(df, strings).where("is_text").collect()} if strings else set()
    dates = set()
    if rest := [c for c in strings if c not in texts]:
        row = df.limit(DATE_ROWS).agg(*[F.try_divide(F.count(F.try_to_timestamp(c)), F.count(c)).alias(f"d{i}") for i, c in enumerate(rest)]).first()
        dates = {c for i, c in enumerate(rest) if (row[f"d{i}"] or 0.0) >= 0.8}
    numeric = set(numeric_columns(some))
    return {c: "id" if c in ids else "datetime" if k in ("timestamp", "timestamp_ntz", "date") or c in dates else "numeric" if c in numeric else "text" if c in texts else "categorical"
            for c, k in kinds.items()}


def _named(facts, names: dict[str, str]):
    """``facts`` with the columns' own names."""
    if isinstance(facts, dict):
        return {names.get(k, k): _named(v, names) for k, v in facts.items()}
    if isinstance(facts, list):
        return [_named(v, names) for v in facts]
    return names.get(facts, facts) if isinstance(facts, str) else facts


def profile(df: DataFrame, target: str | list[str], group: str | None = None, task: str = "auto") -> dict:
    """The facts that later stages read, as plain data."""
    targets = [target] if isinstance(target, str) else list(target)
    if any("." in c or "`" in c for c in df.columns):  # names that expressions would read as paths
        names = {c: f"{c.replace('.', '_').replace('`', '_')}__{i}" for i, c in enumerate(df.columns) if "." in c or "`" in c}
        facts = profile(df.toDF(*[names.get(c, c) for c in df.columns]), [names.get(t, t) for t in targets], names.get(group, group), task)
        return _named(facts, {v: k for k, v in names.items()})
    df = nulled(df)
    features = [c for c in df.columns if c not in (*targets, group)]
    numeric = [c for c in numeric_columns(df) if c in features]
    rows = lambda d: [r.asDict() for r in d.collect()]
    task = task_of(df, targets, group) if task == "auto" else task
    roles = classify_columns(df, (*targets, *([group] if group else [])))
    out = {"rows": df.count(), "columns": features, "numeric": numeric, "roles": roles, "task": task, "targets": targets,
           "missing": {r["column_name"]: r["rate"] for r in rows(wide_then_long(df, features, {"rate": lambda c: F.avg(missing(c).cast("double"))})) if r["rate"]},
           "constant": [r["column_name"] for r in rows(constant_columns(df.select(*features))) if r["constant"]],
           "duplicate_groups": duplicate_groups(df, features), "id_like": [c for c, k in roles.items() if k == "id"],
           "correlated": rows(high_correlations(df, numeric)) if len(numeric) > 1 else [],
           "cardinality": {r["column_name"]: r["distinct_values"] for r in rows(distinct_counts(df, [c for c in features if roles[c] in ("categorical", "id")]))} if features else {}}
    leaking: list[str] = []
    if len(targets) == 1 and features:
        leaking += [r["column_name"] for r in rows(leakage_exact_copy(df, features, targets[0])) if r["copy"]]
        if task in ("binary", "multiclass"):
            leaking += [r["column_name"] for r in rows(leakage_one_to_one(df, features, targets[0])) if r["mapping"]]
            out["classes"] = {r["class"]: r["n"] for r in rows(class_distribution(df, targets[0]))}
            out["imbalanced"] = bool(out["classes"]) and min(out["classes"].values()) / max(out["classes"].values()) < 0.1
        if numeric:
            leaking += [r["column_name"] for r in rows(leakage_correlation(df, numeric, targets[0])) if r["leaks"]]
        out["leakage_names"] = leakage_names(features, targets[0])
    if group:
        out["groups"] = group_sizes(df, group).first().asDict()
    return out | {"leakage": list(dict.fromkeys(leaking))}
