"""Column builders that the operators fuse into one aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df, skip=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in skip]


def finite(c: str | Column) -> Column:
    """The value as a double; NaN and infinities are null."""
    x = (F.col(f"`{c}`") if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def nulled(df):
    """``df`` with NaN as null, so that a missing number is told in one way only."""
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in real}) if real else df


def missing(c: str) -> Column:
    return F.col(f"`{c}`").isNull()


def empty_value(c: str, kind: str = "string") -> Column:
    """Null, NaN, blank text, empty bytes or an empty array, by the column's type (as ``df.dtypes`` names it)."""
    x = F.col(f"`{c}`")
    if kind in ("float", "double"):
        return x.isNull() | F.isnan(x)
    if kind == "string":
        return x.isNull() | (F.trim(x) == "")
    if kind == "binary":
        return x.isNull() | (F.length(x) == 0)
    return x.isNull() | (F.size(x) == 0) if kind.startswith("array") else x.isNull()


def rate(flag: Column) -> Column:
    return F.avg(F.when(flag, 1.0).otherwise(0.0))


def quantiles(c: Column, points: list[float], exact: bool = True, accuracy: int = 10_000) -> Column:
    """Linear-interpolated quantiles; ``exact=False`` is the sketch for data whose distinct values don't fit a task."""
    p = F.array(*[F.lit(float(x)) for x in points])
    return F.percentile(c, p) if exact else F.percentile_approx(c, p, F.lit(accuracy)).cast("array<double>")


DIRECT_BYTES = 64 << 20  # estimated size from which exact quantiles take three passes; results are equal
NEAR = 1e-3  # ranks on each side of a point between which the sketch puts it


def is_large(df) -> bool:
    """By the optimizer's estimate, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > DIRECT_BYTES


def exact_quantiles(df, columns: dict[str, Column], points: list[float]) -> dict[str, list[float] | None]:
    """Linear-interpolated quantiles of each column; none without a value.

    An exact percentile keeps every distinct value of a column in one task.  Of
    large data a sketch tells between which values a point lies, one pass counts
    what is below and between them, and only the values between are sorted.
    """
    if not columns:
        return {}
    names = list(columns)
    if not is_large(df):
        row = df.agg(*[quantiles(columns[c], points).alias(f"q{i}") for i, c in enumerate(names)]).first()
        return {c: row[f"q{i}"] for i, c in enumerate(names)}
    around = [min(1.0, max(0.0, p + d)) for p in points for d in (-NEAR, NEAR)]
    sketch = df.agg(*[F.percentile_approx(columns[c], F.array(*[F.lit(x) for x in around]), F.lit(int(4 / NEAR))).alias(f"q{i}") for i, c in enumerate(names)],
                    *[F.count(columns[c]).alias(f"n{i}") for i, c in enumerate(names)], *[F.min(columns[c]).alias(f"a{i}") for i, c in enumerate(names)], *[F.max(columns[c]).alias(f"b{i}") for i, c in enumerate(names)]).first()
    spans = {}
    for i, c in enumerate(names):
        for j, p in enumerate(points):
            if sketch[f"n{i}"]:
                low, high = sketch[f"q{i}"][2 * j], sketch[f"q{i}"][2 * j + 1]
                spans[c, j] = (sketch[f"a{i}"] if p <= NEAR else low, sketch[f"b{i}"] if p >= 1 - NEAR else high, p * (sketch[f"n{i}"] - 1))
    if not spans:
        return dict.fromkeys(names)
    keys = list(spans)
    inside = lambda c, j: F.when((columns[c] >= spans[c, j][0]) & (columns[c] <= spans[c, j][1]), columns[c])
    counts = df.agg(*[F.sum(F.when(columns[c] < spans[c, j][0], 1).otherwise(0)).alias(f"l{k}") for k, (c, j) in enumerate(keys)], *[F.count(inside(c, j)).alias(f"m{k}") for k, (c, j) in enumerate(keys)]).first()
    found, off, ranks = {}, [], {}
    for k, (c, j) in enumerate(keys):
        low, high, place = spans[c, j]
        rank = place - counts[f"l{k}"]
        if not 0 <= rank <= counts[f"m{k}"] - 1:  # the sketch was off: this column by itself
            off.append(k)
        elif low == high:
            found[k] = float(low)
        else:
            ranks[k] = rank
    if ranks:
        found |= _at_ranks(df, columns, {k: (*keys[k], *spans[keys[k]][:2], rank) for k, rank in ranks.items()})
    if off:
        row = df.agg(*[F.percentile(columns[keys[k][0]], points[keys[k][1]]).alias(f"v{k}") for k in off]).first()
        found |= {k: row[f"v{k}"] for k in off}
    return {c: [found[keys.index((c, j))] for j in range(len(points))] if (c, 0) in spans else None for c in names}


def _at_ranks(df, columns: dict[str, Column], wanted: dict[int, tuple]) -> dict[int, float]:
    """The interpolated value of each (column, point, low, high, rank from 0 among the values from low to high): only values near a point are counted and sorted."""
    own: dict[str, list] = {}
    for k, (c, _, low, high, _) in wanted.items():
        own.setdefault(c, []).append((k, float(low), float(high)))
    rows = df.select(*[columns[c].cast("double").alias(f"x{i}") for i, c in enumerate(own)])
    cells, spans = [], []
    for i, some in enumerate(own.values()):
        x, near = F.col(f"x{i}"), F.lit(False)
        for _, low, high in some:
            near = near | x.between(low, high)
        cells.append(F.struct(F.lit(i).alias("i"), F.when(near, x).alias("v")))
        spans += [F.lit(i), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(low).alias("low"), F.lit(high).alias("high")) for k, low, high in some])]
    counts = rows.select(F.explode(F.array(*cells)).alias("r")).select("r.*").where("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("n"))
    mine = F.filter(F.element_at(F.create_map(*spans), F.col("i")), lambda s: F.col("v").between(s["low"], s["high"]))
    each = counts.select("v", "n", F.explode(F.transform(mine, lambda s: s["k"])).alias("k"))
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = lambda f: F.element_at(F.create_map(*[F.lit(y) for k, w in wanted.items() for y in (k, f(w[4]))]), F.col("k"))
    first = lambda f: F.min(F.when(F.col("upto") > at(f), F.col("v")))
    found = {}
    for r in each.withColumn("upto", upto).groupBy("k").agg(first(math.floor).alias("a"), first(math.ceil).alias("b")).collect():
        share = wanted[r["k"]][4] % 1
        found[r["k"]] = r["a"] if r["a"] == r["b"] else (1 - share) * r["a"] + share * r["b"]
    return found


def skewness(c: Column) -> Column:
    """Bias-corrected skewness; 0 for constant columns and fewer than three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.coalesce(F.skewness(c) * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)


def safe_corr(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson correlation; null for constant columns."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def long_form(row, fields: dict[str, dict[str, Column]], key: str = "column_name"):
    """One aggregate row as one row per name: ``fields[name]`` maps output names to columns."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias(key), *[c.alias(k) for k, c in f.items()]) for n, f in fields.items()])).alias("r")).select("r.*")


def wide_then_long(df, columns: list[str], stats: dict[str, callable], key: str = "column_name"):
    """All statistics of all columns in one pass, then one row per column."""
    row = df.agg(*[make(c).alias(f"{i}__{s}") for i, c in enumerate(columns) for s, make in stats.items()])
    return long_form(row, {c: {s: F.col(f"{i}__{s}") for s in stats} for i, c in enumerate(columns)}, key)


def prefix_sums(df, by: str, values: list[str], parts: int = 64):
    """``df`` with ``<value>_before``: the sums of the rows of smaller ``by``, whose values differ.

    Rows are dealt into ranges of ``by`` (a sketch tells where to cut), summed up
    inside each range and shifted by the ranges before, so no task sorts all rows.
    """
    cuts = cut_points(df, by, parts)
    ranged = df.withColumn("__range", F.size(F.filter(cuts, lambda e: e <= F.col(by).cast("double"))))
    totals = ranged.groupBy("__range").agg(*[F.sum(v).alias(f"{v}__all") for v in values])
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shift = totals.select("__range", *[F.coalesce(F.sum(f"{v}__all").over(ahead), F.lit(0.0)).alias(f"{v}__shift") for v in values])
    inside = Window.partitionBy("__range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({f"{v}__in": F.coalesce(F.sum(v).over(inside), F.lit(0.0)) for v in values}).join(F.broadcast(shift), "__range")
    return out.withColumns({f"{v}_before": F.col(f"{v}__in") + F.col(f"{v}__shift") for v in values}).drop("__range", *[f"{v}__{k}" for v in values for k in ("in", "shift")])


def cut_points(df, by: str, parts: int = 64) -> Column:
    """Edges of about equal ranges of a column, by a sketch."""
    edges = df.agg(F.percentile_approx(by, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(1000)).alias("e")).first()["e"]
    return F.array(*[F.lit(float(e)) for e in sorted(set(edges or []))]).cast("array<double>")


def place_within(df, groups: list[str], order: list[Column], part: Column, name: str):
    """``df`` with ``name``, each row's place (from 1) in its group by ``order``.

    ``part`` numbers ranges of the order, smaller ones first: a group that holds
    most rows is sorted range by range, and only counts of ranges meet.  Rows
    that ``order`` doesn't tell apart share a range.
    """
    by = [f"__g{i}" for i in range(len(groups))]
    rows = df.withColumns({**{g: F.col(f"`{c}`") for g, c in zip(by, groups, strict=True)}, "__part": part})
    counts = rows.groupBy(*by, "__part").agg(F.count("*").alias("__c"))
    ahead = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shift = counts.select(*[F.col(g).alias(f"{g}c") for g in by], F.col("__part").alias("__partc"), F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__partc")
    for g in by:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}c"))
    placed = rows.withColumn("__in", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)))
    return placed.join(shift, same).withColumn(name, F.col("__in") + F.col("__before")).select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)


def bucket_of(c: Column, edges: Column) -> Column:
    """How many inner edges lie at or below the value."""
    return F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(c >= e, 1).otherwise(0))


def hash_unit(key: Column, salt: str) -> Column:
    """A uniform number in [0, 1) from the md5 of salt and key: equal in any engine, on any partitioning."""
    return F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(salt), key.cast("string")), "UTF-8")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
