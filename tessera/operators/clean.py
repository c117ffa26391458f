"""Cleaning steps: fitted state is plain data, replay is one projection."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions.columns import exact_quantiles, finite, numeric_columns, quantiles, skewness
from ..functions.shared import fresh_path
from . import correlate, neighbours

MISSING, RARE, UNKNOWN = "__missing__", "__rare__", "__unknown__"


def gone(df: DataFrame, c: str) -> Column:
    """Whether a value is missing: null, or NaN; an infinity is there, and imputed later."""
    x = F.col(f"`{c}`")
    return x.isNull() | F.isnan(x) if dict(df.dtypes)[c] in ("float", "double") else x.isNull()


def missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}__missing": gone(df, c).cast("int") for c in columns})


def winsor_limits(df: DataFrame, columns: list[str], share: float = 0.01, exact: bool = True) -> dict[str, tuple[float, float]]:
    points = [share, 1 - share]
    if exact:
        found = exact_quantiles(df, {c: finite(c) for c in columns}, points)
    else:
        row = df.agg(*[quantiles(finite(c), points, False).alias(f"q{i}") for i, c in enumerate(columns)]).first()
        found = {c: row[f"q{i}"] for i, c in enumerate(columns)}
    return {c: tuple(q) for c, q in found.items() if q and q[0] < q[1]}


def clip(c: str, limit: tuple[float, float] | None) -> Column:
    return F.when(finite(c).isNotNull(), F.greatest(F.lit(limit[0]), F.least(F.lit(limit[1]), finite(c)))) if limit else finite(c)


def fills(df: DataFrame, columns: list[str], how: str = "median", constant: float = 0.0) -> dict[str, float]:
    if how == "constant":
        return dict.fromkeys(columns, constant)
    if how == "median":
        found = {c: q and q[0] for c, q in exact_quantiles(df, {c: finite(c) for c in columns}, [0.5]).items()}
    else:
        row = df.agg(*[F.avg(finite(c)).alias(f"f{i}") for i, c in enumerate(columns)]).first()
        found = {c: row[f"f{i}"] for i, c in enumerate(columns)}
    return {c: constant if v is None else v for c, v in found.items()}


def impute(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(c), F.lit(float(v))) for c, v in fill.items()})


def kept_categories(df: DataFrame, columns: list[str], share: float = 0.01, most: int = 127) -> dict[str, list[str]]:
    """Of each column the values with max(2, ceil(share * n)) rows at least, the commonest ``most``; ties by value.

    All columns are unpivoted and counted once.
    """
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)).alias("v")) for c in columns])
    counts = df.select(F.explode(cells).alias("r")).select("r.*").groupBy("c", "v").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("c"))
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "v"))
    often = counts.withColumn("t", total).where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("t") * share)))  # at most 1 / share values a column
    found = often.withColumn("i", place).where(F.col("i") <= most).orderBy("c", "i").collect()
    return {c: [r["v"] for r in found if r["c"] == c] for c in columns}


def group_rare(c: str, keep: list[str]) -> Column:
    value = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    return F.when(value.isin(keep or [""]), value).otherwise(RARE)


def ordinal_codes(df: DataFrame, c: str) -> list[str]:
    return sorted(r["v"] for r in df.select(F.col(c).cast("string").alias("v")).where("v IS NOT NULL").distinct().collect())


def encode(c: str, values: list[str]) -> Column:
    """The place in ``values``; unseen and null get len(values)."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c).cast("string"))
    return F.when(F.coalesce(place, F.lit(0)) > 0, place - 1).otherwise(len(values)).cast("int")


def replay_unknown(c: str, values: list[str]) -> Column:
    return F.when(F.col(c).cast("string").isin(values or [""]), F.col(c).cast("string")).otherwise(UNKNOWN)


class LabelEncoder:
    """Classes as 0..k-1 in text order, and back.  A class that wasn't there at fit time raises."""

    def __init__(self, classes: list[str] = ()):
        self.classes = list(classes)

    def fit(self, df: DataFrame, target: str) -> LabelEncoder:
        self.classes = ordinal_codes(df, target)
        return self

    def transform(self, df: DataFrame, target: str, out: str) -> DataFrame:
        unseen = df.where(F.col(target).isNotNull() & ~F.col(target).cast("string").isin(self.classes or [""]))
        if bad := [r[0] for r in unseen.select(F.col(target).cast("string")).distinct().limit(3).collect()]:
            raise DataError(f"{target} holds classes that weren't trained on, such as {bad}")
        place = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col(target).cast("string"))
        return df.withColumn(out, F.when(F.col(target).isNotNull(), place - 1).cast("int"))

    def inverse(self, code: str) -> Column:
        return F.get(F.array(*[F.lit(c) for c in self.classes]), F.col(code).cast("int"))


class MultiLabelEncoder:
    """One ``LabelEncoder`` a column; each has exactly two classes, of which the later one is 1."""

    def fit(self, df: DataFrame, targets: list[str]) -> MultiLabelEncoder:
        self.encoders = {t: LabelEncoder().fit(df, t) for t in targets}
        if bad := [t for t, e in self.encoders.items() if len(e.classes) != 2]:
            raise DataError(f"labels {bad} don't have two classes")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for t, e in self.encoders.items():
            df = e.transform(df, t, t)
        return df

    def inverse(self) -> dict[str, Column]:
        return {t: e.inverse(t) for t, e in self.encoders.items()}


# ---- imputation by neighbours and by regressions

def knn_reference(df: DataFrame, columns: list[str], key: str) -> dict:
    """What neighbours need: the path of a table of all rows, the medians, and k = sqrt(rows) between 2 and 8."""
    n = df.count()
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    rows = df.withColumn("__number", F.col(f"`{key}`").cast("long") if whole else F.xxhash64(f"`{key}`"))
    path = fresh_path(df.sparkSession, "neighbours")
    neighbours.numbered(rows, columns, "__number").write.parquet(path)
    return {"columns": columns, "path": path, "medians": list(fills(df, columns, "median").values()), "k": max(2, min(8, int(max(n, 1) ** 0.5)))}


def _fill_arrow(df: DataFrame, columns: list[str], work) -> DataFrame:
    """``df`` with ``columns`` as doubles that ``work`` (a function of a matrix) has filled, in Arrow batches."""
    rows = df.withColumns({c: finite(c) for c in columns})

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in columns])
            done = work(x)
            new = {c: pa.array(done[:, i]) for i, c in enumerate(columns)}
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(i)) for i, n in enumerate(b.schema.names)], names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def knn_impute(df: DataFrame, state: dict) -> DataFrame:
    """``df`` with its gaps filled by the nearest of all reference rows."""
    reference = df.sparkSession.read.schema("number long, x array<double>").parquet(state["path"])
    return neighbours.impute(df, reference, state["columns"], state["k"], state["medians"])


def _replay(x: np.ndarray, start: np.ndarray, steps: list) -> np.ndarray:
    """``x`` with missing values from the start, then from each regression in turn."""
    lost = np.isnan(x)
    x = np.where(lost, start, x)
    for j, offset, slope in steps:
        x[lost[:, j], j] = offset + x[lost[:, j]] @ np.asarray(slope)
    return x


def iterative_state(df: DataFrame, columns: list[str], rounds: int = 10, ridge: float = 1e-3, tolerance: float = 1e-3) -> dict:
    """Regressions of each column with gaps on all others, round after round, from medians on.

    Each regression is one pass that sums products on the executors; only these
    (columns squared) are gathered.  Ends when no filled value moves by
    ``tolerance`` of the largest value.
    """
    rows = df.select(*[finite(c).alias(f"x{i}") for i, c in enumerate(columns)])
    start = np.array(list(fills(df, columns, "median").values()), float)
    told = rows.agg(*[F.count(f"x{i}").alias(f"n{i}") for i in range(len(columns))], F.count("*").alias("n"), *[F.max(F.abs(f"x{i}")).alias(f"m{i}") for i in range(len(columns))]).first()
    gaps = sorted((i for i in range(len(columns)) if 0 < told[f"n{i}"] < told["n"]), key=lambda i: told["n"] - told[f"n{i}"])
    top = max([told[f"m{i}"] or 0.0 for i in range(len(columns))], default=0.0)
    steps: list = []
    before: dict[int, np.ndarray] = {}

    def sums(j: int):
        now = list(steps)

        def run(batches):
            d = len(columns)
            total = np.zeros((d + 1, d + 1))
            for b in batches:
                x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)])
                x = x.reshape(-1, d)
                seen = ~np.isnan(x[:, j])
                z = np.column_stack([np.ones(int(seen.sum())), _replay(x, start, now)[seen]])
                total += z.T @ z
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        return sum(np.frombuffer(r["total"]).reshape(len(columns) + 1, -1) for r in rows.mapInArrow(run, "total binary").collect())

    for _ in range(rounds if len(columns) > 1 else 0):
        moved = 0.0
        for j in gaps:
            g = sums(j)
            others = [0] + [i + 1 for i in range(len(columns)) if i != j]
            a, y = g[np.ix_(others, others)], g[others, j + 1]
            scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
            penalty = np.eye(len(others)) * ridge
            penalty[0, 0] = 0
            beta = np.linalg.lstsq(a / np.outer(scale, scale) + penalty, y / scale, rcond=None)[0] / scale
            slope = np.zeros(len(columns))
            slope[[i - 1 for i in others[1:]]] = beta[1:]
            steps.append((j, float(beta[0]), slope.tolist()))
            now = np.concatenate(([beta[0]], slope * np.sqrt(np.diag(g)[1:] / max(g[0, 0], 1.0))))
            moved = max(moved, float(np.abs(now - before.get(j, np.zeros_like(now))).max()))
            before[j] = now
        if not gaps or moved <= tolerance * max(top, 1e-12):
            break
    return {"columns": columns, "start": start.tolist(), "steps": steps}


def iterative_impute(df: DataFrame, state: dict) -> DataFrame:
    return _fill_arrow(df, state["columns"], lambda x: _replay(x, np.array(state["start"]), state["steps"]))


# ---- distributions

def distribution_plan(df: DataFrame, columns: list[str], how: str = "auto", least_skew: float = 1.5) -> dict:
    """Which columns go through log1p (with their shifts) and which through Yeo-Johnson (with their exponents).

    Columns of twenty values and five distinct ones at least whose skew is strong
    enough: to the right by log1p, to the left by Yeo-Johnson; ``log1p`` takes all
    of them, ``none`` none.
    """
    plan: dict = {"log1p": {}, "yeo_johnson": {}}
    if how == "none" or not columns:
        return plan
    row = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in
                   {"s": lambda c: skewness(finite(c)), "m": lambda c: F.min(finite(c)), "n": lambda c: F.count(finite(c)), "d": lambda c: F.approx_count_distinct(finite(c))}.items()]).first()
    for i, c in enumerate(columns):
        if row[f"n{i}"] < 20 or row[f"d{i}"] < 5 or abs(row[f"s{i}"]) < least_skew:
            continue
        if how == "log1p" or row[f"s{i}"] > least_skew:
            plan["log1p"][c] = max(0.0, -row[f"m{i}"])
        else:
            plan["yeo_johnson"][c] = yeo_johnson_lambda(df, c)
    return plan


def log_shifts(df: DataFrame, columns: list[str], least_skew: float = 1.5) -> dict[str, float]:
    """Columns for log1p: strongly skewed to the right; the shift makes them non-negative."""
    return distribution_plan(df, columns, "auto", least_skew)["log1p"]


def transformed(plan: dict) -> dict[str, Column]:
    return {**{c: log1p(c, shift) for c, shift in plan["log1p"].items()}, **{c: yeo_johnson(finite(c), lam) for c, lam in plan["yeo_johnson"].items()}}


def log1p(c: str, shift: float) -> Column:
    return F.log1p(F.greatest(finite(c) + shift, F.lit(0.0)))


def yeo_johnson(c: Column, lam: float) -> Column:
    up = F.log1p(F.greatest(c, F.lit(0.0))) if abs(lam) < 1e-9 else (F.pow(F.greatest(c, F.lit(0.0)) + 1, F.lit(lam)) - 1) / lam
    low = F.least(c, F.lit(0.0))
    down = -F.log1p(-low) if abs(lam - 2) < 1e-9 else -(F.pow(1 - low, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(c >= 0, up).otherwise(down)


def yeo_johnson_lambda(df: DataFrame, c: str, rounds: int = 3) -> float:
    """The exponent of greatest likelihood: a grid in one aggregate pass, refined twice."""
    x, low, high = finite(c), -4.0, 4.0
    best = 1.0
    for _ in range(rounds):
        grid = np.linspace(low, high, 17).tolist()
        row = df.agg(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("j"), F.count(x).alias("n"), *[F.var_pop(yeo_johnson(x, g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
        if not row["n"]:
            return 1.0
        fit = [-row["n"] / 2 * np.log(max(row[f"v{i}"], 1e-300)) + (g - 1) * row["j"] for i, g in enumerate(grid)]
        best = grid[int(np.argmax(fit))]
        step = (high - low) / 16
        low, high = best - step, best + step
    return best


def scales(df: DataFrame, columns: list[str], how: str) -> dict[str, tuple[float, float]]:
    """(centre, width) of each column: standard (population), minmax or robust; width 1 where there is none."""
    make = {"standard": lambda c: F.array(F.avg(finite(c)), F.stddev_pop(finite(c))),
            "minmax": lambda c: F.array(F.min(finite(c)), F.max(finite(c)) - F.min(finite(c)))}
    if how == "robust":
        found = exact_quantiles(df, {c: finite(c) for c in columns}, [0.25, 0.5, 0.75])
    else:
        row = df.agg(*[make[how](c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        found = {c: row[f"s{i}"] for i, c in enumerate(columns)}
    out = {}
    for c in columns:
        s = found[c]
        centre, width = (s[1], s[2] - s[0]) if how == "robust" and s else (s[0], s[1]) if s and s[0] is not None else (0.0, 1.0)
        out[c] = (centre, width or 1.0)
    return out


def scale(c: str, state: tuple[float, float]) -> Column:
    return (finite(c) - state[0]) / state[1]


def datetime_parts(c: str, hours: bool = False) -> dict[str, Column]:
    t = F.col(c).cast("timestamp")
    month, dow = F.month(t), F.weekday(t)
    turn = lambda x, n: x * F.lit(2 * np.pi / n)
    parts = {"missing": t.isNull().cast("int"), "year": F.year(t), "month": month, "day": F.dayofmonth(t), "dayofweek": dow, "dayofyear": F.dayofyear(t),
             "quarter": F.quarter(t), "is_weekend": (dow >= 5).cast("int"), "days_since_epoch": F.unix_micros(t) / F.lit(8.64e10),
             "month_sin": F.sin(turn(month - 1, 12)), "month_cos": F.cos(turn(month - 1, 12)), "dow_sin": F.sin(turn(dow, 7)), "dow_cos": F.cos(turn(dow, 7))}
    if hours:
        h = F.hour(t) + F.minute(t) / 60.0
        parts |= {"hour": F.hour(t), "hour_sin": F.sin(turn(h, 24)), "hour_cos": F.cos(turn(h, 24))}
    return {f"{c}__{k}": v for k, v in parts.items()}


def near_duplicate_columns(df: DataFrame, columns: list[str], least: float = 0.999) -> list[str]:
    """Later columns that correlate with a kept earlier one."""
    if len(columns) < 2:
        return []
    high = {(r["first"], r["second"]) for r in correlate.correlations(df, columns).where(F.abs("corr") >= least).collect()}
    dropped: list[str] = []
    for i, b in enumerate(columns):
        if any((a, b) in high for a in columns[:i] if a not in dropped):
            dropped.append(b)
    return dropped


def feature_budget(rows: int, explicit: int | None = None) -> int:
    return max(8, explicit) if explicit else int(max(128, min(2048, 48 * rows ** 0.5)))


def prepare(df: DataFrame, schema: dict[str, str], policy: str = "strict") -> DataFrame:
    """Column order and types of ``schema``: strict raises on any difference, coerce fills nulls and drops the rest."""
    absent, extra = [c for c in schema if c not in df.columns], [c for c in df.columns if c not in schema]
    if policy == "strict" and (absent or extra):
        raise DataError(f"missing columns {absent}, unexpected columns {extra}")
    cast = {c: (F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)) for c, t in schema.items()}
    if policy == "strict":
        bad = df.agg(*[F.sum(F.when(F.col(c).isNotNull() & cast[c].isNull(), 1).otherwise(0)).alias(c) for c in schema]).first()
        if wrong := [c for c in schema if bad[c]]:
            raise DataError(f"values of other types in {wrong}")
    return df.select(*[x.alias(c) for c, x in cast.items()])


@dataclass
class Cleaner:
    """Fits on training rows, replays on any rows; its state is JSON.

    In turn: columns that go, date parts, missing indicators, winsorizing,
    imputation (median, mean, constant, knn, iterative), rare categories,
    encoding, distribution, scaling, near-duplicate columns, feature budget.
    Without knn and iterative the replay is one projection.
    """

    winsor: float = 0.01
    fill: str = "median"
    scaling: str = "none"
    distribution: str = "none"
    drop: list = field(default_factory=list)
    key: str = ""
    budget: int | None = None
    schema: dict = field(default_factory=dict)
    state: dict = field(default_factory=dict)

    @property
    def points(self) -> list[float]:
        """The quantiles that a fit needs of each numeric feature."""
        return [self.winsor, 0.5, 1 - self.winsor] if self.winsor else [0.5]

    def fit(self, df: DataFrame, features: list[str], target: str | None = None, known: dict[str, dict[float, float]] | None = None) -> Cleaner:
        """``known`` has the quantiles of columns, by point, if the caller has them."""
        kinds = dict(df.dtypes)
        features = [c for c in features if c not in self.drop]
        self.schema = {c: kinds[c] for c in features}
        numeric = [c for c in numeric_columns(df) if c in features]
        dates = [c for c in features if kinds[c] in ("timestamp", "timestamp_ntz", "date")]
        other = [c for c in features if c not in numeric and c not in dates]
        # Everything that one pass can tell: gaps of numbers, and hours of dates.
        hours = {c: F.max(F.coalesce((F.hour(F.col(c).cast("timestamp")) + F.minute(F.col(c).cast("timestamp")) > 0).cast("int"), F.lit(0))) for c in dates}
        facts = df.agg(F.count("*").alias("__n"), *[F.max(gone(df, c).cast("int")).alias(f"g{i}") for i, c in enumerate(numeric)], *[x.alias(f"h{i}") for i, x in enumerate(hours.values())]).first()
        self.state = {"numeric": numeric, "dates": {c: bool(facts[f"h{i}"]) for i, c in enumerate(dates)}, "missing": [c for i, c in enumerate(numeric) if facts[f"g{i}"]],
                      "values": {c: sorted({*v, RARE}) for c, v in kept_categories(df, other).items()}, "limits": {}, "fills": {}, "impute": None, "plan": {"log1p": {}, "yeo_johnson": {}}, "scales": {}, "dropped": []}
        s = self.state
        if numeric:
            simple = self.fill in ("median", "mean", "constant")
            points = self.points
            found = exact_quantiles(df, {c: finite(c) for c in numeric}, points) if known is None else {c: [known[c][p] for p in points] if known[c] else None for c in numeric}
            for c in numeric:
                q = found[c]
                if q and self.winsor and q[0] < q[2]:
                    s["limits"][c] = (q[0], q[2])
                inside = lambda x, c=c: x if x is None or c not in s["limits"] else max(s["limits"][c][0], min(s["limits"][c][1], x))
                middle = inside(q[len(points) // 2]) if q else None  # clipping keeps the order, so the clipped median is the median clipped
                s["fills"][c] = {"median": middle, "mean": 0.0, "constant": 0.0}[self.fill if simple else "median"] or 0.0
            if self.fill == "mean":
                s["fills"] |= {c: v for c, v in fills(df.withColumns({c: clip(c, s["limits"].get(c)) for c in numeric}), numeric, "mean").items()}
            if not simple:
                clipped = df.withColumns({c: clip(c, s["limits"].get(c)) for c in numeric})
                s["impute"] = knn_reference(clipped, numeric, self.key) if self.fill == "knn" else iterative_state(clipped, numeric)
            clean = self._numeric(df)
            s["plan"] = distribution_plan(clean, numeric, self.distribution)
            clean = clean.withColumns(transformed(s["plan"])) if any(s["plan"].values()) else clean
            s["scales"] = scales(clean, numeric, self.scaling) if self.scaling != "none" else {}
            s["dropped"] = near_duplicate_columns(clean, numeric)
        most = feature_budget(facts["__n"], self.budget)
        if len(self.outputs) > most and target is not None:
            s["kept"] = top_features(self.transform(df, keep=[target]), self.outputs, target, most)
        return self

    def _numeric(self, df: DataFrame) -> DataFrame:
        s = self.state
        out = df.withColumns({f"{c}__missing": gone(df, c).cast("int") for c in s["missing"]}) if s["missing"] else df
        if s["impute"]:
            out = out.withColumns({c: clip(c, s["limits"].get(c)) for c in s["numeric"]})
            return (knn_impute if "path" in s["impute"] else iterative_impute)(out, s["impute"])
        return out.withColumns({c: F.coalesce(clip(c, s["limits"].get(c)), F.lit(float(s["fills"][c]))) for c in s["numeric"]}) if s["numeric"] else out

    @property
    def outputs(self) -> list[str]:
        s = self.state
        every = [c for c in s["numeric"] if c not in s["dropped"]] + [f"{c}__missing" for c in s["missing"]]
        every += [n for c, hours in s["dates"].items() for n in datetime_parts(c, hours)] + [f"{c}__code" for c in s["values"]]
        return [c for c in every if c in s["kept"]] if s.get("kept") else every

    def transform(self, df: DataFrame, keep: list[str] = (), policy: str = "strict") -> DataFrame:
        """``keep`` and the outputs.  ``strict`` refuses absent columns and values of other types, ``coerce`` makes them null; extra columns are ignored."""
        absent = [c for c in self.schema if c not in df.columns]
        if policy == "strict" and absent:
            raise DataError(f"missing columns {absent}")
        kinds = dict(df.dtypes)
        cast = {c: F.lit(None).cast(t) if c in absent else F.col(f"`{c}`").try_cast(t) for c, t in self.schema.items() if c in absent or kinds[c] != t}
        if policy == "strict" and (other := [c for c in cast if c not in absent]):
            lost = df.agg(*[F.sum((F.col(f"`{c}`").isNotNull() & cast[c].isNull()).cast("int")).alias(f"b{i}") for i, c in enumerate(other)]).first()
            if bad := [c for i, c in enumerate(other) if lost[f"b{i}"]]:
                raise DataError(f"values of other types in {bad}")
        s, out = self.state, self._numeric(df.withColumns(cast) if cast else df)
        if any(s["plan"].values()):
            out = out.withColumns(transformed(s["plan"]))
        if s["scales"]:
            out = out.withColumns({c: (F.col(c) - v[0]) / v[1] for c, v in s["scales"].items()})
        for c, hours in s["dates"].items():
            out = out.withColumns({k: F.coalesce(v.cast("double"), F.lit(-1.0)) for k, v in datetime_parts(c, hours).items()})
        for c, values in s["values"].items():
            out = out.withColumn(f"{c}__g", group_rare(c, [v for v in values if v != RARE])).withColumn(f"{c}__code", encode(f"{c}__g", values)).drop(f"{c}__g")
        return out.select(*keep, *self.outputs)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Cleaner:
        return cls(**json.loads(text))


def top_features(df: DataFrame, columns: list[str], target: str, most: int) -> list[str]:
    """The columns of greatest mutual information with the target, missing indicators first; ties in their order."""
    from .rank import mutual_information

    flags = [c for c in columns if c.endswith("__missing")]
    rest = [c for c in columns if c not in flags]
    score = {r["column_name"]: r["mi"] for r in mutual_information(df, rest, target).collect()}
    ranked = sorted(rest, key=lambda c: -round(score.get(c) or 0.0, 9))
    chosen = set((flags + ranked)[:most])
    return [c for c in columns if c in chosen]
