"""Thresholds, conformal sets, out-of-distribution scores and drift."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.columns import exact_quantiles, finite, prefix_sums
from .metrics import curve

MISSING = "__missing__"


GRID = [i / 100 for i in range(1, 100)]
MCC_GRID = [0.05 + 0.025 * i for i in range(37)]  # of an ensemble's own threshold
REJECT_GRID = [i / 100 for i in range(100)]
OBJECTIVES = ("f1", "precision", "recall", "accuracy", "balanced_accuracy", "mcc")
COVERAGE = 0.01  # share of rows that a threshold of a ladder accepts at least


def grid_cell(p: Column, grid: list[float]) -> Column:
    """How many points of an even, ascending grid lie at or below ``p``: a guess, put right by comparison with the points beside it."""
    step = (grid[-1] - grid[0]) / max(1, len(grid) - 1) or 1.0
    points = F.array(*[F.lit(float(g)) for g in grid])
    guess = F.greatest(F.lit(0), F.least(F.lit(len(grid)), F.floor((p - grid[0]) / step) + 1)).cast("int")
    down = F.when((guess > 0) & (p < F.get(points, guess - 1)), guess - 1).otherwise(guess)
    return F.when((down < len(grid)) & (p >= F.get(points, down)), down + 1).otherwise(down)


def _sweep(rows, grid: list[float]) -> list[dict]:
    """True positives and positives said at each point of a grid, from rows (cell, pos, n)."""
    pos, n = [0.0] * (len(grid) + 1), [0.0] * (len(grid) + 1)
    for cell, x, many in rows:
        pos[cell], n[cell] = pos[cell] + x, n[cell] + many
    total, every = sum(pos), sum(n)
    out, tp, said = [], 0.0, 0.0
    for i in range(len(grid), 0, -1):
        tp, said = tp + pos[i], said + n[i]
        out.append({"threshold": float(grid[i - 1]), **scores(tp, said - tp, total - tp, every - total - said + tp)})
    return out[::-1]


def scores(tp: float, fp: float, fn: float, tn: float) -> dict[str, float]:
    """The scores of a binary decision from its four counts; 0 where there is nothing to divide by."""
    div = lambda a, b: a / b if b else 0.0
    return {"f1": div(2 * tp, 2 * tp + fp + fn), "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "accuracy": div(tp + tn, tp + fp + fn + tn),
            "balanced_accuracy": (div(tp, tp + fn) + div(tn, tn + fp)) / 2, "mcc": div(tp * tn - fp * fn, math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))}


def _cells(df: DataFrame, y: str, p: str, grid: list[float]) -> list[tuple]:
    """(cell, positives, rows) of each cell of a grid."""
    counts = df.groupBy(grid_cell(F.col(p), grid).alias("cell")).agg(F.sum(F.when(F.col(y) == 1, 1.0).otherwise(0.0)).alias("pos"), F.count("*").alias("n"))
    return [tuple(r) for r in counts.collect()]


def threshold_sweep(df: DataFrame, y: str, p: str, grid: list[float] | None = None) -> DataFrame:
    """Scores of every threshold from one pass: only the counts of the grid's cells are gathered."""
    rows = _sweep(_cells(df, y, p, grid or GRID), grid or GRID)
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} double" for k in rows[0]))


def _best(rows: list[dict], objective: str, half: float) -> float:
    """The lowest threshold of strictly greater score than 0.5."""
    best, at = half, 0.5
    for r in rows:
        if r[objective] > best:
            best, at = r[objective], r["threshold"]
    return at


def best_threshold(df: DataFrame, y: str, p: str, objective: str = "f1", grid: list[float] | None = None) -> float:
    """The threshold of the greatest score; 0.5 at ties, without both classes, and for ROC-AUC, which has none."""
    if objective != "roc_auc" and objective not in OBJECTIVES:
        raise ConfigError(f"objective is one of {(*OBJECTIVES, 'roc_auc')}")
    grid = grid or GRID
    counts = _cells(df, y, p, grid) if objective != "roc_auc" else []
    if not 0 < sum(x[1] for x in counts) < sum(x[2] for x in counts):
        return 0.5
    rows = _sweep(counts, grid)
    return _best(rows, objective, next((r[objective] for r in rows if abs(r["threshold"] - 0.5) < 1e-9), -2.0))


def per_label_thresholds(df: DataFrame, labels: list[tuple[str, str]], objective: str = "mcc") -> dict[str, float]:
    """The best threshold of each label, all from one pass over the rows."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), grid_cell(F.col(p), GRID).alias("cell"), F.when(F.col(y) == 1, 1.0).otherwise(0.0).alias("pos")) for i, (y, p) in enumerate(labels)])).alias("r"))
    counts = rows.select("r.*").groupBy("i", "cell").agg(F.sum("pos").alias("pos"), F.count("*").alias("n")).collect()
    out = {}
    for i, (y, _) in enumerate(labels):
        own = [(r["cell"], r["pos"], r["n"]) for r in counts if r["i"] == i]
        positives, every = sum(x[1] for x in own), sum(x[2] for x in own)
        swept = _sweep(own, GRID)
        out[y] = _best(swept, objective, swept[49][objective]) if 0 < positives < every else 0.5
    return out


def _reject_counts(df: DataFrame, y: str, p: str, grid: list[float]) -> list[tuple]:
    """(cell of the top probability, true class, said class, rows) of class numbers and arrays of probabilities."""
    top = F.array_max(p)
    said = F.array_position(p, top) - 1
    return [tuple(r) for r in df.groupBy(grid_cell(top, grid).alias("cell"), F.col(y).cast("int").alias("y"), said.cast("int").alias("said")).agg(F.count("*").alias("n")).collect()]


def reject_sweep(df: DataFrame, y: str, p: str, grid: list[float] | None = None) -> DataFrame:
    """Scores of every cut-off of the top probability; a rejected row is wrong and belongs to no class."""
    grid = grid or REJECT_GRID
    counts = _reject_counts(df, y, p, grid)
    total = sum(x[3] for x in counts) or 1
    classes = sorted({x[1] for x in counts})
    out = []
    for i, t in enumerate(grid, 1):
        taken = [x for x in counts if x[0] >= i]
        hit = {k: sum(n for _, a, s, n in taken if a == s == k) for k in classes}
        said = {k: sum(n for _, _, s, n in taken if s == k) for k in classes}
        true = {k: sum(n for _, a, _, n in counts if a == k) for k in classes}
        many, right = sum(x[3] for x in taken), sum(hit.values())
        div = lambda a, b: a / b if b else 0.0
        mean = lambda f: sum(f(k) for k in classes) / max(1, len(classes))
        out.append((float(t), many / total, div(right, many), right / total, mean(lambda k, h=hit, s=said, a=true: div(2 * h[k], s[k] + a[k])), mean(lambda k, h=hit, a=true: div(h[k], a[k])), many))
    return df.sparkSession.createDataFrame(out, "threshold double, coverage double, accuracy_on_accepted double, accuracy double, f1 double, balanced_accuracy double, n_accepted long")


def best_reject_threshold(df: DataFrame, y: str, p: str, objective: str = "accuracy") -> float:
    """The lowest cut-off of the greatest score; 0 accepts every row."""
    rows = reject_sweep(df, y, p).orderBy("threshold").collect()
    best = max((r[objective] for r in rows), default=0.0)
    return next((r["threshold"] for r in rows if r[objective] == best), 0.0)


def _spread(chosen: list[float], n: int, top: float = 1.0) -> list[float]:
    """``n`` ascending thresholds: the widest gap is halved until there are enough."""
    chosen = sorted(set(chosen))
    while len(chosen) < n:
        if len(chosen) == 1:
            chosen.append(min(top, chosen[-1] + 0.01))
            if chosen[0] == chosen[1]:
                chosen[0] -= 0.01
            continue
        k = max(range(len(chosen) - 1), key=lambda i: chosen[i + 1] - chosen[i])
        chosen.insert(k + 1, (chosen[k] + chosen[k + 1]) / 2)
    return chosen[:n]


def ladder_points(df: DataFrame, y: str, p: str, n: int = 4) -> list[float]:
    """``n`` thresholds at evenly spaced recalls of the precision-recall curve, from lenient to strict.

    Only scores in [0.01, 0.99] that accept a hundredth of the rows count, as
    long as there are two of them; the curve stays distributed.
    """
    if n < 2:
        raise ConfigError("a ladder has two thresholds at least")
    points = curve(df, y, p).withColumn("said", F.col("tp") + F.col("fp"))
    total = points.agg(F.max("tp").alias("P"), F.max("said").alias("N")).first()
    if not total["P"] or total["P"] == total["N"]:
        return [0.5] * n
    inside = F.col("score").between(GRID[0], GRID[-1])
    for kept in (points.where(inside & (F.col("said") >= COVERAGE * total["N"])), points.where(inside), points):
        ends = kept.agg(F.min("tp").alias("a"), F.max("tp").alias("b"), F.count("*").alias("n")).first()
        if ends["n"] >= 2:
            break
    aims = [ends["b"] + (ends["a"] - ends["b"]) * i / (n - 1) for i in range(n)]
    row = kept.agg(*[F.min_by("score", F.struct(F.abs(F.col("tp") - a), F.col("score"))).alias(f"a{i}") for i, a in enumerate(aims)]).first()
    return _spread(list(row), n)


def threshold_ladder(df: DataFrame, y: str, p: str, n: int = 4) -> DataFrame:
    """The thresholds of ``ladder_points`` and what each achieves."""
    points = ladder_points(df, y, p, n)
    hit = lambda t, a: F.sum(F.when((F.col(p) >= t) & (F.col(y) == a), 1.0).otherwise(0.0))
    row = df.agg(F.count("*").cast("double").alias("N"), F.sum(F.when(F.col(y) == 1, 1.0).otherwise(0.0)).alias("P"),
                 *[hit(t, a).alias(f"h{i}_{a}") for i, t in enumerate(points) for a in (0, 1)]).first()
    out = []
    for i, t in enumerate(points):
        tp, fp = row[f"h{i}_1"] or 0.0, row[f"h{i}_0"] or 0.0
        s = scores(tp, fp, row["P"] - tp, row["N"] - row["P"] - fp)
        out.append((float(t), s["precision"], s["recall"], s["f1"], s["accuracy"], (tp + fp) / row["N"] if row["N"] else 0.0))
    return df.sparkSession.createDataFrame(out, "threshold double, precision double, recall double, f1 double, accuracy double, positive_rate double")


def reject_ladder(df: DataFrame, y: str, p: str, n: int = 4) -> list[dict]:
    """``n`` cut-offs of the top probability at evenly spaced coverages, from lenient to strict."""
    if n < 2:
        raise ConfigError("a ladder has two thresholds at least")
    rows = [r.asDict() for r in reject_sweep(df, y, p).orderBy("threshold").collect()]
    kept = [r for r in rows if r["coverage"] >= COVERAGE]
    kept = kept if len(kept) >= 2 else rows
    top, low = max(r["coverage"] for r in kept), min(r["coverage"] for r in kept)
    aims = [top + (low - top) * i / (n - 1) for i in range(n)]
    chosen = _spread([min(kept, key=lambda r, a=a: (abs(r["coverage"] - a), r["threshold"]))["threshold"] for a in aims], n)
    return [min(rows, key=lambda r, t=t: abs(r["threshold"] - t)) | {"threshold": t} for t in chosen]


def ladder_confidence(p: Column, ladder: list[float]) -> Column:
    """The share of a ladder's thresholds that a probability passes."""
    return sum((F.when(p >= t, 1.0).otherwise(0.0) for t in ladder), F.lit(0.0)) / float(len(ladder))


def apply_threshold(p: str, threshold: float) -> Column:
    return (F.col(p) >= threshold).cast("int")


def conformal_rank(n: int, alpha: float) -> int:
    """The 1-based order statistic of the finite-sample quantile."""
    q = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)
    return math.ceil(q * (n - 1)) + 1


def conformal_quantile(df: DataFrame, residual: Column, alpha: float = 0.1) -> float | None:
    """The exact order statistic: cumulative counts of distinct residuals, in ranges."""
    counts = df.select(residual.alias("r")).where("r IS NOT NULL").groupBy("r").agg(F.count("*").cast("double").alias("n"))
    n = counts.agg(F.sum("n")).first()[0]
    if not n:
        return None
    rank = conformal_rank(int(n), alpha)
    return prefix_sums(counts, "r", ["n"]).where(F.col("n_before") + F.col("n") >= rank).agg(F.min("r")).first()[0]


def nonconformity(y: str, p: str) -> Column:
    """1 - the probability of the true class, from class numbers and arrays of probabilities."""
    return 1 - F.get(p, F.col(y).cast("int"))


def interval(p: str, q: float) -> dict[str, Column]:
    return {"lower": F.col(p) - q, "upper": F.col(p) + q}


def prediction_set(probabilities: Column, classes: list[str], q: float) -> Column:
    """Classes with 1 - q at least, never empty."""
    names = F.array(*[F.lit(c) for c in classes])
    pairs = F.zip_with(probabilities, names, lambda p, c: F.struct(p.alias("p"), c.alias("c")))
    chosen = F.transform(F.filter(pairs, lambda x: x["p"] >= 1 - q), lambda x: x["c"])
    best = F.element_at(names, F.array_position(probabilities, F.array_max(probabilities)).cast("int"))
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.array(best))


def multilabel_sets(p: str, q: float) -> dict[str, Column]:
    """Whether a label may be there, and whether it may be absent; both where it is open."""
    return {"positive_possible": F.col(p) >= 1 - q, "negative_possible": (1 - F.col(p)) >= 1 - q}


def interval_coverage(df: DataFrame, y: str, p: str, q: float) -> DataFrame:
    """The share of true values inside prediction intervals, and the intervals' width."""
    return df.agg(F.avg(F.when(F.col(y).between(F.col(p) - q, F.col(p) + q), 1.0).otherwise(0.0)).alias("coverage"), (F.avg(F.col(p) + q - (F.col(p) - q))).alias("width"))


def set_coverage(df: DataFrame, y: str, p: str, q: float) -> DataFrame:
    """The share of true classes inside prediction sets, and the sets' mean size, from class numbers and arrays of probabilities."""
    inside = F.size(F.filter(p, lambda x: x >= 1 - q))
    hit = (F.get(p, F.col(y).cast("int")) >= 1 - q) | ((inside == 0) & (F.array_position(p, F.array_max(p)) - 1 == F.col(y)))
    return df.agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.greatest(inside, F.lit(1)).cast("double")).alias("set_size"))


def label_coverage(df: DataFrame, labels: list[tuple[str, str]], quantiles_: list[float]) -> DataFrame:
    """The share of true labels that are possible, and of labels that are open, over all labels (label, probability)."""
    covered, open_ = [], []
    for (y, p), q in zip(labels, quantiles_, strict=True):
        sets = multilabel_sets(p, q)
        covered.append(F.when(F.when(F.col(y) == 1, sets["positive_possible"]).otherwise(sets["negative_possible"]), 1.0).otherwise(0.0))
        open_.append(F.when(sets["positive_possible"] & sets["negative_possible"], 1.0).otherwise(0.0))
    mean = lambda xs: F.avg(sum(xs, F.lit(0.0)) / len(labels))
    return df.agg(mean(covered).alias("label_coverage"), mean(open_).alias("ambiguous_rate"))


OOD_POINTS = [0.005, 0.25, 0.5, 0.75, 0.995]


def drift_points(bins: int = 10) -> list[float]:
    return [*[i / bins for i in range(1, bins)], 0.25, 0.75, 0.5]


def _at(df: DataFrame, columns: list[str], points: list[float], known: dict[str, dict[float, float]] | None) -> dict[str, list[float] | None]:
    """The quantiles of each column, from ``known`` where the caller has them."""
    if known is None:
        return exact_quantiles(df, {c: finite(c) for c in columns}, points)
    return {c: [known[c][p] for p in points] if known[c] else None for c in columns}


def ood_reference(df: DataFrame, columns: list[str], known: dict | None = None) -> dict[str, tuple]:
    """(median, inter-quartile range, low, high) of each column that holds a number."""
    found = _at(df, columns, OOD_POINTS, known)
    return {c: (q[2], (q[3] - q[1]) if q[3] - q[1] > 1e-7 else 1.0, q[0], q[4]) for c, q in found.items() if q}


def ood_score(reference: dict[str, tuple], codes: dict[str, list[str]] | None = None) -> Column:
    """0 to 1: far from the median, outside the range, or missing.  ``codes`` names categorical columns, whose values stand for their places in the list."""
    if not reference:
        return F.lit(0.0)
    n = float(len(reference))
    far = out = bad = F.lit(0.0)
    for c, (mid, iqr, low, high) in reference.items():
        x = category_code(c, codes[c]) if codes and c in codes else finite(c)
        z = F.abs(x - mid) / iqr
        far = far + F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (z - 2) / 8)), F.lit(0.0))
        out = out + F.when((x < low) | (x > high), 1.0).otherwise(0.0)
        bad = bad + F.when(x.isNull(), 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.55 * far / n + 0.30 * out / n + 0.15 * bad / n))


def category_code(c: str, values: list[str]) -> Column:
    """The place of a category among ``values`` as a number; unseen and null are missing."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]).cast("array<string>"), F.col(c).cast("string"))
    return F.when(F.coalesce(place, F.lit(0)) > 0, (place - 1).cast("double"))


def ood_threshold(df: DataFrame, reference: dict[str, tuple], codes: dict[str, list[str]] | None = None) -> float:
    """The score from which a row counts as out of distribution: the 99.5 % quantile in training, 0.35 at least."""
    q = df.agg(F.percentile(F.round(ood_score(reference, codes), 6), 0.995)).first()[0]
    return max(0.35, q or 0.0)


def ood_metrics(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.agg(F.avg(score).alias("ood_mean"), F.percentile(F.round(score, 6), 0.95).alias("ood_p95"), F.avg(F.when(F.col(score) >= threshold, 1.0).otherwise(0.0)).alias("ood_flag_rate"))


# ---- drift

def numeric_reference(df: DataFrame, columns: list[str], bins: int = 10, known: dict | None = None) -> dict[str, dict]:
    """Bin edges, shares, median, inter-quartile range and missing rate of each column; one without numbers has one bin around 0."""
    gone = _missing_rates(df, columns)
    found = _at(df, columns, drift_points(bins), known)
    out = {}
    for c, q in found.items():
        out[c] = {"edges": sorted(set(q[: bins - 1])) if q else [], "median": q[-1] if q else 0.0, "iqr": max(1e-6, q[-2] - q[-3]) if q else 1.0, "missing": gone[c]}
    shares = bin_shares(df, out)
    for c, q in found.items():
        out[c]["p"] = shares[c] if q else [1.0]
    return out


def _missing_rates(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The share of rows without a finite number, by column."""
    row = df.agg(*[F.avg(F.when(finite(c).isNull(), 1.0).otherwise(0.0)).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"g{i}"] or 0.0 for i, c in enumerate(columns)}


def bin_shares(df: DataFrame, reference: dict[str, dict]) -> dict[str, list[float]]:
    """The share of rows in each bin of each column, in one pass."""
    cols, names = [], []
    for c, r in reference.items():
        e = [-math.inf, *r["edges"], math.inf]
        for i, (a, b) in enumerate(zip(e[:-1], e[1:], strict=True)):
            inside = F.lit(True)
            if a != -math.inf:
                inside = inside & (finite(c) >= a)
            if b != math.inf:
                inside = inside & (finite(c) < b)
            cols.append(F.sum(F.when(finite(c).isNotNull() & inside, 1).otherwise(0)).alias(f"b{len(names)}"))
            names.append((c, i))
    row = df.agg(*cols).first()
    out: dict[str, list[float]] = {c: [] for c in reference}
    for k, (c, _) in enumerate(names):
        out[c].append(float(row[f"b{k}"] or 0))
    return {c: [x / s for x in v] if (s := sum(v)) else v for c, v in out.items()}


def _smooth(p: list[float]) -> list[float]:
    p = [max(x, 1e-6) for x in p]
    return [x / sum(p) for x in p]


def psi(a: list[float], b: list[float]) -> float:
    a, b = _smooth(a), _smooth(b)
    return sum((y - x) * math.log(y / x) for x, y in zip(a, b, strict=True))


def jensen_shannon(a: list[float], b: list[float]) -> float:
    a, b = _smooth(a), _smooth(b)
    m = [(x + y) / 2 for x, y in zip(a, b, strict=True)]
    kl = lambda p: sum(x * math.log(x / y) for x, y in zip(p, m, strict=True))
    return math.sqrt(max(0.0, (kl(a) + kl(b)) / 2))


def numeric_drift(reference: dict[str, dict], current: DataFrame) -> list[dict]:
    shares = bin_shares(current, reference)
    lost, middle = _missing_rates(current, list(reference)), exact_quantiles(current, {c: finite(c) for c in reference}, [0.5])
    out = []
    for c, r in reference.items():
        empty = middle[c] is None
        value = 1.0 if empty else psi(r["p"], shares[c])
        shift = 5.0 if empty else abs(middle[c][0] - r["median"]) / r["iqr"]
        gone = abs(lost[c] - (r["missing"] or 0.0))
        out.append({"column_name": c, "psi": value, "shift": shift, "missing_shift": gone,
                    "score": min(1.0, 0.65 * min(value / 0.5, 1) + 0.20 * min(shift / 3, 1) + 0.15 * min(gone / 0.25, 1))})
    return out


def category_shares(df: DataFrame, column: str, top: int = 50) -> dict[str, float]:
    """Shares of the commonest values of all rows, missing ones under ``MISSING``; ties by value."""
    counts = df.groupBy(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(MISSING)).alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r["v"]: r["n"] / total for r in counts.orderBy(F.desc("n"), "v").limit(top).collect()}


def categorical_reference(df: DataFrame, column: str, top: int = 50) -> dict:
    gone = df.agg(F.avg(F.when(F.col(f"`{column}`").isNull(), 1.0).otherwise(0.0))).first()[0] or 0.0
    known = category_shares(df, column, top)
    return {"known": known, "other": max(0.0, 1 - sum(known.values())), "missing": gone}


def categorical_drift(reference: DataFrame | dict, current: DataFrame, column: str, top: int = 50) -> dict:
    ref = reference if isinstance(reference, dict) else categorical_reference(reference, column, top)
    value = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(MISSING))
    gone = F.sum(F.when(F.col(f"`{column}`").isNull(), 1.0).otherwise(0.0))
    counts = current.groupBy(F.when(value.isin(list(ref["known"]) or [""]), value).alias("v")).agg(F.count("*").alias("n"), gone.alias("gone")).collect()
    total = sum(r["n"] for r in counts) or 1
    now = {r["v"]: r["n"] / total for r in counts}
    js = jensen_shannon([*ref["known"].values(), ref["other"]], [*[now.get(v, 0.0) for v in ref["known"]], now.get(None, 0.0)])
    missing = abs(sum(r["gone"] for r in counts) / total - ref["missing"])
    score = min(1.0, 0.7 * min(js / 0.35, 1) + 0.2 * min(now.get(None, 0.0) / 0.25, 1) + 0.1 * min(missing / 0.25, 1))
    return {"column_name": column, "js": js, "unknown_rate": now.get(None, 0.0), "missing_shift": missing, "score": score}


def overall_drift(scores: list[float], top: int = 20) -> tuple[float, str]:
    best = sorted(scores, reverse=True)[:top]
    value = sum(best) / len(best) if best else 0.0
    return value, severity(value)


def severity(score: float) -> str:
    return "critical" if score >= 0.65 else "warning" if score >= 0.30 else "stable"
