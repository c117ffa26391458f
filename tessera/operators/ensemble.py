"""Ensembles: candidates, out-of-fold predictions, diverse selection, voting weights, stacking, and which of them is kept.

Candidates predict every row out of fold, as columns of one table, so no
predictions are joined; all choices read aggregates of that table.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from .decide import MCC_GRID, best_threshold, scores
from .profile import correlations
from .tuning import FAMILIES, Deadline, default_params

#: Members, correlation and gain limits, weight draws, and how much better each part of a selection vector must be.
MEMBERS, CORRELATED, GAIN, DRAWS, CONCENTRATION, TOLERANCES = 5, 0.98, 0.001, 96, 0.75, (0.005, 0.003, 0.003, 1e-6)
CANDIDATES = 12
CLEAR_WINNER, WEIGHT_FLOOR = 0.01, 0.2


@dataclass
class Candidate:
    name: str
    family: str
    columns: list[str]
    params: dict = field(default_factory=dict)


def candidate_pool(columns: list[str], groups: dict[str, list[str]] | None = None, fusion: str = "auto", families: tuple[str, ...] = FAMILIES, most: int = CANDIDATES) -> list[Candidate]:
    """Each family on all columns (anchors), specialists on each group of columns, then variants of the anchors, ``most`` in all."""
    groups = {g: [c for c in cols if c in columns] for g, cols in (groups or {}).items()}
    groups = usable_groups(groups, columns)
    how = fusion_strategy(fusion, groups)
    pool = [Candidate(f, f, columns, default_params(f)) for f in families] if how != "late" or not groups else []
    if how in ("late", "hybrid"):
        pool += [Candidate(f"{families[0]}:{g}", families[0], cols, default_params(families[0])) for g, cols in sorted(groups.items())]
    variants = {"gbt": ({"depth": 3, "step": 0.15}, {"depth": 7, "step": 0.05}, {"subsample": 0.8}), "forest": ({"depth": 5}, {"depth": 10, "min_rows": 2}), "linear": ({"ridge": 0.1}, {"ridge": 0.001, "elastic": 0.5})}
    for i in range(3):
        for f in families:
            if how != "late" and i < len(variants[f]):
                pool.append(Candidate(f"{f}~{i + 1}", f, columns, default_params(f) | variants[f][i]))
    return pool[:most]


def fusion_strategy(asked: str, groups: dict) -> str:
    """early: one model of all columns; late: a specialist a group; hybrid: both; auto: hybrid where there are two groups."""
    if asked not in ("auto", "early", "late", "hybrid"):
        raise ConfigError("fusion is auto, early, late or hybrid")
    if len(groups) < 2:
        return "early"
    return "hybrid" if asked == "auto" else asked


def usable_groups(groups: dict[str, list[str]], columns: list[str]) -> dict[str, list[str]]:
    """Groups of two columns at least that aren't all columns."""
    return {g: c for g, c in groups.items() if 2 <= len(c) < len(columns)}


def estimator(c: Candidate, task: str, classes: int, trees: int, seed: int = 42):
    from .learn import estimator as make

    return make(task, c.family, classes, trees, seed, c.params)


def _predicted(scored: DataFrame, name: str, task: str) -> DataFrame:
    value = (F.col("prediction") if task == "regression" else F.element_at(vector_to_array("probability"), 2) if task == "binary" else vector_to_array("probability"))
    return scored.withColumn(name, value).drop("prediction", "probability", "rawPrediction", f"__{name}")


def predict_with(models: dict, pool: list[Candidate], df: DataFrame, task: str) -> DataFrame:
    """``df`` with a column ``p_<i>`` for each candidate's model."""
    for i, c in enumerate(pool):
        if i in models:
            rows = VectorAssembler(inputCols=c.columns, outputCol=f"__p_{i}", handleInvalid="keep").transform(df)
            df = _predicted(models[i].transform(rows), f"p_{i}", task)
    return df


def fit_members(pool: list[Candidate], df: DataFrame, task: str, classes: int, trees: int, seed: int = 42) -> dict:
    out = {}
    for i, c in enumerate(pool):
        rows = VectorAssembler(inputCols=c.columns, outputCol=f"__p_{i}", handleInvalid="keep").transform(df).select(f"__p_{i}", "label")
        out[i] = estimator(c, task, classes, trees, seed).setFeaturesCol(f"__p_{i}").fit(rows)
    return out


def out_of_fold(pool: list[Candidate], df: DataFrame, task: str, classes: int, trees: int, deadline: Deadline | None = None, seed: int = 42) -> DataFrame:
    """``df`` (with label and fold) where each candidate has predicted every row by a model that hasn't seen its fold; fold -1 only trains."""
    out = None
    for k in sorted(r[0] for r in df.select("fold").distinct().collect() if r[0] >= 0):
        if deadline and deadline.over() and out is not None:
            break
        part = predict_with(fit_members(pool, df.where(F.col("fold") != k), task, classes, trees, seed), pool, df.where(F.col("fold") == k), task)
        out = part if out is None else out.unionByName(part)
    return out


# ---- what is better

def _quality(task: str, p: Column, y: Column) -> dict[str, Column]:
    """Sums over rows from which ``_vector`` is made."""
    one = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    if task == "regression":
        return {"n": F.count(p).cast("double"), "abs": F.sum(F.abs(y - p)), "sq": F.sum((y - p) * (y - p)), "y": F.sum(y), "yy": F.sum(y * y)}
    if task == "binary":
        q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
        return {"tp": one((p >= 0.5) & (y == 1)), "fp": one((p >= 0.5) & (y != 1)), "fn": one((p < 0.5) & (y == 1)), "tn": one((p < 0.5) & (y != 1)),
                "loss": F.avg(-F.when(y == 1, F.log(q)).otherwise(F.log(1 - q)))}
    said = F.array_position(p, F.array_max(p)) - 1
    return {"right": F.avg(F.when(said == y, 1.0).otherwise(0.0)), "loss": F.avg(-F.log(F.greatest(F.lit(1e-15), F.get(p, y.cast("int")))))}


def _vector(task: str, r: dict) -> tuple[float, ...]:
    """What candidates are compared by, in order of weight; more is better: (MCC, F1, recall, -log loss), (accuracy, -log loss) or (-RMSE, -MAE, R2)."""
    if task == "regression":
        n = max(r["n"], 1.0)
        total = r["yy"] - r["y"] ** 2 / n
        return -((r["sq"] / n) ** 0.5), -r["abs"] / n, 1 - r["sq"] / total if total > 0 else 0.0
    if task == "binary":
        s = scores(r["tp"], r["fp"], r["fn"], r["tn"])
        return s["mcc"], s["f1"], s["recall"], -r["loss"]
    return r["right"], -r["loss"]


def compare(a: tuple, b: tuple, task: str = "binary") -> int:
    """1 if ``a`` is better, -1 if ``b`` is, 0 if no part differs by its tolerance (of the value, for errors)."""
    for x, y, t in zip(a, b, TOLERANCES, strict=False):
        t = t * max(abs(x), abs(y), 1e-12) if task == "regression" else t
        if abs(x - y) > t:
            return 1 if x > y else -1
    return 0


def vectors(df: DataFrame, columns: list[str], task: str) -> list[tuple]:
    """The selection vector of each column of predictions, in one pass."""
    y = F.col("label")
    made = [_quality(task, F.col(c), y) for c in columns]
    row = df.agg(*[v.alias(f"{i}_{k}") for i, m in enumerate(made) for k, v in m.items()]).first()
    return [_vector(task, {k: row[f"{i}_{k}"] or 0.0 for k in m}) for i, m in enumerate(made)]


def _blended(columns: list[str], weights: list[Column]) -> Column:
    """The weighted sum of arrays of probabilities."""
    def scaled(c: str, w: Column) -> Column:
        return F.transform(c, lambda x: x * w)

    out = scaled(columns[0], weights[0])
    for c, w in zip(columns[1:], weights[1:], strict=True):
        out = F.zip_with(out, scaled(c, w), lambda a, b: a + b)
    return out


def blend(columns: list[str], weights: list[float], task: str) -> Column:
    """The weighted mean of predictions; of arrays of probabilities, of each class."""
    total = sum(weights) or 1.0
    if task != "multiclass":
        return sum((F.col(c) * float(w / total) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))
    return _blended(columns, [F.lit(float(w / total)) for w in weights])


def select_diverse(oof: DataFrame, columns: list[str], task: str, most: int = MEMBERS, correlated: float = CORRELATED, gain: float = GAIN) -> list[str]:
    """Greedy: the best candidate, then whatever improves the equal blend by ``gain`` and isn't too like a member."""
    each = dict(zip(columns, vectors(oof, columns, task), strict=True))
    rank = sorted(columns, key=lambda c: each[c], reverse=True)
    flat = oof
    if task == "multiclass":  # likeness of the probability of the true class
        flat = oof.withColumns({c: F.get(c, F.col("label").cast("int")) for c in columns})
    like = {}
    if len(columns) > 1:
        like = {frozenset((r["first"], r["second"])): abs(r["corr"]) if r["corr"] is not None else 1.0 for r in correlations(flat, columns).collect()}
    chosen, best = [rank[0]], each[rank[0]]
    while len(chosen) < most:
        rest = [c for c in rank if c not in chosen and all(like.get(frozenset((c, m)), 0.0) < correlated for m in chosen)]
        if not rest:
            break
        tried = vectors(oof.withColumns({f"__t{i}": blend([*chosen, c], [1.0] * (len(chosen) + 1), task) for i, c in enumerate(rest)}), [f"__t{i}" for i in range(len(rest))], task)
        top = max(range(len(rest)), key=lambda i: tried[i])
        if tried[top][0] - best[0] < gain * max(1.0, abs(best[0]) if task == "regression" else 1.0):
            break
        chosen, best = [*chosen, rest[top]], tried[top]
    return chosen


def weight_candidates(n: int, draws: int = DRAWS, seed: int = 42) -> list[list[float]]:
    """Equal weights, each member alone, and Dirichlet draws."""
    rng = random.Random(seed)
    out = [[1.0 / n] * n] + [[float(i == j) for j in range(n)] for i in range(n)]
    for _ in range(draws if n > 1 else 0):
        g = [rng.gammavariate(CONCENTRATION, 1.0) for _ in range(n)]
        out.append([x / sum(g) for x in g])
    return out


def weight_vectors(oof: DataFrame, columns: list[str], task: str, tried: list[list[float]]) -> list[tuple]:
    """The selection vector of each blend: every row meets all weights in one grouped pass."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(x) for x in w]).alias("w")) for i, w in enumerate(tried)])
    weights = [F.get("r.w", F.lit(j)) for j in range(len(columns))]
    p = _blended(columns, weights) if task == "multiclass" else sum((F.col(c) * w for c, w in zip(columns, weights, strict=True)), F.lit(0.0))
    rows = oof.select("label", *columns, F.explode(each).alias("r")).select("label", F.col("r.i").alias("i"), p.alias("p"))
    made = _quality(task, F.col("p"), F.col("label"))
    found = {r["i"]: _vector(task, {k: r[k] or 0.0 for k in made}) for r in rows.groupBy("i").agg(*[v.alias(k) for k, v in made.items()]).collect()}
    return [found[i] for i in range(len(tried))]


def voting_weights(oof: DataFrame, columns: list[str], task: str, seed: int = 42) -> tuple[list[float], tuple]:
    """The best weights by the selection vector: the first that no other beats by more than the tolerances."""
    tried = weight_candidates(len(columns), seed=seed)
    made = weight_vectors(oof, columns, task, tried)
    best = 0
    for i in range(1, len(tried)):
        if compare(made[i], made[best], task) > 0:
            best = i
    return tried[best], made[best]


def score_weights(values: list[float], floor: float = WEIGHT_FLOOR) -> list[float]:
    """Weights in proportion to scores, each at least ``floor`` of an equal share."""
    total = sum(max(v, 0.0) for v in values) or 1.0
    raised = [max(max(v, 0.0) / total, floor / len(values)) for v in values]
    return [w / sum(raised) for w in raised]


def clear_winner(values: list[float], least: float = CLEAR_WINNER) -> int | None:
    """The member whose score is ahead of the second by ``least`` of it, which needs no ensemble."""
    order = sorted(range(len(values)), key=lambda i: -values[i])
    if len(values) == 1 or values[order[0]] - values[order[1]] >= least * max(abs(values[order[1]]), 1e-12):
        return order[0]
    return None


def _meta(df: DataFrame, columns: list[str], task: str) -> DataFrame:
    flat = F.array(*columns) if task != "multiclass" else F.flatten(F.array(*columns))
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("__meta", array_to_vector(flat))


def fit_stack(oof: DataFrame, columns: list[str], task: str):
    """A linear meta learner on out-of-fold predictions: the positive's, or all classes' probabilities."""
    make = LinearRegression(regParam=0.01) if task == "regression" else LogisticRegression(regParam=0.01)
    return make.setFeaturesCol("__meta").setLabelCol("label").fit(_meta(oof, columns, task).select("__meta", "label"))


def apply_stack(model, df: DataFrame, columns: list[str], task: str, name: str) -> DataFrame:
    scored = model.transform(_meta(df, columns, task))
    return _predicted(scored, name, task).drop("__meta")


@dataclass
class Ensemble:
    """What was chosen, its members fitted on all rows, and how to predict with it."""

    strategy: str
    task: str
    pool: list[Candidate]
    members: list[int]
    weights: list[float]
    models: dict
    stack: object | None = None
    threshold: float = 0.5
    scores: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with the prediction: a number, the positive's probability, or all classes' probabilities."""
        columns = [f"p_{i}" for i in self.members]
        out = predict_with(self.models, self.pool, df, self.task)
        if self.strategy == "stacking":
            return apply_stack(self.stack, out, columns, self.task, name).drop(*columns)
        return out.withColumn(name, blend(columns, self.weights, self.task)).drop(*columns)


def train(df: DataFrame, columns: list[str], task: str, key: str, classes: int = 2, strategy: str = "auto", groups: dict | None = None, fusion: str = "auto",
          trees: int = 20, families: tuple[str, ...] = FAMILIES, deadline: Deadline | None = None, seed: int = 42, candidates: int = CANDIDATES) -> Ensemble:
    """Single, voting or stacking, whichever the rows that chose nothing show to be materially better, refitted on all rows.

    ``df`` has ``columns``, label and fold.
    """
    from .split import meta_split

    if strategy not in ("auto", "single", "voting", "stacking"):
        raise ConfigError("strategy is auto, single, voting or stacking")
    pool = candidate_pool(columns, groups, fusion, families, candidates)
    df = df.persist()  # folds are dealt once; every candidate of every fold reads these rows
    oof = out_of_fold(pool, df, task, classes, trees, deadline, seed).persist()
    parts = meta_split(oof, key, seed=seed)
    fit, judge = parts.where(~F.col("is_select")), parts.where("is_select")
    chosen = select_diverse(fit, [f"p_{i}" for i in range(len(pool))], task)
    weights, _ = voting_weights(fit, chosen, task, seed)
    stack = fit_stack(fit, chosen, task) if len(chosen) > 1 and strategy in ("auto", "stacking") else None
    tried = judge.withColumns({"__voting": blend(chosen, weights, task)})
    names = {"single": chosen[0], "voting": "__voting"}
    if stack is not None:
        tried, names = apply_stack(stack, tried, chosen, task, "__stacking"), names | {"stacking": "__stacking"}
    found = dict(zip(names, vectors(tried, list(names.values()), task), strict=True))
    best = "single"
    for other in names:
        if compare(found[other], found[best], task) > 0:
            best = other
    if strategy != "auto" and strategy in names:
        best = strategy
    members = [int(c[2:]) for c in (chosen[:1] if best == "single" else chosen)]
    weights = [1.0] if best == "single" else weights
    threshold = best_threshold(tried, "label", names[best], "mcc", MCC_GRID) if task == "binary" else 0.5
    used = {i: c for i, c in enumerate(pool) if i in members}
    models = {}
    for i, c in used.items():
        models[i] = fit_members([c], df, task, classes, trees, seed)[0].setFeaturesCol(f"__p_{i}")
    oof.unpersist()
    df.unpersist()
    return Ensemble(best, task, pool, members, weights, models, stack if best == "stacking" else None, threshold, found)
