"""Which learner, with which parameters, for how long: model choice, search spaces, search, deadline and resources."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError

#: Sizes from which the family that scales best is taken, and the signs of categorical data.
LARGE_ROWS, LARGE_CELLS, WIDE, LARGE_RANKING, CATEGORICAL_ROWS, CATEGORICAL_SHARE, MANY_CATEGORIES = 250_000, 30_000_000, 300, 75_000, 200_000, 0.08, 50
FAMILIES = ("gbt", "forest", "linear")
LEAST_GAIN = 0.001  # of the baseline's score, for a tuned model to be kept
VERY_LARGE, SMALL = 250_000, 2_000


def select_model(rows: int, features: int, categorical: int, cardinality: dict[str, int], task: str, learner: str = "auto") -> tuple[str, str]:
    """The family of learners and why: boosted trees for large, wide or numeric data, a forest where categories tell."""
    if learner != "auto":
        if learner not in FAMILIES:
            raise ConfigError(f"learner is auto or one of {FAMILIES}")
        return learner, "asked for"
    if rows >= LARGE_ROWS:
        return "gbt", f"{rows} rows"
    if rows * max(features, 1) >= LARGE_CELLS or features >= WIDE:
        return "gbt", f"{rows * features} cells, {features} features"
    if task == "ranking" and rows > LARGE_RANKING:
        return "gbt", "a large ranking"
    if rows <= CATEGORICAL_ROWS and (categorical / max(features, 1) >= CATEGORICAL_SHARE or any(n >= MANY_CATEGORIES for n in cardinality.values())):
        return "forest", f"{categorical} categorical features"
    return "gbt", "numeric data"


def default_params(family: str) -> dict:
    return {"gbt": {"depth": 5, "step": 0.1, "min_rows": 20, "subsample": 1.0}, "forest": {"depth": 8, "min_rows": 5, "subsample": 1.0}, "linear": {"ridge": 0.01, "elastic": 0.0}}[family]


#: The search space of each family: how a value is scaled, and its bounds.
SPACE = {"gbt": {"depth": ("whole", 3, 8), "step": ("log", 0.02, 0.18), "min_rows": ("whole", 10, 100), "subsample": ("plain", 0.7, 1.0)},
         "forest": {"depth": ("whole", 4, 10), "min_rows": ("whole", 2, 30), "subsample": ("plain", 0.7, 1.0)},
         "linear": {"ridge": ("log", 1e-6, 8.0), "elastic": ("plain", 0.0, 1.0)}}
FIRST, GOOD, TRIED = 5, 0.25, 24  # random trials before densities are told apart; share of trials that count as good; points drawn for each trial


def _value(u: float, kind: str, low: float, high: float):
    if kind == "log":
        return math.exp(math.log(low) + u * (math.log(high) - math.log(low)))
    return min(high, int(low + u * (high - low + 1))) if kind == "whole" else low + u * (high - low)


def _unit(v: float, kind: str, low: float, high: float) -> float:
    if kind == "log":
        return (math.log(v) - math.log(low)) / (math.log(high) - math.log(low))
    return (v - low + 0.5) / (high - low + 1) if kind == "whole" else (v - low) / (high - low)


def draw_params(family: str, rng: random.Random) -> dict:
    """One point of the family's search space; scales that span magnitudes are drawn by their logarithm."""
    return {name: _value(rng.random(), *how) for name, how in SPACE[family].items()}


def _kernels(points: list[float]) -> list[tuple[float, float]]:
    """A normal around each point, as wide as the gap to its neighbours, and a wide one that keeps every value possible."""
    points = sorted(points)
    least = 1 / min(100, 1 + len(points))
    ends = [0.0, *points, 1.0]
    return [(x, min(1.0, max(least, x - ends[i], ends[i + 2] - x))) for i, x in enumerate(points)] + [(0.5, 1.0)]


def _density(u: float, kernels: list[tuple[float, float]]) -> float:
    """The mean of the kernels, each cut to [0, 1]."""
    upto = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    return sum(math.exp(-0.5 * ((u - m) / s) ** 2) / (s * (upto((1 - m) / s) - upto(-m / s))) for m, s in kernels) / len(kernels)


def propose(family: str, done: list[tuple[dict, float]], rng: random.Random) -> dict:
    """The next point by a tree-structured Parzen estimator: of ``TRIED`` points drawn from the density of the good trials, that which is likeliest there and unlikeliest among the others.

    ``done`` are finished trials with their losses, less is better.
    """
    if len(done) < FIRST:
        return draw_params(family, rng)
    order = sorted(done, key=lambda t: t[1])
    cut = max(1, math.ceil(GOOD * len(order)))
    out = {}
    for name, how in SPACE[family].items():
        good, rest = (_kernels([_unit(p[name], *how) for p, _ in part if name in p]) for part in (order[:cut], order[cut:]))
        best = None
        for _ in range(TRIED):
            m, s = rng.choice(good)
            u = rng.gauss(m, s)
            while not 0 <= u <= 1:
                u = rng.gauss(m, s)
            told = math.log(_density(u, good)) - math.log(_density(u, rest))
            if best is None or told > best[0]:
                best = told, u
        out[name] = _value(min(best[1], 1 - 1e-12), *how)
    return out


def n_trials(rows: int, features: int, cores: int, asked: int | str = "auto") -> int:
    if asked != "auto":
        if int(asked) < 1:
            raise ConfigError("trials: one at least")
        return int(asked)
    n = 4 if rows >= VERY_LARGE or features > 250 else 8 if rows < SMALL else 6
    return min(n, 6) if cores <= 2 else n


def n_trees(rows: int) -> int:
    """Fewer trees for more rows."""
    return next(trees for most, trees in ((5_000, 350), (20_000, 300), (100_000, 250), (500_000, 180), (math.inf, 120)) if rows <= most)


def primary_metric(task: str, asked: str = "auto") -> str:
    from .metrics import DIRECTION

    if asked != "auto":
        if asked not in DIRECTION:
            raise ConfigError(f"metric is auto or one of {sorted(DIRECTION)}")
        return asked
    return {"regression": "rmse", "multioutput_regression": "rmse", "ranking": "ndcg", "binary": "roc_auc"}.get(task, "f1_macro")


def class_weights(df: DataFrame, label: str, most: float = 0.1) -> dict | None:
    """n / (k * n_c) of each class, where the rarest has under ``most`` of the commonest's rows; else none."""
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*")).collect()}
    if len(counts) < 2 or min(counts.values()) / max(counts.values()) >= most:
        return None
    total = sum(counts.values())
    return {k: total / (len(counts) * n) for k, n in counts.items()}


class Deadline:
    """Seconds that all stages share; no limit if none are given."""

    def __init__(self, seconds: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.clock, self.ends = clock, None if seconds is None else clock() + seconds

    def left(self) -> float:
        return math.inf if self.ends is None else max(0.0, self.ends - self.clock())

    def over(self) -> bool:
        return self.left() <= 0

    def share(self, part: float) -> Deadline:
        """A deadline after ``part`` of the time that is left."""
        return Deadline(None if self.ends is None else self.left() * part, self.clock)


@dataclass
class ResourcePlan:
    cores: int
    executors: int
    executor_mb: int
    shuffle_partitions: int


def _megabytes(text: str) -> int:
    scale = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    text = text.lower().removesuffix("b")
    return int(float(text[:-1]) * scale[text[-1]]) if text and text[-1] in scale else int(int(text or 0) / 1024 / 1024)


def resource_plan(spark: SparkSession) -> ResourcePlan:
    """What the cluster gives: cores, executors, memory of each and shuffle partitions, from the session's settings."""
    conf = spark.sparkContext.getConf()
    executors = max(1, int(conf.get("spark.executor.instances", "1")))
    local = spark.sparkContext.master.startswith("local")
    memory = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g")
    return ResourcePlan(spark.sparkContext.defaultParallelism, executors, max(128, _megabytes(memory)), int(spark.conf.get("spark.sql.shuffle.partitions")))


def memory_note(rows: int, features: int, plan: ResourcePlan) -> str | None:
    """A note where a matrix's share of an executor, twice the doubles or the doubles and 32 MB, takes over 85 % of its memory.

    No learner needs the matrix in memory: what doesn't fit is kept on disk.
    """
    raw = rows * features * 8 / 1024 / 1024 / plan.executors
    need = max(2 * raw, raw + 32)
    return f"a matrix of {rows} x {features} would need {need:.0f} MB an executor of {plan.executor_mb}: kept rows go to disk in part" if need > 0.85 * plan.executor_mb else None


@dataclass
class SearchResult:
    params: dict
    score: float
    baseline: float
    tuned: bool
    trials: list = field(default_factory=list)


def search(family: str, evaluate: Callable[[dict, int], float], folds: int, trials: int, better: bool, seed: int = 42, deadline: Deadline | None = None, how: str = "density") -> SearchResult:
    """Search that knows its baseline: ``evaluate(params, fold)`` gives a score, of which more is ``better`` or less.

    The defaults go first; then points by densities of good and other trials
    (``propose``), or with ``how`` "random" plain draws.  A trial ends early when its mean so far is worse than
    the median of the others after as many folds.  Tuned parameters are kept only
    if they gain ``LEAST_GAIN`` of the baseline.
    """
    deadline, sign = deadline or Deadline(), 1.0 if better else -1.0
    mean = lambda xs: sum(xs) / len(xs)
    first = default_params(family)
    done = [[evaluate(first, k) for k in range(folds)]]
    out = [{"params": first, "scores": done[0], "pruned": False}]
    baseline = mean(done[0])
    rng = random.Random(seed)
    for _ in range(trials):
        if deadline.over():
            break
        seen = [(t["params"], -sign * mean(t["scores"])) for t in out]
        params, scores = propose(family, seen, rng) if how == "density" else draw_params(family, rng), []
        for k in range(folds):
            scores.append(evaluate(params, k))
            others = sorted(sign * mean(x[: k + 1]) for x in done)
            if k + 1 < folds and sign * mean(scores) < others[len(others) // 2]:
                break
        whole = len(scores) == folds
        out.append({"params": params, "scores": scores, "pruned": not whole})
        if whole:
            done.append(scores)
    best = max((t for t in out if not t["pruned"]), key=lambda t: sign * mean(t["scores"]))
    gain = sign * (mean(best["scores"]) - baseline)
    tuned = best is not out[0] and gain >= LEAST_GAIN * max(abs(baseline), 1e-12)
    chosen = best if tuned else out[0]
    return SearchResult(chosen["params"], mean(chosen["scores"]), baseline, tuned, out)
