"""Evaluation metrics as aggregates; ranks and curves go by distinct score, so ties and skew are counted, not gathered."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.columns import exact_quantiles, is_large, prefix_sums

EPS = 1e-15


def _div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def binary(df: DataFrame, y: str, p: str) -> DataFrame:
    hit = lambda a, b: F.sum(F.when((F.col(y) == a) & (F.col(p) == b), 1.0).otherwise(0.0))
    c = df.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    chance = _div((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return c.select(_div(tp + tn, n).alias("accuracy"), _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"), _div(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    _div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
                    _div(_div(tp + tn, n) - chance, 1 - chance).alias("kappa"), ((_div(tp, tp + fn) + _div(tn, tn + fp)) / 2).alias("balanced_accuracy"))


def multiclass(df: DataFrame, y: str, p: str) -> DataFrame:
    """Macro and weighted scores, MCC, kappa and balanced accuracy (the mean recall of the classes that occur)."""
    c = confusion(df, y, p)
    side = c.select(F.explode(F.array(F.struct(F.col("y").alias("k"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
                                      F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("r")).select("r.*")
    k = side.groupBy("k").agg(F.sum("actual").alias("a"), F.sum("said").alias("s"), F.sum("hit").alias("h"))
    f1 = _div(2 * F.col("h"), F.col("a") + F.col("s"))
    a, s, h = F.sum("a").cast("double"), F.sum(F.col("a").cast("double") * F.col("s")), F.sum("h").cast("double")
    aa, ss = F.sum(F.col("a").cast("double") ** 2), F.sum(F.col("s").cast("double") ** 2)
    return k.agg(_div(h, a).alias("accuracy"), F.avg(_div(F.col("h"), F.col("s"))).alias("precision"), F.avg(_div(F.col("h"), F.col("a"))).alias("recall"), F.avg(f1).alias("f1_macro"),
                 _div(F.sum(f1 * F.col("a")), a).alias("f1_weighted"), _div(h * a - s, F.sqrt(a * a - ss) * F.sqrt(a * a - aa)).alias("mcc"), _div(_div(h, a) - s / (a * a), 1 - s / (a * a)).alias("kappa"),
                 F.avg(F.when(F.col("a") > 0, _div(F.col("h"), F.col("a")))).alias("balanced_accuracy"))


def log_loss(df: DataFrame, y: str, p: str) -> DataFrame:
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(p)))
    return df.agg(F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))


def _calibration_error(df: DataFrame, conf: Column, right: Column, bins: int) -> DataFrame:
    b = df.select(F.least(F.floor(conf * bins), F.lit(bins - 1)).alias("b"), conf.alias("c"), right.alias("r")).groupBy("b").agg(F.count("*").alias("n"), F.avg("c").alias("c"), F.avg("r").alias("r"))
    return b.agg(_div(F.sum(F.abs(F.col("c") - F.col("r")) * F.col("n")), F.sum("n")).alias("ece"))


def ece(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Expected calibration error of the top label; the last bin is closed."""
    return _calibration_error(df, F.greatest(F.col(p), 1 - F.col(p)), F.when((F.col(p) >= 0.5) == (F.col(y) == 1), 1.0).otherwise(0.0), bins)


def multiclass_probabilities(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """log_loss, brier and ece of class numbers ``y`` and arrays of probabilities ``p``."""
    of_y = F.get(p, F.col(y).cast("int"))
    top = F.array_max(p)
    losses = df.agg(F.avg(-F.log(F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), of_y)))).alias("log_loss"),
                    F.avg(F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x) - 2 * of_y + 1).alias("brier"))
    right = F.when(F.array_position(p, top) - 1 == F.col(y), 1.0).otherwise(0.0)
    return losses.crossJoin(_calibration_error(df, top, right, bins))  # one row each


def score_table(df: DataFrame, y: str, p: str) -> DataFrame:
    """Positives and negatives of each distinct score."""
    return df.groupBy(F.col(p).alias("score")).agg(F.sum(F.when(F.col(y) == 1, 1.0).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(1.0)).alias("neg"))


def roc_auc(df: DataFrame, y: str, p: str, digits: int | None = None) -> DataFrame:
    """Exact: ties share rank.  Scores are ranked in ranges; ``digits`` rounds them first."""
    t = prefix_sums(score_table(df.withColumn(p, F.round(p, digits)) if digits else df, y, p), "score", ["neg"])
    return t.agg(_div(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, y: str, p: str, classes: int) -> float:
    """The mean over classes of one against the rest, from arrays of probabilities; classes without both sides are left out."""
    each = []
    for k in range(classes):
        t = score_table(df.select((F.col(y) == k).cast("int").alias("y"), F.get(p, F.lit(k)).alias("s")), "y", "s")
        row = prefix_sums(t, "score", ["neg"]).agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("a"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
        if row["pos"] and row["neg"]:
            each.append(row["a"] / (row["pos"] * row["neg"]))
    return sum(each) / len(each) if each else 0.0


def curve(df: DataFrame, y: str, p: str) -> DataFrame:
    """Cumulative counts by falling score: the points of ROC and precision-recall curves."""
    t = prefix_sums(score_table(df, y, p).withColumn("falling", -F.col("score")), "falling", ["pos", "neg"])
    return t.select("score", "pos", "neg", (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"))


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    return curve(df, y, p).agg(_div(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos")).alias("average_precision"))


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    if is_large(df):  # only the errors near the middle are sorted
        middle = exact_quantiles(df, {"e": F.abs(e)}, [0.5])["e"]
        median = F.lit(middle[0] if middle else None).cast("double")
    else:
        median = F.percentile(F.abs(e), 0.5)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
                  median.alias("median_ae"), F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(2.220446049250313e-16))).alias("mape"))


def multioutput(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The RMSE of each output, and the means over outputs of RMSE, MAE and R2."""
    error = [F.col(y) - F.col(p) for y, p in pairs]
    mean = lambda xs: sum(xs, F.lit(0.0)) / len(pairs)
    return df.agg(*[F.sqrt(F.avg(e * e)).alias(f"rmse_{i}") for i, e in enumerate(error)], mean([F.sqrt(F.avg(e * e)) for e in error]).alias("rmse"),
                  mean([F.avg(F.abs(e)) for e in error]).alias("mae"), mean([1 - F.try_divide(F.avg(e * e), F.var_pop(y)) for e, (y, _) in zip(error, pairs, strict=True)]).alias("r2"))


def multilabel(df: DataFrame, labels: list[tuple[str, str]]) -> DataFrame:
    """Subset accuracy, Hamming loss, F1 (macro, micro, mean of rows), and macro precision and recall."""
    same = F.lit(True)
    for y, p in labels:
        same = same & (F.col(y) == F.col(p))
    wrong = sum((F.when(F.col(y) != F.col(p), 1.0).otherwise(0.0) for y, p in labels), F.lit(0.0))
    both = [F.when((F.col(y) == 1) & (F.col(p) == 1), 1.0).otherwise(0.0) for y, p in labels]
    tp, said, true = [F.sum(b) for b in both], [F.sum(F.col(p).cast("double")) for _, p in labels], [F.sum(F.col(y).cast("double")) for y, _ in labels]
    mean = lambda xs: sum(xs, F.lit(0.0)) / len(labels)
    row_f1 = _div(2 * sum(both, F.lit(0.0)), sum((F.col(y).cast("double") + F.col(p) for y, p in labels), F.lit(0.0)))
    return df.agg(F.avg(F.when(same, 1.0).otherwise(0.0)).alias("subset_accuracy"), (F.avg(wrong) / len(labels)).alias("hamming"),
                  mean([_div(2 * t, s + a) for t, s, a in zip(tp, said, true, strict=True)]).alias("f1_macro"),
                  _div(2 * sum(tp, F.lit(0.0)), sum(said, F.lit(0.0)) + sum(true, F.lit(0.0))).alias("f1_micro"), F.avg(row_f1).alias("f1_samples"),
                  mean([_div(t, s) for t, s in zip(tp, said, strict=True)]).alias("precision_macro"), mean([_div(t, a) for t, a in zip(tp, true, strict=True)]).alias("recall_macro"))


def multilabel_average_precision(df: DataFrame, labels: list[tuple[str, str]]) -> float:
    """The mean average precision over labels (label, probability) that have a positive."""
    each = [average_precision(df, y, p).first()[0] for y, p in labels if df.where(F.col(y) == 1).limit(1).count()]
    return sum(each) / len(each) if each else 0.0


def _discounted(blocks: DataFrame, group: str, value: str, gain: str, k: int, name: str) -> DataFrame:
    """The discounted gain of each group's first ``k`` rows by falling ``value``; ``blocks`` are the rows of equal values, with their number ``n`` and mean ``gain``."""
    order = Window.partitionBy(group).orderBy(F.desc(value))
    first = blocks.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)  # cut before the exchange: k blocks a group and task
    upto = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    discount = F.array(*[F.lit(float(x)) for x in np.concatenate(([0.0], np.cumsum(1 / np.log2(np.arange(k) + 2.0))))])
    at = lambda n: F.get(discount, F.least(n, F.lit(k)).cast("int"))
    return first.withColumn("__u", upto).groupBy(group).agg(F.sum(F.col(gain) * (at(F.col("__u") + F.col("n")) - at(F.col("__u")))).alias(name))


def ndcg(df: DataFrame, group: str, gain: str, score: str, k: int) -> DataFrame:
    """Mean NDCG@k over groups of two rows at least; equal scores share their mean gain.

    Rows of one score, and of one gain, become one before they are ordered, and
    only the first ``k`` of these leave a task, so no task sorts a large group.
    """
    rows = df.select(F.col(group).alias("__group"), F.col(score).alias("score"), F.col(gain).cast("double").alias("gain"))
    said = rows.groupBy("__group", "score").agg(F.count("*").alias("n"), F.avg("gain").alias("gain"))
    best = rows.groupBy("__group", "gain").agg(F.count("*").alias("n"))
    sizes = best.groupBy("__group").agg(F.sum("n").alias("rows")).where("rows >= 2").withColumnRenamed("__group", "__whole")
    found = _discounted(said, "__group", "score", "gain", k, "dcg").withColumnRenamed("__group", "__said")
    each = (sizes.join(found, F.col("__whole").eqNullSafe(F.col("__said")))
            .join(_discounted(best, "__group", "gain", "gain", k, "ideal"), F.col("__whole").eqNullSafe(F.col("__group"))))
    return each.agg(F.avg(_div(F.col("dcg"), F.col("ideal"))).alias("ndcg"), F.count("*").alias("groups"))


#: Whether more of a metric is better.
DIRECTION = {"accuracy": True, "precision": True, "recall": True, "f1": True, "f1_macro": True, "f1_weighted": True, "mcc": True, "kappa": True, "balanced_accuracy": True,
             "roc_auc": True, "average_precision": True, "ndcg": True, "r2": True, "log_loss": False, "brier": False, "ece": False, "rmse": False, "mae": False, "mse": False,
             "median_ae": False, "mape": False}


def compute(name: str, df: DataFrame, y: str, said: str | None = None, p: str | None = None, classes: int = 2, group: str | None = None, k: int = 10) -> float:
    """One metric by its name, from true values, predictions ``said`` and probabilities ``p`` (an array beyond two classes)."""
    if name not in DIRECTION:
        raise ConfigError(f"metric {name!r} is none of {sorted(DIRECTION)}")
    if name in ("rmse", "mae", "mse", "r2", "median_ae", "mape"):
        return regression(df, y, said).first()[name]
    if name == "ndcg":
        return ndcg(df, group, y, said, k).first()["ndcg"]
    if name == "roc_auc":
        return roc_auc(df, y, p).first()[0] if classes == 2 else roc_auc_ovr(df, y, p, classes)
    if name == "average_precision":
        return average_precision(df, y, p).first()[0]
    if name in ("log_loss", "brier", "ece"):
        if classes > 2:
            return multiclass_probabilities(df, y, p).first()[name]
        return (ece(df, y, p) if name == "ece" else log_loss(df, y, p)).first()[name]
    if classes > 2 or name in ("f1_macro", "f1_weighted"):
        return multiclass(df, y, said).first()["f1_macro" if name == "f1" else name]
    return binary(df, y, said).first()[name]


def diagnostics(df: DataFrame, y: str, said: str, p: str | None = None, points: int = 200) -> dict:
    """What a report draws: the confusion matrix, and for probabilities an evenly thinned ROC curve."""
    out: dict = {"confusion": [r.asDict() for r in confusion(df, y, said).orderBy("y", "p").collect()]}
    if p:
        c = curve(df, y, p)
        total = c.agg(F.max("tp").alias("P"), F.max("fp").alias("N"), F.count("*").alias("n")).first()
        if total["P"] and total["N"]:
            cell = F.floor(F.col("fp") / total["N"] * points / 2) + F.floor(F.col("tp") / total["P"] * points / 2)
            thin = c.withColumn("cell", cell).groupBy("cell").agg(F.max_by(F.struct("score", "tp", "fp"), "tp").alias("x")).select("x.*").orderBy("fp", "tp").collect()
            out["roc"] = [{"threshold": r["score"], "fpr": r["fp"] / total["N"], "tpr": r["tp"] / total["P"]} for r in thin]
    return out


def predicted_against_true(df: DataFrame, y: str, p: str, bins: int = 20) -> DataFrame:
    """Mean prediction, mean true value and rows of equal ranges of the prediction."""
    row = df.agg(F.min(p).alias("a"), F.max(p).alias("b")).first()
    width = ((row["b"] or 0.0) - (row["a"] or 0.0)) / bins or 1.0
    bin_ = F.least(F.floor((F.col(p) - F.lit(row["a"])) / width), F.lit(bins - 1))
    return df.groupBy(bin_.alias("bin")).agg(F.avg(p).alias("predicted"), F.avg(y).alias("actual"), F.count("*").alias("n"))
