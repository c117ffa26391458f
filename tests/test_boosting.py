import itertools
import math
import time

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tessera.errors import DataError
from tessera.operators import boosting, ensemble, learn, metrics, split, tuning
from tessera.operators.boosting import BoostedModel, Boosting


def frame(spark, x, y, *more, ddl=""):
    rows = [(x[i].tolist(), float(y[i]), *(m[i].item() for m in more)) for i in range(len(x))]
    return spark.createDataFrame(rows, f"features array<double>, label double{ddl}").repartition(3)


def naive(x, y, model, depth, min_rows, ridge=1.0):
    """One regression tree on the model's own edges, by trying every split."""
    codes = model.coder.codes(x)
    g, base = model.base[0] - y, model.base[0]

    def grow(rows, d):
        best, value = None, -g[rows].sum() / (len(rows) + ridge)
        if d:
            for f in range(len(codes)):
                for t in range(1, boosting.BINS):
                    left = codes[f][rows] <= t
                    if min(left.sum(), (~left).sum()) < min_rows:
                        continue
                    gain = sum(g[rows][s].sum() ** 2 / (s.sum() + ridge) for s in (left, ~left)) - g[rows].sum() ** 2 / (len(rows) + ridge)
                    if gain > 1e-10 and (best is None or gain > best[0] + 1e-9):
                        best = gain, left
        if best is None:
            out[rows] += value
        else:
            grow(rows[best[1]], d - 1)
            grow(rows[~best[1]], d - 1)

    out = np.full(len(y), base)
    grow(np.arange(len(y)), depth)
    return out


def test_one_tree_by_hand(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)).round(2)
    y = x[:, 0] * (x[:, 1] > 0) + 0.1 * rng.normal(size=400)
    model = Boosting("regression", trees=1, depth=3, step=1.0, min_rows=10).fit(frame(spark, x, y))
    assert model.raw(x)[0] == pytest.approx(naive(x, y, model, 3, 10))


def test_one_task_and_many_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    x[::9, 1] = np.nan
    y = np.where(x[:, 0] > 0.3, 2, np.where(np.isnan(x[:, 1]), 1, 0))
    df = frame(spark, x, y).persist()
    make = lambda: Boosting("multiclass", trees=3, depth=3, step=0.5, classes=3, min_rows=5)
    one = make().fit(df)
    monkeypatch.setattr(boosting, "LOCAL", 0)
    monkeypatch.setattr(boosting, "STEPS", 2)
    many = make().fit(df)
    assert many.raw(x) == pytest.approx(one.raw(x)) and (one.raw(x).argmax(0) == y).mean() > 0.99
    again = BoostedModel.from_dict(one.to_dict())
    assert (again.raw(x) == one.raw(x)).all() and sum(one.featureImportances) == pytest.approx(1)


def test_multiclass_beats_the_forest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 6))
    s = np.stack((x[:, 0] * x[:, 1], x[:, 2] + 0.5 * x[:, 3], np.sin(2 * x[:, 4])))
    y = (s + 0.3 * rng.normal(size=s.shape)).argmax(0)
    rows = frame(spark, x, y).withColumn("features", array_to_vector("features"))
    train, test = (split.split_random(rows.withColumn("k", F.monotonically_increasing_id()).persist(), "k").where(c) for c in ("NOT is_test", "is_test"))
    made = learn.estimator("multiclass", "gbt", 3, 40, params={"min_rows": 5})
    assert isinstance(made, Boosting)
    loss = {}
    for name, e in (("boosted", made), ("forest", RandomForestClassifier(numTrees=40, maxDepth=8, seed=1))):
        out = e.fit(train).transform(test).withColumn("p", vector_to_array("probability"))
        loss[name] = metrics.multiclass_probabilities(out, "label", "p").first()["log_loss"]
    assert loss["boosted"] < loss["forest"] - 0.02


def test_categories_by_ordered_statistics(spark):
    rng = np.random.default_rng(4)
    code = rng.integers(0, 300, 6000)
    chance = rng.random(300)
    y = (rng.random(6000) < chance[code]).astype(float)
    x = np.column_stack((code, rng.normal(size=6000))).astype(float)
    df = frame(spark, x, y, np.arange(6000), ddl=", id long").persist()
    auc = {}
    for name, cats in (("native", [0]), ("numeric", [])):
        model = Boosting("binary", trees=15, depth=3, categories=cats, min_rows=10).fit(df.where("id < 4000"))
        p = model.transform(df.where("id >= 4000")).select("label", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
        auc[name] = metrics.roc_auc(p, "label", "p").first()[0]
    assert auc["native"] > auc["numeric"] + 0.05
    # A row's own target isn't in its statistic: of codes seen once, all that training rows are told is the prior.
    once = frame(spark, np.arange(500.0)[:, None], np.arange(500) % 2)
    assert not any((t.feature >= 0).any() for trees in Boosting("binary", trees=2, categories=[0], min_rows=1).fit(once).rounds for t in trees)


def test_pairs_beat_points_in_a_ranking(spark):
    rng = np.random.default_rng(5)
    g = np.repeat(np.arange(300), 8)
    x = rng.normal(size=(2400, 3))
    offset = 8 * rng.normal(size=300)[g]  # what a pointwise model spends its trees on
    x[:, 2] = offset + rng.normal(size=2400)
    y = offset + 0.4 * x[:, 0] + 0.3 * np.abs(x[:, 1]) + 0.05 * rng.normal(size=2400)
    y -= np.minimum.reduceat(y, np.arange(0, 2400, 8))[g]
    y = np.maximum(0, y + 0.2 * offset)
    df = frame(spark, x, y, g, ddl=", grp long").persist()
    train, test = df.where("grp < 200"), df.where("grp >= 200")
    made = {}
    for kind in ("ranking", "regression"):
        out = Boosting(kind, trees=20, depth=3, min_rows=5, group_col="grp").fit(train).transform(test)
        made[kind] = metrics.ndcg(out, "grp", "label", "prediction", 10).first()["ndcg"]
    assert made["ranking"] > made["regression"]
    with pytest.raises(DataError):
        Boosting("ranking").fit(train)


def test_lambdas_by_hand():
    rng = np.random.default_rng(6)
    sizes = np.array([1, 2, 5, 3, 9, 17])
    s, y = rng.normal(size=sizes.sum()), rng.integers(0, 4, sizes.sum()).astype(float)
    g, h, loss = boosting.lambdas(s, y, sizes)
    at = 0
    for n in sizes:
        a, b = s[at: at + n], y[at: at + n] - y[at: at + n].min()
        rank = np.argsort(np.argsort(-a, kind="stable"))
        ideal = sum(v / math.log2(i + 2) for i, v in enumerate(sorted(b, reverse=True))) or 1.0
        want, curve = np.zeros(n), np.zeros(n)
        for i, j in itertools.permutations(range(n), 2):
            if b[i] > b[j]:
                d = abs((b[i] - b[j]) * (1 / math.log2(rank[i] + 2) - 1 / math.log2(rank[j] + 2))) / ideal
                r = 1 / (1 + math.exp(a[i] - a[j]))
                want[i] -= d * r
                want[j] += d * r
                curve[[i, j]] += d * r * (1 - r)
        assert g[at: at + n] == pytest.approx(want) and h[at: at + n] == pytest.approx(curve)
        at += n


def test_large_groups_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(boosting, "GROUP", 40)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 2))
    df = frame(spark, x, x[:, 0] + 3, np.where(np.arange(900) < 600, 0, np.arange(900)), ddl=", grp long").persist()
    b = Boosting("ranking", trees=20, depth=3, step=0.3, min_rows=2, group_col="grp")
    rows = b._together(b._rows(df))
    assert rows.groupBy("grp").count().agg(F.max("count")).first()[0] < 60 and rows.count() == 900
    out = b.fit(df).transform(df.where("grp = 0"))
    assert out.agg(F.corr("label", "prediction")).first()[0] > 0.8


def test_held_out_rows_stop_the_rounds(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 3))
    y = (x[:, 0] + 1.5 * rng.normal(size=1200) > 0).astype(float)
    df = frame(spark, x, y, np.arange(1200) % 4 == 0, ddl=", held boolean")
    model = Boosting("binary", trees=80, depth=5, step=0.3, min_rows=2, patience=5, held_col="held").fit(df)
    best = int(np.argmin(model.losses))
    assert model.stopped == "held-out loss" and len(model.rounds) == best < 40 and len(model.losses) == best + 6
    every = Boosting("binary", trees=3, depth=2, held_col="held").fit(df)
    assert len(every.losses) == 4 and every.losses[-1] < every.losses[0]


def test_a_deadline_ends_the_rounds(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20_000, 10))
    df = frame(spark, x[:, :10], x[:, 0] * x[:, 1]).persist()
    df.count()
    for local in (boosting.LOCAL, 0):
        monkeypatch.setattr(boosting, "LOCAL", local)
        began = time.monotonic()
        model = Boosting("regression", trees=100_000, depth=6, deadline=tuning.Deadline(12)).fit(df)
        assert model.stopped == "deadline" and model.rounds and time.monotonic() - began < 13.2


def test_contributions_against_all_subsets(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 4))
    y = x[:, 0] * x[:, 1] + (x[:, 2] > 0)
    df = frame(spark, x, y)
    model = Boosting("regression", trees=3, depth=4, min_rows=3).fit(df)
    codes = model.coder.codes(x[:12])

    def value(tree, row, known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = 2 * node + 1, 2 * node + 2
        if f in known:
            c = codes[f, row]
            return value(tree, row, known, right if (not tree.missing_left[node] if c == 0 else c > tree.bin[node]) else left)
        return sum(tree.cover[k] / tree.cover[node] * value(tree, row, known, k) for k in (left, right))

    want = np.zeros((12, 5))
    for row in range(12):
        for trees in model.rounds:
            for i in range(4):
                for size in range(4):
                    for s in itertools.combinations([j for j in range(4) if j != i], size):
                        w = math.factorial(size) * math.factorial(3 - size) / 24
                        want[row, i] += w * (value(trees[0], row, {*s, i}) - value(trees[0], row, set(s)))
            want[row, 4] += value(trees[0], row, set())
    want[:, 4] += model.base[0]
    assert model.contributions(x[:12])[0] == pytest.approx(want)
    got = model.explain(model.transform(df)).select("prediction", F.aggregate(F.get("contributions", F.lit(0)), F.lit(0.0), lambda a, v: a + v).alias("s"))
    assert got.where("abs(prediction - s) > 1e-9").count() == 0


def test_fit_multiclass_and_ranking(spark, tmp_path):
    df = spark.range(900).selectExpr("id", "CAST(id % 30 AS double) AS x", "concat('c', id % 7) AS c", "concat('k', CAST(id % 30 / 10 AS int)) AS y", "id % 45 AS g")
    model = learn.fit(df, learn.FitConfig(target="y", key="id", learner="gbt", trees=8, early_stopping=True, features=["x", "c"]))
    assert isinstance(model.learners["label"], BoostedModel) and model.learners["label"].kind == "multiclass" and model.metrics["accuracy"] > 0.95
    assert any("rounds" in n for n in model.notes)
    model.save(spark, str(tmp_path / "m"))
    again = learn.FittedModel.load(spark, str(tmp_path / "m"))
    assert again.predict(df, ["id"]).orderBy("id").collect() == model.predict(df, ["id"]).orderBy("id").collect()
    told = learn.explain(model, df, ["id"]).first()["shap_label"]
    assert len(told) == 3 and {t["feature"] for t in told[0]} == {*model.cleaner.outputs, "expected"}
    ranked = learn.fit(df.withColumn("y", F.col("id") % 30), learn.FitConfig(target="y", key="id", group="g", task="ranking", learner="gbt", trees=8, features=["x"], early_stopping=True))
    assert ranked.learners["label"].kind == "ranking" and ranked.metrics["ndcg_5"] > 0.95


def test_multiclass_ensembles(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 3, 500)
    x = np.column_stack((y + 0.5 * rng.normal(size=500), (y == 1) + 0.4 * rng.normal(size=500), rng.normal(size=500)))

    def member(noise):
        s = np.exp(2.0 * np.eye(3)[y] + noise * rng.normal(size=(500, 3)))
        return s / s.sum(1, keepdims=True)

    p = [member(n) for n in (1.0, 1.0, 3.0)]
    df = spark.createDataFrame([(i, float(y[i]), *(m[i].tolist() for m in p), *x[i].tolist()) for i in range(500)], "id long, label double, p_0 array<double>, p_1 array<double>, p_2 array<double>, a double, b double, c double")
    got = np.array([r[0] for r in df.orderBy("id").select(ensemble.blend(["p_0", "p_1", "p_2"], [1.0, 2.0, 1.0], "multiclass")).collect()])
    assert got == pytest.approx((p[0] + 2 * p[1] + p[2]) / 4)
    chosen = ensemble.select_diverse(df, ["p_0", "p_1", "p_2"], "multiclass")
    assert {"p_0", "p_1"} <= set(chosen)
    weights, best = ensemble.voting_weights(df, ["p_0", "p_1", "p_2"], "multiclass")
    tried = ensemble.weight_candidates(3)
    assert len(tried) == 100 and weights in tried and sum(weights) == pytest.approx(1)
    w = np.array(weights)
    assert best[0] == pytest.approx(((w[0] * p[0] + w[1] * p[1] + w[2] * p[2]).argmax(1) == y).mean())
    made = ensemble.train(split.stratified_folds(df, "id", "label", 2), ["a", "b", "c"], "multiclass", "id", 3, trees=5, families=("gbt", "linear"))
    out = made.predict(df)
    assert out.where(F.array_position("prediction", F.array_max("prediction")) - 1 == F.col("label")).count() > 400


def test_temporal_split_keeps_the_rows(spark):
    df = spark.createDataFrame([(k, 5 if i > 2 else i) for i, k in enumerate([1, 2, 3, 7, 7, 7, 8, 8])], "id long, s long").selectExpr("id", "timestamp_seconds(s) AS t")
    out = split.split_temporal(df, "t", "id")
    assert out.count() == 8 and 0 < out.where("is_test").count() < 8
