"""Large groups in ranges, NDCG by blocks, bundles as archives, and adapters of few rows."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.errors import DataError
from tessera.functions import columns
from tessera.operators import learn, metrics, multimodal, split
from tessera.sources import tables


def hot(spark):
    """Half of the rows in one group, ties, null groups and null scores."""
    return spark.range(4000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 101 = 0 THEN NULL ELSE concat('g', id % 40) END AS g",
                                        "CASE WHEN id % 97 = 0 THEN NULL ELSE CAST(pmod(hash(id), 300) AS DOUBLE) END AS s", "CAST(pmod(hash(id, 7), 5) AS DOUBLE) AS gain")


def test_places_in_ranges_equal_one_window(spark):
    df = hot(spark)
    part = -F.size(F.filter(columns.cut_points(df, "s", 16), lambda e: e <= F.col("s")))
    order = [F.desc("s"), F.col("id")]
    got = columns.place_within(df.withColumn("fold", F.lit(9)), ["g"], order, part, "place")
    assert got.columns == ["id", "g", "s", "gain", "fold", "place"]
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert sorted((r["id"], r["place"]) for r in got.collect()) == sorted((r["id"], r["place"]) for r in want.collect())
    assert columns.place_within(df.limit(0), ["g"], order, F.lit(0), "place").count() == 0


def test_stratified_folds_of_a_large_class(spark):
    sizes = split.stratified_folds(hot(spark), "id", "g", 4).groupBy("g", "fold").count().collect()
    by = {}
    for r in sizes:
        by.setdefault(r["g"], []).append(r["count"])
    assert len(by["hot"]) == 4 and all(max(v) - min(v) <= 1 for v in by.values() if len(v) == 4)
    assert sum(map(sum, by.values())) == 4000


@pytest.mark.parametrize("k", [1, 5, 50])
def test_ndcg_equals_brute_force(spark, k):
    rows = hot(spark).where("s IS NOT NULL").select("g", "s", "gain").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["g"], []).append((r["s"], r["gain"]))
    found = []
    for each in groups.values():
        if len(each) < 2:
            continue
        s, gain = np.array(each).T
        mean = {v: gain[s == v].mean() for v in set(s)}  # equal scores share their mean gain
        said = np.array([mean[v] for v in sorted(s, reverse=True)])[:k]
        best = np.sort(gain)[::-1][:k]
        discount = lambda x: (x / np.log2(np.arange(len(x)) + 2)).sum()
        found.append(discount(said) / discount(best) if best.any() else 0.0)
    got = metrics.ndcg(hot(spark).where("s IS NOT NULL"), "g", "gain", "s", k).first()
    assert got["groups"] == len(found) and got["ndcg"] == pytest.approx(np.mean(found))
    assert metrics.ndcg(hot(spark).limit(0), "g", "gain", "s", k).first()["groups"] == 0


def test_median_error_of_large_data(spark, monkeypatch):
    df = hot(spark).selectExpr("gain AS y", "s AS p").where("p IS NOT NULL")
    small = metrics.regression(df, "y", "p").first()
    monkeypatch.setattr(columns, "DIRECT_BYTES", 0)
    assert metrics.regression(df, "y", "p").first()["median_ae"] == pytest.approx(small["median_ae"])


@pytest.fixture(scope="module")
def ranked(spark):
    df = spark.range(900).selectExpr("id", "CAST(id % 9 AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS z", "id % 20 AS g", "CAST(id % 9 > 4 AS INT) AS y")
    return df, learn.fit(df, learn.FitConfig(target="y", key="id", group="g", task="ranking", learner="linear", features=["x", "z"]))


def test_ranks_of_a_ranking(ranked):
    df, model = ranked
    got = model.predict_ranked(df, ["id"])
    want = got.withColumn("again", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("prediction"), "id")))
    assert got.count() == 900 and want.where("rank <> again").count() == 0
    beside = model.predict(df.withColumn("x", F.when(F.col("id") > 0, F.col("x"))), ["x", "id"])  # a feature, kept as it was
    assert beside.columns == ["x", "id", "prediction"] and beside.where("id = 0 AND x IS NULL AND prediction IS NOT NULL").count() == 1


def test_bundle_as_one_archive(spark, ranked, tmp_path):
    df, model = ranked
    path = str(tmp_path / "model.zip")
    model.save(spark, path)
    assert zipfile.ZipFile(path).testzip() is None and {"metadata.json", "manifest.json"} <= set(zipfile.ZipFile(path).namelist())
    again = learn.FittedModel.load(spark, path)
    assert again.predict(df, ["id"]).orderBy("id").collect() == model.predict(df, ["id"]).orderBy("id").collect()
    model.save(spark, path)  # takes the place of the old one
    assert learn.FittedModel.load(spark, path).metrics == model.metrics
    with pytest.raises(DataError):
        learn.FittedModel.load(spark, str(tmp_path / "none.zip"))


def rewritten(source, target, change):
    with zipfile.ZipFile(source) as a, zipfile.ZipFile(target, "w") as b:
        for name in a.namelist():
            for new, data in change(name, a.read(name)):
                b.writestr(new, data)
    return str(target)


def test_archives_that_are_refused(spark, ranked, tmp_path, monkeypatch):
    whole = str(tmp_path / "model.zip")
    ranked[1].save(spark, whole)
    outside = rewritten(whole, tmp_path / "outside.zip", lambda n, d: [(n, d)] + ([("../../outside.txt", b"x")] if n == "metadata.json" else []))
    changed = rewritten(whole, tmp_path / "changed.zip", lambda n, d: [(n, d.replace(b"ranking", b"binary!") if n == "metadata.json" else d)])
    bare = rewritten(whole, tmp_path / "bare.zip", lambda n, d: [] if n == "manifest.json" else [(n, d)])
    for path in (outside, changed, bare):
        with pytest.raises(DataError):
            learn.FittedModel.load(spark, path)
    assert not (tmp_path / "outside.txt").exists()
    with monkeypatch.context() as m:
        m.setattr(learn, "MOST_BYTES", 200)
        with pytest.raises(DataError):
            learn.FittedModel.load(spark, whole)
    with monkeypatch.context() as m:
        m.setattr(learn, "MOST_FILES", 2)
        with pytest.raises(DataError):
            learn.unpack(spark, whole, str(tmp_path / "few"))


def test_foreign_classes_need_trust(spark, ranked, tmp_path, monkeypatch):
    df, model = ranked
    path = str(tmp_path / "m")
    model.save(spark, path)
    assert all(c.startswith(learn.OWN_CLASSES) for c in learn._classes(spark, f"{path}/learner_label"))
    monkeypatch.setattr(learn, "OWN_CLASSES", "somewhere.else.")
    with pytest.raises(DataError, match="trusted"):
        learn.FittedModel.load(spark, path)
    assert learn.FittedModel.load(spark, path, trusted=True).predict(df, ["id"]).count() == 900


def test_calibrators_at_the_ends_and_of_nothing(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.25,), (None,)], "p double")
    steps = learn.Calibrator("isotonic", [([0.0, 0.5, 1.0], [0.1, 0.4, 0.8])])
    assert [r[0] for r in df.select(steps.apply(F.col("p"))).collect()] == [0.1, 0.8, pytest.approx(0.25), None]
    same = learn.Calibrator("sigmoid", [(1.0, 0.0)])
    assert [r[0] for r in df.select(same.apply(F.col("p"))).collect()] == [pytest.approx(1e-7), pytest.approx(1 - 1e-7), pytest.approx(0.25), None]


@pytest.mark.parametrize("how", ["sigmoid", "isotonic"])
def test_classes_calibrated_to_sum_to_one(spark, how):
    df = spark.range(900).selectExpr("id", "CAST(id % 9 AS DOUBLE) AS x", "concat('c', id % 9 div 3) AS y")
    model = learn.fit(df, learn.FitConfig(target="y", key="id", trees=3, calibration=how))
    out = model.predict(df, ["id", "y"])
    assert out.where("abs(aggregate(probability, 0D, (a, v) -> a + v) - 1) > 1e-9").count() == 0 and out.where("prediction = y").count() > 850


def test_adapter_of_few_rows(spark):
    df = spark.range(60).selectExpr("id", "CAST(id % 10 AS DOUBLE) AS a", "CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(id % 4 AS DOUBLE) END AS b",
                                    "CASE WHEN id < 30 THEN id % 10 * 2.0D WHEN id < 35 THEN DOUBLE('NaN') END AS y", "1.0D AS one", "'only' AS same")
    made = multimodal.fit_adapter(df, ["a", "b"], "y", components=1)
    assert len(made.weights) == 1
    out = made.transform(df).where("id < 30").select("pls_0000", "y").toPandas()
    assert abs(np.corrcoef(out["pls_0000"], out["y"])[0, 1]) > 0.9
    for rows, names, target, classes in ((df.limit(19), ["a", "b"], "y", None), (df, ["a"], "y", None), (df, ["a", "b"], "one", None), (df, ["a", "b"], "same", ["only"])):
        none = multimodal.fit_adapter(rows, names, target, classes)
        assert none.weights == [] and none.transform(rows).columns == rows.columns


def test_json_of_columns(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text(' {"b": ["x", null, "z"], "a": [1, 2, 3]}')
    got = tables.load_table(spark, str(tmp_path / "a.json"))
    assert got.columns == ["b", "a"] and [tuple(r) for r in got.collect()] == [("x", 1), (None, 2), ("z", 3)]
    (tmp_path / "b.json").write_text('{"b": ["x"], "a": [1, 2]}')
    (tmp_path / "c.json").write_text('{"b": {"0": "x", "1": "y"}, "a": {"0": 1, "1": 2}}')
    assert [tuple(r) for r in tables.load_table(spark, str(tmp_path / "c.json")).select("a", "b").collect()] == [(1, "x"), (2, "y")]
    with pytest.raises(DataError):
        tables.load_table(spark, str(tmp_path / "b.json"))
    monkeypatch.setattr(tables, "LOCAL_BYTES", 10)
    assert tables.load_table(spark, str(tmp_path / "a.json")).count() == 3
    with pytest.raises(DataError):
        tables.load_table(spark, str(tmp_path / "c.json"))
