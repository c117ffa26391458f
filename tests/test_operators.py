import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigError, DataError
from tessera.functions import columns, media
from tessera.operators import clean, decide, ensemble, learn, metrics, multimodal, quality, rows, split, tuning, validate
from tessera.sources import tables


def test_audit_finds_planted_issues(spark):
    df = spark.createDataFrame([(float("inf"), "a", 1), (1000.0, "b", 0), (None, "a", 0), (1.0, "c", 1), (1.0, "c", 1), (2.0, "d", 0)], "x double, c string, y int")
    codes = {i.code for i in quality.audit(df, "y").issues}
    assert {"infinite_values", "duplicate_rows"} <= codes


def test_schema_policies(spark):
    df = spark.createDataFrame([("1", "x"), ("oops", "y")], "a string, b string")
    with pytest.raises(DataError):
        clean.prepare(df, {"a": "double", "b": "string"})
    assert [r["a"] for r in clean.prepare(df, {"a": "double", "b": "string", "c": "int"}, "coerce").collect()] == [1.0, None]


def test_conformal_rank_matches_numpy():
    rng = np.random.default_rng(1)
    for n in (5, 17, 300):
        x = np.sort(rng.normal(size=n))
        q = min(1.0, np.ceil((n + 1) * 0.9) / n)
        assert x[decide.conformal_rank(n, 0.1) - 1] == np.quantile(x, q, method="higher")


def test_prediction_sets_are_never_empty(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.01, 0.02],)], "p array<double>")
    out = [r[0] for r in df.select(decide.prediction_set(df["p"], ["a", "b"], 0.1)).collect()]
    assert out == [["a"], ["b"]]


def test_far_rows_score_higher(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "a double")
    ref = decide.ood_reference(df, ["a"])
    low, high = spark.createDataFrame([(50.0,), (1e4,)], "a double").select(decide.ood_score(ref)).collect()
    assert low[0] < high[0]


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.5), (0, 0.5), (1, 0.9)], "y int, p double")
    assert metrics.roc_auc(df, "y", "p").first()[0] == pytest.approx(0.875)


def test_fit_save_load_predict(spark, tmp_path):
    df = spark.range(600).selectExpr("id", "CAST(id % 20 AS double) AS x", "CASE WHEN id % 20 > 9 THEN 'yes' ELSE 'no' END AS y")
    model = learn.fit(df, learn.FitConfig(target="y", key="id", trees=3, calibration="sigmoid"))
    assert model.metrics["f1"] > 0.9 and model.calibrator.method == "sigmoid" and model.metrics["coverage"] > 0.85
    assert model.metrics["calibration"]["rows"] > 50 and model.drift_report(df)["severity"] == "stable"
    path = str(tmp_path / "m")
    model.save(spark, path)
    again = learn.FittedModel.load(spark, path)
    assert again.predict(df, ["id"]).orderBy("id").collect() == model.predict(df, ["id"]).orderBy("id").collect()
    assert again.predict_sets(df, ["id"]).where("size(classes) = 0").count() == 0
    learn.report(model, df, str(tmp_path / "r"))
    assert "<svg" in (tmp_path / "r" / "report.html").read_text() and learn.importance(model)[0][0] == "x"
    assert learn.permutation_importance(model, df)[0][1] > 0.1
    data = next((tmp_path / "m" / "learner_label").rglob("part-*"))
    data.write_bytes(data.read_bytes() + b"x")
    with pytest.raises(DataError):
        learn.FittedModel.load(spark, path)


def test_fit_by_group_and_time(spark):
    df = spark.range(800).selectExpr("id", "id % 40 AS g", "CAST(id % 7 AS double) AS x", "timestamp_seconds(1000000 + id) AS t", "CAST(id % 7 + (id % 3) * 0.1 AS double) AS y")
    model = learn.fit(df, learn.FitConfig(target="y", key="id", group="g", task="ranking", learner="linear", features=["x"]))
    assert model.metrics["ndcg_5"] > 0.9 and model.predict_ranked(df, ["id"]).where("rank = 1").count() == 40
    late = learn.fit(df, learn.FitConfig(target="y", key="id", time="t", task="regression", trees=3, depth=3, features=["x"], fill="mean", scaling="robust", early_stopping=True))
    assert late.metrics["r2"] > 0.8 and 0.8 < late.metrics["coverage"] <= 1


def test_uneven_classes_are_weighted(spark):
    df = spark.range(2000).selectExpr("id", "CAST(id % 50 AS double) AS x", "CASE WHEN id % 50 = 7 THEN 'rare' ELSE 'common' END AS y")
    assert tuning.class_weights(df, "y")["rare"] == pytest.approx(25)
    model = learn.fit(df, learn.FitConfig(target="y", key="id", trees=4, objective="recall"))
    assert model.metrics["recall"] > 0.9
    with pytest.raises(DataError):
        learn.fit(df.where("x <> 7 OR id = 7"), learn.FitConfig(target="y", key="id"))


def test_search_keeps_the_baseline_unless_it_gains():
    flat = tuning.search("gbt", lambda params, k: 0.8, 3, 5, True)
    assert not flat.tuned and flat.params == tuning.default_params("gbt")
    deep = tuning.search("gbt", lambda params, k: params["depth"] / 10 + k / 100, 3, 12, True)
    assert deep.tuned and deep.params["depth"] > 5 and any(t["pruned"] for t in deep.trials)
    clock = iter(range(100))
    assert len(tuning.search("gbt", lambda params, k: 1.0, 1, 50, True, deadline=tuning.Deadline(3, lambda: next(clock))).trials) < 5


def test_model_choice():
    assert tuning.select_model(1000, 10, 3, {}, "binary")[0] == "forest" and tuning.select_model(10 ** 6, 10, 3, {}, "binary")[0] == "gbt"
    assert tuning.n_trials(1000, 5, 8) == 8 and tuning.n_trials(1000, 5, 2) == 6 and tuning.n_trees(10 ** 6) == 120
    with pytest.raises(ConfigError):
        tuning.primary_metric("binary", "charm")


def test_splits(spark):
    tied = spark.createDataFrame([(i, 5 if i > 4 else i) for i in range(10)], "id long, s long").selectExpr("id", "timestamp_seconds(s) AS t")
    assert split.split_temporal(tied, "t", "id").where("is_test").count() == 2
    same = spark.range(10).selectExpr("id", "timestamp_seconds(7) AS t")
    assert split.split_temporal(same, "t", "id").where("is_test").count() == 2
    with pytest.raises(DataError):
        split.split_temporal(same.withColumn("t", F.when(F.col("id") > 3, F.col("t"))), "t", "id")
    uneven = spark.range(1000).selectExpr("id", "CASE WHEN id < 10 THEN 'b' ELSE 'a' END AS y")
    assert {r["y"]: r["count"] for r in split.stratified_sample(uneven, "id", "y", 0.1).groupBy("y").count().collect()} == {"a": 99, "b": 1}
    parts = split.split(uneven.withColumn("g", F.col("id") % 20), "id", "binary", ["y"], "stratified_group", group="g")
    assert parts.groupBy("g").agg(F.count_distinct("is_test").alias("n")).where("n > 1").count() == 0
    assert {r["fold"] for r in split.validation_folds(uneven, "id", "binary", "y").select("fold").distinct().collect()} == {-1, 0}
    few = split.validation_folds(uneven.where("id < 300"), "id", "binary", "y", k=4).groupBy("y", "fold").count().collect()
    assert len(few) == 8 and split.calibration_split(uneven.where("id < 70"), "id") is None
    with pytest.raises(ConfigError):
        split.split(uneven, "id", "binary", ["y"], "group")


def test_validation(spark):
    df = spark.createDataFrame([(i, "a" if i else "b", 1.0) for i in range(20)], "id long, y string, x double")
    with pytest.raises(DataError):
        validate.target_support(df, "binary", ["y"], 0.2)
    with pytest.raises(DataError):
        validate.task_shape(df, "regression", ["y"])
    with pytest.raises(DataError):
        validate.after_split(df.withColumn("is_test", F.col("y") == "b"), "binary", ["y"])
    mixed = spark.createDataFrame([("2024-01-05",), ("05.01.2024",), ("2024/01/05",), (None,)], "t string")
    assert {str(r[0]) for r in validate.mixed_dates(mixed, ["t"]).collect()} == {"2024-01-05 00:00:00", "None"}
    with pytest.raises(DataError):
        validate.mixed_dates(spark.createDataFrame([("soon",)], "t string"), ["t"])
    facts = {"columns": ["a", "b", "c", "d", "e"], "constant": ["a"], "duplicate_groups": [["b", "c"]], "id_like": ["d"], "leakage": ["e"]}
    assert validate.columns_to_drop(facts) == ["a", "c", "d"] and validate.columns_to_drop(facts, "none", "drop") == ["e"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    assert quality.missing_rates(df).first()["missing_rate"] == pytest.approx(2 / 3)
    assert rows.drop_missing_targets(df, ["x"]).count() == 1
    with pytest.raises(DataError):
        rows.drop_missing_targets(df.where("x IS NOT NULL"), ["x"], "error")
    assert [r[1] for r in clean.missing_indicators(df, ["x"]).collect()] == [1, 1, 0]


def test_exact_quantiles_of_large_data(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=5000), rng.integers(0, 3, 5000)
    df = spark.createDataFrame([(float(a), int(b), None) for a, b in zip(x, y, strict=True)], "a double, b int, c double").repartition(4)
    cols = {c: F.col(c).cast("double") for c in ("a", "b", "c")}
    points = [0.0, 0.01, 0.25, 0.5, 0.9, 0.995, 1.0]
    small = columns.exact_quantiles(df, cols, points)
    monkeypatch.setattr(columns, "DIRECT_BYTES", 0)
    large = columns.exact_quantiles(df, cols, points)
    assert large["c"] is None and small["c"] is None
    for c, v in (("a", x), ("b", y)):
        assert large[c] == pytest.approx(small[c]) and large[c] == pytest.approx(np.quantile(v, points))


def test_summary_of_large_data_sorts_near_the_quartiles(spark, monkeypatch):
    """A table of some hundred MB isn't sorted in one task, and the summary of large data is the same."""
    assert columns.is_large(spark.range(40_000_000).selectExpr("CAST(id AS DOUBLE) AS x", "id"))
    df = spark.createDataFrame([(float(i * 37 % 1009), i % 3, None) for i in range(3000)], "a double, b int, c double").repartition(4)
    small = sorted(map(tuple, quality.numeric_summary(df).collect()))
    monkeypatch.setattr(columns, "DIRECT_BYTES", 0)
    large = quality.numeric_summary(df)
    assert "percentile(" not in large._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, large.collect())) == small


def test_drift_of_empty_columns(spark):
    df = spark.createDataFrame([(None, "a"), (None, None)], "x double, c string")
    ref = decide.numeric_reference(df, ["x"])
    assert ref["x"]["median"] == 0 and ref["x"]["p"] == [1.0]
    now = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, c string")
    assert 0 <= decide.numeric_drift(ref, now)[0]["score"] <= 1
    assert decide.numeric_drift(decide.numeric_reference(now, ["x"]), df)[0]["psi"] == 1.0
    nulls = spark.createDataFrame([("a",)] * 4, "c string")
    assert decide.categorical_drift(nulls, spark.createDataFrame([(None,)] * 3 + [("a",)], "c string"), "c")["unknown_rate"] == pytest.approx(0.75)


def test_imputation_by_neighbours_and_regressions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    x[:, 2] = 2 * x[:, 0] - x[:, 1] + 0.01 * rng.normal(size=60)
    holes = x.copy()
    holes[::7, 2] = np.nan
    holes[3::9, 0] = np.nan
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in row)) for i, row in enumerate(holes)], "id long, a double, b double, c double")
    state = clean.knn_reference(df, ["a", "b", "c"], "id")
    got = np.array([tuple(r)[1:] for r in clean.knn_impute(df, state).orderBy("id").collect()])
    assert state["k"] == 7
    for i, j in zip(*np.nonzero(np.isnan(holes)), strict=True):
        near = []
        for k in range(60):
            both = ~np.isnan(holes[i]) & ~np.isnan(holes[k])
            if both.any() and not np.isnan(holes[k, j]):
                near.append((np.sqrt(((holes[i] - holes[k])[both] ** 2).sum() * 3 / both.sum()), k))
        near = sorted(near)[:7]
        assert got[i, j] == pytest.approx(sum(holes[k, j] / d for d, k in near) / sum(1 / d for d, _ in near))
    filled = np.array([tuple(r)[1:] for r in clean.iterative_impute(df, clean.iterative_state(df, ["a", "b", "c"])).orderBy("id").collect()])
    told = np.isnan(holes).sum(1) < 2  # two of three values can't be told from one
    assert np.abs(filled - x)[told].max() < 0.3 and (filled[~np.isnan(holes)] == x[~np.isnan(holes)]).all()


def test_label_encoders(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), (None, "x")], "y string, z string")
    e = clean.LabelEncoder().fit(df, "y")
    assert [r["c"] for r in e.transform(df, "y", "c").collect()] == [1, 0, None]
    with pytest.raises(DataError):
        e.transform(spark.createDataFrame([("q",)], "y string"), "y", "c")
    assert [r["z"] for r in clean.MultiLabelEncoder().fit(df, ["y", "z"]).transform(df).collect()] == [0, 1, 0]
    with pytest.raises(DataError):
        clean.MultiLabelEncoder().fit(df.where("y = 'a'"), ["y"])


def test_ladders_and_best_thresholds(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    p = np.clip(0.3 * y + 0.5 * rng.random(400), 0, 1).round(3)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist(), strict=True)), "y int, p double")
    grid = [i / 100 for i in range(1, 100)]
    f1 = lambda t: 2 * ((p >= t) & (y == 1)).sum() / ((p >= t).sum() + y.sum())
    assert decide.best_threshold(df, "y", "p", "f1") == max(grid, key=lambda t: (f1(t), -t))
    ladder = decide.threshold_ladder(df, "y", "p", 4).collect()
    assert [r["threshold"] for r in ladder] == sorted(r["threshold"] for r in ladder) and len(ladder) == 4
    assert all(r["precision"] == pytest.approx(((p >= r["threshold"]) & (y == 1)).sum() / (p >= r["threshold"]).sum()) for r in ladder)
    assert decide.best_threshold(df.where("y = 1"), "y", "p") == 0.5
    three = df.selectExpr("y", "array(1 - p, p) AS q")
    assert len(decide.reject_ladder(three, "y", "q", 3)) == 3 and 0 <= decide.best_reject_threshold(three, "y", "q") < 1


def test_calibrators(spark):
    rng = np.random.default_rng(8)
    p = rng.random(3000)
    y = (rng.random(3000) < p ** 2).astype(int)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist(), strict=True)), "y int, p double")
    for method in ("sigmoid", "isotonic"):
        c = learn.fit_calibrator(df, [("y", "p")], method)
        out = df.withColumn("p", c.apply(F.col("p")))
        assert metrics.log_loss(out, "y", "p").first()["log_loss"] < metrics.log_loss(df, "y", "p").first()["log_loss"] - 0.02
    many = df.selectExpr("y", "array(p / 2, 1 - p, p / 2) AS q")
    c = learn.Calibrator("sigmoid", [(1.0, 0.0), (2.0, 0.5), (0.5, -1.0)])
    assert many.select(F.aggregate(c.apply_all(F.col("q")), F.lit(0.0), lambda a, x: a + x).alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    assert learn.fit_calibrator(df.where("y = 1"), [("y", "p")], "isotonic").parts[0] == ([0.0], [1.0])


def test_metrics_by_hand(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 300), rng.random(300).round(2)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist(), strict=True)), "y int, p double")
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert metrics.roc_auc(df, "y", "p").first()[0] == pytest.approx(np.mean(pairs))
    assert metrics.compute("roc_auc", df, "y", p="p") == pytest.approx(np.mean(pairs))
    ordered = sorted(set(p), reverse=True)
    step, last = 0.0, 0.0
    for t in ordered:
        recall = ((p >= t) & (y == 1)).sum() / y.sum()
        step, last = step + (recall - last) * ((p >= t) & (y == 1)).sum() / (p >= t).sum(), recall
    assert metrics.average_precision(df, "y", "p").first()[0] == pytest.approx(step)
    found = metrics.diagnostics(df.withColumn("said", (F.col("p") > 0.5).cast("int")), "y", "said", "p")
    assert sum(r["n"] for r in found["confusion"]) == 300 and found["roc"][-1]["tpr"] == 1
    with pytest.raises(ConfigError):
        metrics.compute("charm", df, "y")


def test_ensemble_choices(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 600)
    noise = [np.clip(0.5 + (y - 0.5) * s + 0.3 * rng.normal(size=600), 0.01, 0.99) for s in (0.5, 0.5, 0.1)]
    rows_ = [(i, float(y[i]), *(float(n[i]) for n in noise), float(noise[0][i])) for i in range(600)]
    df = spark.createDataFrame(rows_, "id long, label double, p_0 double, p_1 double, p_2 double, p_3 double")
    chosen = ensemble.select_diverse(df, ["p_0", "p_1", "p_2", "p_3"], "binary")
    assert {"p_0", "p_1"} <= {c if c != "p_3" else "p_0" for c in chosen} and len({"p_0", "p_3"} & set(chosen)) == 1
    weights, best = ensemble.voting_weights(df, ["p_0", "p_1"], "binary")
    assert sum(weights) == pytest.approx(1) and best[0] >= ensemble.vectors(df, ["p_0"], "binary")[0][0] - 0.005
    assert ensemble.compare((0.5, 0.9), (0.502, 0.8)) == 1 and ensemble.compare((0.5,), (0.5,)) == 0
    stack = ensemble.fit_stack(df, ["p_0", "p_1"], "binary")
    assert metrics.roc_auc(ensemble.apply_stack(stack, df, ["p_0", "p_1"], "binary", "s"), "label", "s").first()[0] > 0.85
    assert ensemble.clear_winner([0.9, 0.5]) == 0 and ensemble.clear_winner([0.9, 0.899]) is None
    assert ensemble.fusion_strategy("auto", {"a": [], "b": []}) == "hybrid" and len(ensemble.candidate_pool(["a", "b", "c"], {"m": ["a", "b"], "n": ["b", "c"]})) <= 12


def test_modalities_and_budget(spark):
    df = spark.createDataFrame([(i, "some words that go on and on for a while " + str(i), f"/x/{i}.png", "red") for i in range(30)], "id long, body string, picture string, colour string")
    assert multimodal.resolve_modalities(df, skip=("id",)) == {"body": "text", "picture": "image"}
    budget = multimodal.resolve_budget("auto", 0.5)
    assert budget.total == 640 and budget.limit_for("text", ["text", "image"]) == int(640 * 0.4 / 0.64)
    with pytest.raises(ConfigError):
        multimodal.resolve_budget(7)
    assert multimodal.value_modality(b"RIFF0000WAVE") == "audio" and multimodal.value_modality(np.zeros((4, 5, 3))) == "image"


def test_multimodal_pipeline_and_cache(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows_ = [(i, ("good fine words here" if i % 2 else "bad poor terms there") + f" number {i} in a longer line of text", (rng.random(16) * (0.3 if i % 2 else 1)).tolist() if i % 5 else None, i % 2) for i in range(90)]
    df = spark.createDataFrame(rows_, "id long, body string, picture array<double>, y int")
    pipe = multimodal.MultimodalPipeline(multimodal.resolve_budget(48), {"body": "text", "picture": "image"}, shapes={"picture": {"height": 4, "width": 4}}).fit(df, "id", "y", ["0", "1"], 0.9)
    out = pipe.transform(df, "id")
    assert "picture__source_missing" in out.columns and 4 < len(out.columns) <= 2 + 48 + 24 and any(c.startswith("pls_") for c in out.columns)
    assert out.where("picture__source_missing = 1").count() == 18 and set(pipe.groups) == {"modality:text", "modality:image"}
    path = str(tmp_path / "cache")
    compute = lambda d: multimodal.media_features(d, "picture", "image", 5, height=4, width=4).drop("picture__error")
    first = multimodal.cached_features(df, "picture", compute, path)
    assert first.where("picture IS NOT NULL AND size(picture__features) = 5").count() == 72
    assert multimodal.cached_features(df, "picture", compute, path).count() == 90 and spark.read.parquet(path).count() == 72


def test_embeddings_of_a_model_of_ones_own(spark):
    df = spark.createDataFrame([(i, "ab" * (i % 7) + "c" * (i % 3)) for i in range(60)], "id long, t string")
    embed = lambda c: F.array(F.length(c).cast("double"), F.regexp_count(c, F.lit("a")).cast("double"), F.lit(1.0))
    out = df.select(multimodal.embedding_features(df, "t", embed, 2).alias("e")).collect()
    x = np.array([r["e"] for r in out])
    assert x.shape == (60, 2) and abs(x.mean(0)).max() < 1e-6 and x[:, 0].std() > x[:, 1].std()
    made = multimodal.TextExtractor(60, "hybrid").fit(df, "id", "t", embed).transform(df, "id", "t", embed)
    assert made.where(F.size("t__features") > 40).count() == 60


def test_media_is_decoded():
    import io
    import wave
    import zlib

    pixels = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    lines = [bytes([0]) + pixels[0].tobytes()]
    for y in range(1, 4):
        up = (pixels[y].astype(int) - pixels[y - 1]).astype(np.uint8)
        lines.append(bytes([2]) + up.tobytes())
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (5).to_bytes(4, "big") + (4).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (media.read_png(png) == pixels).all() and media.read_image(b"P5 2 1 255\n\x00\xff")[0, 1, 0] == 1
    with io.BytesIO() as f:
        with wave.open(f, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(16000)
            w.writeframes((np.sin(np.arange(16000) * 2 * np.pi * 1000 / 16000) * 20000).astype("<i2").tobytes())
        features = dict(zip(media.AUDIO, media.audio_features(f.getvalue()), strict=True))
    assert features["seconds"] == pytest.approx(1) and features["centroid_mean"] == pytest.approx(1000, rel=0.15) and features["band_1000_2000"] + features["band_500_1000"] > 0.9
    named = dict(zip(media.IMAGE, media.image_features(np.full((6, 8), 0.5)), strict=True))
    assert named["width"] == 8 and named["contrast"] == 0 and named["brightness"] == pytest.approx(0.5)
    assert len(media.video_features(np.zeros((5, 4, 4)))) == len(media.VIDEO) and sorted(media.feature_order("audio")) == sorted(media.AUDIO)


def test_error_policy_of_media(spark):
    df = spark.createDataFrame([(b"no image",), (None,), (b"P5 1 1 255\n\xff",)], "b binary")
    told = df.select(media.image("b", policy="warn").alias("m")).select("m.*").collect()
    assert told[0]["error"] and told[0]["features"] == [0.0] * len(media.IMAGE) and told[1]["error"] is None and any(told[2]["features"])
    with pytest.raises(Exception, match="error|Error|identify|PIL"):
        df.select(media.image("b", policy="error").alias("m")).collect()


def test_config_is_checked():
    with pytest.raises(ConfigError):
        learn.FitConfig(target="y", key="id", task="poetry")


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    assert tables.load_table(spark, str(tmp_path / "t.csv")).count() == 2
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert tables.load_table(spark, str(tmp_path / "t.tsv")).columns == ["a", "b"]
    (tmp_path / "c.json").write_text('{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}')
    assert [tuple(r) for r in tables.load_table(spark, str(tmp_path / "c.json")).select("a", "b").collect()] == [(1, "x"), (2, "y")]
    (tmp_path / "r.json").write_text('[{"a": 1}, {"a": 2}]')
    assert tables.load_table(spark, str(tmp_path / "r.json")).count() == 2
    import pandas as pd
    import pyarrow.feather

    pyarrow.feather.write_feather(pd.DataFrame({"a": [1, 2, 3]}), str(tmp_path / "f.feather"))
    assert tables.load_table(spark, str(tmp_path / "f.feather")).count() == 3
    pd.DataFrame({"a": [1]}).to_pickle(tmp_path / "p.pkl")
    assert tables.load_table(spark, str(tmp_path / "p.pkl"), trusted=True).count() == 1
    for bad in ("p.pkl", "absent.csv", "t.xyz"):
        with pytest.raises(DataError):
            tables.load_table(spark, str(tmp_path / bad))
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "1.txt").write_text("x")
    assert tables.load_folder(spark, str(tmp_path), "*.txt").first()["label"] == "cat"
    texts = spark.createDataFrame([("path:" + str(tmp_path / "cat" / "1.txt"),), ("plain",)], "t string")
    assert {r["t"] for r in tables.read_texts(texts, "t").collect()} == {"x", "plain"}


def test_inputs(spark):
    assert tables.single_or_many(spark, {"a": 1}, ["a"])[1] and not tables.single_or_many(spark, [{"a": 1}], ["a"])[1]
    frame, one = tables.single_or_many(spark, np.array([[1.0, 2.0], [3.0, 4.0]]), ["a", "b"])
    assert not one and frame.count() == 2 and tables.single_or_many(spark, [1.0, 2.0], ["a", "b"])[1]
    for bad in ([], [(1,)], np.zeros((2, 2, 2))):
        with pytest.raises(DataError):
            tables.prediction_input(spark, bad, ["a", "b"])
    made = tables.raw_samples(spark, ["x", "y"], [1, 0])
    assert [tuple(r) for r in made.orderBy("id").select("sample", "label").collect()] == [("x", 1), ("y", 0)]
    assert tables.raw_samples(spark, [(8000, np.zeros(4))], modality="audio").first()["sample"]["rate"] == 8000
    with pytest.raises(DataError):
        tables.raw_samples(spark, ["x"], [1, 2])
    assert tables.predictions_text(made.select("sample")).startswith("sample")


def test_motion_of_still_frames_is_zero():
    assert media.motion_features([np.ones((3, 3, 1))] * 4)[0] == 0


def test_entry_works_without_the_llm_folders(tmp_path):
    """A copy of the repository without the subpackage, its tests and the pipeline still imports and gives the engine's queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
