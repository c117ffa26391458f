"""That work is dealt over all tasks, and passes aren't repeated, at sizes where that matters."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns, media, textcount
from tessera.operators import boosting, ensemble, learn, split, text, tuning
from tessera.sources import tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stratified_split_does_not_gather_classes(spark):
    """Rows keep their partitions: two classes would fill two tasks."""
    df = spark.range(4000).selectExpr("id", "CAST(id % 2 AS STRING) AS y").repartition(8)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        parts = split.split_stratified(df, "id", "y")
        assert "SortMergeJoin" not in _plan(parts) and parts.rdd.getNumPartitions() == 8
        assert {r["y"]: r["n"] for r in parts.where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()} == {"0": 400, "1": 400}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_exact_quantiles_of_large_data_use_no_percentile(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=4000), rng.integers(0, 4, 4000) / 8
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double").repartition(4)
    points = [0.0, 0.005, 0.1, 0.25, 0.5, 0.75, 0.995, 1.0]
    monkeypatch.setattr(columns, "DIRECT_BYTES", 0)
    monkeypatch.setattr(columns.F, "percentile", lambda *_: pytest.fail("a percentile of all rows"))
    found = columns.exact_quantiles(df, {c: columns.finite(c) for c in "ab"}, points)
    for c, v in (("a", x), ("b", y)):
        assert found[c] == pytest.approx(np.quantile(v, points))


def test_scores_travel_as_arrow():
    x = np.arange(24.0).reshape(2, 3, 4)
    assert boosting._lists(x).to_pylist() == x.tolist() and boosting._lists(x[:, 0]).to_pylist() == x[:, 0].tolist()
    assert boosting._matrix(pa.array([[1.0, None], [3.0, 4.0]]).slice(1)).tolist() == [[3.0, 4.0]]


def test_ensemble_deals_folds_once(spark, monkeypatch):
    """All candidates of all folds read kept rows, not the windows that dealt the folds."""
    seen = []

    def stop(pool, df, *_):
        seen.append(df.storageLevel.useMemory)
        raise InterruptedError

    monkeypatch.setattr(ensemble, "out_of_fold", stop)
    with pytest.raises(InterruptedError):
        ensemble.train(spark.range(10).selectExpr("id", "CAST(id AS DOUBLE) AS x", "0 AS fold", "1.0D AS label"), ["x"], "binary", "id", families=("linear",))
    assert seen == [True]


def test_tfidf_shuffles_no_texts_and_keeps_shared_keys(spark):
    texts = [(1, "b a A ß b"), (2, "a c"), (3, None), (4, "  "), (5, "c b")]
    df = spark.createDataFrame(texts, "id long, t string")
    each = text._counted(df, "id", "t")
    assert "Exchange" not in _plan(each)
    assert {tuple(r) for r in each.collect()} == {(1, "a", 2), (1, "b", 2), (1, "ß", 1), (2, "a", 1), (2, "c", 1), (5, "b", 1), (5, "c", 1)}
    shared = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "a b")], "id long, t string")
    found = {(r["__key"], r["__word"]): (r["df"], round(r["score"], 9)) for r in text._weighted(shared, "id", "t", 1, 1.0).collect()}
    assert found[1, "a"] == (2, round((1 + np.log(2)) * (np.log(4 / 3) + 1), 9)) and len(found) == 4


def test_features_of_text_and_media_are_made_in_small_parts(spark, monkeypatch):
    """Texts become Python strings some at a time, and features no Python lists; results don't depend on it."""
    seen, real = [], textcount.features
    monkeypatch.setattr(textcount, "features", lambda texts: seen.append(len(texts)) or real(texts))
    monkeypatch.setattr(textcount.F, "arrow_udf", lambda _: lambda run: lambda c: run)
    run = textcount.handcrafted(F.lit(""))
    words = pa.array([f"w{i} x" if i % 7 else None for i in range(600)])
    assert np.array(run(words).to_pylist()) == pytest.approx(real(words.to_pylist())) and max(seen) <= textcount.ROWS
    monkeypatch.setattr(media.F, "arrow_udf", lambda _: lambda run: lambda c: run)
    made = media.guarded(lambda x: [x.sum(), len(x)], 2, "warn")(None)(pa.array([[1.0, 2.0], None, [], [4.0]])).to_pylist()
    assert made == [{"features": [3.0, 2.0], "error": None}] + [{"features": [0.0, 0.0], "error": None}] * 2 + [{"features": [4.0, 1.0], "error": None}]


def test_vectors_make_no_terms_outside_the_vocabulary(monkeypatch):
    texts = ["one two one two three", None, "", "Òne twó", "two one", "??", "three " * 4 + "one"] * 3
    names, *_ = text._terms(texts)["words"]
    grams, *_ = text._terms(texts)["chars"]
    terms = {"words": [*names[::2], "absent one", "absent"], "chars": [*grams[::3], "zzz"]}
    made = text.Lexical(terms, {k: [1 + i / 8 for i in range(len(v))] for k, v in terms.items()}, np.zeros((0, 0)), [])
    want, column = np.zeros((len(texts), made.width)), 0
    for kind, _, _ in text.KINDS:
        every, doc, term, times = text._terms(texts)[kind]
        for d, t, n in zip(doc, term, times, strict=True):
            if every[t] in terms[kind]:
                want[d, column + terms[kind].index(every[t])] = n * made.idf[kind][terms[kind].index(every[t])]
        column += len(terms[kind])
    size = np.sqrt((want * want).sum(1, keepdims=True))
    monkeypatch.setattr(text, "_terms", lambda *_: pytest.fail("every term is made"))
    assert (made.vectors(texts) == want / np.where(size > 0, size, 1.0)).all() and made.vectors([]).shape == (0, made.width)
    assert text.Lexical({"words": [], "chars": []}, {"words": [], "chars": []}, np.zeros((0, 0)), []).vectors(texts).shape == (len(texts), 0)


def test_a_matrix_beyond_memory_is_fitted_and_noted(spark, monkeypatch):
    """Kept rows go to disk: no learner needs the matrix in memory, so size is no error."""
    monkeypatch.setattr(learn.tuning, "resource_plan", lambda _: tuning.ResourcePlan(4, 1, 1, 4))
    df = spark.range(400).selectExpr("id", "CAST(id % 17 AS DOUBLE) AS x", "CAST(id % 17 * 2 AS DOUBLE) AS y")
    model = learn.fit(df, learn.FitConfig(target="y", key="id", task="regression", learner="linear"))
    assert any("matrix" in n for n in model.notes) and model.predict(df, ["id"]).count() == 400


def test_texts_are_written_by_their_own_tasks(spark, tmp_path):
    """One file a row in folders as Spark names them, without the checksum file and the move that Spark's writer spends on each."""
    rows = [("en", "one\ntwo"), ("en", ""), ("a/b:c", "Ö\U0001f600"), ("", "three")]
    folder = f"file://{tmp_path}/texts"
    assert tables.write_texts(spark.createDataFrame(rows, "lang string, text string").repartition(3), folder, "lang", "text") == 4
    read = tables.load_folder(spark, folder, "*.txt").select("label", F.decode("content", "UTF-8").alias("t"))
    assert {tuple(r) for r in read.collect()} == {("lang=en", "one\ntwo\n"), ("lang=en", "\n"), ("lang=a%2Fb%3Ac", "Ö\U0001f600\n"), ("lang=__HIVE_DEFAULT_PARTITION__", "three\n")}
    assert not list(tmp_path.rglob("*.crc"))
