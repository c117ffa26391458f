import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tessera.functions import shared, textcount
from tessera.functions import text as T
from tessera.operators import clean, correlate, learn, multimodal, neighbours, profile, text, tuning
from tessera.sources import tables


def frame(spark, x):
    names = [f"c{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names)).repartition(3), names


def test_correlations_of_many_columns(spark, monkeypatch):
    monkeypatch.setattr(correlate, "TILE", 16)
    monkeypatch.setattr(correlate, "HELD", 6 * 8 * 16 * 16 * 4)  # several passes
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 60)) + 1e6
    x[:, 7] = 5.0
    x[:, 9] = x[:, 8] * -2 + 3
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 11] = np.nan
    df, names = frame(spark, x)
    got = {(r["first"], r["second"]): r["corr"] for r in correlate.correlations(df, names).collect()}
    assert len(got) == 60 * 59 // 2
    for i in range(60):
        for j in range(i + 1, 60):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            want = None if both.sum() < 2 or a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]
            assert got[f"c{i}", f"c{j}"] == (None if want is None else pytest.approx(want, abs=1e-9))
    assert {(r["first"], r["second"]) for r in profile.high_correlations(df, names).collect()} == {("c8", "c9")}
    assert clean.near_duplicate_columns(df, names) == ["c9"]


def test_five_hundred_columns_in_one_pass(spark):
    rng = np.random.default_rng(2)
    df = spark.range(300).select(F.array(*[F.rand(i) for i in range(4)]).alias("r"), "id").select(*[(F.get("r", F.lit(i % 4)) * (i + 1) + F.rand(1000 + i) * 0.1).alias(f"c{i}") for i in range(500)])
    df = df.persist()
    got = correlate.correlations(df, [f"c{i}" for i in range(500)]).where("abs(corr) > 0.99").count()
    x = np.array(df.collect())
    c = np.corrcoef(x.T)
    assert got == int((np.abs(np.triu(c, 1)) > 0.99).sum()) and rng is not None


def test_equal_columns_by_fingerprints(spark):
    df = spark.createDataFrame([(1, "1", None, 2.0, None, "null"), (2, "2", "x", 2.0, "x", "x"), (2, "2", None, 3.0, None, "y")], "a int, b string, c string, d double, e string, f string")
    df = df.withColumn("a.b", F.col("c")).repartition(2)
    assert correlate.equal_columns(df, df.columns) == [("a", "b"), ("c", "e"), ("c", "a.b"), ("e", "a.b")]
    assert profile.duplicate_groups(df, df.columns) == [["a", "b"], ["c", "e", "a.b"]]


def test_profile_of_names_with_dots(spark):
    df = spark.range(60).selectExpr("id AS `k.id`", "CAST(id % 7 AS double) AS `a.b`", "CAST(id % 7 AS double) AS c", "CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END AS `y.z`")
    facts = profile.profile(df, "y.z")
    assert facts["targets"] == ["y.z"] and facts["duplicate_groups"] == [["a.b", "c"]] and set(facts["roles"]) == {"k.id", "a.b", "c"}


@pytest.mark.parametrize("rows,part", [(2048, 512), (16, 5)])
def test_neighbours_among_all_rows(spark, monkeypatch, rows, part):
    monkeypatch.setattr(neighbours, "ROWS", rows)
    monkeypatch.setattr(neighbours, "PART", part)
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(300, 4)) * [5, 1, 1, 1], rng.integers(0, 3, (60, 4)).astype(float)))  # with many ties
    x[rng.random(x.shape) < 0.25] = np.nan
    x[5] = np.nan
    x[:, 3] = np.where(np.arange(len(x)) % 9 == 0, x[:, 3], np.nan)
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double").repartition(4)
    state = clean.knn_reference(df, ["a", "b", "c", "d"], "id")
    got = np.array([tuple(r)[1:] for r in clean.knn_impute(df, state).orderBy("id").collect()], float)
    medians = [np.nanmedian(x[:, j]) for j in range(4)]
    for i, j in zip(*np.nonzero(np.isnan(x)), strict=True):
        near = []
        for k in np.flatnonzero(~np.isnan(x[:, j])):
            both = ~np.isnan(x[i]) & ~np.isnan(x[k])
            if both.any():
                d = 0.0
                for c in np.flatnonzero(both):
                    d += (x[i, c] - x[k, c]) ** 2
                near.append((d / both.sum() * 4, k))
        near = sorted(near)[: state["k"]]
        if not near:
            want = medians[j]
        elif near[0][0] == 0:
            want = np.mean([x[k, j] for d, k in near if d == 0])
        else:
            want = sum(x[k, j] / d ** 0.5 for d, k in near) / sum(d ** -0.5 for d, k in near)
        assert got[i, j] == pytest.approx(want)
    assert (got[~np.isnan(x)] == x[~np.isnan(x)]).all()


def test_blocks_that_are_too_far_are_not_met(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack((rng.random(20_000) * 1000, rng.random(20_000)))
    rows = [(i, float(a), None if i % 50 == 0 else float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(4)
    width, near = 2, neighbours.numbered(df, ["a", "b"], "id")
    held = neighbours.blocks(near, width, [0, 1]).collect()
    boxes = neighbours.Boxes([r.asDict() for r in held], width)
    one = next(r for r in held if r["pattern"] == "10")
    assert (boxes.bound(neighbours._there("10"), np.array([500.0, 0]), np.array([501.0, 0])) > 100).sum() > len(held) / 2 and one["n"] <= neighbours.ROWS
    state = clean.knn_reference(df, ["a", "b"], "id")
    got = {r["id"]: r["b"] for r in clean.knn_impute(df, state).where("id % 5000 = 0").collect()}
    for i in (0, 5000, 10_000):
        others = np.arange(20_000)[np.arange(20_000) % 50 != 0]
        d = np.abs(x[others, 0] - x[i, 0])
        order = np.argsort(d, kind="stable")[:8]
        assert got[i] == pytest.approx((x[others[order], 1] / d[order]).sum() / (1 / d[order]).sum())


def test_equal_rows_are_looked_up_once(spark, monkeypatch):
    """Copies of rows add neither lookups nor reference rows beyond k each, and change no result."""
    rows = [(i, float(i % 5), None if i % 7 == 0 else float(i % 35), None if i % 11 == 0 else float(i % 3)) for i in range(3850)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(4)
    seen, blocks = [], neighbours.blocks

    def counted(some, *args):
        seen.append(some.count())
        return blocks(some, *args)

    monkeypatch.setattr(neighbours, "blocks", counted)
    state = clean.knn_reference(df, ["a", "b", "c"], "id")
    got = clean.knn_impute(df, state).orderBy("id").collect()
    points = {r[1:] for r in rows}
    assert seen == [sum(None in p for p in points), sum(min(state["k"], sum(r[1:] == p for r in rows)) for p in points)] and len(got) == len(rows)
    for i in (7, 11, 77, 3773):
        for j in (j for j in (2, 3) if rows[i][j] is None):
            near = []
            for o in (o for o in rows if o[j] is not None):
                both = [c for c in (1, 2, 3) if rows[i][c] is not None and o[c] is not None]
                near.append((sum((rows[i][c] - o[c]) ** 2 for c in both) / len(both) * 3, o[0], o[j]))
            near = sorted(near)[: state["k"]]
            assert near[0][0] == 0 and got[i][j] == pytest.approx(np.mean([v for d, _, v in near if d == 0]))


def test_a_bundle_holds_its_neighbours(spark, tmp_path):
    df = spark.range(300).selectExpr("id", "CAST(id % 20 AS double) AS x", "CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(id % 20 AS double) * 2 END AS z", "CASE WHEN id % 20 > 9 THEN 'yes' ELSE 'no' END AS y")
    model = learn.fit(df, learn.FitConfig(target="y", key="id", trees=3, fill="knn", features=["x", "z"]))
    model.save(spark, str(tmp_path / "m"))
    again = learn.FittedModel.load(spark, str(tmp_path / "m"))
    assert again.cleaner.state["impute"]["path"].startswith(str(tmp_path))
    assert again.predict(df, ["id"]).orderBy("id").collect() == model.predict(df, ["id"]).orderBy("id").collect()


ODD = [None, "", " ", "   ", "aaa bbb\n\n\n\n", "Hello, World! 123 https://a.b/c x@y.org", "Σίσυφος Привет 漢字 ひらがな カタカナ 한국어 العربية", "a_b c1 22 ٣٤ ½", "!!! ??? ...", "Istanbul ﬁ é́   x", "…。！？", "€ + = $"]


def test_text_features_equal_the_expressions(spark):
    r = random.Random(5)
    pool = "abc ABC\n.,!? 0129éßñ漢あカ한Жع€+_-'@/:"
    texts = ODD + ["".join(r.choice(pool) for _ in range(r.randrange(200))) for _ in range(150)] + ["word " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    c = F.coalesce(F.col("t"), F.lit(""))
    blocks = [T.char_stats(c), T.ratios(c), T.scripts(c), T.patterns(c), T.diversity(c), T.shape(c)]
    made = {k: v for b in blocks for k, v in b.items()} | {"token_entropy": T.entropy(F.transform(T.words(c), F.lower)), "char_entropy": T.entropy(T.characters(c))}
    assert tuple(made) == textcount.NAMES
    want = {x["id"]: x for x in df.select("id", *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in made.items() if k not in ("token_entropy", "char_entropy", "hapax_ratio", "unique_ratio")]).collect()}
    slow = {x["id"]: x for x in df.where("length(t) < 300 OR t IS NULL").select("id", *[made[k].alias(k) for k in ("token_entropy", "char_entropy", "hapax_ratio", "unique_ratio")]).collect()}
    for x in df.withColumn("f", textcount.handcrafted(F.col("t"))).collect():
        got = dict(zip(textcount.NAMES, x["f"], strict=True))
        for rows in (want, slow):
            for k in (rows[x["id"]].asDict() if x["id"] in rows else {}):
                if k != "id":
                    assert got[k] == pytest.approx(rows[x["id"]][k], abs=1e-9), (x["t"], k)
    assert textcount.features([]).shape == (0, len(textcount.NAMES))


def test_repeats_by_pattern():
    r = random.Random(6)
    texts = ["".join(r.choice("aab\n\n ") for _ in range(r.randrange(40))) for _ in range(300)]
    got = textcount.features(texts)[:, textcount.NAMES.index("repeats")]
    assert got.tolist() == [len(regex.findall(r"([^\n])\1{2,}", t)) for t in texts]


def naive_terms(t):
    w = regex.findall(r"[\p{L}\p{N}_]+", t.translate(text._FOLD).lower())
    chars = [p[i: i + n] for p in (f" {x} " for x in w) for n in (3, 4, 5) for i in range(len(p) - n + 1)]
    return {"words": w + [f"{a} {b}" for a, b in zip(w, w[1:])], "chars": chars}


def test_lexical_factors_of_all_texts(spark):
    from collections import Counter

    r = random.Random(7)
    words = ["alpha", "béta", "gamma", "delta", "eps", "zeta", "eta", "Theta", "iota", "kappa"]
    texts = [" ".join(r.choice(words[(i % 3) * 3: (i % 3) * 3 + 4]) for _ in range(r.randrange(2, 30))) for i in range(120)] + [None, "", "??"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4)
    made = text.fit_lexical(df, "id", "t", dims=6)
    counts = {k: Counter() for k in ("words", "chars")}
    docs = {k: Counter() for k in counts}
    for t in texts:
        for k, v in naive_terms(t or "").items():
            counts[k].update(v)
            docs[k].update(set(v))
    for k, share, least in text.KINDS:
        best = sorted((t for t in counts[k] if least <= docs[k][t] <= 0.995 * len(texts)), key=lambda t: (-counts[k][t], t))[: int(64 * share)]
        assert made.terms[k] == best
        assert made.idf[k] == pytest.approx([np.log((len(texts) + 1) / (docs[k][t] + 1)) for t in best])
    x = np.zeros((len(texts), made.width))
    for i, t in enumerate(texts):
        own = naive_terms(t or "")
        row = [Counter(own[k])[term] * w for k in ("words", "chars") for term, w in zip(made.terms[k], made.idf[k], strict=True)]
        x[i] = np.array(row) / (np.linalg.norm(row) or 1.0)
    assert made.vectors(texts) == pytest.approx(x)
    s = np.linalg.svd(x, compute_uv=False)[:6]
    assert made.values == pytest.approx(s.tolist(), rel=0.01)
    got = np.array([r["f"] for r in made.transform(df, "t", "f").orderBy("id").collect()])
    assert np.linalg.norm(got, axis=0) == pytest.approx(s, rel=0.01)


def test_range_finder_on_a_wide_matrix(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(shared, "FAN", 2)  # the sums of the partitions meet in a tree
    rng = np.random.default_rng(8)
    x = ((rng.normal(size=(900, 40)) * np.exp(-np.arange(40) / 4)) @ rng.normal(size=(40, 300))).astype(np.float32)
    rows = spark.createDataFrame([(x[i: i + 100].tobytes(),) for i in range(0, 900, 100)], "x binary").repartition(9)
    v, values = text.right_factors(rows, 300, 8)
    want = np.linalg.svd(x.astype(float), full_matrices=False)
    assert values == pytest.approx(want[1][:8], rel=0.01) and v.T @ v == pytest.approx(np.eye(8), abs=1e-9)
    assert np.abs((want[2][:3] * v.T[:3]).sum(1)) == pytest.approx(np.ones(3), abs=1e-3) and pa is not None


def test_text_extractor(spark):
    df = spark.createDataFrame([(i, f"some {'fine' if i % 2 else 'poor'} words number {i}") for i in range(40)] + [(99, None)], "id long, t string")
    out = multimodal.TextExtractor(60).fit(df, "id", "t").transform(df, "id", "t")
    sizes = {len(r["t__features"]) for r in out.collect()}
    assert len(sizes) == 1 and 45 < sizes.pop() <= 60


def test_many_texts_by_path(spark, tmp_path):
    for i in range(2000):
        (tmp_path / f"{i}.txt").write_text(f"text {i} é")
    (tmp_path / "long.txt").write_text("h" * 3000 + "m" * 4000 + "t" * 3000)
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfeok")
    rows = [(i, f"path:{tmp_path}/{i % 2000}.txt") for i in range(20_000)] + [(-1, "plain"), (-2, f"path:{tmp_path}/none.txt"), (-3, None), (-4, f"path:file://{tmp_path}/long.txt"), (-5, f"path:{tmp_path}/bad.txt"), (-6, f"path:{tmp_path}")]
    got = {r["id"]: r for r in tables.read_texts(spark.createDataFrame(rows, "id long, t string").repartition(4), "t", 600).collect()}
    assert all(got[i]["t"] == f"text {i % 2000} é" for i in range(20_000))
    assert got[-1]["t"] == "plain" and got[-2]["t"] is None and "FileNotFound" in got[-2]["t__error"] and got[-3]["t"] is None and got[-3]["t__error"] is None
    assert got[-4]["t"][:200] == "h" * 200 and got[-4]["t"][-200:] == "t" * 200 and "m" * 200 in got[-4]["t"] and len(got[-4]["t"]) < 620
    assert got[-5]["t"].endswith("ok") and got[-6]["t__error"]


def test_densities_find_more_than_chance():
    import math

    def surface(p, k):
        return -((math.log(p["step"] / 0.07)) ** 2 + 0.075 * (p["depth"] - 6) ** 2 + ((p["min_rows"] - 30) / 40) ** 2 + 4 * (p["subsample"] - 0.85) ** 2)

    pairs = [[tuning.search("gbt", surface, 1, 30, True, seed, how=how).score for how in ("density", "random")] for seed in range(20)]
    assert sum(a > b for a, b in pairs) >= 14 and sum(a - b for a, b in pairs) > 0
    assert set(tuning.propose("linear", [], random.Random(1))) == {"ridge", "elastic"}
    for _ in range(50):
        p = tuning.propose("forest", [({"depth": 4 + i % 7, "min_rows": 2 + i, "subsample": 0.7 + i / 40}, float(i)) for i in range(9)], random.Random(3))
        assert 4 <= p["depth"] <= 10 and 2 <= p["min_rows"] <= 30 and 0.7 <= p["subsample"] <= 1


def test_many_small_files_share_tasks(spark, tmp_path):
    """The tasks that read a folder grow with the cores, not with the files."""
    for i in range(200):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        files = tables.load_folder(spark, str(tmp_path), "*.txt")
        assert files.rdd.getNumPartitions() <= max(64, 4 * spark.sparkContext.defaultParallelism) and files.count() == 200
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
