"""Registered queries of what comes in and goes out: files by path, caches, mixed types, exports, bundles, calibration of classes, metrics by name; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textcount
from ..functions.columns import cut_points, place_within
from ..functions.shared import fresh_path
from ..operators import clean, learn, metrics, multimodal, quality, validate
from ..sources import tables
from .extended import _three
from .registry import NUM, ORACLES, QUERIES, SCORED, _said, _t, cte, query

# ---- sources and sinks


def _texts_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a file below a folder of its language; the folders are scanned, and each task opens the paths of its own rows."""
    folder = fresh_path(spark, "texts")
    texts = _t(spark, d, "documents", ["coalesce(lang, 'none') AS lang", "coalesce(text, '') AS text"]).repartition(tables.FOLDER_TASKS * spark.sparkContext.defaultParallelism)  # a file costs more than its bytes
    tables.write_texts(texts, folder, "lang", "text")
    paths = tables.load_folder(spark, folder, "*.txt").select("label", F.concat(F.lit("path:"), "path").alias("text"))
    read = tables.read_texts(paths, "text", most=1 << 30)
    return read.select("label", F.length("text").cast("long").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("text__error").alias("error"))


QUERIES["texts_by_path"] = _texts_by_path
ORACLES["texts_by_path"] = """
SELECT 'lang=' || coalesce(lang, 'none') AS label, (length(coalesce(text, '')) + 1)::BIGINT AS chars, sha256(coalesce(text, '') || chr(10)) AS sha256, NULL::VARCHAR AS error FROM documents"""


@query("export_predictions", "lineitem", cte("scored") + "SELECT l_orderkey, l_linenumber, round(p, 6) AS probability, CASE WHEN p >= 0.5 THEN 'yes' ELSE 'no' END AS prediction FROM scored", SCORED)
def _export_predictions(df: DataFrame) -> DataFrame:
    """Predictions written as CSV, and read back."""
    path = fresh_path(df.sparkSession, "predictions") + ".csv"
    tables.write_predictions(df.select("l_orderkey", "l_linenumber", F.col("p").alias("probability"), F.when(F.col("p") >= 0.5, "yes").otherwise("no").alias("prediction")), path)
    return tables.load_table(df.sparkSession, path).selectExpr("CAST(l_orderkey AS BIGINT) AS l_orderkey", "CAST(l_linenumber AS INT) AS l_linenumber", "CAST(probability AS DOUBLE) AS probability", "prediction")


_cached = ("chars", "words", "unique_ratio", "char_entropy")


@query("feature_cache", "documents", f"SELECT doc_id, chars::DOUBLE AS chars, words::DOUBLE AS words, unique_ratio, char_entropy, 0::BIGINT AS computed_twice FROM ({ORACLES['text_handcrafted']})")
def _feature_cache(df: DataFrame) -> DataFrame:
    """Features by content: of half of the documents first, then of all, which computes only what isn't known yet."""
    path = fresh_path(df.sparkSession, "cache")
    at = [textcount.NAMES.index(n) for n in _cached]
    compute = lambda rows: rows.withColumn("f", textcount.handcrafted(F.col("text"))).withColumn("text__features", F.array(*[F.get("f", F.lit(i)) for i in at]))
    multimodal.cached_features(df.where("doc_id % 2 = 0"), "text", compute, path)
    out = multimodal.cached_features(df, "text", compute, path)
    again = df.sparkSession.read.parquet(path).groupBy("__key").count().where("count > 1").count()
    return out.select("doc_id", *[F.get("text__features", F.lit(i)).alias(n) for i, n in enumerate(_cached)], F.lit(again).cast("long").alias("computed_twice"))


_RIDGE = ["l_orderkey * 10 + l_linenumber AS id", *NUM]


@query("bundle_round_trip", "lineitem", "SELECT l_orderkey * 10 + l_linenumber AS id, true AS same FROM lineitem", _RIDGE)
def _bundle_round_trip(df: DataFrame) -> DataFrame:
    """A model saved as one archive, checked and read back: do its predictions of every row equal those before?"""
    path = fresh_path(df.sparkSession, "model") + ".zip"
    model = learn.fit(df, learn.FitConfig(target="l_extendedprice", key="id", task="regression", trees=3))
    model.save(df.sparkSession, path)
    again = learn.FittedModel.load(df.sparkSession, path)
    before = model.predict(df, df.columns).withColumnRenamed("prediction", "before")
    return again.predict(before, ["id", "before"]).select("id", (F.col("prediction") == F.col("before")).alias("same"))


# ---- types
_MIXED = ["o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'dd.MM.yyyy') WHEN 1 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN 2 THEN date_format(o_orderdate, 'yyyyMMdd') "
          "WHEN 3 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'soon' END ELSE CAST(o_orderdate AS STRING) END AS told"]
query("mixed_dates", "orders", """
SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 5 = 3 THEN NULL WHEN o_orderkey % 5 = 4 THEN o_orderdate ELSE date_trunc('day', o_orderdate) END, '%Y-%m-%d %H:%M:%S') AS told FROM orders""", _MIXED)(
    lambda df: validate.mixed_dates(df, ["told"], "coerce").select("o_orderkey", F.date_format("told", "yyyy-MM-dd HH:mm:ss").alias("told")))
_KINDS = ["o_orderpriority AS texts", "CAST(o_totalprice AS STRING) AS numbers", "CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN ' 12.5 ' WHEN 2 THEN 'True' ELSE CAST(o_orderdate AS STRING) END AS mixed",
          "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'false' END AS truths"]
query("mixed_value_kinds", "orders", """
SELECT 'texts' AS column_name, 1::BIGINT AS kinds UNION ALL SELECT 'numbers', 1 UNION ALL SELECT 'mixed', count(DISTINCT o_orderkey % 4) FROM orders UNION ALL SELECT 'truths', 1""", _KINDS)(
    lambda df: quality.shape_classes(df, ["texts", "numbers", "mixed", "truths"]))
_TWO = ["l_orderkey", "l_linenumber", "l_linestatus AS a", "CASE WHEN l_quantity > 25 THEN 'many' WHEN l_orderkey % 10 = 0 THEN NULL ELSE 'few' END AS b"]
query("multilabel_encode", "lineitem", """
WITH c AS (SELECT max(l_linestatus) AS top FROM lineitem)
SELECT l_orderkey, l_linenumber, (l_linestatus = top)::INT AS a, CASE WHEN l_quantity > 25 THEN 1 WHEN l_orderkey % 10 = 0 THEN NULL ELSE 0 END::INT AS b FROM lineitem, c""", _TWO)(
    lambda df: clean.MultiLabelEncoder().fit(df, ["a", "b"]).transform(df))

# ---- decisions
_iso = lambda k: f"""  -- the greatest over begins of the least mean over ends
t{k} AS (SELECT p[{k}] AS p, sum((y = {k - 1})::INT)::DOUBLE AS s, count(*) AS n FROM s GROUP BY 1),
c{k} AS (SELECT p, row_number() OVER o AS i, sum(s) OVER o AS s, sum(n) OVER o AS n, sum(s) OVER o - s AS s0, sum(n) OVER o - n AS n0 FROM t{k} WINDOW o AS (ORDER BY p)),
m{k} AS (SELECT b.i AS b, min((b.s - a.s0) / (b.n - a.n0)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS least FROM c{k} a JOIN c{k} b ON a.i <= b.i),
f{k} AS (SELECT c{k}.p, max(least) AS v FROM m{k} JOIN c{k} ON c{k}.i = b GROUP BY 1)"""  # noqa: E731
_CLASSES = ["l_orderkey", "l_linenumber", *_three]


@query("calibrate_classes", "lineitem", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, (l_linenumber % 3)::INT AS y, [u / 100, u / 200, 1.0::DOUBLE - 3 * u / 200] AS p FROM (SELECT *, ((l_orderkey * 7) % 50 + 1)::DOUBLE AS u FROM lineitem)),
{','.join(_iso(k) for k in (1, 2, 3))},
j AS (SELECT l_orderkey, l_linenumber, f1.v AS a, f2.v AS b, f3.v AS c FROM s JOIN f1 ON s.p[1] = f1.p JOIN f2 ON s.p[2] = f2.p JOIN f3 ON s.p[3] = f3.p)
SELECT l_orderkey, l_linenumber, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM j""", _CLASSES)
def _calibrate_classes(df: DataFrame) -> DataFrame:
    """Each class against the rest by isotonic steps, then brought to sum to 1."""
    wide = df.withColumns({**{f"y{k}": (F.col("y") == k).cast("double") for k in range(3)}, **{f"q{k}": F.get("p", F.lit(k)) for k in range(3)}})
    made = learn.fit_calibrator(wide, [(f"y{k}", f"q{k}") for k in range(3)], "isotonic").apply_all(F.col("p"))
    return df.withColumn("c", made).select("l_orderkey", "l_linenumber", *[F.get("c", F.lit(k)).alias(f"p{k}") for k in range(3)])


_BY_NAME = {"accuracy": "metrics_binary", "precision": "metrics_binary", "recall": "metrics_binary", "f1": "metrics_binary", "mcc": "metrics_binary", "kappa": "metrics_binary",
            "roc_auc": "roc_auc", "average_precision": "pr_auc", "log_loss": "log_loss", "brier": "log_loss", "ece": "ece"}
query("metrics_by_name", "lineitem", " UNION ALL ".join(f"SELECT '{n}' AS name, {n}::DOUBLE AS value FROM ({ORACLES[q]})" for n, q in _BY_NAME.items()), _said)(
    lambda df: df.sparkSession.createDataFrame([(n, float(metrics.compute(n, df, "y", "said", "p"))) for n in _BY_NAME], "name string, value double"))
query("predicted_against_true", "orders", """
WITH s AS (SELECT o_totalprice AS y, (o_orderkey % 1000)::DOUBLE AS p FROM orders), e AS (SELECT min(p) AS a, (max(p) - min(p)) / 20 AS w FROM s)
SELECT least(floor((p - a) / w), 19)::BIGINT AS bin, round(avg(p), 4) AS predicted, round(avg(y), 4) AS actual, count(*)::BIGINT AS n FROM s, e GROUP BY 1""",
      ["o_totalprice AS y", "CAST(o_orderkey % 1000 AS DOUBLE) AS p"], digits=4)(lambda df: metrics.predicted_against_true(df, "y", "p"))
query("ranks_in_groups", "orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS place FROM orders")(
    lambda df: place_within(df, ["o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")], -F.size(F.filter(cut_points(df, "o_totalprice"), lambda e: e <= F.col("o_totalprice"))), "place").select("o_orderkey", F.col("place").cast("long").alias("place")))
