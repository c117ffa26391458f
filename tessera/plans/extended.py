"""More registered queries: replayed cleaning, imputation, ladders, coverage, folds, ensembles, sources and media, each with its SQL in one block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media, textcount
from ..functions import text as T
from ..functions.shared import fresh_path, stored
from ..operators import clean, decide, ensemble, learn, metrics, multimodal, quality, rank, split
from ..sources import tables
from .registry import HOLES, NUM, ORACLES, QUERIES, SCORED, _key, _round, _t, _text, _unit, cte, query

# ---- audit of rows with NaN, and its score

_NAN = ["o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status"]
_gone = "(CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 1.0 ELSE 0.0 END)"
query("audit_missing_nan", "orders", f"""
SELECT 'o_orderkey' AS column_name, 0.0::DOUBLE AS missing_rate
UNION ALL SELECT 'price', round(avg({_gone}), 6) FROM orders
UNION ALL SELECT 'status', round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) FROM orders""", _NAN)(quality.missing_rates)
query("audit_row_missing_nan", "orders", f"""
WITH m AS (SELECT ({_gone} + CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE / 3 AS m FROM orders)
SELECT round(quantile_cont(m, 0.5), 6) AS q50, round(quantile_cont(m, 0.9), 6) AS q90, round(quantile_cont(m, 0.99), 6) AS q99, round(max(m), 6) AS max, 0::BIGINT AS almost_empty FROM m""", _NAN)(quality.row_missing_quantiles)
query("missing_indicators_nan", "orders", f"SELECT o_orderkey, {_gone}::INT AS price__missing FROM orders", _NAN)(lambda df: clean.missing_indicators(df, ["price"]).select("o_orderkey", "price__missing"))


def _audit_score(spark: SparkSession, d: str) -> DataFrame:
    report = quality.audit(_t(spark, d, "lineitem", HOLES), "l_linestatus")
    return spark.createDataFrame([(report.score, len(report.issues))], "score double, issues int")


QUERIES["audit_score"] = _audit_score
_features = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag"
_skewed = " + ".join(f"(abs(coalesce(skewness({c}), 0)) >= 3)::INT" for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"))
_outlying = " + ".join(f"""(SELECT (count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) >= 0.1 * count({c}))::INT FROM holes,
  (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM holes))""" for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"))
ORACLES["audit_score"] = cte("holes").rstrip() + f""",
i AS (SELECT (count(*) > count(DISTINCT (l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus)))::INT AS repeated,
        ({_skewed} > 0)::INT AS skewed, ({_outlying} > 0)::INT AS outlying FROM holes),
c AS (SELECT (count(*) > 0)::INT AS conflicts FROM (SELECT 1 FROM holes GROUP BY {_features} HAVING count(DISTINCT l_linestatus) > 1)),
m AS (SELECT (greatest({', '.join(f'avg(({c} IS NULL)::INT)' for c in _features.split(', '))}) >= 0.5)::INT AS empty FROM holes)
SELECT greatest(0, 100 - 15.0 * conflicts - 6.0 * (repeated + outlying + empty) - 1.5 * skewed)::DOUBLE AS score, (conflicts + repeated + outlying + empty + skewed)::INT AS issues FROM i, c, m"""

# ---- splits and samples
query("split_stratified_group", "orders", f"""
WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2),
g AS (SELECT o_custkey, arg_min(o_orderstatus, (-n, o_orderstatus)) AS class FROM c GROUP BY 1),
s AS (SELECT o_custkey, row_number() OVER (PARTITION BY class ORDER BY {_unit('o_custkey', '42:')}, o_custkey) <= greatest(1, floor(count(*) OVER (PARTITION BY class) * 0.2)) AS is_test FROM g)
SELECT o_orderkey, is_test FROM orders JOIN s USING (o_custkey)""")(lambda df: split.split_stratified_group(df, "o_orderkey", "o_custkey", "o_orderstatus").select("o_orderkey", "is_test"))
query("split_three_way", "orders", f"""
SELECT o_orderkey, CASE WHEN {_unit('o_orderkey', '42:')} < 0.2 THEN 'select' WHEN {_unit('o_orderkey', '42:')} < 0.4 THEN 'meta' ELSE 'fit' END AS part FROM orders""")(
    lambda df: split.three_way(df, "o_orderkey").select("o_orderkey", "part"))
_auto = {"by_class": ("multiclass", {}), "by_group": ("multiclass", {"group": "o_custkey"}), "by_class_and_group": ("multiclass", {"strategy": "stratified_group", "group": "o_custkey"}),
         "at_random": ("regression", {})}
query("split_strategies", "orders", f"""
WITH a AS ({ORACLES['split_stratified']}), b AS ({ORACLES['split_group']}), c AS ({ORACLES['split_stratified_group']}), d AS ({ORACLES['split_random']})
SELECT o_orderkey, a.is_test AS by_class, b.is_test AS by_group, c.is_test AS by_class_and_group, d.is_test AS at_random
FROM a JOIN b USING (o_orderkey) JOIN c USING (o_orderkey) JOIN d USING (o_orderkey)""")(lambda df: _split_strategies(df))


def _split_strategies(df: DataFrame) -> DataFrame:
    """What the dispatcher chooses by task, group and strategy."""
    for name, (task, how) in _auto.items():
        df = split.split(df, "o_orderkey", task, ["o_orderstatus"], **how).withColumnRenamed("is_test", name)
    return df.select("o_orderkey", *_auto)


query("stratified_folds", "orders", f"""
SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_unit('o_orderkey', '42:fold:')}, o_orderkey) - 1) % 3)::INT AS fold FROM orders""")(
    lambda df: split.stratified_folds(df, "o_orderkey", "o_orderstatus").select("o_orderkey", "fold"))
query("search_sample", "orders", f"SELECT o_orderkey FROM orders ORDER BY {_unit('o_orderkey', '42:sample:')}, o_orderkey LIMIT 500")(
    lambda df: split.search_sample(df, "o_orderkey", most=500).select("o_orderkey"))
query("member_sample", "orders", f"""
SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_unit('o_orderkey', '2060:sample:')}, o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
WHERE i <= greatest(1, round(n * 0.9))""")(lambda df: split.member_sample(df, "o_orderkey", 1, "o_orderstatus").select("o_orderkey"))
query("meta_split", "orders", f"SELECT o_orderkey, {_unit('o_orderkey', '95:')} < 0.25 AS is_select FROM orders")(lambda df: split.meta_split(df, "o_orderkey").select("o_orderkey", "is_select"))


# ---- cleaning: fitted on one side, replayed on the other
def _clean_replay(spark: SparkSession, d: str) -> DataFrame:
    parts = split.split_random(_t(spark, d, "lineitem", [*HOLES, "l_shipdate"]), "l_orderkey")
    fitted = clean.Cleaner(scaling="robust").fit(parts.where("NOT is_test"), ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"])
    return _round(clean.Cleaner.from_json(fitted.to_json()).transform(parts.where("is_test"), keep=_key))


QUERIES["clean_replay"] = _clean_replay
_numbers = ["l_quantity", "l_extendedprice", "l_discount"]
_turn = lambda f, x, n, k: f"round({f}(({x}) * 2 * pi() / {n}), 6) AS l_shipdate__{k}"
ORACLES["clean_replay"] = cte("holes").replace("l_linestatus FROM", "l_linestatus, l_shipdate FROM").rstrip() + f""",
p AS (SELECT *, {_unit('l_orderkey', '42:')} < 0.2 AS is_test FROM holes), t AS (SELECT * FROM p WHERE NOT is_test),
q AS (SELECT {', '.join(f'quantile_cont({c}::DOUBLE, 0.01) AS {c}_a, quantile_cont({c}::DOUBLE, 0.5) AS {c}_m, quantile_cont({c}::DOUBLE, 0.99) AS {c}_b' for c in _numbers)} FROM t),
c AS (SELECT p.*, {', '.join(f'greatest({c}_a, least({c}_b, coalesce({c}, {c}_m))) AS {c}_c' for c in _numbers)} FROM p, q),
s AS (SELECT {', '.join(f'quantile_cont({c}_c, 0.25) AS {c}_1, quantile_cont({c}_c, 0.5) AS {c}_2, quantile_cont({c}_c, 0.75) AS {c}_3' for c in _numbers)} FROM c WHERE NOT is_test),
k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT coalesce(l_returnflag, '__missing__') AS v FROM t GROUP BY 1
      HAVING count(*) >= greatest(2, ceil((SELECT count(*) FROM t) * 0.01)) UNION SELECT '__rare__'))
SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c}_c - {c}_2) / CASE WHEN {c}_3 - {c}_1 = 0 THEN 1 ELSE {c}_3 - {c}_1 END, 6) AS {c}' for c in _numbers)},
  (l_quantity IS NULL)::INT AS l_quantity__missing, (l_discount IS NULL)::INT AS l_discount__missing,
  0.0::DOUBLE AS l_shipdate__missing, year(l_shipdate)::DOUBLE AS l_shipdate__year, month(l_shipdate)::DOUBLE AS l_shipdate__month, day(l_shipdate)::DOUBLE AS l_shipdate__day,
  (isodow(l_shipdate) - 1)::DOUBLE AS l_shipdate__dayofweek, dayofyear(l_shipdate)::DOUBLE AS l_shipdate__dayofyear, quarter(l_shipdate)::DOUBLE AS l_shipdate__quarter,
  (isodow(l_shipdate) >= 6)::INT::DOUBLE AS l_shipdate__is_weekend, round(epoch_us(l_shipdate) / 8.64e10, 6) AS l_shipdate__days_since_epoch,
  {_turn('sin', 'month(l_shipdate) - 1', 12, 'month_sin')}, {_turn('cos', 'month(l_shipdate) - 1', 12, 'month_cos')},
  {_turn('sin', 'isodow(l_shipdate) - 1', 7, 'dow_sin')}, {_turn('cos', 'isodow(l_shipdate) - 1', 7, 'dow_cos')},
  coalesce((SELECT code FROM k WHERE v = coalesce(l_returnflag, '__missing__')), (SELECT code FROM k WHERE v = '__rare__'))::INT AS l_returnflag__code
FROM c, s WHERE is_test"""

_PART = ["p_partkey", "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size", "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS price", "CAST(p_partkey % 17 AS DOUBLE) AS w"]
_masked = " + ".join(f"coalesce((q.{c} - r.{c}) * (q.{c} - r.{c}), 0)" for c in ("size", "price", "w"))
_shared = " + ".join(f"(q.{c} IS NOT NULL AND r.{c} IS NOT NULL)::INT" for c in ("size", "price", "w"))
_filled = lambda c: f"""  -- noqa: E731
r_{c} AS (SELECT id, d, v, row_number() OVER (PARTITION BY id ORDER BY d, other) AS place FROM (SELECT q.p_partkey AS id, r.p_partkey AS other, r.{c} AS v, ({_masked}) / ({_shared}) * 3 AS d
  FROM p q JOIN p r ON q.{c} IS NULL AND r.{c} IS NOT NULL)),
f_{c} AS (SELECT id, CASE WHEN min(d) = 0 THEN avg(v) FILTER (WHERE d = 0) ELSE sum(v / sqrt(d)) / sum(1 / sqrt(d)) END AS v FROM r_{c}
  WHERE place <= (SELECT least(8, greatest(2, floor(sqrt(count(*))))) FROM p) GROUP BY id)""".replace("  -- noqa: E731", "")  # noqa: E731
query("impute_knn", "part", f"""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size::DOUBLE END AS size, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS price, (p_partkey % 17)::DOUBLE AS w FROM part),
{_filled('size')}, {_filled('price')}
SELECT p_partkey, round(coalesce(size, f_size.v), 6) AS size, round(coalesce(price, f_price.v), 6) AS price, w FROM p LEFT JOIN f_size ON f_size.id = p_partkey LEFT JOIN f_price ON f_price.id = p_partkey""", _PART)(lambda df: clean.knn_impute(df, clean.knn_reference(df, ["size", "price", "w"], "p_partkey")))
_GAP = ["l_orderkey", "l_linenumber", "l_quantity AS x", "CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_extendedprice END AS y"]
query("impute_regression", "lineitem", f"""
WITH g AS (SELECT {', '.join(_GAP)} FROM lineitem),
s AS (SELECT count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx, sum(x * x)::DOUBLE AS sxx, sum(y)::DOUBLE AS sy, sum(x * y)::DOUBLE AS sxy FROM g WHERE y IS NOT NULL),
t AS (SELECT n, sxx, sx / sqrt(n * sxx) AS r, sy / sqrt(n) AS u, sxy / sqrt(sxx) AS v, 1.001::DOUBLE AS one FROM s),  -- scaled normal equations; the slope bears the ridge
b AS (SELECT (u * one - r * v) / (one - r * r) / sqrt(n) AS b0, (v - r * u) / (one - r * r) / sqrt(sxx) AS b1 FROM t)
SELECT l_orderkey, l_linenumber, round(coalesce(y, b0 + b1 * x), 4) AS y FROM g, b""", _GAP, digits=4)(
    lambda df: clean.iterative_impute(df, clean.iterative_state(df, ["x", "y"])).select("l_orderkey", "l_linenumber", "y"))
query("impute_iterative", "part", exprs=_PART)(lambda df: clean.iterative_impute(df, clean.iterative_state(df, ["size", "price", "w"])))
query("label_encode", "orders", """
SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INT AS code, o_orderstatus AS back FROM orders""")(
    lambda df: (lambda e: e.transform(df, "o_orderstatus", "code").select("o_orderkey", "code", e.inverse("code").alias("back")))(clean.LabelEncoder().fit(df, "o_orderstatus")))
query("distribution_plan", "events", """
SELECT event_id, round(CASE WHEN (SELECT skewness(value) FROM events) > 1.5 THEN ln(1 + greatest(value + greatest(0, -(SELECT min(value) FROM events)), 0)) ELSE value END, 6) AS value FROM events""")(
    lambda df: df.select("event_id", "value").withColumns(clean.transformed(clean.distribution_plan(df, ["value"]))))

# ---- text
_n = lambda p: f"len(regexp_extract_all(text, '{p}'))::BIGINT"
_text("text_patterns", lambda c: {k: v for k, v in T.patterns(c).items() if k != "repeats"}, f"""
SELECT doc_id, {_n('https?://[^ ' + chr(10) + ']+')} AS urls, {_n('[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+')} AS emails, {_n(chr(92) + 'p{S}')} AS symbols FROM documents""")
_text("text_repeats", lambda c: {"repeats": T.patterns(c)["repeats"]}, """
WITH c AS (SELECT doc_id, string_split(text, '') AS c FROM documents)
SELECT doc_id, len(list_filter(range(1, greatest(len(c) - 1, 1)), lambda i: c[i] = c[i + 1] AND c[i] = c[i + 2] AND (i = 1 OR c[i - 1] <> c[i])
  AND NOT list_contains([chr(10), chr(13), chr(133), chr(8232), chr(8233)], c[i])))::BIGINT AS repeats FROM c""")
_text("text_shape", T.shape, f"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '{T.WORD}') AS w FROM documents)
SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE (length(text) - length(replace(text, chr(10), ''))) / length(text)::DOUBLE END, 6) AS newline_ratio,
  round(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: regexp_full_match(x, '\\p{{N}}+'))) / len(w)::DOUBLE END, 6) AS numeric_ratio, (trim(text) = '')::INT AS empty FROM w""")
query("text_char_entropy", "documents", """
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''), n AS (SELECT doc_id, c, count(*) AS n FROM c GROUP BY 1, 2),
e AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM n GROUP BY 1)
SELECT d.doc_id, round(coalesce(e, 0.0), 6) + 0.0 AS char_entropy FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id""")(
    lambda df: df.select("doc_id", (F.round(T.entropy(T.characters(F.col("text"))), 6) + 0.0).alias("char_entropy")))
_blocks = ("text_char_stats", "text_ratios", "text_scripts", "text_patterns", "text_lexical_diversity", "text_shape", "text_entropy", "text_char_entropy")
query("text_handcrafted", "documents", "SELECT * FROM " + " JOIN ".join(f"({ORACLES[b]}) AS {b}" + (" USING (doc_id)" if b != _blocks[0] else "") for b in _blocks))(
    lambda df: df.withColumn("f", textcount.handcrafted(F.col("text"))).select("doc_id", *[
        (F.get("f", F.lit(i)).cast("int" if n == "empty" else "long") if n in _whole else F.get("f", F.lit(i))).alias(n) for i, n in enumerate(textcount.NAMES) if n != "repeats"]))
_whole = {"chars", "words", "sentences", "lines", "questions", "exclamations", "urls", "emails", "symbols", "word_max", "empty"}
query("text_features", "documents")(lambda df: multimodal.TextExtractor(80).fit(df, "doc_id", "text").transform(df, "doc_id", "text").select("doc_id", "text__features"))

# ---- ranking of features
query("mi_topk", "lineitem", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM (
  SELECT *, sum(n) OVER (PARTITION BY b) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM (
    SELECT len(list_filter(e, lambda x: x <= {c})) AS b, l_returnflag AS y, count(*)::DOUBLE AS n
    FROM lineitem, (SELECT list_distinct([{', '.join(f'quantile_cont({c}::DOUBLE, {i / 8})' for i in range(1, 8))}]) AS e FROM lineitem) GROUP BY 1, 2))""" for c in NUM))(
    lambda df: rank.mutual_information(df, NUM, "l_returnflag"))

# ---- decisions
query("per_label_thresholds", "lineitem", cte("scored").rstrip() + f""",
l AS (SELECT 'y' AS label, y, p FROM scored UNION ALL SELECT 'z', 1 - y, 1 - p FROM scored),
g AS (SELECT label, i, sum(CASE WHEN p >= i / 100.0::DOUBLE THEN y ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN p >= i / 100.0::DOUBLE THEN 1 - y ELSE 0 END)::DOUBLE AS fp,
        sum(CASE WHEN p < i / 100.0::DOUBLE THEN y ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN p < i / 100.0::DOUBLE THEN 1 - y ELSE 0 END)::DOUBLE AS tn FROM l, range(1, 100) t(i) GROUP BY 1, 2),
m AS (SELECT label, i, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc FROM g)
SELECT label, CASE WHEN max(mcc) > max(mcc) FILTER (WHERE i = 50) THEN arg_min(i, (-mcc, i)) / 100.0::DOUBLE ELSE 0.5 END AS threshold FROM m GROUP BY 1""", [*SCORED, "1 - CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS z"])(
    lambda df: df.sparkSession.createDataFrame(list(decide.per_label_thresholds(df.withColumn("pz", 1 - F.col("p")), [("y", "p"), ("z", "pz")]).items()), "label string, threshold double"))
_three = ["CAST(l_linenumber % 3 AS INT) AS y", "array(CAST((l_orderkey * 7) % 50 + 1 AS DOUBLE) / 100, CAST((l_orderkey * 7) % 50 + 1 AS DOUBLE) / 200, 1.0D - 3 * CAST((l_orderkey * 7) % 50 + 1 AS DOUBLE) / 200) AS p"]
query("reject_sweep", "lineitem", """
WITH s AS (SELECT (l_linenumber % 3)::INT AS y, ((l_orderkey * 7) % 50 + 1)::DOUBLE AS u FROM lineitem),
a AS (SELECT y, u / 100 AS p0, u / 200 AS p1, 1.0::DOUBLE - 3 * u / 200 AS p2 FROM s), b AS (SELECT y, greatest(p0, p1, p2) AS top, CASE WHEN p0 >= p2 THEN 0 ELSE 2 END AS said FROM a),
g AS (SELECT i / 100.0::DOUBLE AS threshold, y, said, top FROM b, range(0, 100) t(i)),
c AS (SELECT threshold, avg((top >= threshold)::INT) AS coverage, sum((top >= threshold AND y = said)::INT) AS hit, sum((top >= threshold)::INT) AS n, count(*) AS total FROM g GROUP BY 1)
SELECT threshold, round(coverage, 6) AS coverage, round(CASE WHEN n = 0 THEN 0.0 ELSE hit / n::DOUBLE END, 6) AS accuracy_on_accepted, round(hit / total::DOUBLE, 6) AS accuracy, n::BIGINT AS n_accepted FROM c""", _three)(
    lambda df: decide.reject_sweep(df, "y", "p").select("threshold", "coverage", "accuracy_on_accepted", "accuracy", "n_accepted"))
query("pr_ladder_points", "lineitem", cte("scored").rstrip() + """,
t AS (SELECT p AS score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scored GROUP BY 1),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS said FROM t),
k AS (SELECT * FROM c WHERE score BETWEEN 0.01 AND 0.99 AND said >= 0.01 * (SELECT count(*) FROM scored)),
e AS (SELECT min(tp) AS a, max(tp) AS b FROM k),
x AS (SELECT i, arg_min(score, (abs(tp - (b + (a - b) * i / 3)), score)) AS threshold FROM k, e, range(0, 4) t(i) GROUP BY 1)
SELECT threshold, round(sum(CASE WHEN p >= threshold THEN y ELSE 0 END) / sum((p >= threshold)::INT)::DOUBLE, 6) AS precision, round(sum(CASE WHEN p >= threshold THEN y ELSE 0 END) / sum(y)::DOUBLE, 6) AS recall,
  round(avg((p >= threshold)::INT), 6) AS positive_rate FROM x, scored GROUP BY i, threshold""", SCORED)(lambda df: decide.threshold_ladder(df, "y", "p").select("threshold", "precision", "recall", "positive_rate"))
query("conformal_coverage", "lineitem", """
SELECT round(avg(CASE WHEN abs(l_extendedprice - (l_extendedprice * 0.9 + l_quantity * 20)) <= 1000 THEN 1.0 ELSE 0.0 END), 6) AS coverage, 2000.0::DOUBLE AS width FROM lineitem""",
      ["l_extendedprice AS y", "l_extendedprice * 0.9 + l_quantity * 20 AS p"])(lambda df: _round(decide.interval_coverage(df, "y", "p", 1000.0), 3).select("coverage", "width"))
ORACLES["conformal_coverage"] = ORACLES["conformal_coverage"].replace("END), 6)", "END), 3)")
query("conformal_set_coverage", "lineitem", cte("scored") + """
SELECT round(avg(CASE WHEN CASE WHEN y = 1 THEN p ELSE 1 - p END >= 0.4 OR (greatest(p, 1 - p) < 0.4 AND (p > 0.5) = (y = 1)) THEN 1.0 ELSE 0.0 END), 6) AS coverage,
  round(avg(greatest(1, (p >= 0.4)::INT + (1 - p >= 0.4)::INT)), 6) AS set_size FROM scored""", SCORED)(
    lambda df: decide.set_coverage(df.select("y", F.array(1 - F.col("p"), F.col("p")).alias("p")), "y", "p", 0.6))
query("ladder_confidence", "lineitem", cte("scored") + """
SELECT l_orderkey, l_linenumber, round(((p >= 0.2)::INT + (p >= 0.5)::INT + (p >= 0.8)::INT) / 3.0, 6)::DOUBLE AS confidence FROM scored""", SCORED)(
    lambda df: df.select(*_key, decide.ladder_confidence(F.col("p"), [0.2, 0.5, 0.8]).alias("confidence")))
query("multilabel_sets", "lineitem", cte("scored") + "SELECT l_orderkey, l_linenumber, p >= 0.25 AS positive_possible, 1 - p >= 0.25 AS negative_possible FROM scored", SCORED)(
    lambda df: df.select(*_key, *[v.alias(k) for k, v in decide.multilabel_sets("p", 0.75).items()]))
query("log_loss_multiclass", "lineitem", """
WITH s AS (SELECT (l_linenumber % 3)::INT AS y, ((l_orderkey * 7) % 50 + 1)::DOUBLE AS u FROM lineitem), a AS (SELECT y, u / 100 AS p0, u / 200 AS p1, 1.0::DOUBLE - 3 * u / 200 AS p2 FROM s)
SELECT round(avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) AS log_loss, round(avg(p0 * p0 + p1 * p1 + p2 * p2 - 2 * CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END + 1), 6) AS brier FROM a""", _three)(
    lambda df: metrics.multiclass_probabilities(df, "y", "p").select("log_loss", "brier"))
query("drift_overall", "events", """
WITH a AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-16'), b AS (SELECT value FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
e AS (SELECT list_distinct([""" + ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 10)) + """]) AS e FROM a),
ca AS (SELECT len(list_filter(e, lambda x: x <= value)) AS k, count(*) / (SELECT count(*) FROM a)::DOUBLE AS p FROM a, e GROUP BY 1),
cb AS (SELECT len(list_filter(e, lambda x: x <= value)) AS k, count(*) / (SELECT count(*) FROM b)::DOUBLE AS p FROM b, e GROUP BY 1),
j AS (SELECT greatest(coalesce(ca.p, 0), 1e-6) AS p, greatest(coalesce(cb.p, 0), 1e-6) AS q FROM (SELECT unnest(range(0, len(e) + 1)) AS k FROM e) t LEFT JOIN ca ON ca.k = t.k LEFT JOIN cb ON cb.k = t.k),
s AS (SELECT p / (SELECT sum(p) FROM j) AS p, q / (SELECT sum(q) FROM j) AS q FROM j),
num AS (SELECT least(1, 0.65 * least(psi / 0.5, 1) + 0.20 * least(shift / 3, 1)) AS score FROM (SELECT sum((q - p) * ln(q / p)) AS psi FROM s),
  (SELECT abs((SELECT quantile_cont(value, 0.5) FROM b) - quantile_cont(value, 0.5)) / greatest(1e-6, quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS shift FROM a)),
c AS (SELECT event_type AS v, sum((ts < TIMESTAMP '2024-01-16')::INT)::DOUBLE AS a, sum((ts >= TIMESTAMP '2024-01-16')::INT)::DOUBLE AS b FROM events GROUP BY 1 UNION ALL SELECT NULL, 0, 0),
p AS (SELECT greatest(a / (SELECT sum(a) FROM c), 1e-6) AS a, greatest(b / (SELECT sum(b) FROM c), 1e-6) AS b FROM c),
z AS (SELECT a / (SELECT sum(a) FROM p) AS a, b / (SELECT sum(b) FROM p) AS b FROM p),
cat AS (SELECT least(1, 0.7 * least(sqrt(greatest(0, sum(a * ln(2 * a / (a + b)) + b * ln(2 * b / (a + b))) / 2)) / 0.35, 1)) AS score FROM z)
SELECT round((num.score + cat.score) / 2, 4)::DOUBLE AS overall, CASE WHEN (num.score + cat.score) / 2 >= 0.65 THEN 'critical' WHEN (num.score + cat.score) / 2 >= 0.30 THEN 'warning' ELSE 'stable' END AS severity FROM num, cat""")(
    lambda df: _drift_overall(df))


def _drift_overall(df: DataFrame) -> DataFrame:
    a, b = df.where("ts < '2024-01-16'"), df.where("ts >= '2024-01-16'")
    each = [x["score"] for x in decide.numeric_drift(decide.numeric_reference(a, ["value"]), b)] + [decide.categorical_drift(a, b, "event_type")["score"]]
    value, severity = decide.overall_drift(each)
    return df.sparkSession.createDataFrame([(round(value, 4), severity)], "overall double, severity string")


_NULLED = ["CAST(l_shipdate < TIMESTAMP '1995-06-17' AS INT) AS early", "CASE WHEN l_shipdate < TIMESTAMP '1995-06-17' AND l_linenumber % 2 = 0 THEN NULL ELSE l_returnflag END AS flag"]
query("drift_categorical_missing", "lineitem", """
WITH f AS (SELECT (l_shipdate < TIMESTAMP '1995-06-17')::INT AS early, coalesce(CASE WHEN l_shipdate < TIMESTAMP '1995-06-17' AND l_linenumber % 2 = 0 THEN NULL ELSE l_returnflag END, '__missing__') AS v FROM lineitem),
k AS (SELECT DISTINCT v FROM f WHERE early = 1),
c AS (SELECT k.v, coalesce(sum(early), 0)::DOUBLE AS a, coalesce(sum(1 - early), 0)::DOUBLE AS b FROM k JOIN f ON f.v = k.v GROUP BY 1
      UNION ALL SELECT NULL, 0, (SELECT count(*) FROM f WHERE early = 0 AND v NOT IN (SELECT v FROM k))),
p AS (SELECT greatest(a / (SELECT sum(a) FROM c), 1e-6) AS a, greatest(b / (SELECT sum(b) FROM c), 1e-6) AS b FROM c), s AS (SELECT a / (SELECT sum(a) FROM p) AS a, b / (SELECT sum(b) FROM p) AS b FROM p)
SELECT round(sqrt(greatest(0, sum(a * ln(2 * a / (a + b)) + b * ln(2 * b / (a + b))) / 2)), 6) AS js,
  round(abs((SELECT avg((v = '__missing__')::INT) FROM f WHERE early = 1) - (SELECT avg((v = '__missing__')::INT) FROM f WHERE early = 0)), 6) AS missing_shift FROM s""", _NULLED)(
    lambda df: df.sparkSession.createDataFrame([(lambda x: (x["js"], x["missing_shift"]))(decide.categorical_drift(df.where("early = 1"), df.where("early = 0"), "flag"))], "js double, missing_shift double"))

# ---- ensembles of given predictions
_members = [*SCORED, "CAST((l_orderkey * 13 + l_linenumber) % 1000 AS DOUBLE) / 1000 AS q"]
_draws = ensemble.weight_candidates(2)
_voted = lambda p: f"""  -- noqa: E731
g AS (SELECT i, any_value(w) AS w, sum(({p} >= 0.5 AND y = 1)::INT)::DOUBLE AS tp, sum(({p} >= 0.5 AND y = 0)::INT)::DOUBLE AS fp,
        sum(({p} < 0.5 AND y = 1)::INT)::DOUBLE AS fn, sum(({p} < 0.5 AND y = 0)::INT)::DOUBLE AS tn FROM s, w GROUP BY i)""".replace("  -- noqa: E731", "")  # noqa: E731
query("voting_weight_draws", "lineitem", f"""
WITH s AS (SELECT {', '.join(_members)} FROM lineitem), w AS (SELECT unnest([{', '.join(f"{{'i': {i}, 'w': {w[0]!r}, 'v': {w[1]!r}}}" for i, w in enumerate(_draws))}], recursive := true)),
{_voted('w * p + v * q')}
SELECT i::INT AS draw, round(w::DOUBLE, 6) AS weight, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc,
  round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round(tp / (tp + fn), 6) AS recall FROM g""", _members)(
    lambda df: df.sparkSession.createDataFrame([(i, w[0], *v[:3]) for i, (w, v) in enumerate(zip(_draws, ensemble.weight_vectors(df.withColumnRenamed("y", "label"), ["p", "q"], "binary", _draws), strict=True))],
                                               "draw int, weight double, mcc double, f1 double, recall double"))
_second = "array(1.0D - 3 * CAST((l_orderkey * 11) % 50 + 1 AS DOUBLE) / 200, CAST((l_orderkey * 11) % 50 + 1 AS DOUBLE) / 200, CAST((l_orderkey * 11) % 50 + 1 AS DOUBLE) / 100) AS q"
query("ensemble_multiclass", "lineitem", f"""
WITH s AS (SELECT (l_linenumber % 3)::INT AS y, ((l_orderkey * 7) % 50 + 1)::DOUBLE AS u, ((l_orderkey * 11) % 50 + 1)::DOUBLE AS t FROM lineitem),
a AS (SELECT y, u / 100 AS p0, u / 200 AS p1, 1.0::DOUBLE - 3 * u / 200 AS p2, 1.0::DOUBLE - 3 * t / 200 AS q0, t / 200 AS q1, t / 100 AS q2 FROM s),
w AS (SELECT unnest([{', '.join(f"{{'i': {i}, 'w': {w[0]!r}, 'v': {w[1]!r}}}" for i, w in enumerate(_draws))}], recursive := true)),
b AS (SELECT i, w, y, [p0 * w + q0 * v, p1 * w + q1 * v, p2 * w + q2 * v] AS p FROM a, w)
SELECT i::INT AS draw, round(any_value(w)::DOUBLE, 6) AS weight, round(avg((list_position(p, list_max(p)) - 1 = y)::INT), 6) AS accuracy, round(avg(-ln(greatest(1e-15, p[y + 1]))), 6) AS log_loss FROM b GROUP BY i""", [*_three, _second])(
    lambda df: df.sparkSession.createDataFrame([(i, w[0], v[0], -v[1]) for i, (w, v) in enumerate(zip(_draws, ensemble.weight_vectors(df.withColumnRenamed("y", "label"), ["p", "q"], "multiclass", _draws), strict=True))],
                                               "draw int, weight double, accuracy double, log_loss double"))
query("selection_vector", "lineitem", f"""
WITH s AS (SELECT {', '.join(_members)} FROM lineitem), m AS (SELECT 'p' AS member, y, p AS v FROM s UNION ALL SELECT 'q', y, q FROM s),
g AS (SELECT member, sum((v >= 0.5 AND y = 1)::INT)::DOUBLE AS tp, sum((v >= 0.5 AND y = 0)::INT)::DOUBLE AS fp, sum((v < 0.5 AND y = 1)::INT)::DOUBLE AS fn, sum((v < 0.5 AND y = 0)::INT)::DOUBLE AS tn FROM m GROUP BY 1)
SELECT member, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fn), 6) AS recall FROM g""", _members)(
    lambda df: _round(df.sparkSession.createDataFrame([(c, *v[:3]) for c, v in zip("pq", ensemble.vectors(df.withColumnRenamed("y", "label"), ["p", "q"], "binary"), strict=True)], "member string, mcc double, f1 double, recall double")))

# ---- sources: written, and read back
_WRITE = {"csv": ("csv", lambda df, p: df.write.csv(p, header=True)), "json": ("jsonl", lambda df, p: df.write.json(p)), "tsv": ("tsv", lambda df, p: df.write.csv(p, header=True, sep="\t")),
          "parquet": ("parquet", lambda df, p: df.write.parquet(p))}


def _roundtrip(kind: str, table: str, columns: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        suffix, write = _WRITE[kind]
        path = f"{fresh_path(spark, 'roundtrip')}.{suffix}"
        write(_t(spark, d, table).selectExpr(*columns.split(", ")), path)
        return tables.load_table(spark, path).selectExpr(*columns.split(", "))

    return run


_customer = "CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment"
for _name, _kind, _table, _columns in (
        ("read_csv_roundtrip", "csv", "region", "CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name"), ("read_json_roundtrip", "json", "nation", "CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name"),
        ("read_csv_customers", "csv", "customer", _customer), ("read_tsv_customers", "tsv", "customer", _customer), ("read_json_customers", "json", "customer", _customer), ("read_parquet_customers", "parquet", "customer", _customer)):
    QUERIES[_name] = _roundtrip(_kind, _table, _columns)
    ORACLES[_name] = f"SELECT {_columns} FROM {_table}"


# ---- learners: no SQL
_train = ["l_orderkey * 10 + l_linenumber AS id", *NUM, "l_linestatus", "CASE WHEN l_quantity + l_discount * 100 > 30 THEN 'yes' ELSE 'no' END AS label", "l_returnflag"]


def _fit(name, exprs, **config):
    QUERIES[name] = lambda spark, d: (lambda df: learn.fit(df, learn.FitConfig(key="id", **{"trees": 5, **config})).predict(df, keep=["id"]))(_t(spark, d, "lineitem", exprs))


_fit("fit_binary", _train[:-1], target="label", calibration="auto")
_fit("fit_multiclass", [*_train[:-2], "l_returnflag"], target="l_returnflag", calibration="sigmoid")
_fit("fit_categories", [*_train, "concat('m', month(l_shipdate)) AS month", "concat('s', CAST(l_suppkey % 40 AS STRING)) AS supplier"], target="label", calibration="none", conformal=False, optimize_threshold=False)
_fit("fit_regression", _train[:-2], target="l_extendedprice", task="regression")
_fit("fit_ranking", [*_train[:-2], "l_orderkey AS grp"], target="l_quantity", task="ranking", learner="linear", group="grp")
_fit("fit_ranking_pairs", [*_train[:-2], "l_orderkey AS grp"], target="l_quantity", task="ranking", learner="gbt", group="grp")
_fit("fit_multilabel", [*_train[:-2], "CAST(l_quantity > 25 AS INT) AS a", "CAST(l_tax > 0.04 AS INT) AS b"], target=["a", "b"], task="multilabel", learner="linear")


@query("explain_rows", "lineitem", exprs=_train[:-1])
def _explain_rows(df: DataFrame) -> DataFrame:
    """Tree SHAP values of every row, one a feature."""
    model = learn.fit(df, learn.FitConfig(target="label", key="id", trees=5, optimize_threshold=False, conformal=False, clean="none", leakage="ignore"))
    told = F.get("shap_label", F.lit(0))
    return learn.explain(model, df, ["id"]).select("id", *[F.get(told, F.lit(i))["value"].alias(c) for i, c in enumerate([*model.cleaner.outputs, "expected"])])


query("calibrate_sigmoid", "lineitem", exprs=SCORED)(lambda df: df.select(*_key, learn.apply_sigmoid("p", learn.calibrate_sigmoid(df, "y", "p")).alias("calibrated")))
query("calibrate_isotonic", "lineitem", cte("scored").rstrip() + """,
t AS (SELECT p, sum(y)::DOUBLE AS s, count(*) AS n FROM scored GROUP BY p),
c AS (SELECT p, row_number() OVER o AS i, sum(s) OVER o AS s, sum(n) OVER o AS n, sum(s) OVER o - s AS s0, sum(n) OVER o - n AS n0 FROM t WINDOW o AS (ORDER BY p)),
m AS (SELECT a.i AS a, b.i AS b, min((b.s - a.s0) / (b.n - a.n0)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS least FROM c a JOIN c b ON a.i <= b.i),
f AS (SELECT b, max(least) AS calibrated FROM m GROUP BY b)  -- the greatest over begins of the least mean over ends
SELECT l_orderkey, l_linenumber, round(calibrated, 6) AS calibrated FROM scored JOIN c USING (p) JOIN f ON f.b = c.i""", SCORED)(lambda df: df.select(*_key, learn.fit_calibrator(df, [("y", "p")], "isotonic").apply(F.col("p")).alias("calibrated")))
_STACK = ["l_orderkey * 10 + l_linenumber AS id", *NUM, "CASE WHEN l_quantity + l_discount * 100 > 30 THEN 1.0D ELSE 0.0D END AS label"]


@query("oof_stacking", "lineitem", exprs=_STACK)
def _oof_stacking(df: DataFrame) -> DataFrame:
    """Out-of-fold predictions of two learners, stacked."""
    pool = [ensemble.Candidate("linear", "linear", NUM, {}), ensemble.Candidate("forest", "forest", NUM[:2], {"depth": 4})]
    oof = stored(ensemble.out_of_fold(pool, stored(split.folds(df, "id", 2), "folds"), "binary", 2, 5), "oof")  # each read some dozen times
    return ensemble.apply_stack(ensemble.fit_stack(oof, ["p_0", "p_1"], "binary"), oof, ["p_0", "p_1"], "binary", "stacked").select("id", "label", "stacked")


@query("ensemble_auto", "lineitem", exprs=_STACK)
def _ensemble_auto(df: DataFrame) -> DataFrame:
    """Single, voting or stacking, chosen on rows that fitted nothing."""
    made = ensemble.train(split.stratified_folds(df, "id", "label", 2), NUM, "binary", "id", trees=4, families=("linear", "gbt"), candidates=3)
    return made.predict(df).select("id", "prediction")


# ---- media: files made of embeddings, decoded by the executors
_byte = "CAST(greatest(0, least(255, floor(x * 255.0D + 127.5D))) AS INT)"
#: A BMP of 8 x 8 pixels: its header of 54 bytes, then rows from the bottom up, blue, green and red.
_bmp = (f"unhex(concat('424DF60000000000000036000000', '28000000', '0800000008000000', '01001800', repeat('00', 24), "
        f"array_join(transform(embedding, x -> lpad(hex({_byte}), 2, '0') || lpad(hex({_byte}), 2, '0') || lpad(hex(255 - {_byte}), 2, '0')), ''))) AS file")
_IMAGE = ["width", "height", "brightness", "contrast", "dark_ratio", "bright_ratio", "symmetry_x", "symmetry_y", "red_mean", "blue_std", "value_mean", "saturation_mean"]
_tied = ("brightness", "symmetry_x", "symmetry_y")  # multiples of 1 / 16,320,000, which may lie midway between two roundings: shifted by 1e-9
query("image_files", "embeddings", """
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor(x::DOUBLE * 255.0 + 127.5)))) AS b FROM embeddings),
g AS (SELECT vec_id, list_transform(b, lambda v: v / 255) AS b, list_transform(b, lambda v: (0.299::DOUBLE * (255 - v) + 0.701::DOUBLE * v) / 255) AS g FROM b)
SELECT vec_id, 8.0::DOUBLE AS width, 8.0::DOUBLE AS height, round(list_avg(g) + 1e-9, 6) AS brightness, round(list_stddev_pop(g), 6) AS contrast,
  round(len(list_filter(g, lambda v: v < 0.1::DOUBLE)) / 64.0, 6)::DOUBLE AS dark_ratio, round(len(list_filter(g, lambda v: v > 0.9::DOUBLE)) / 64.0, 6)::DOUBLE AS bright_ratio,
  round(1 - list_avg(list_transform(range(0, 64), lambda i: abs(g[i + 1] - g[i - i % 8 + 7 - i % 8 + 1]))) + 1e-9, 6) AS symmetry_x,
  round(1 - list_avg(list_transform(range(0, 64), lambda i: abs(g[i + 1] - g[(7 - (i // 8)) * 8 + i % 8 + 1]))) + 1e-9, 6) AS symmetry_y,
  round(1 - list_avg(b), 6) AS red_mean, round(list_stddev_pop(b), 6) AS blue_std, round(list_avg(list_transform(b, lambda v: greatest(v, 1 - v))), 6) AS value_mean,
  round(list_avg(list_transform(b, lambda v: abs(1 - 2 * v) / greatest(v, 1 - v))), 6) AS saturation_mean FROM g""", ["vec_id", _bmp])(
    lambda df: df.withColumn("m", media.image("file", policy="error")).select("vec_id", *[(F.get("m.features", F.lit(media.IMAGE.index(n))) + (1e-9 if n in _tied else 0.0)).alias(n) for n in _IMAGE]))
_sample = "CAST(round(greatest(-1.0D, least(1.0D, CAST(x AS DOUBLE))) * 32000) AS INT)"
#: A mono WAV of 64 samples of 16 bits at 16 kHz: a header of 44 bytes, then the samples, low byte first.
_wav = (f"unhex(concat('52494646A400000057415645666D7420', '10000000', '01000100', '803E0000', '007D0000', '02001000', '6461746180000000', "
        f"array_join(transform(transform(embedding, x -> lpad(right(hex({_sample} + 65536), 4), 4, '0')), h -> right(h, 2) || left(h, 2)), ''))) AS file")
_AUDIO = ["seconds", "mean", "std", "rms", "peak", "crest", "zero_crossings", "silence", "clipping", *(f"segment_{i}" for i in range(8))]
query("audio_files", "embeddings", f"""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: round(greatest(-1.0, least(1.0, x::DOUBLE)) * 32000) / 32768.0::DOUBLE) AS x FROM embeddings),
s AS (SELECT vec_id, x, sqrt(list_avg(list_transform(x, lambda v: v * v))) AS rms, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM x)
SELECT vec_id, 0.004::DOUBLE AS seconds, round(list_avg(x), 6) AS mean, round(list_stddev_pop(x), 6) AS std, round(rms, 6) AS rms, round(peak, 6) AS peak, round(peak / greatest(rms, 1e-12), 6) AS crest,
  round(len(list_filter(range(1, 64), lambda i: (x[i] < 0) <> (x[i + 1] < 0))) / 63.0::DOUBLE, 6) AS zero_crossings, round(len(list_filter(x, lambda v: abs(v) < 0.01::DOUBLE)) / 64.0::DOUBLE, 6) AS silence,
  round(len(list_filter(x, lambda v: abs(v) > 0.99::DOUBLE)) / 64.0::DOUBLE, 6) AS clipping,
  {', '.join(f"round(sqrt(list_avg(list_transform(x[{8 * i + 1}:{8 * i + 8}], lambda v: v * v))), 6) AS segment_{i}" for i in range(8))} FROM s""", ["vec_id", _wav])(
    lambda df: df.withColumn("m", media.audio("file", policy="error")).select("vec_id", *[F.get("m.features", F.lit(media.AUDIO.index(n))).alias(n) for n in _AUDIO]))

# ---- media: arrays made of embeddings
_shift = "transform(embedding, x -> greatest(0.0D, least(1.0D, CAST(x AS double) * 2 + 0.5D))) AS e"
query("image_features", "embeddings", exprs=["vec_id", _shift])(lambda df: df.select("vec_id", media.image("e", 8, 8).alias("m")).select("vec_id", "m.features"))
query("audio_features", "embeddings")(lambda df: df.select("vec_id", media.audio("embedding").alias("m")).select("vec_id", "m.features"))
query("video_features", "embeddings", exprs=["vec_id", _shift])(lambda df: df.select("vec_id", media.video("e", 4, 4).alias("m")).select("vec_id", "m.features"))
query("video_motion", "embeddings", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, x::DOUBLE * 2 + 0.5))) AS e FROM embeddings),
d AS (SELECT vec_id, list_transform([0, 1, 2], lambda k: list_avg(list_transform(range(1, (len(e) / 4)::INT + 1), lambda i: abs(e[(k + 1) * (len(e) / 4)::INT + i] - e[k * (len(e) / 4)::INT + i])))) AS d FROM v),
s AS (SELECT vec_id, d, list_sort(d) AS o FROM d)
SELECT vec_id, round(list_avg(d), 6) AS motion_mean, round(list_stddev_pop(d), 6) AS motion_std, round(o[3], 6) AS motion_max, round((d[3] - d[1]) / 2, 6) AS motion_trend,
  round(len(list_filter(d, lambda x: x > greatest(0.25, o[2] + 0.8 * (o[3] - o[2])))) / 3.0, 6)::DOUBLE AS cut_ratio FROM s""", ["vec_id", _shift])(
    lambda df: df.withColumn("m", media.motion("e", 4)).select("vec_id", *[F.get("m", F.lit(i)).alias(n) for i, n in enumerate(media.MOTION)]))
