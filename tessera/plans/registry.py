"""The registered queries of the engine and their SQL.

The tables hold no nulls, so nulls, infinities and repeated rows are put in by
expressions that both engines share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import wide_then_long
from ..operators import clean, decide, learn, metrics, profile, quality, rank, rows, split, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOLES = ["l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS l_quantity", "l_extendedprice",
         "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount", "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS l_returnflag", "l_linestatus"]
SCORED = ["l_orderkey", "l_linenumber", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", "CAST((l_orderkey * 37 + l_partkey * 11 + l_linenumber * 5 + CASE WHEN l_returnflag = 'R' THEN 150 ELSE 0 END) % 1000 AS DOUBLE) / 1000 AS p"]
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WITH = {"holes": f"SELECT {', '.join(HOLES)} FROM lineitem", "scored": f"SELECT {', '.join(SCORED)} FROM lineitem"}


def _t(spark, d, name, exprs=None) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.selectExpr(*exprs) if exprs else df


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def query(name: str, table: str, sql: str | None = None, exprs: list[str] | None = None, digits: int = 6):
    """Registers ``work(df)`` over a table under ``name``; doubles are rounded on both sides."""

    def put(work):
        QUERIES[name] = lambda spark, d: _round(work(_t(spark, d, table, exprs)), digits)
        if sql:
            ORACLES[name] = sql
        return work

    return put


def r(x: str, alias: str) -> str:
    return f"round({x}, 6) AS {alias}"


def per_column(columns, source: str, make) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {make(c)} FROM {source}" for c in columns)


def cte(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({WITH[n]})" for n in names) + " "


_hole_columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]

# ---- audit
query("audit_missing_rates", "lineitem", cte("holes") + per_column(_hole_columns, "holes", lambda c: r(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)", "missing_rate")), HOLES)(quality.missing_rates)
_rm = "(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END" for c in _hole_columns) + ")::DOUBLE / 7.0"
query("audit_row_missing_quantiles", "lineitem", cte("holes") + f"SELECT {r('quantile_cont(m, 0.5)', 'q50')}, {r('quantile_cont(m, 0.9)', 'q90')}, {r('quantile_cont(m, 0.99)', 'q99')}, {r('max(m)', 'max')}, sum(CASE WHEN m >= 0.98 THEN 1 ELSE 0 END)::BIGINT AS almost_empty FROM (SELECT {_rm} AS m FROM holes)", HOLES)(quality.row_missing_quantiles)
_summary = lambda c: ", ".join([r(f"avg(CASE WHEN {c} IS NULL THEN 0.0 ELSE 1.0 END)", "finite_rate"), r(f"avg({c})", "mean"), r(f"stddev_pop({c})", "std"), r(f"min({c})::DOUBLE", "min"), r(f"quantile_cont({c}::DOUBLE, 0.25)", "q25"), r(f"quantile_cont({c}::DOUBLE, 0.5)", "median"), r(f"quantile_cont({c}::DOUBLE, 0.75)", "q75"), r(f"max({c})::DOUBLE", "max"), r(f"coalesce(skewness({c}), 0)", "skew"), r(f"avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END)", "zero_rate")])
query("audit_numeric_summary", "lineitem", cte("holes") + per_column(["l_quantity", "l_extendedprice", "l_discount"], "holes", _summary), HOLES)(lambda df: quality.numeric_summary(df, ["l_quantity", "l_extendedprice", "l_discount"]))
_inf = ["p_partkey", "CASE WHEN p_partkey % 97 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE p_retailprice END AS price"]
query("audit_infinite_counts", "part", "SELECT 'price' AS column_name, sum(CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 0 END)::BIGINT AS infinite FROM part", _inf)(lambda df: quality.infinite_counts(df, ["price"]))
query("audit_outlier_rates", "events", f"WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT 'value' AS column_name, sum(CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN 1 ELSE 0 END)::BIGINT AS outliers, {r('avg(CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN 1.0 ELSE 0.0 END)', 'outlier_rate')} FROM events, q")(lambda df: quality.outlier_counts(df, ["value"]))
query("audit_skew_flags", "events", "SELECT 'value' AS column_name, abs(skewness(value)) >= 3 AS skewed FROM events")(lambda df: quality.numeric_summary(df, ["value"]).select("column_name", (F.abs("skew") >= 3).alias("skewed")))
_cat = lambda c, t: f"SELECT '{c}' AS column_name, count(v)::BIGINT AS cardinality, {r('count(v) / max(total)::DOUBLE', 'cardinality_ratio')}, {r('sum(CASE WHEN v IS NOT NULL AND n < greatest(2, ceil(total * 0.01)) THEN n ELSE 0 END) / max(total)::DOUBLE', 'rare_row_rate')}, {r('sum(CASE WHEN v IS NOT NULL AND n = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE / count(v)', 'singleton_share')}, {r('max(CASE WHEN v IS NOT NULL THEN n END) / max(total)::DOUBLE', 'top_share')} FROM (SELECT {c} AS v, count(*) AS n, (SELECT count(*) FROM {t}) AS total FROM {t} GROUP BY 1)"
query("audit_categorical_summary", "lineitem", cte("holes") + " UNION ALL ".join(_cat(c, "holes") for c in ("l_returnflag", "l_linestatus")), HOLES)(lambda df: quality.categorical_summary(df, ["l_returnflag", "l_linestatus"]))
query("audit_high_cardinality", "events", "SELECT 'event_type' AS column_name, count(DISTINCT event_type) > 128 AND count(DISTINCT event_type) > 0.2 * count(*) AS high FROM events UNION ALL SELECT 'props', count(DISTINCT props) > 128 AND count(DISTINCT props) > 0.2 * count(*) FROM events")(lambda df: quality.high_cardinality(df, ["event_type", "props"]))
query("audit_target_summary", "orders", "SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 30")(lambda df: quality.target_distribution(df, "o_orderstatus"))
query("audit_conflicting_labels", "lineitem", "SELECT l_quantity, l_discount, count(DISTINCT l_returnflag)::BIGINT AS targets, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1")(lambda df: quality.conflicting_patterns(df, ["l_quantity", "l_discount"], "l_returnflag"))
_dups = ["l_linenumber", "l_returnflag", "l_linestatus", "l_discount"]
query("audit_duplicates", "lineitem", f"SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_dups)} FROM lineitem)))::BIGINT AS duplicates, {r(f'(count(*) - (SELECT count(*) FROM (SELECT DISTINCT ' + ', '.join(_dups) + ' FROM lineitem)))::DOUBLE / count(*)', 'fraction')} FROM lineitem", _dups)(quality.duplicate_rows)
query("audit_text_modality", "documents", f"SELECT 'text' AS column_name, {r('''avg(CASE WHEN text IS NULL OR trim(text) = '' THEN 1.0 ELSE 0.0 END)''', 'empty_rate')}, {r('avg(length(text))', 'mean_length')}, {r('quantile_cont(length(text)::DOUBLE, 0.9)', 'q90_length')} FROM documents")(lambda df: quality.text_modality(df, ["text"]))


# ---- profile
query("profile_constant_columns", "orders", "SELECT 'one' AS column_name, true AS constant UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) <= 1 FROM orders UNION ALL SELECT 'hole', false", ["1 AS one", "o_orderstatus", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1 END AS hole"])(profile.constant_columns)
query("profile_duplicate_columns", "lineitem", "SELECT 'a' AS first, 'c' AS second", ["l_quantity AS a", "l_tax AS b", "l_quantity AS c"])(lambda df: profile.duplicate_column_pairs(df, ["a", "b", "c"]))
query("profile_correlations", "lineitem", " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, {r(f'corr({a}, {b})', 'corr')} FROM lineitem" for i, a in enumerate(NUM) for b in NUM[i + 1:]))(lambda df: profile.correlations(df, NUM))
query("profile_high_corr_pairs", "lineitem", f"SELECT 'l_quantity' AS first, 'twice' AS second, {r('corr(l_quantity, 2 * l_quantity + 0.0001)', 'corr')} FROM lineitem", ["l_quantity", "l_tax", "2 * l_quantity + 0.0001 AS twice"])(lambda df: profile.high_correlations(df, ["l_quantity", "l_tax", "twice"]))
query("profile_cardinality", "orders", per_column(["o_orderstatus", "o_orderpriority", "o_custkey"], "orders", lambda c: f"count(DISTINCT {c}) AS distinct_values"))(lambda df: profile.distinct_counts(df, ["o_orderstatus", "o_orderpriority", "o_custkey"]))
_q4 = "SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM orders"
query("profile_outlier_counts", "orders", f"WITH q AS ({_q4.format(c='o_totalprice')}) SELECT 'o_totalprice' AS column_name, sum(CASE WHEN o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a) THEN 1 ELSE 0 END)::BIGINT AS outliers FROM orders, q")(lambda df: quality.outlier_counts(df, ["o_totalprice"]).select("column_name", "outliers"))
query("filter_iqr_outliers", "events", f"WITH q AS ({_q4.format(c='value').replace('orders', 'events')}) SELECT event_id, {r('value', 'value')} FROM events, q WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")(lambda df: rows.remove_outliers(df, ["value"]).select("event_id", "value"))
query("profile_class_distribution", "labels", f"WITH c AS (SELECT toxic::VARCHAR AS class, count(*) AS n FROM labels GROUP BY 1) SELECT class, n, {r('(SELECT min(n) FROM c)::DOUBLE / (SELECT max(n) FROM c)', 'imbalance')}, (SELECT min(n) FROM c)::DOUBLE / (SELECT max(n) FROM c) < 0.1 AS imbalanced FROM c")(lambda df: profile.class_distribution(df, "toxic"))
query("profile_positive_counts", "labels", per_column(["quality", "toxic"], "labels", lambda c: f"sum(CASE WHEN {c} = 1 THEN 1 ELSE 0 END)::BIGINT AS positives, {r(f'avg({c})', 'rate')}"))(lambda df: profile.positive_counts(df, ["quality", "toxic"]))
query("profile_group_sizes", "orders", f"SELECT count(*) AS groups, min(n) AS smallest, max(n) AS largest, {r('avg(n)', 'mean')} FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")(lambda df: profile.group_sizes(df, "o_custkey"))
_leak = ["l_returnflag", "' ' || upper(l_returnflag) || ' ' AS copy", "l_linestatus", "CASE l_returnflag WHEN 'A' THEN 'x' WHEN 'N' THEN 'y' ELSE 'z' END AS coded", "CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 2.0 END * 1.0000001 AS leaky", "l_quantity"]
query("profile_leakage_exact_copy", "lineitem", "SELECT 'copy' AS column_name, true AS copy UNION ALL SELECT 'l_linestatus', false", _leak)(lambda df: profile.leakage_exact_copy(df, ["copy", "l_linestatus"], "l_returnflag"))
query("profile_leakage_one_to_one", "lineitem", "SELECT 'coded' AS column_name, true AS mapping UNION ALL SELECT 'l_linestatus', (SELECT count(DISTINCT l_returnflag || l_linestatus) = count(DISTINCT l_linestatus) AND count(DISTINCT l_linestatus) = count(DISTINCT l_returnflag) FROM lineitem)", _leak)(lambda df: profile.leakage_one_to_one(df, ["coded", "l_linestatus"], "l_returnflag"))
_code = "dense_rank() OVER (ORDER BY l_returnflag) - 1"
query("profile_leakage_corr", "lineitem", f"WITH c AS (SELECT *, {_code} AS y, CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 2.0 END * 1.0000001 AS leaky FROM lineitem) " + per_column(["leaky", "l_quantity"], "c", lambda c: f"{r(f'corr({c}, y)', 'corr')}, abs(corr({c}, y)) >= 0.98 AS leaks"), _leak)(lambda df: profile.leakage_correlation(df, ["leaky", "l_quantity"], "l_returnflag"))
query("infer_task_types", "orders", "SELECT 'o_orderstatus' AS column_name, count(DISTINCT o_orderstatus) AS distinct_values, CASE WHEN count(DISTINCT o_orderstatus) = 2 THEN 'binary' ELSE 'multiclass' END AS task FROM orders UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), CASE WHEN count(DISTINCT o_totalprice) = 2 THEN 'binary' ELSE 'regression' END FROM orders")(lambda df: profile.infer_tasks(df, ["o_orderstatus", "o_totalprice"]))
query("detect_id_like", "orders", "SELECT 'o_orderkey' AS column_name, count(*) > 20 AND count(DISTINCT o_orderkey) >= 0.995 * count(*) AS id_like FROM orders UNION ALL SELECT 'o_custkey', count(*) > 20 AND count(DISTINCT o_custkey) >= 0.995 * count(*) FROM orders", ["o_orderkey", "o_custkey"])(profile.id_like)
query("infer_text_modality_stats", "documents", f"SELECT 'text' AS column_name, {r('avg(length(text))', 'mean_length')}, {r('count(DISTINCT text)::DOUBLE / count(text)', 'distinct_ratio')}, {r('''avg(CASE WHEN regexp_matches(text, '[ \t\n]') THEN 1.0 ELSE 0.0 END)''', 'space_share')}, true AS is_text FROM documents")(lambda df: profile.text_like(df, ["text"]))

# ---- row filters, splits
query("drop_missing_targets", "lineitem", cte("holes") + f"SELECT l_orderkey, l_linenumber, {r('l_quantity', 'l_quantity')} FROM holes WHERE l_quantity IS NOT NULL", HOLES)(lambda df: rows.drop_missing_targets(df, ["l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity"))
query("drop_low_quality_rows", "lineitem", cte("holes") + f"SELECT l_orderkey, l_linenumber FROM holes WHERE {_rm} < 0.3", HOLES)(lambda df: rows.drop_low_quality(df, 0.3).select("l_orderkey", "l_linenumber"))
query("dedupe_rows", "lineitem", f"SELECT DISTINCT l_linenumber, l_returnflag, l_linestatus, {r('l_discount', 'l_discount')} FROM lineitem", _dups)(rows.drop_duplicate_rows)
query("drop_conflicting_labels", "lineitem", "SELECT l_orderkey, l_linenumber FROM (SELECT *, min(l_linestatus) OVER w AS a, max(l_linestatus) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_returnflag)) WHERE a = b")(lambda df: rows.drop_conflicting(df, ["l_partkey", "l_returnflag"], "l_linestatus").select("l_orderkey", "l_linenumber"))
_unit = lambda key, salt: f"('0x' || substr(md5('{salt}' || {key}::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
query("split_random", "orders", f"SELECT o_orderkey, {_unit('o_orderkey', '42:')} < 0.2 AS is_test FROM orders")(lambda df: split.split_random(df, "o_orderkey").select("o_orderkey", "is_test"))
query("split_group", "orders", f"SELECT o_orderkey, o_custkey, {_unit('o_custkey', '42:')} < 0.2 AS is_test FROM orders")(lambda df: split.split_group(df, "o_custkey").select("o_orderkey", "o_custkey", "is_test"))
query("split_stratified", "orders", f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_unit('o_orderkey', '42:')}, o_orderkey) <= greatest(1, floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2)) AS is_test FROM orders")(lambda df: split.split_stratified(df, "o_orderkey", "o_orderstatus").select("o_orderkey", "is_test"))
query("split_temporal", "events", f"SELECT event_id, row_number() OVER (ORDER BY ts, {_unit('event_id', '42:')}, event_id) > greatest(1, least(count(*) OVER () - 1, round(count(*) OVER () * 0.8))) AS is_test FROM events")(
    lambda df: split.split_temporal(df, "ts", "event_id").select("event_id", "is_test"))
query("assign_folds", "orders", f"SELECT o_orderkey, floor({_unit('o_orderkey', '42:fold:')} * 3)::INT AS fold FROM orders")(lambda df: split.folds(df, "o_orderkey").select("o_orderkey", "fold"))
query("stratified_sample", "orders", f"SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_unit('o_orderkey', '42:sample:')}, o_orderkey) AS i, "
      "count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE i <= greatest(1, round(n * 0.1))")(lambda df: split.stratified_sample(df, "o_orderkey", "o_orderstatus", 0.1).select("o_orderkey", "o_orderstatus"))
query("calibration_holdout", "orders", f"SELECT o_orderkey, {_unit('o_orderkey', '139:')} < 0.15 AS is_calibration FROM orders")(lambda df: split.calibration_holdout(df, "o_orderkey").select("o_orderkey", "is_calibration"))
query("modality_dropout", "orders", f"SELECT o_orderkey, {r('o_totalprice', 'o_totalprice')}, o_orderpriority FROM orders UNION ALL SELECT o_orderkey, CASE WHEN {_unit('o_orderkey', '820:')} >= 0.5 THEN {'round(o_totalprice, 6)'} END, CASE WHEN {_unit('o_orderkey', '820:')} < 0.5 THEN o_orderpriority END FROM orders WHERE {_unit('o_orderkey', '819:')} < 0.08", ["o_orderkey", "o_totalprice", "o_orderpriority"])(lambda df: split.modality_dropout(df, "o_orderkey", {"a": ["o_totalprice"], "b": ["o_orderpriority"]}))

# ---- cleaning
_key = ["l_orderkey", "l_linenumber"]
query("missing_indicators", "lineitem", cte("holes") + "SELECT l_orderkey, l_linenumber, (l_quantity IS NULL)::INT AS l_quantity__missing, (l_returnflag IS NULL)::INT AS l_returnflag__missing FROM holes", HOLES)(lambda df: clean.missing_indicators(df, ["l_quantity", "l_returnflag"]).select(*_key, "l_quantity__missing", "l_returnflag__missing"))
query("winsorize", "lineitem", f"WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, {r('greatest(a, least(b, l_extendedprice))', 'x')} FROM lineitem, q")(lambda df: df.select(*_key, clean.clip("l_extendedprice", clean.winsor_limits(df, ["l_extendedprice"])["l_extendedprice"]).alias("x")))
for _how, _agg in (("median", "quantile_cont(l_quantity::DOUBLE, 0.5)"), ("mean", "avg(l_quantity)")):
    query(f"impute_{_how}", "lineitem", cte("holes") + f"SELECT l_orderkey, l_linenumber, {r(f'coalesce(l_quantity, (SELECT {_agg} FROM holes))', 'l_quantity')} FROM holes", HOLES)(lambda df, how=_how: clean.impute(df, clean.fills(df, ["l_quantity"], how)).select(*_key, "l_quantity"))
query("rare_group", "events", "WITH k AS (SELECT event_type AS v, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= greatest(2, ceil((SELECT count(*) FROM events) * 0.15))) SELECT event_id, CASE WHEN event_type IN (SELECT v FROM k) THEN event_type ELSE '__rare__' END AS c FROM events", ["event_id", "event_type"])(lambda df: df.select("event_id", clean.group_rare("event_type", clean.kept_categories(df, ["event_type"], 0.15)["event_type"]).alias("c")))
query("ordinal_encode", "orders", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS code FROM orders")(lambda df: df.select("o_orderkey", clean.encode("o_orderpriority", clean.ordinal_codes(df, "o_orderpriority")).alias("code")))
query("unknown_category_replay", "orders", "SELECT o_orderkey, CASE WHEN o_orderstatus = (SELECT min(o_orderstatus) FROM orders) THEN o_orderstatus ELSE '__unknown__' END AS c FROM orders")(lambda df: df.select("o_orderkey", clean.replay_unknown("o_orderstatus", clean.ordinal_codes(df, "o_orderstatus")[:1]).alias("c")))
query("log1p_transform", "orders", f"SELECT o_orderkey, {r('ln(1 + o_totalprice)', 'x')} FROM orders")(lambda df: df.select("o_orderkey", clean.log1p("o_totalprice", 0.0).alias("x")))
for _how, _a, _b in (("standard", "avg(o_totalprice)", "stddev_pop(o_totalprice)"), ("minmax", "min(o_totalprice)", "max(o_totalprice) - min(o_totalprice)"), ("robust", "quantile_cont(o_totalprice, 0.5)", "quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)")):
    query(f"scale_{_how}", "orders", f"WITH s AS (SELECT {_a} AS a, {_b} AS b FROM orders) SELECT o_orderkey, {r('(o_totalprice - a) / b', 'x')} FROM orders, s")(lambda df, how=_how: df.select("o_orderkey", clean.scale("o_totalprice", clean.scales(df, ["o_totalprice"], how)["o_totalprice"]).alias("x")))
query("datetime_expand", "events", f"SELECT event_id, year(ts)::INT AS ts__year, month(ts)::INT AS ts__month, day(ts)::INT AS ts__day, (isodow(ts) - 1)::INT AS ts__dayofweek, dayofyear(ts)::INT AS ts__dayofyear, quarter(ts)::INT AS ts__quarter, (isodow(ts) >= 6)::INT AS ts__is_weekend, {r('epoch_us(ts) / 8.64e10', 'ts__days_since_epoch')}, {r('sin((month(ts) - 1) * 2 * pi() / 12)', 'ts__month_sin')}, {r('cos((isodow(ts) - 1) * 2 * pi() / 7)', 'ts__dow_cos')} FROM events")(lambda df: df.select("event_id", *[v.alias(k) for k, v in clean.datetime_parts("ts").items() if k.split("__")[1] in ("year", "month", "day", "dayofweek", "dayofyear", "quarter", "is_weekend", "days_since_epoch", "month_sin", "dow_cos")]))
query("drop_near_duplicates", "lineitem", "SELECT 'twice' AS dropped", ["l_quantity", "l_tax", "2 * l_quantity + 1 AS twice"])(lambda df: df.sparkSession.createDataFrame([(c,) for c in clean.near_duplicate_columns(df, ["l_quantity", "l_tax", "twice"])], "dropped string"))
_yj = lambda e: f"CASE WHEN abs({e}) < 1e-9 THEN ln(x + 1) ELSE (pow(x + 1, {e}) - 1) / {e} END"
_yj_round = lambda grid, source: f"(SELECT arg_max(e, f) AS e FROM (SELECT e, -count(*) / 2.0::DOUBLE * ln(greatest(var_pop({_yj('e')}), 1e-300)) + (e - 1) * sum(ln(x + 1)) AS f FROM x, (SELECT {grid} AS e FROM {source}) GROUP BY e))"
query("yeo_johnson", "part", f"""
WITH x AS (SELECT p_partkey, p_retailprice::DOUBLE AS x FROM part),
a AS {_yj_round('-4 + i * 0.5::DOUBLE', 'range(17) t(i)')},
b AS {_yj_round('a.e - 0.5 + i / 16.0::DOUBLE', 'a, range(17) t(i)')},
c AS {_yj_round('b.e - 0.0625 + i / 128.0::DOUBLE', 'b, range(17) t(i)')}
SELECT p_partkey, round({_yj('c.e')}, 6) AS x FROM x, c""")(lambda df: df.select("p_partkey", clean.yeo_johnson(F.col("p_retailprice"), clean.yeo_johnson_lambda(df, "p_retailprice")).alias("x")))



# ---- text
def _text(name: str, make, sql: str | None):
    query(name, "documents", sql)(lambda df: df.select("doc_id", *[v.alias(k) for k, v in make(F.col("text")).items()]))


_n = lambda p: f"len(regexp_extract_all(text, '{p}'))"
_sh = lambda a, b, k: r(f"CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / ({b})::DOUBLE END", k)
_text("text_char_stats", T.char_stats, f"SELECT doc_id, length(text)::BIGINT AS chars, {_n(T.WORD)}::BIGINT AS words, {_n(f'[{T.SENTENCE}]+')}::BIGINT AS sentences, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines, {_n('[?؟]')}::BIGINT AS questions, {_n('!')}::BIGINT AS exclamations FROM documents")
_text("text_ratios", T.ratios, "SELECT doc_id, " + ", ".join(_sh(_n(p), b, k) for k, p, b in (("digit", r"\p{Nd}", "length(text)"), ("alpha", r"\p{L}", "length(text)"), ("upper", r"\p{Lu}", _n(r"\p{L}")), ("lower", r"\p{Ll}", _n(r"\p{L}")), ("space", r"[ \t\n\r]", "length(text)"), ("punctuation", r"\p{P}", "length(text)"), ("symbol", r"\p{S}", "length(text)"), ("non_ascii", r"[^\x00-\x7F]", "length(text)"))) + " FROM documents")
_text("text_scripts", T.scripts, "SELECT doc_id, " + ", ".join(_sh(_n(rf"\p{{{p}}}"), _n(r"\p{L}"), k) for k, p in (("latin", "Latin"), ("arabic", "Arabic"), ("cyrillic", "Cyrillic"), ("han", "Han"), ("hiragana", "Hiragana"), ("katakana", "Katakana"), ("hangul", "Hangul"))) + " FROM documents")
_w = f"list_transform(regexp_extract_all(text, '{T.WORD}'), lambda x: lower(x))"
query("text_lexical_diversity", "documents", f"WITH w AS (SELECT doc_id, text, {_w} AS w FROM documents) SELECT doc_id, {_sh('len(list_distinct(w))', 'len(w)', 'unique_ratio')}, {_sh('ln(1 + len(list_distinct(w)))', 'ln(1 + len(w))', 'log_ttr')}, {_sh('len(list_distinct(w))', 'sqrt(greatest(length(text), 1))', 'per_root_char')}, {_sh('coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)', 'len(w)', 'word_mean')}, coalesce(list_max(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_max, "
      f"round(coalesce(list_stddev_pop(list_transform(w, lambda x: length(x))), 0.0), 6) AS word_std, "
      f"{_sh('list_sum([0] || list_transform(map_values(list_histogram(w)), lambda n: CASE WHEN n = 1 THEN 1 ELSE 0 END))', 'len(w)', 'hapax_ratio')} FROM w")(lambda df: text.lexical_diversity(df, "doc_id", "text"))
query("text_entropy", "documents", f"WITH c AS (SELECT doc_id, unnest({_w}) AS w FROM documents), n AS (SELECT doc_id, w, count(*) AS n FROM c GROUP BY 1, 2), e AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM n GROUP BY 1) SELECT d.doc_id, round(coalesce(e, 0.0), 6) + 0.0 AS token_entropy FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id")(lambda df: text.token_entropy(df, "doc_id", "text").select("doc_id", (F.round("token_entropy", 6) + 0.0).alias("token_entropy")))
query("text_bounded", "documents", "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 100) || chr(10) || '…' || chr(10) || substr(text, trunc(length(text) / 2 - 50)::INT + 1, 100) || chr(10) || '…' || chr(10) || right(text, 100) END AS part FROM documents")(lambda df: df.select("doc_id", T.bounded(F.col("text"), 300).alias("part")))
query("tfidf_topk", "documents", f"WITH w AS (SELECT doc_id, unnest({_w}) AS word FROM documents), t AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents), f AS (SELECT word, count(*) AS df FROM t GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.995 * (SELECT n FROM n)), s AS (SELECT doc_id, word, round((1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1), 9) AS score FROM t JOIN f USING (word), n) SELECT doc_id, rank, word, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS rank FROM s) WHERE rank <= 3")(lambda df: text.tfidf(df, "doc_id", "text"))
query("hashing_tfidf", "documents")(lambda df: text.hashed(df, "doc_id", "text").select("doc_id", F.col("features").cast("string").alias("features")))
query("lsa", "documents")(lambda df: text.latent(df, "doc_id", "text"))

# ---- ranking of features
query("variance_ranking", "lineitem", per_column(NUM, "lineitem", lambda c: r(f"var_pop({c})", "variance")))(lambda df: rank.variance_ranking(df, NUM))
query("anova_f_ranking", "lineitem", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 6) AS f FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) * count(*) AS ss, (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY l_returnflag)" for c in NUM))(lambda df: rank.anova_f(df, NUM, "l_returnflag"))
query("regression_f_ranking", "lineitem", per_column(NUM[1:], "lineitem", lambda c: r(f"corr({c}, l_quantity) ** 2 * (count(*) - 2) / (1 - corr({c}, l_quantity) ** 2)", "f")), digits=3)(lambda df: rank.regression_f(df, NUM[1:], "l_quantity"))
ORACLES["regression_f_ranking"] = ORACLES["regression_f_ranking"].replace(", 6) AS f", ", 3) AS f")

# ---- metrics
_said = [*SCORED, "CASE WHEN CAST((l_orderkey * 37 + l_partkey * 11 + l_linenumber * 5 + CASE WHEN l_returnflag = 'R' THEN 150 ELSE 0 END) % 1000 AS DOUBLE) / 1000 >= 0.5 THEN 1 ELSE 0 END AS said"]
_conf = f"WITH s AS (SELECT {', '.join(_said)} FROM lineitem), c AS (SELECT sum(y * said)::DOUBLE AS tp, sum((1 - y) * said)::DOUBLE AS fp, sum(y * (1 - said))::DOUBLE AS fn, sum((1 - y) * (1 - said))::DOUBLE AS tn FROM s), d AS (SELECT *, tp + fp + fn + tn AS n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) ** 2) AS e FROM c) "
query("metrics_binary", "lineitem", _conf + f"SELECT {r('(tp + tn) / n', 'accuracy')}, {r('tp / (tp + fp)', 'precision')}, {r('tp / (tp + fn)', 'recall')}, {r('2 * tp / (2 * tp + fp + fn)', 'f1')}, {r('(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))', 'mcc')}, {r('((tp + tn) / n - e) / (1 - e)', 'kappa')}, {r('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'balanced_accuracy')} FROM d", _said)(lambda df: metrics.binary(df, "y", "said"))
query("roc_auc", "lineitem", cte("scored") + f"SELECT {r('(sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))', 'roc_auc')} FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM scored)", SCORED)(lambda df: metrics.roc_auc(df, "y", "p"))
query("pr_auc", "lineitem", cte("scored") + ", t AS (SELECT p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY p), w AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS said FROM t) SELECT round((sum(pos * tp / said::DOUBLE) / sum(pos))::DOUBLE, 6) AS average_precision FROM w", SCORED)(lambda df: metrics.average_precision(df, "y", "p"))
query("log_loss", "lineitem", cte("scored") + f"SELECT {r('avg(-CASE WHEN y = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, p))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, p))) END)', 'log_loss')}, {r('avg((p - y) ** 2)', 'brier')} FROM scored", SCORED)(lambda df: metrics.log_loss(df, "y", "p"))
query("ece", "lineitem", cte("scored") + f"SELECT {r('sum(abs(c - k) * n) / sum(n)', 'ece')} FROM (SELECT least(floor(greatest(p, 1 - p) * 10), 9) AS b, count(*) AS n, avg(greatest(p, 1 - p)) AS c, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS k FROM scored GROUP BY 1)", SCORED)(lambda df: metrics.ece(df, "y", "p"))
_multi = ["l_returnflag AS y", "CASE WHEN l_orderkey % 3 = 0 THEN 'A' WHEN l_partkey % 2 = 0 THEN l_returnflag ELSE 'N' END AS p"]
query("metrics_multiclass", "lineitem", f"WITH s AS (SELECT {', '.join(_multi)} FROM lineitem), k AS (SELECT k, sum(a)::DOUBLE AS a, sum(s)::DOUBLE AS s, sum(h)::DOUBLE AS h FROM (SELECT y AS k, 1 AS a, 0 AS s, (y = p)::INT AS h FROM s UNION ALL SELECT p, 0, 1, 0 FROM s) GROUP BY 1), g AS (SELECT sum(h) AS c, sum(a) AS n, sum(a * s) AS x, sum(a * a) AS aa, sum(s * s) AS ss, avg(coalesce(h / nullif(s, 0), 0)) AS pr, avg(coalesce(h / nullif(a, 0), 0)) AS re, avg(h / nullif(a, 0)) AS ba, avg(2 * h / (a + s)) AS f, sum(2 * h / (a + s) * a) / sum(a) AS fw FROM k) SELECT {r('c / n', 'accuracy')}, {r('pr', 'precision')}, {r('re', 'recall')}, {r('f', 'f1_macro')}, {r('fw', 'f1_weighted')}, {r('(c * n - x) / (sqrt(n * n - ss) * sqrt(n * n - aa))', 'mcc')}, {r('(c / n - x / (n * n)) / (1 - x / (n * n))', 'kappa')}, {r('ba', 'balanced_accuracy')} FROM g", _multi)(lambda df: metrics.multiclass(df, "y", "p"))
_reg = ["l_extendedprice AS y", "l_extendedprice * 0.9 + l_quantity * 20 AS p", "l_tax AS y2", "l_discount AS p2"]
query("metrics_regression", "lineitem", f"WITH s AS (SELECT {', '.join(_reg)} FROM lineitem) SELECT {r('avg(abs(y - p))', 'mae')}, round(avg((y - p) ** 2), 6) AS mse, {r('sqrt(avg((y - p) ** 2))', 'rmse')}, {r('1 - avg((y - p) ** 2) / var_pop(y)', 'r2')}, {r('quantile_cont(abs(y - p), 0.5)', 'median_ae')}, {r('avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16))', 'mape')} FROM s".replace("round(avg((y - p) ** 2), 6)", "round(avg((y - p) ** 2), 2)"), _reg)(lambda df: metrics.regression(df, "y", "p").withColumn("mse", F.round("mse", 2)))
query("metrics_multioutput", "lineitem", f"WITH s AS (SELECT {', '.join(_reg)} FROM lineitem) SELECT {r('sqrt(avg((y - p) ** 2))', 'rmse_0')}, {r('sqrt(avg((y2 - p2) ** 2))', 'rmse_1')}, {r('(sqrt(avg((y - p) ** 2)) + sqrt(avg((y2 - p2) ** 2))) / 2', 'rmse')}, "
      f"{r('(avg(abs(y - p)) + avg(abs(y2 - p2))) / 2', 'mae')}, {r('1 - (avg((y - p) ** 2) / var_pop(y) + avg((y2 - p2) ** 2) / var_pop(y2)) / 2', 'r2')} FROM s", _reg)(lambda df: metrics.multioutput(df, [("y", "p"), ("y2", "p2")]))
_ml = ["quality AS a", "toxic AS b", "CAST(doc_id % 2 AS INT) AS pa", "CAST(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS pb"]
query("metrics_multilabel", "labels", f"WITH s AS (SELECT {', '.join(_ml)} FROM labels) SELECT {r('avg(CASE WHEN a = pa AND b = pb THEN 1.0 ELSE 0.0 END)', 'subset_accuracy')}, {r('avg(abs(a - pa) + abs(b - pb)) / 2', 'hamming')}, {r('(2 * sum(a * pa)::DOUBLE / (sum(a) + sum(pa)) + 2 * sum(b * pb)::DOUBLE / (sum(b) + sum(pb))) / 2', 'f1_macro')}, {r('2 * (sum(a * pa) + sum(b * pb))::DOUBLE / (sum(a) + sum(pa) + sum(b) + sum(pb))', 'f1_micro')}, "
      f"{r('avg(CASE WHEN a + b + pa + pb = 0 THEN 0.0 ELSE 2.0 * (a * pa + b * pb) / (a + b + pa + pb) END)', 'f1_samples')}, "
      f"{r('(sum(a * pa)::DOUBLE / sum(pa) + sum(b * pb)::DOUBLE / sum(pb)) / 2', 'precision_macro')}, {r('(sum(a * pa)::DOUBLE / sum(a) + sum(b * pb)::DOUBLE / sum(b)) / 2', 'recall_macro')} FROM s", _ml)(lambda df: metrics.multilabel(df, [("a", "pa"), ("b", "pb")]))
_rk = ["o_custkey AS g", "CAST(o_orderkey % 4 AS DOUBLE) AS gain", "CAST(o_orderkey * 7 % 5 AS DOUBLE) AS score"]
query("ndcg_at_k", "orders", f"WITH s AS (SELECT {', '.join(_rk)} FROM orders), t AS (SELECT *, avg(gain) OVER (PARTITION BY g, score) AS m, row_number() OVER (PARTITION BY g ORDER BY score DESC) AS i, row_number() OVER (PARTITION BY g ORDER BY gain DESC) AS j FROM s), e AS (SELECT g, sum(CASE WHEN i <= 5 THEN m / log2(i + 1) ELSE 0 END) AS d, sum(CASE WHEN j <= 5 THEN gain / log2(j + 1) ELSE 0 END) AS z FROM t GROUP BY g HAVING count(*) >= 2) SELECT {r('avg(CASE WHEN z = 0 THEN 0 ELSE d / z END)', 'ndcg')}, count(*) AS groups FROM e", _rk)(lambda df: metrics.ndcg(df, "g", "gain", "score", 5))

# ---- decisions
query("threshold_sweep", "lineitem", cte("scored") + f", g AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(1, 100) t(i)), c AS (SELECT threshold, sum(CASE WHEN p >= threshold THEN y ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN p >= threshold THEN 1 - y ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN p < threshold THEN y ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN p < threshold THEN 1 - y ELSE 0 END)::DOUBLE AS tn FROM scored, g GROUP BY 1) SELECT {r('threshold', 'threshold')}, {r('CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END', 'f1')}, {r('CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END', 'precision')}, {r('tp / (tp + fn)', 'recall')}, {r('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')}, {r('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'balanced_accuracy')}, {r('CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END', 'mcc')} FROM c", SCORED)(lambda df: decide.threshold_sweep(df, "y", "p"))
query("conformal_quantile", "lineitem", cte("scored") + f", o AS (SELECT abs(y - p) AS e, row_number() OVER (ORDER BY abs(y - p)) AS i, count(*) OVER () AS n FROM scored) SELECT {r('max(e)', 'q')} FROM o WHERE i = ceil(least(1.0, ceil((n + 1) * 0.9) / n) * (n - 1)) + 1", SCORED)(lambda df: df.sparkSession.createDataFrame([(decide.conformal_quantile(df, F.abs(F.col("y") - F.col("p")), 0.1),)], "q double"))
query("conformal_intervals", "lineitem", f"WITH s AS (SELECT l_orderkey, l_linenumber, {', '.join(_reg)} FROM lineitem) SELECT l_orderkey, l_linenumber, {r('p - 1000', 'lower')}, {r('p + 1000', 'upper')}, y BETWEEN p - 1000 AND p + 1000 AS covered FROM s", [*_key, *_reg])(lambda df: df.withColumns(decide.interval("p", 1000.0)).select(*_key, "lower", "upper", F.col("y").between(F.col("lower"), F.col("upper")).alias("covered")))
query("conformal_sets", "lineitem", cte("scored") + "SELECT l_orderkey, l_linenumber, CASE WHEN p >= 0.4 AND 1 - p >= 0.4 THEN 'no,yes' WHEN p > 1 - p THEN 'yes' ELSE 'no' END AS labels FROM scored", SCORED)(lambda df: df.select(*_key, F.array_join(decide.prediction_set(F.array(1 - F.col("p"), F.col("p")), ["no", "yes"], 0.6), ",").alias("labels")))
_ood_q = ", ".join(f"quantile_cont({c}::DOUBLE, {q}) AS {c}_{n}" for c in NUM[:2] for n, q in (("a", 0.005), ("b", 0.25), ("m", 0.5), ("c", 0.75), ("d", 0.995)))
_z = lambda c: f"greatest(0.0, least(1.0, (abs({c} - {c}_m) / ({c}_c - {c}_b) - 2) / 8))"
_o = lambda c: f"CASE WHEN {c} < {c}_a OR {c} > {c}_d THEN 1.0 ELSE 0.0 END"
query("ood_scores", "lineitem", f"WITH q AS (SELECT {_ood_q} FROM lineitem) SELECT l_orderkey, l_linenumber, round((0.55 * ({_z(NUM[0])} + {_z(NUM[1])}) / 2 + 0.30 * ({_o(NUM[0])} + {_o(NUM[1])}) / 2)::DOUBLE, 6) AS ood FROM lineitem, q")(lambda df: df.select(*_key, decide.ood_score(decide.ood_reference(df, NUM[:2])).alias("ood")))
query("ood_reference", "lineitem", " UNION ALL ".join(f"SELECT '{c}' AS column_name, {r(f'quantile_cont({c}::DOUBLE, 0.5)', 'median')}, {r(f'quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)', 'iqr')}, {r(f'quantile_cont({c}::DOUBLE, 0.005)', 'low')}, {r(f'quantile_cont({c}::DOUBLE, 0.995)', 'high')} FROM lineitem" for c in NUM))(lambda df: df.sparkSession.createDataFrame([(c, *map(float, v)) for c, v in decide.ood_reference(df, NUM).items()], "column_name string, median double, iqr double, low double, high double"))
_edges = ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 10))
query("drift_numeric_psi", "events", f"WITH a AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-16'), b AS (SELECT value FROM events WHERE ts >= TIMESTAMP '2024-01-16'), e AS (SELECT [{_edges}] AS e FROM a), ca AS (SELECT len(list_filter(e, lambda x: x <= value)) AS k, count(*) / (SELECT count(*) FROM a)::DOUBLE AS p FROM a, e GROUP BY 1), cb AS (SELECT len(list_filter(e, lambda x: x <= value)) AS k, count(*) / (SELECT count(*) FROM b)::DOUBLE AS p FROM b, e GROUP BY 1), j AS (SELECT greatest(coalesce(ca.p, 0), 1e-6) AS p, greatest(coalesce(cb.p, 0), 1e-6) AS q FROM range(0, 10) t(k) LEFT JOIN ca ON ca.k = t.k LEFT JOIN cb ON cb.k = t.k), s AS (SELECT p / (SELECT sum(p) FROM j) AS p, q / (SELECT sum(q) FROM j) AS q FROM j) SELECT 'value' AS column_name, {r('sum((q - p) * ln(q / p))', 'psi')} FROM s")(lambda df: df.sparkSession.createDataFrame([(x["column_name"], x["psi"]) for x in decide.numeric_drift(decide.numeric_reference(df.where("ts < '2024-01-16'"), ["value"]), df.where("ts >= '2024-01-16'"))], "column_name string, psi double"))
_two = "SELECT event_type AS v, sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END)::DOUBLE AS b FROM events GROUP BY 1 UNION ALL SELECT NULL, 0, 0"
query("drift_categorical_js", "events", f"WITH c AS ({_two}), p AS (SELECT greatest(a / (SELECT sum(a) FROM c), 1e-6) AS a, greatest(b / (SELECT sum(b) FROM c), 1e-6) AS b FROM c), s AS (SELECT a / (SELECT sum(a) FROM p) AS a, b / (SELECT sum(b) FROM p) AS b FROM p) SELECT 'event_type' AS column_name, {r('sqrt(greatest(0, sum(a * ln(2 * a / (a + b)) + b * ln(2 * b / (a + b))) / 2))', 'js')} FROM s")(lambda df: df.sparkSession.createDataFrame([(x["column_name"], x["js"]) for x in [decide.categorical_drift(df.where("ts < '2024-01-16'"), df.where("ts >= '2024-01-16'"), "event_type")]], "column_name string, js double"))

_members = [*SCORED, "CAST((l_orderkey * 13 + l_linenumber) % 1000 AS DOUBLE) / 1000 AS q"]
query("prediction_correlation", "lineitem", f"WITH s AS (SELECT {', '.join(_members)} FROM lineitem) SELECT 'p' AS first, 'q' AS second, {r('corr(p, q)', 'corr')} FROM s", _members)(lambda df: profile.correlations(df, ["p", "q"]))
query("voting_weighted", "lineitem", f"WITH s AS (SELECT {', '.join(_members)} FROM lineitem) SELECT l_orderkey, l_linenumber, {r('(3 * p + q) / 4', 'vote')} FROM s", _members)(lambda df: df.select(*_key, learn.vote(["p", "q"], [3.0, 1.0]).alias("vote")))
query("voting_weight_search", "lineitem", f"WITH s AS (SELECT {', '.join(_members)} FROM lineitem) SELECT i / 10.0::DOUBLE AS weight, round(avg((p * (i / 10.0) + q * (1 - i / 10.0) - y) ** 2)::DOUBLE, 6) AS brier FROM s, range(0, 11) t(i) GROUP BY 1", _members)(lambda df: wide_then_long(df.withColumns({f"w{i}": (F.col("p") * (i / 10) + F.col("q") * (1 - i / 10) - F.col("y")) ** 2 for i in range(11)}), [f"w{i}" for i in range(11)], {"brier": lambda c: F.avg(c)}).select((F.substring("column_name", 2, 9).cast("double") / 10).alias("weight"), "brier"))

from . import extended, inputs  # noqa: E402, F401
