"""Feature ranking: variance, ANOVA F, regression F, mutual information of binned values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_quantiles, finite, safe_corr, wide_then_long


def variance_ranking(df: DataFrame, columns: list[str]) -> DataFrame:
    return wide_then_long(df, columns, {"variance": lambda c: F.var_pop(finite(c))})


def anova_f(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """F of each column between classes, from per-class counts, sums and sums of squares."""
    long = df.where(F.col(target).isNotNull()).select(F.col(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), finite(c).alias("x")) for c in columns])).alias("r")).select("y", "r.*").where("x IS NOT NULL")
    k = long.groupBy("column_name", "y").agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("ss"))
    t = k.groupBy("column_name").agg(F.sum("n").alias("N"), F.count("*").cast("double").alias("k"), F.sum("ss").alias("within"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    between = k.join(F.broadcast(t.select("column_name", "mean")), "column_name").groupBy("column_name").agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("between"))
    return t.join(between, "column_name").select("column_name", F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("N") - F.col("k"))).alias("f"))


def regression_f(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    out = wide_then_long(df, columns, {"r": lambda c: safe_corr(finite(c), finite(target)), "n": lambda c: F.count(F.when(finite(target).isNotNull(), finite(c))).cast("double")})
    return out.select("column_name", F.try_divide(F.col("r") ** 2 * (F.col("n") - 2), 1 - F.col("r") ** 2).alias("f"))


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 8) -> DataFrame:
    """Mutual information (nats) of quantile-binned columns with a class target."""
    points = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(df, {c: finite(c) for c in columns}, points)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), sum((F.when(finite(c) >= e, 1).otherwise(0) for e in sorted(set(edges[c] or []))), F.lit(0)).alias("b")) for i, c in enumerate(columns)])
    n = df.select(F.col(target).alias("y"), F.explode(cells).alias("r")).select("y", "r.*").groupBy("column_name", "b", "y").agg(F.count("*").cast("double").alias("n"))
    x = n.groupBy("column_name", "b").agg(F.sum("n").alias("nx"))
    y = n.groupBy("column_name", "y").agg(F.sum("n").alias("ny"))
    t = n.groupBy("column_name").agg(F.sum("n").alias("nt"))
    j = n.join(x, ["column_name", "b"]).join(y, ["column_name", "y"]).join(t, "column_name")
    return j.groupBy("column_name").agg(F.sum(F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")))).alias("mi"))
