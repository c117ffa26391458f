"""Streaming extensions: windowed drift counts and stateless out-of-distribution scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket_of, finite
from ..operators.decide import ood_score


def windowed_bins(stream: DataFrame, time: str, column: str, edges: list[float], every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows of each reference bin in each time window: state is windows times bins, whatever the input."""
    inside = bucket_of(finite(column), F.array(*[F.lit(float(e)) for e in edges]))
    t = F.col(time).cast("timestamp")
    rows = stream.select(t.alias("ts"), F.when(finite(column).isNotNull(), inside).alias("bin"))
    return rows.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "bin").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bin", "n")


def scored(stream: DataFrame, reference: dict[str, tuple]) -> DataFrame:
    return stream.withColumn("ood_score", ood_score(reference))
