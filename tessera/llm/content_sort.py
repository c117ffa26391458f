"""Exact duplicates by sorting content.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` has become
one space.  Rows are dealt by Spark's sampled range partitioner in the order of
their normalised bytes; an external sort then places equal texts next to each
other, and neighbours are compared in full (a window whose partitions are the
runs of one text).  Of each run the row with the smallest doc_id stays.

* The splitters are samples of the first ``PREFIX`` characters and a 64-bit hash
  of the whole text, so that neither long texts nor texts that begin alike make
  the sample large or a range heavy.  The sort goes on with the whole bytes.
* A text whose copies are many or large (counted by hash with partial
  aggregation, 24 bytes a text) is dealt into salts, each a run of its own of
  some ``HOT_ROWS`` rows; the first rows of these runs are then compared once
  more, in full, by partial aggregation.

Only DataFrame operations; whole texts cross the network once.

Defined cases: a null text is empty, and equal to an empty one and to no other
(a text of white space alone is one space); a null doc_id comes after all
others, so it stays only where all copies have none, and keep_id is null then;
of rows that share the smallest doc_id one stays; repeated rows are copies;
very long texts are compared whole; other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, stored

PREFIX = 64  # characters of a text among the splitters
HOT_ROWS, HOT_BYTES = 256, 32 << 20  # copies of one text, and their bytes, from which they are dealt into salts
FAR_ROWS = 1_000_000  # hot texts (some 24 bytes each) that may be broadcast; beyond, the join shuffles


def normalised(text):
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FAR_ROWS else df


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("hash", F.xxhash64("norm"))
    sizes = rows.groupBy("hash").agg(F.count("*").alias("n"), F.sum(F.octet_length("norm")).alias("bytes"))
    hot = stored(sizes.where((F.col("n") >= hot_rows) | ((F.col("n") > 1) & (F.col("bytes") >= HOT_BYTES)))
                 .select("hash", F.ceil(F.greatest(F.col("n") * 2 / hot_rows, F.col("bytes") / HOT_BYTES)).cast("int").alias("salts")), "content-hot")
    salted = not hot.isEmpty()
    if salted:
        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
        rows = numbered.join(_near(hot), "hash", "left").withColumn("salt", salt).drop("row", "salts")

    order = ["prefix", "hash", *(["salt"] if salted else [])]
    dealt = rows.withColumn("prefix", F.substring("norm", 1, PREFIX)).repartitionByRange(shuffle_parts(docs.sparkSession), *order)
    run = Window.partitionBy(*order, "norm").orderBy(F.asc_nulls_last("doc_id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (dealt.sortWithinPartitions(*order, "norm", F.asc_nulls_last("doc_id"))
            .select("doc_id", "norm", *order[2:], F.row_number().over(run).alias("place"), F.first("doc_id").over(whole).alias("first"), F.count(F.lit(1)).over(whole).alias("n"))
            .withColumn("text_sha256", F.sha2(F.encode("norm", "UTF-8"), 256)))
    own = [F.col("first").alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == 1).alias("kept")]
    if not salted:
        return runs.select("doc_id", *own, "text_sha256")

    # The first row of each run of a salted text carries the text, for the comparison between the runs.
    mine = stored(runs.withColumn("norm", F.when(F.col("salt").isNotNull() & (F.col("place") == 1), F.col("norm"))), "content-runs")
    heads = (mine.where("norm IS NOT NULL").groupBy("norm")
             .agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "salt")).alias("m"), F.sum("n").alias("all"))
             .select(F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), F.col("m.first").alias("least"), F.col("m.salt").alias("at"), "all"))
    heads = stored(heads, "content-heads")
    both = mine.drop("norm").join(_near(heads), "text_sha256", "left")
    joined = F.col("salt").isNotNull()
    return both.select("doc_id", F.when(joined, F.col("least")).otherwise(F.col("first")).alias("keep_id"), F.when(joined, F.col("all")).otherwise(F.col("n")).alias("group_size"),
                       ((F.col("place") == 1) & (~joined | (F.col("salt") == F.col("at")))).alias("kept"), "text_sha256")
