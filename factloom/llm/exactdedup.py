"""Exact dedup by content sort, in DataFrame functions only.

Texts are normalised (A-Z lower-cased), then range-partitioned by sampled splitters over
``(first characters, 64-bit hash, slice)``; every partition is sorted externally by the whole normalised text, so that
equal texts are adjacent, and neighbours are compared in full: a text that differs from the one before it starts
a run. The run's extreme identifier stays.

The splitter key is short, so the sampled rows that reach the driver are small whatever the texts' length. A hash that
more rows hold than a ``1 / (2 * partitions)`` share of all rows is hot; there are at most ``2 * partitions`` of them, a
bounded broadcast. Only their rows are dealt over slices (by a hash of the identifier), each slice is sorted and
compared like any other run, and the slices' few run heads are combined by an aggregate.

Defined results: null text counts as empty; a null identifier loses to any other (a group of only nulls keeps null);
rows that repeat identifier and text are all marked as kept or all dropped; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


def normalised(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of one byte a character take the quicker function."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, C.ASCII_UPPER, C.ASCII_LOWER))


def groups(docs: DataFrame, *, keep: str = "min", prefix: int = 16) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row; ``keep`` is min or max."""
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    pick = F.min if keep == "min" else F.max
    spark = docs.sparkSession
    wide = C.width(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm")).withColumn("h", F.xxhash64("norm"))
    counts = docs.select(F.xxhash64(normalised(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    total = docs.count()
    hot = counts.where(F.col("n") > F.lit(max(16, total // (2 * wide)))).select("h", F.lit(True).alias("hot"))
    dealt = rows.join(F.broadcast(hot), "h", "left").select(
        "doc_id",
        "norm",
        "h",
        F.substring("norm", 1, prefix).alias("head"),
        F.when(F.col("hot"), F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(11)), F.lit(4 * wide))).otherwise(F.lit(-1)).alias("slice"),
    )
    spread = dealt.repartitionByRange(wide, "head", "h", "slice")
    # The range partitioning by (head, h, slice) already clusters these keys: the windows sort in place.
    place = Window.partitionBy("head", "h", "slice").orderBy("norm", F.col("doc_id").asc_nulls_first())
    compared = spread.withColumn("starts", F.coalesce(F.col("norm") != F.lag("norm").over(place), F.lit(True)).cast("int"))
    runs = compared.withColumn("run", F.sum("starts").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("head", "h", "slice", "run")
    sized = runs.withColumn("run_id", pick("doc_id").over(own)).withColumn("run_size", F.count("*").over(own))
    found = C.table(sized.select("doc_id", F.sha2(F.col("norm"), 256).alias("text_sha256"), "slice", "run_id", "run_size"), "content-sort")
    # Hot groups: a row per run in a slice, at most slices times hot hashes, met by digest.
    combined = (
        found.where("slice >= 0")
        .groupBy("text_sha256", "slice")
        .agg(pick("run_id").alias("run_id"), F.max("run_size").alias("run_size"))
        .groupBy("text_sha256")
        .agg(pick("run_id").alias("all_id"), F.sum("run_size").alias("all_size"))
    )
    # One row per hot text; hot hashes number at most 2 * partitions.
    out = found.join(F.broadcast(combined), "text_sha256", "left")
    keep_id = F.when(F.col("slice") < 0, F.col("run_id")).otherwise(F.col("all_id"))
    size = F.when(F.col("slice") < 0, F.col("run_size")).otherwise(F.col("all_size"))
    return out.select("doc_id", keep_id.alias("keep_id"), size.cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, *, keep: str = "min") -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that stay; of rows that repeat a kept identifier and text one
    stays. Null texts count as empty; of a group with null identifiers only one row stays; an empty table stays empty."""
    of, digest, own = (C.fresh(n, docs.columns) for n in ("keep_of", "keep_digest", "own_digest"))
    decided = groups(docs, keep=keep).where("kept").select(F.col("doc_id").alias(of), F.col("text_sha256").alias(digest)).distinct()
    tagged = docs.withColumn(own, F.sha2(normalised(F.col("text")), 256))
    stays = tagged.join(decided, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(own) == F.col(digest)), "left_semi")
    again = docs.groupBy("doc_id").count().where("count > 1").limit(1)
    if not again.isEmpty():
        stays = stays.dropDuplicates(["doc_id", own])
    return stays.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size, sha256(norm) AS text_sha256 FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, g.text_sha256 FROM n JOIN g USING (norm)
"""
