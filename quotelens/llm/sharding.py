"""Sharding: global prefix sums of byte sizes from per-partition totals, cut at equal targets.

Rows are ordered by doc_id (nulls first; ties by checksum and size), so shards are contiguous ranges of ids
whose byte totals differ by no more than the rows at the cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, partitions

SHARDS = 8


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    Size is the UTF-8 bytes of the text plus 1, so a null or empty text weighs 1. Repeated rows are rows of their own. Empty table: no
    rows. Only (doc_id, size, checksum) is shuffled, never the text. The range-partitioned rows are checkpointed, so that a
    lost executor can't change which row is in which partition after the totals have been taken.
    """
    spark = docs.sparkSession
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    ranged = cut(narrow.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row for each partition: the only thing that one task sees whole.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )
    inner = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumn("sum_here", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("row_here", F.row_number().over(inner))
        .join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("bytes_before") + F.col("sum_here") - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.col("row_here") - 1)
        # By its middle a row belongs to the target range that holds most of it.
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"((2 * start + size) * {shards}) div (2 * all_bytes)")).cast("int"))
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
