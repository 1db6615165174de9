"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are sorted over range partitions; each partition's total is one row, the running sum of those totals gives
every partition its offset, and a running sum inside the partition completes each row's global prefix. A row
goes to the shard in whose equal part of all bytes its midpoint lies, so shards are contiguous in the order
and differ from the equal target by at most one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 40
ROW_BYTES = 16


def text_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def text_crc(text: str = "text") -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def prefix_shards(rows: DataFrame, size: str, order: list[str], shards: int = SHARDS) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in each shard) to ``rows``.

    Sizes are longs above 0, null counting as 0; ``order`` should make a total order up to equal rows, nulls come first. Fewer rows than
    shards leave shards empty. Rows of one key may lie in many partitions: the last columns of ``order`` split it.
    Equal rows are interchangeable, whichever comes first.
    """
    sized = rows.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    # The partition number is kept with each row, so that offsets fit whatever way the table is read again.
    parted = written(sized.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "shards")
    totals = parted.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    # One row a partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(*order, "_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = parted.withColumn("_upto", F.sum("_size").over(inside)).join(F.broadcast(offsets), "_part")
    middle = 2 * (F.col("_bytes0") + F.col("_upto")) - F.col("_size")
    # Whole numbers throughout: a quotient that is rounded could lie beyond a cut.
    placed = placed.withColumn("_middle", middle.cast("decimal(30,0)") * F.lit(shards).cast("decimal(6,0)"))
    sharded = placed.withColumn("shard", F.expr(f"cast(least(_middle div (2 * cast(greatest(_all, 1) as decimal(30,0))), {shards - 1}) as int)")).withColumn("_in", F.row_number().over(Window.partitionBy("_part", "shard").orderBy(*order, "_size")))
    # A slot counts the rows of the shard in earlier partitions, then those before it in its own.
    counts = sharded.groupBy("_part", "shard").agg(F.count("*").alias("_n"))
    first = counts.select("_part", "shard", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # One row for each shard that a partition touches: partitions plus shards at most.
    return sharded.join(F.broadcast(first), ["_part", "shard"]).withColumn("slot", F.col("_before") + F.col("_in") - 1).drop(
        "_part", "_size", "_bytes0", "_upto", "_all", "_middle", "_in", "_before"
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """documents -> (doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row.

    The order is the text's checksum and then doc_id: shards are well mixed, and equal texts lie side by side.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_size().alias("size"), text_crc().alias("text_crc32"))
    placed = prefix_shards(rows, "size", ["text_crc32", "doc_id"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
