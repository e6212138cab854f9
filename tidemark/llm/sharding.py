"""Contiguous shards of near equal bytes, cut from global prefix sums of sizes.

Rows are range-partitioned into a total order; each partition's total (one row
a partition) gives every partition its offset, running sums inside partitions
give each row its place in the whole, and equal targets cut the line of bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import remove, written

LAW = "bytes"


def prefix_sums(rows: DataFrame, order: Sequence[str], *values: str) -> DataFrame:
    """``rows``, written, with ``place`` (rows before), and for each value ``before_<value>`` (its sum over earlier rows) and ``total_<value>``.

    ``order`` should tell rows apart; rows that tie in all of it follow each
    other in any order. No rows give no rows.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt, dealt_at = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = [F.sum(v).alias(f"_sum_{v}") for v in values]
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_rows"), *sums)
    earlier, whole = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    # one row for each range partition, so the broadcast is bounded by their number
    starts = [x for v in values for x in (before(f"_sum_{v}").alias(f"_start_{v}"), F.sum(f"_sum_{v}").over(whole).alias(f"total_{v}"))]
    offsets = totals.select("_part", before("_rows").alias("_first"), *starts)
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    running = dealt.withColumns({"_row": F.row_number().over(inside), **{f"_upto_{v}": F.sum(v).over(inside) for v in values}})
    out = running.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_first") + F.col("_row") - 1)
    out = out.withColumns({f"before_{v}": F.col(f"_start_{v}") + F.col(f"_upto_{v}") - F.col(v) for v in values})
    out = out.drop("_part", "_row", "_first", *[f"_{x}_{v}" for v in values for x in ("start", "upto")])
    out, _ = written(out, "placed")
    remove(spark, dealt_at)
    return out


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    Rows are in order of id (nulls first), checksum and size. The shard of a row
    is where the middle of its bytes falls on the line of all bytes cut at
    ``shards`` equal targets; slots count from 0 in each shard. A null text has
    size ``overhead`` and a null checksum. A row larger than a target leaves
    neighbouring shards empty. No rows give no rows; further columns are ignored.
    """
    sized = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
    )
    placed = prefix_sums(sized, ["id", "text_crc32", "size"], "size")
    placed = placed.withColumn("shard", F.expr(f"cast(least({shards - 1}, (2 * before_size + size) * {shards} div (2 * total_size)) as int)"))
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # a row for each shard
    return placed.join(first, "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
