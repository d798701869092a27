"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are range-partitioned by id once and written with their partition's number.  A prefix sum is then the
totals of the partitions before (one row per partition, the only thing summed in one place) plus the running sum
inside the partition.  Shard s takes the rows whose middle byte lies in [s, s+1) / shards of all bytes, so each
boundary is off its target by at most half a row, and neighbours in id order stay together.

Edge cases: a null text has no bytes and size 1; an empty table gives an empty result; rows with equal ids are
ordered by checksum and size, and rows equal in all three are interchangeable; null ids come first.  A row larger
than a shard's share leaves shards empty.  Extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, utf8


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], work: Workspace) -> tuple[DataFrame, DataFrame]:
    """df with, for each (name, column) of sums, the sum of that column over the rows before; and the one-row grand totals.

    order: columns that sort the rows.  Every column summed must be integral and not null.  Column names
    starting with ``__`` are the operator's own.
    """
    parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order]).withColumn("__part", F.spark_partition_id())
    kept = work.keep(dealt, "ranges")
    totals = kept.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = W.partitionBy("__part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    out = kept.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__in_{n}") for n, c in sums.items()])
    out = out.join(F.broadcast(starts), "__part")  # as many rows as partitions
    out = out.select(*df.columns, *[(F.col(f"__in_{n}") + F.col(f"__{n}")).alias(n) for n in sums])
    return out, totals.agg(*[F.coalesce(F.sum(f"__{n}"), F.lit(0)).alias(n) for n in sums])


def byte_shards(df: DataFrame, work: Workspace, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot): size is the text's UTF-8 bytes plus 1; slot counts a shard's rows from 0 in id order."""
    sized = df.select(key, (F.octet_length(utf8(text)) + 1).cast("bigint").alias("size"), F.crc32(utf8(text)).alias("text_crc32"), F.lit(1).cast("bigint").alias("one"))
    summed, totals = prefix_sums(sized, [key, "text_crc32", "size"], {"bytes_before": "size", "rows_before": "one"}, work)
    total = totals.first()["bytes_before"]
    # 2 * middle byte * shards / (2 * total), in whole numbers
    middle = F.col("bytes_before").cast("decimal(38,0)") * 2 + F.col("size")
    shard = F.floor(middle * shards / F.lit(max(1, 2 * total)).cast("decimal(38,0)")).cast("int")
    placed = work.keep(summed.withColumn("shard", F.least(shard, F.lit(shards - 1))), "placed")
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(key, "size", "text_crc32", "shard", (F.col("rows_before") - F.col("first")).alias("slot"))
