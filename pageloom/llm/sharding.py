"""Contiguous shards of nearly equal bytes.

Documents are ordered by id (then by checksum and size; a null id first). The
running byte total of the whole corpus follows from the totals of the ordered
partitions, and shards are cut where it crosses equal targets.

Nulls: a null text has no bytes, so its size is 1 and its checksum 0. Repeated
rows are rows of their own with slots of their own. An empty table gives no
rows. Documents are never split, so a shard differs from the target by at most
one document at either end. Only id, size and checksum are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import narrow
from pageloom.scratch import materialize

_ROW_BITS = 33  # monotonically_increasing_id() keeps the partition above these


def byte_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard (from 0), slot (from 0 in each shard)."""
    sized = materialize(
        narrow(docs, "doc_id", "text").select(
            "doc_id",
            (F.octet_length("text") + 1).cast("long").alias("size"),
            F.crc32("text").alias("text_crc32"),
        ),
        "sizes",
    )
    order = ["doc_id", "text_crc32", "size"]
    # equal rows are interchangeable; the last column deals them out
    tied = sized.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    ordered = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    marked = materialize(ordered.withColumn("_mark", F.monotonically_increasing_id()), "ordered")
    marked = marked.withColumn("_part", F.shiftright("_mark", _ROW_BITS))

    # one row per partition
    parts = materialize(
        marked.groupBy("_part").agg(F.sum("size").alias("_size"), F.count("*").alias("_rows")),
        "totals",
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_part",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
    )
    total = parts.agg(F.sum("_size")).first()[0] or 1

    within = (
        Window.partitionBy("_part").orderBy("_mark").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("_bytes_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    in_part = F.col("_mark").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = marked.join(F.broadcast(offsets), "_part").select(
        *order, start.alias("_start"), (F.col("_rows_before") + in_part).alias("_row")
    )
    # the middle of a document decides, so a cut lies within half a document of its target
    middle = (2 * F.col("_start") + F.col("size")).cast("decimal(38,0)")
    shard = F.floor(middle * shards / F.lit(2 * total).cast("decimal(38,0)"))
    cut = materialize(
        placed.withColumn("shard", F.least(shard, F.lit(shards - 1)).cast("int")), "shards"
    )
    first = cut.groupBy("shard").agg(F.min("_row").alias("_first"))  # a row for each shard
    return cut.join(F.broadcast(first), "shard").select(
        *order, "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )
