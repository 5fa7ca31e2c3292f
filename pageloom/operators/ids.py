"""Dense surrogate ids in key order without a single-partition sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.scratch import materialize

# monotonically_increasing_id() keeps the partition number above 33 row bits.
_ROW_BITS = 33


def assign_ids(
    df: DataFrame, keys: list[str | Column], id_column: str, after: int = 0
) -> DataFrame:
    """Number the rows ``after + 1, after + 2, ...`` in the order of ``keys``.

    Equals ``row_number() over (order by keys)``: the rows are range-partitioned
    and sorted by key, numbered inside each partition, and shifted by the sizes
    of the partitions before. The numbered rows are written once, so a lost
    executor cannot renumber them.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = materialize(ranged.withColumn("_mark", F.monotonically_increasing_id()), "ids")
    part = F.shiftright("_mark", _ROW_BITS)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, whatever the size of the data
    offsets = (
        marked.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    row = F.col("_mark").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        marked.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(id_column, (F.col("_offset") + row + 1 + after).cast("long"))
        .select(id_column, *df.columns)
    )


def _counted_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the flag ``_head`` by how many rows of the partition had it so far."""
    before = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = batch.schema.get_field_index("_head")
        numbers = pc.cumulative_sum(pc.cast(batch.column(at), pa.int64()), start=before)
        before = numbers[-1].as_py()
        yield batch.set_column(at, "_head", numbers)


# Words joined by the least character sort as the words do one by one. Characters below the
# space, which words cannot hold, make room for it.
_LOW = "".join(map(chr, range(32)))
_RAISED = "".join(map(chr, range(1, 33)))


def _joined(words: list[str]) -> Column:
    """One string that sorts as these words, which hold no space and are not null."""
    raised = F.concat_ws("\0", *[F.translate(word, _LOW, _RAISED) for word in words])
    # hardly any word holds a control character, and this test is the cheaper pass
    odd = F.concat_ws(" ", *words).rlike(r"[\x00-\x1F]")
    return F.when(odd, raised).otherwise(F.concat_ws("\0", *words))


def _parted(joined: Column, at: int) -> Column:
    """The word at a place of ``_joined``."""
    word = F.split(joined, "\0")[at]
    # translate would delete what it is asked to turn into the least character
    lowest = F.replace(word, F.lit(_RAISED[0]), F.lit(_LOW[0]))
    return F.translate(lowest, _RAISED[1:], _LOW[1:])


def number_groups(
    rows: DataFrame,
    keys: list[str],
    order: str,
    id_column: str,
    sums: dict[str, Column] | None = None,
    page_count: bool = True,
    joined: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Number distinct ``keys`` densely in their order: (groups, rows with their number).

    The groups are (id, keys, page_count, sums), ``page_count`` being their number
    of rows. Without it and sums a group's rows pass one by one. The rows have the other columns and the id in place of the keys. Rows
    move once, ranged by key, and are numbered where they lie, so no join brings
    the ids back. They are written once, with the keys on one row of each group.
    ``rows`` is read twice, so pass a materialized table. A group lies in one task.
    The rows with their number lie in the order of it and of ``order``.
    Keys that are words, not null and without space, may move ``joined`` to one string.
    """
    named, stored = keys, {key: F.col(key) for key in keys}
    if joined and all(kind == "string" for name, kind in rows.dtypes if name in keys):
        others = [c for c in rows.columns if c not in keys]
        rows, keys = rows.select(_joined(keys).alias("_joined"), *others), ["_joined"]
        stored = {key: _parted(F.col("_joined"), at) for at, key in enumerate(named)}
        order = order if order in others else "_joined"
    group = Window.partitionBy(*keys)
    others = [c for c in rows.columns if c not in keys]
    head = F.row_number().over(group.orderBy(order)) == 1
    facts = ({"page_count": F.count(F.lit(1))} if page_count else {}) | (sums or {})
    ranged = rows.repartitionByRange(*keys).withColumns(
        {"_head": head} | {f"_{name}": total.over(group) for name, total in facts.items()}
    )
    once = [F.when(F.col("_head"), word).alias(key) for key, word in stored.items()]
    once += [F.when(F.col("_head"), F.col(f"_{name}")).alias(f"_{name}") for name in facts]
    flagged = ranged.select(F.col("_head").alias("_first"), "_head", *once, *others)
    kinds = [f"`{field.name}` {field.dataType.simpleString()}" for field in flagged.schema.fields]
    schema = ", ".join("`_head` long" if kind.startswith("`_head`") else kind for kind in kinds)
    counted = flagged.mapInArrow(_counted_heads, schema).withColumn("_part", F.spark_partition_id())
    written = materialize(counted, "groups")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, whatever the size of the data
    offsets = (
        written.groupBy("_part")
        .agg(F.max("_head").alias("_groups"))
        .select("_part", F.coalesce(F.sum("_groups").over(earlier), F.lit(0)).alias("_offset"))
    )
    numbered = written.join(F.broadcast(offsets), "_part").withColumn(
        id_column, F.col("_offset") + F.col("_head")
    )
    groups = numbered.filter("_first").select(
        id_column, *named, *[F.col(f"_{name}").alias(name) for name in facts]
    )
    return groups, numbered.select(id_column, *others)

