"""Writing tables, and keyed changes of tables as distributed joins."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import exploded
from pageloom.operators.ids import assign_ids
from pageloom.schema import TABLES
from pageloom.scratch import materialize, shuffles_end

# What each stored table is sorted by, so that a lookup's filter prunes parquet row
# groups. Dictionaries hold the words lowered beside the text. Those of n-grams are
# in word order already, because their ids were assigned in it.
SORT = {
    "page": ["url"],
    "word": ["word_key"],
    "set2": None,
    "set3": None,
    "word_page": ["id_word", "id_page"],
    "set2_page": ["id_set2", "id_page"],
    "set3_page": ["id_set3", "id_page"],
    "page_word": ["id_page", "id_word"],
    "shared2": ["id_page1", "rank"],
    "shared3": ["id_page1", "rank"],
}


def write_table(
    df: DataFrame,
    path: str,
    sort: list[str] | None = None,
    after: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Replace the table at ``path``; a second run gives the same table.

    With ``sort`` the rows are range-partitioned and sorted. The range covers all
    sort columns, so a word on a third of all rows spreads over many files.
    ``after`` adds columns that follow from the others once the rows have moved.
    """
    if sort:
        df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    if after:
        df = after(df)
    with shuffles_end(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_ranked(df: DataFrame, path: str, order: list[Column]) -> None:
    """Replace the table at ``path`` by a copy whose files follow each other in ``order``.

    Beside the files stands how many rows lie before each of them, so that
    ``read_first`` opens no more files than it needs. The order should end with
    a key, so that no range of equal rows falls to one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("_range", F.spark_partition_id())
    numbered.write.mode("overwrite").partitionBy("_range").parquet(path)
    # a table without rows has no ranges to take its schema from
    numbered.limit(0).write.mode("overwrite").parquet(f"{path}/_schema")
    # one row a range; the counts come from the files' footers
    stored = df.sparkSession.read.schema(numbered.schema).parquet(path)
    sizes = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")
    sizes.select("_range", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/_ranges")


def write_tables(
    tables: dict[str, DataFrame],
    folder: str,
    after: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    ordered: Collection[str] = (),
) -> None:
    """Write tables in the order of ``SORT``; those of ``ordered`` come in it and need not move."""
    for name, df in tables.items():
        words = [column for column in df.columns if column.startswith("word")]
        for column in words:
            df = df.withColumn(f"{column}_key", F.lower(column))
        sort = None if name in ordered else SORT[name]
        write_table(df, f"{folder.rstrip('/')}/{name}", sort, (after or {}).get(name))


def write_dictionaries(pages: DataFrame, paths: dict[int, str]) -> dict[int, str]:
    """Write the distinct words, bigrams and trigrams of ``pages``; the folder of those of 1, 2 and 3 words.

    Texts are cut once, for the trigrams. A page's bigrams are what its trigrams begin
    with, and its last; its words are what its bigrams begin with, and its last. So the
    ends of pages are kept beside the longer items, and each dictionary follows from
    the distinct items of the one before in place of all occurrences.
    """
    ends = [F.slice("bigrams", F.lit(-1), F.lit(1)), F.slice("word_list", F.lit(-1), F.lit(1))]
    items = exploded(pages, [], F.concat("trigrams", *ends), "item").distinct()
    for n in (3, 2, 1):
        # words hold no space, so an item of fewer words is the end of a page
        whole = F.substring_index("item", " ", n - 1) != F.col("item") if n > 1 else F.lit(True)
        items.withColumn("whole", whole).write.mode("overwrite").partitionBy("whole").parquet(paths[n])
        # an empty corpus has no folder yet
        items.limit(0).write.mode("append").parquet(f"{paths[n]}/whole=true")
        stored = items.sparkSession.read.schema(items.schema).parquet(paths[n])
        items = stored.select(F.substring_index("item", " ", n - 1).alias("item")).distinct()
    return {n: f"{path}/whole=true" for n, path in paths.items()}


def write_jsonl(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Page records as JSON lines, one object per page, text not escaped.

    Words stand in a record three times over, so files are compressed (``none`` leaves
    them plain). A compressed file is read by one task, as it was written by one.
    """
    pages.write.mode("overwrite").option("compression", compression).json(path)


def write_jdbc(
    df: DataFrame, url: str, table: str, properties: dict[str, str], mode: str = "append"
) -> None:
    """Write to a database table, one connection and one batch stream per partition."""
    df.write.mode(mode).option("batchsize", 1000).jdbc(url, table, properties=properties)


def insert_if_absent(
    existing: DataFrame, incoming: DataFrame, keys: list[str], id_column: str | None = None
) -> DataFrame:
    """``existing`` plus the incoming rows whose key it lacks.

    Existing rows keep their values and ids; new keys are numbered from the
    largest id on, in key order. Repeating the call adds nothing.
    """
    fresh = incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    if id_column is None:
        return existing.unionByName(fresh)
    last = existing.agg(F.max(id_column)).first()[0] or 0
    numbered = assign_ids(fresh, keys, id_column, after=last)
    return existing.unionByName(numbered.select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with rows of the same key replaced by the incoming ones.

    Of incoming rows with one key the last by the other columns counts.
    """
    others = [c for c in incoming.columns if c not in keys]
    if others:
        incoming = incoming.withColumn("_all", F.struct(*others))
        incoming = latest_per_key(incoming, keys, "_all").drop("_all")
    else:
        incoming = incoming.dropDuplicates(keys)
    kept = existing.join(incoming.select(*keys), keys, "left_anti")
    return kept.select(*existing.columns).unionByName(incoming.select(*existing.columns))


def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the largest ``order``. Prepares an upsert."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    ranked = rows.withColumn("_rank", F.row_number().over(newest))
    return ranked.filter("_rank <= 1").drop("_rank")


def update_by_key(
    table: DataFrame, updates: DataFrame, key: str, columns: dict[str, str]
) -> DataFrame:
    """Set ``columns`` (target -> column of ``updates``) where the key matches."""
    renamed = updates.select(
        key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{t}") for t, c in columns.items()]
    )
    joined = table.join(renamed, key, "left")
    values = [
        F.when(F.col("_hit"), F.col(f"_{name}")).otherwise(F.col(name)).alias(name)
        if name in columns
        else F.col(name)
        for name in table.columns
    ]
    return joined.select(*values)


def rewrite(df: DataFrame, path: str) -> None:
    """Replace a table by a result that reads the same table."""
    write_table(materialize(df, "rewrite"), path)


def empty_tables(spark, folder: str) -> None:
    """Clear all result tables, leaving their schemas."""
    for name, schema in TABLES.items():
        df = spark.createDataFrame([], schema)
        words = [column for column in df.columns if column.startswith("word")]
        for column in words:
            df = df.withColumn(f"{column}_key", F.lower(column))
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
