"""Reading page records and stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.urls import normalize_url
from pageloom.schema import PAGE_RECORD, TABLES
from pageloom.sources.versions import history, read_version


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on an input of few splits (a small file, one row group).

    Tokenising is the costly part, so it should not run in a single task. An
    input with a split for every core is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(3 * cores, key)


def _position() -> Column:
    """Where a record stands: file, block of the file and place within it."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def load_pages(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    """Page records from JSON lines, without those that have no title.

    With ``position`` they carry where they stand: file, block of the file and
    place within it, which order as the lines do.

    The schema is fixed, so nothing is inferred and unused fields are not parsed.
    A malformed line has no title either.
    """
    records = spark.read.schema(PAGE_RECORD).option("mode", "PERMISSIVE").json(path)
    if position:
        records = records.withColumn("position", _position())
    return records.filter("title is not null")


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are not valid records: (line)."""
    schema = T.StructType([*PAGE_RECORD.fields, T.StructField("line", T.StringType())])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    records = reader.option("columnNameOfCorruptRecord", "line").json(path)
    # a filter on the corrupt column alone would be pruned to an empty schema
    return records.filter("line is not null and title is null").select("line")


def observed_pages(spark: SparkSession, path: str) -> tuple[DataFrame, Observation]:
    """Page records with their position, and counts taken by the scan that feeds them.

    The observation has ``records``, ``without_url`` and ``rejected_lines`` once
    the records have been used. Counts are taken where lines are read, so a
    stage that is run again after the loss of an executor may count twice: they
    are for the log, no result depends on them.
    """
    schema = T.StructType([*PAGE_RECORD.fields, T.StructField("line", T.StringType())])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    lines = reader.option("columnNameOfCorruptRecord", "line").json(path)
    record = F.col("title").isNotNull()
    named = F.col("url").isNotNull() & (normalize_url(F.col("url")) != "")
    seen = Observation("load")
    observed = lines.withColumn("position", _position()).observe(
        seen,
        F.count(F.when(record, 1)).alias("records"),
        F.count(F.when(record & ~F.coalesce(named, F.lit(False)), 1)).alias("without_url"),
        F.count(F.when(~record & F.col("line").isNotNull(), 1)).alias("rejected_lines"),
    )
    return observed.filter(record).drop("line"), seen


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The result tables under ``folder``: the newest version, or as ``write_tables`` left them."""
    folder = folder.rstrip("/")
    if history(spark, folder):
        return read_version(spark, folder)
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}


def read_first(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The files of a table by ``write_ranked`` that hold its first ``limit`` rows.

    They may hold some more, and rows come in no order.
    """
    ranges = spark.read.parquet(f"{path}/_ranges").filter(F.col("before") < limit)
    last = ranges.agg(F.max("_range")).first()[0]
    rows = spark.read.schema(spark.read.parquet(f"{path}/_schema").schema).parquet(path)
    return rows.filter(F.col("_range") <= (-1 if last is None else last)).drop("_range")


def stored_sizes(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """One row with the number of rows of each stored table, from the files' footers.

    The reader that answers aggregates from footers is asked for by name, so no
    data page is read whatever the size of the tables.
    """
    conf = spark.conf
    conf.set("spark.sql.parquet.aggregatePushdown", True)
    usual = conf.get("spark.sql.sources.useV1SourceList")
    conf.set("spark.sql.sources.useV1SourceList", "")
    try:
        tables = {name: spark.read.parquet(folder) for name, folder in folders.items()}
    finally:
        conf.set("spark.sql.sources.useV1SourceList", usual)
    sizes = None
    for name, table in tables.items():
        size = table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        sizes = size if sizes is None else sizes.unionAll(size)
    return sizes.agg(*[F.max(F.when(F.col("name") == name, F.col("rows"))).alias(name) for name in tables])


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A database table; with ``key`` and ``bounds`` it is read in parallel ranges."""
    if key is None or bounds is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(
        url,
        table,
        column=key,
        lowerBound=bounds[0],
        upperBound=bounds[1],
        numPartitions=partitions,
        properties=properties,
    )
