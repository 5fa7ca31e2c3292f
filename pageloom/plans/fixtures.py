"""The driver's tables seen as a page corpus and a page graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.urls import LinkRules
from pageloom.operators import frequency as freq
from pageloom.operators import graph
from pageloom.operators.prepare import edit_rate, with_terms
from pageloom.sources.records import spread

# The pages table links site-relative, as in "/The".
RULES = LinkRules(base="https://wiki.example.org/wiki/", rooted="/", marker="example.org/wiki/")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages; ``title`` repeats, ``url`` is unique."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id_page"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("title"),
        "text",
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their kept words and n-grams."""
    return with_terms(spread(documents(spark, sf_dir), "id_page"))


def corpus_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus for counts of each page: texts move by page id, so that counts need not.

    The number of partitions is fixed, for Spark would make few large ones by the
    size of the texts, which is small against that of their counted n-grams.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(partitions, 3 * spark.sparkContext.defaultParallelism)
    return with_terms(documents(spark, sf_dir).repartition(partitions, "id_page"))


def words_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Word totals over the whole of a table that has a ``text`` column."""
    texts = read(spark, sf_dir, table)
    keyed = texts.select(F.col(texts.columns[0]).alias("id"), "text")
    return freq.word_totals(with_terms(spread(keyed, "id")))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id_page"),
        F.concat(F.lit("part://"), F.col("p_partkey").cast("string")).alias("url"),
        F.col("p_name").alias("title"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link occurrences, repeats and self-links included."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.link_edges(links(spark, sf_dir))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("page"), "ts")
    return edit_rate(events).withColumnRenamed("page", "id_page")


def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.page_connectivity(vertices(spark, sf_dir), edges(spark, sf_dir), "id_page")


def graph_page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table of the graph: degrees, repetitions and edit rates."""
    repeated = graph.repeated_links(links(spark, sf_dir))
    pages = graph.page_repetitions(connectivity(spark, sf_dir), repeated, "id_page")
    joined = pages.join(rates(spark, sf_dir), "id_page", "left")
    return joined.withColumn("edits_per_day", F.coalesce("edits_per_day", F.lit(0.0)))


def corpus_with_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate joins before words and n-grams are made, so that only texts are shuffled."""
    rated = documents(spark, sf_dir).join(rates(spark, sf_dir), "id_page", "left")
    return with_terms(spread(rated, "id_page"))
