"""The directed page graph: edges, degrees, hubs, communities, traversal, repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import exploded
from pageloom.operators.joins import join_on_skewed_key
from pageloom.operators.similarity import shared_pairs
from pageloom.scratch import materialize


def page_link_occurrences(pages: DataFrame, source: str = "url") -> DataFrame:
    """(src, dst) for every non-empty link of every page, repeats kept."""
    links = exploded(pages, [source], F.col("links"), "dst")
    return links.withColumnRenamed(source, "src")


def link_counts(occurrences: DataFrame) -> DataFrame:
    """Distinct links of each source."""
    counts = occurrences.groupBy("src").agg(F.count_distinct("dst").alias("distinct_links"))
    return counts.withColumnRenamed("src", "id_page")


def link_edges(occurrences: DataFrame) -> DataFrame:
    """Distinct edges between different, known ends."""
    ends = occurrences.select("src", "dst")
    return ends.filter("src is not null and dst is not null and src <> dst").distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    counts = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("incoming_links"))
    return counts.withColumnRenamed("dst", "page")


def out_degree(edges: DataFrame) -> DataFrame:
    counts = edges.groupBy("src").agg(F.count(F.lit(1)).alias("outgoing_links"))
    return counts.withColumnRenamed("src", "page")


def total_connections(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("page")).unionAll(edges.select("dst"))
    return ends.groupBy("page").agg(F.count(F.lit(1)).alias("total_connections"))


def degrees(edges: DataFrame) -> DataFrame:
    """In-, out- and total degree of every page in one shuffle.

    Each edge is turned into its two ends by an in-row explode, so the edge
    list is computed once.
    """
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("page"), F.lit(1).alias("out"), F.lit(0).alias("in")),
            F.struct(F.col("dst").alias("page"), F.lit(0).alias("out"), F.lit(1).alias("in")),
        )
    )
    return (
        edges.select(ends.alias("end"))
        .select("end.*")
        .groupBy("page")
        .agg(
            F.sum("in").alias("incoming_links"),
            F.sum("out").alias("outgoing_links"),
            F.count(F.lit(1)).alias("total_connections"),
        )
    )


def page_connectivity(pages: DataFrame, edges: DataFrame, page: str = "url") -> DataFrame:
    """Every page with its degrees, zero where it has none; score = in + out."""
    found = degrees(edges).withColumnRenamed("page", page)
    zero = F.lit(0).cast("long")
    counts = [
        F.coalesce(F.col(name), zero).alias(name)
        for name in ("incoming_links", "outgoing_links", "total_connections")
    ]
    joined = pages.join(found, page, "left").select(*pages.columns, *counts)
    return joined.withColumn(
        "connectivity_score", F.col("incoming_links") + F.col("outgoing_links")
    )


def top_connected(connectivity: DataFrame, limit: int = 20, page: str = "url") -> DataFrame:
    return connectivity.orderBy(F.desc("connectivity_score"), page).limit(limit)


def hub_pages(connectivity: DataFrame, limit: int = 15, page: str = "url") -> DataFrame:
    """Pages by out-degree x 0.6 + in-degree x 0.4."""
    score = F.col("outgoing_links") * F.lit(0.6) + F.col("incoming_links") * F.lit(0.4)
    scored = connectivity.withColumn("hub_score", score)
    return scored.orderBy(F.desc("hub_score"), page).limit(limit)


def hub_report(connectivity: DataFrame, limit: int = 5, page: str = "url") -> DataFrame:
    return hub_pages(connectivity, limit, page).select(
        F.substring("title", 1, 50).alias("title"), F.round("hub_score", 2).alias("hub_score")
    )


def graph_summary(pages: DataFrame, edges: DataFrame, page: str = "url") -> DataFrame:
    """Number of edges, and of known pages that have a connection: one row."""
    known = pages.select(F.col(page).alias("page")).distinct().withColumn("known", F.lit(1))
    found = degrees(edges).join(known, "page", "left")
    return found.agg(
        F.coalesce(F.sum("outgoing_links"), F.lit(0)).cast("long").alias("total_edges"),
        F.count("known").alias("connected_pages"),
    )


def shared_link_pairs(edges: DataFrame, min_shared: int = 2) -> DataFrame:
    """Pairs of pages that link to at least ``min_shared`` common targets."""
    postings = edges.select(F.col("dst").alias("item"), F.col("src").alias("member"))
    pairs = shared_pairs(postings, min_shared)
    return pairs.withColumnRenamed("shared", "shared_links_count")


def repeated_links(occurrences: DataFrame) -> DataFrame:
    """How often each link occurs over all pages, repeats on one page included."""
    links = occurrences.filter("dst is not null").select(F.col("dst").alias("link"))
    return links.groupBy("link").agg(F.count(F.lit(1)).alias("total_repetitions"))


def page_repetitions(pages: DataFrame, repetitions: DataFrame, page: str = "url") -> DataFrame:
    """Every page with the number of links to it, zero when there is none."""
    counts = repetitions.withColumnRenamed("link", page)
    kept = [name for name in pages.columns if name != "total_repetitions"]
    return (
        pages.select(*kept)
        .join(counts, page, "left")
        .select(*kept, F.coalesce("total_repetitions", F.lit(0)).cast("long").alias("total_repetitions"))
    )


def words_in_links(pages: DataFrame, occurrences: DataFrame, page: str = "url") -> DataFrame:
    """Occurrences of each word over the pages that links point to, one per link.

    Links are counted per target first; each target page then contributes its
    words with that multiplicity. Both join sides hold one row per page, and the
    words are combined map-side, so links x words is never materialised.
    """
    times = occurrences.groupBy(F.col("dst").alias(page)).agg(F.count(F.lit(1)).alias("times"))
    linked = pages.select(page, "word_list").join(times, page)
    words = exploded(linked, ["times"], F.col("word_list"), "word")
    return words.groupBy("word").agg(F.sum("times").alias("total_repetitions"))


def reachable(edges: DataFrame, start: DataFrame, max_depth: int = 3) -> DataFrame:
    """Breadth-first traversal: each reached page with its smallest depth.

    ``start`` has one column ``page``. Each level is written before the next one
    starts. The frontier holds a page once, and sources with very many edges
    meet it through the skew-aware join instead of one task.
    """
    edges = materialize(edges.select("src", "dst"), "edges")
    fan_out = materialize(edges.groupBy("src").agg(F.count(F.lit(1)).alias("fan_out")), "fan_out")
    frontier = materialize(start.select("page").distinct(), "frontier")
    visited = frontier.select("page", F.lit(0).alias("depth"))
    for depth in range(1, max_depth + 1):
        sources = materialize(
            frontier.select(F.col("page").alias("src")).join(fan_out, "src"), "sources"
        )
        targets = join_on_skewed_key(edges, sources, ["src"], "fan_out")
        found = targets.select(F.col("dst").alias("page")).distinct()
        frontier = materialize(found.join(visited, "page", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("page", F.lit(depth).alias("depth")))
    return visited
