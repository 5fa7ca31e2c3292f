"""From raw pages to page records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.html import block_text, heading, hrefs
from pageloom.functions.text import kept_words, ngrams
from pageloom.functions.urls import LinkRules, normalize_url


def page_text(pages: DataFrame, repeat: bool = True) -> DataFrame:
    """Block text of each page, within its row."""
    return pages.select("page_id", block_text(F.col("html"), repeat).alias("text"))


def page_title(pages: DataFrame, fallback: str | None = None) -> DataFrame:
    """First h1, else the ``fallback`` column with underscores as spaces."""
    title = heading(F.col("html"))
    if fallback is not None:
        title = F.coalesce(title, F.replace(F.col(fallback), F.lit("_"), F.lit(" ")))
    return pages.select("page_id", title.alias("title"))


def link_array(html: Column, rules: LinkRules) -> Column:
    """Distinct absolute links of a page, within its row."""
    resolved = F.transform(hrefs(html), rules.resolve)
    return F.array_distinct(F.filter(resolved, lambda link: link.isNotNull()))


def page_link_arrays(pages: DataFrame, rules: LinkRules = LinkRules()) -> DataFrame:
    """Distinct absolute links of each page as an array."""
    return pages.select("page_id", link_array(F.col("html"), rules).alias("links"))


def page_links(pages: DataFrame, rules: LinkRules = LinkRules()) -> DataFrame:
    """One row per page and distinct link."""
    links = page_link_arrays(pages, rules)
    return links.select("page_id", F.explode_outer("links").alias("link")).filter("link is not null")


def with_terms(
    pages: DataFrame, text: str = "text", stopwords: Iterable[str] | None = None
) -> DataFrame:
    """Add ``word_list``, ``bigrams`` and ``trigrams``; adjacency is that of kept words."""
    worded = pages.withColumn("word_list", kept_words(F.col(text), stopwords))
    return worded.withColumn("bigrams", ngrams(F.col("word_list"), 2)).withColumn(
        "trigrams", ngrams(F.col("word_list"), 3, F.col("bigrams"))
    )


def edit_rate(revisions: DataFrame, newest: int | None = None) -> DataFrame:
    """Revisions per day and page; below two it is 0.

    ``revisions`` has (page, ts). With ``newest`` only so many of the latest
    revisions of a page count, as with a history that is served in one portion;
    the limit is then applied per task before the shuffle.
    """
    stamped = revisions.select("page", F.col("ts").cast("timestamp").alias("ts"))
    kept = stamped.filter("ts is not null")
    if newest is not None:
        recent = Window.partitionBy("page").orderBy(F.col("ts").desc())
        kept = kept.withColumn("rank", F.row_number().over(recent)).filter(F.col("rank") <= newest)
    spans = kept.groupBy("page").agg(
        F.count(F.lit(1)).alias("revisions"),
        (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("micros"),
    )
    days = F.greatest(F.col("micros") / F.lit(86_400_000_000.0), F.lit(1.0))
    rate = F.when(F.col("revisions") < 2, F.lit(0.0)).otherwise(
        F.round(F.col("revisions") / days, 2)
    )
    return spans.select("page", rate.alias("edits_per_day"))


def dedup_by_url(pages: DataFrame, url: str, position: str) -> DataFrame:
    """Keep the first row (by ``position``) of each normalised URL.

    Rows without a URL count as duplicates. The ``<= 1`` limit is applied per
    task before the shuffle, so a URL that fills a third of the table is cheap.
    """
    key = normalize_url(F.col(url))
    first = Window.partitionBy("normalized_url").orderBy(position)
    keyed = pages.withColumn("normalized_url", key).filter(F.col("normalized_url") != "")
    return keyed.withColumn("_rank", F.row_number().over(first)).filter("_rank <= 1").drop("_rank")


def new_pages(incoming: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key has not been processed yet."""
    return incoming.join(processed.select(key).distinct(), key, "left_anti")


def page_records(
    pages: DataFrame,
    revisions: DataFrame,
    rules: LinkRules = LinkRules(),
    stopwords: Iterable[str] | None = None,
    repeat: bool = True,
) -> DataFrame:
    """Page records from raw pages (page_id, url, html) and revisions (page, ts).

    ``page`` of a revision is the page id. The edit rate joins the pages before
    words and n-grams are made, so that those never pass through a shuffle.
    """
    rates = edit_rate(revisions).withColumnRenamed("page", "page_id")
    rated = pages.select("page_id", "url", "html").join(rates, "page_id", "left")
    parsed = rated.select(
        "page_id",
        "url",
        "edits_per_day",
        heading(F.col("html")).alias("title"),
        link_array(F.col("html"), rules).alias("links"),
        block_text(F.col("html"), repeat).alias("text"),
    )
    return with_terms(parsed, "text", stopwords).select(
        F.col("page_id").alias("id_page"),
        "url",
        "title",
        "word_list",
        "bigrams",
        "trigrams",
        F.coalesce("edits_per_day", F.lit(0.0)).alias("edits_per_day"),
        "links",
    )
