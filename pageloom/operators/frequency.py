"""Word and n-gram counts, totals, dictionaries and shares.

Pages are rows with ``id_page`` and the arrays ``word_list``, ``bigrams`` and
``trigrams``; ``id_page`` (or ``url``) is unique. Every count is one shuffle
with map-side combining on (page, term).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import exploded
from pageloom.operators.ids import assign_ids, number_groups
from pageloom.operators.joins import join_on_skewed_key
from pageloom.scratch import discard, materialize

GRAM_COLUMN = {2: "bigrams", 3: "trigrams"}


def _length(items: str) -> Column:
    return F.size(F.coalesce(F.col(items), F.array().cast("array<string>"))).cast("long")


def page_stats(pages: DataFrame, link_counts: DataFrame | None = None) -> DataFrame:
    """Per page: edit rate, distinct links, numbers of bigrams and trigrams.

    Links are the page's own array, or come counted as (id_page, distinct_links)
    where they are kept as a table of their own.
    """
    if link_counts is None:
        links = F.array_distinct(F.coalesce(F.col("links"), F.array().cast("array<string>")))
        distinct = F.size(links).cast("long")
    else:
        pages = pages.join(link_counts, "id_page", "left")
        distinct = F.coalesce(F.col("distinct_links"), F.lit(0)).cast("long")
    return pages.select(
        "id_page",
        "title",
        "url",
        F.coalesce(F.col("edits_per_day"), F.lit(0.0)).cast("double").alias("edits_per_day"),
        distinct.alias("distinct_links"),
        _length("bigrams").alias("quant_set2"),
        _length("trigrams").alias("quant_set3"),
        F.lit(1).cast("long").alias("total_repetitions"),
    )


def word_page_frequency(pages: DataFrame, page: str = "id_page") -> DataFrame:
    """Occurrences of each word on each page."""
    words = exploded(pages, [page], F.col("word_list"), "word")
    return words.groupBy(page, "word").agg(F.count(F.lit(1)).alias("quantity"))


def word_totals(pages: DataFrame) -> DataFrame:
    """Occurrences of each word in the corpus.

    Counted straight from the words: the per-page counts would be a second,
    far larger shuffle and give the same sums.
    """
    words = exploded(pages, [], F.col("word_list"), "word")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("total_repetitions"))


def gram_words(n: int) -> list[str]:
    return [f"word{i}" for i in range(1, n + 1)]


def _heads(pages: DataFrame, n: int, page: str) -> DataFrame:
    """Valid grams: at least n space-separated parts, the first n not empty."""
    valid = F.col("gram").rlike(rf"^[^ ]+(?: [^ ]+){{{n - 1}}}(?: |$)")
    return exploded(pages, [page], F.col(GRAM_COLUMN[n]), "gram").filter(valid)


def _with_parts(rows: DataFrame, n: int) -> DataFrame:
    """Add word1 ... wordn, the first n parts of ``gram``."""
    split = rows.withColumn("parts", F.split("gram", " "))
    for at, name in enumerate(gram_words(n)):
        split = split.withColumn(name, F.col("parts")[at])
    return split


def gram_split(pages: DataFrame, n: int, page: str = "id_page") -> DataFrame:
    """One row per n-gram occurrence, with its words."""
    return _with_parts(_heads(pages, n, page), n).select(page, "gram", *gram_words(n))


def gram_page_frequency(pages: DataFrame, n: int, page: str = "id_page") -> DataFrame:
    """Occurrences of each n-gram on each page, keyed by its words.

    The first n parts stay one string until after the count, so a single
    narrow key is shuffled instead of n.
    """
    head = F.substring_index("gram", " ", n).alias("gram")
    counts = (
        _heads(pages, n, page)
        .select(page, head)
        .groupBy(page, "gram")
        .agg(F.count(F.lit(1)).alias("repetition_count"))
    )
    return _with_parts(counts, n).select(page, *gram_words(n), "repetition_count")


def dictionary(frequency: DataFrame, keys: list[str], id_column: str, *sums: Column) -> DataFrame:
    """Distinct terms with dense ids in term order, the pages each occurs on, and further sums.

    Terms are written before they are ordered: finding the ranges reads them once more.
    """
    terms = frequency.groupBy(*keys).agg(F.count(F.lit(1)).alias("page_count"), *sums)
    return assign_ids(materialize(terms, "terms"), keys, id_column)


def relation(frequency: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Attach term ids to per-page counts; ``terms`` comes from ``dictionary``.

    A word that a third of all rows share is a hot join key, so the join is the
    skew-aware one, weighted by ``page_count``.
    """
    return join_on_skewed_key(frequency, terms, keys, "page_count")


def word_page_relation(pages: DataFrame) -> DataFrame:
    counts = materialize(word_page_frequency(pages), "word_page")
    facts = number_groups(counts, ["word"], "id_page", "id_word", page_count=False)[1]
    discard(counts)
    return facts.select("id_word", "id_page", "quantity")


def gram_page_relation(pages: DataFrame, n: int) -> DataFrame:
    counts = written_grams(pages, n)
    facts = number_groups(counts, gram_words(n), "id_page", f"id_set{n}", page_count=False, joined=True)[1]
    discard(counts)
    return facts.select(f"id_set{n}", "id_page", "repetition_count")


def written_grams(pages: DataFrame, n: int) -> DataFrame:
    """``gram_page_frequency``, written in word order within each task.

    Neighbours then begin with the same words, so less is written, and less moves when they are ranged.
    """
    return materialize(gram_page_frequency(pages, n).sortWithinPartitions(*gram_words(n)), f"set{n}_page")


def gram_dictionary(pages: DataFrame, n: int) -> DataFrame:
    """Distinct n-grams with dense ids in word order and the pages each occurs on.

    Most n-grams stand on one page, so adding them up before they are ordered would
    move them once more and save nothing.
    """
    keys = gram_words(n)
    grams = written_grams(pages, n)
    groups = number_groups(grams.select(*keys), keys, keys[0], f"id_set{n}", joined=True)[0]
    discard(grams)
    return groups


def page_word_counts(pages: DataFrame, page: str = "id_page") -> DataFrame:
    """Per page and word: quantity, and the page's total.

    The page total is the length of the page's own word array, so it needs
    neither a window nor a join and a huge page is never gathered in one task.
    """
    real = F.filter(F.col("word_list"), lambda word: word.isNotNull() & (word != ""))
    sized = pages.select(page, real.alias("word_list"))
    sized = sized.withColumn("total", F.size("word_list"))
    return (
        exploded(sized, [page, "total"], F.col("word_list"), "word")
        .groupBy(page, "word", "total")
        .agg(F.count(F.lit(1)).alias("quantity"))
    )


def with_shares(counts: DataFrame) -> DataFrame:
    """Percentage (0-100) and fraction (0-1) of the page in place of its total."""
    share = F.col("quantity") / F.col("total")
    shared = counts.withColumns({"percentage": share * 100, "fraction": share})
    return shared.drop("total")


def page_word_share(pages: DataFrame, page: str = "id_page") -> DataFrame:
    """Per page and word: quantity, percentage (0-100) and fraction (0-1) of the page."""
    return with_shares(page_word_counts(pages, page)).select(
        page, "word", "quantity", "percentage", "fraction"
    )
