"""Parameterised lookups over the result tables.

Each takes the dict of result tables and its argument, and returns ordered rows.
A null argument raises ``ValueError``; an unknown page or word gives no rows.
Words match regardless of case, URLs exactly. With a ``collation`` such as
``UNICODE_CI_AI`` words also match regardless of accents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import natural_key

Tables = dict[str, DataFrame]

# Ids of one term (its spellings in upper and lower case) that become a filter;
# beyond that they are joined.
MAX_IDS = 1000

# Pages that a list of hubs may name.
MAY_BE_HUB = "connectivity_score > 0 or total_repetitions > 1"

LEADING_NUMBER = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"


def _given(name: str, value):
    if value is None:
        raise ValueError(f"{name} must not be null")
    return value


def _limit(value: int | None, default: int) -> int:
    return value if value is not None and value > 0 else default


def _matching(rows: DataFrame, words: dict[str, str], collation: str | None) -> DataFrame:
    """Rows whose words equal the arguments, ignoring case.

    Stored dictionaries hold a lowered copy of each word (``word_key`` and so
    on) and are sorted by it, so the comparison reaches the parquet scan.
    """
    for name, value in words.items():
        if collation is not None:
            same = F.collate(F.col(name), collation) == F.lit(_given(name, value))
            rows = rows.filter(same)
            continue
        key = f"{name}_key"
        column = F.col(key) if key in rows.columns else F.lower(name)
        rows = rows.filter(column == F.lower(F.lit(_given(name, value))))
    return rows


def _facts(
    tables: Tables, fact: str, terms: str, words: dict[str, str], collation: str | None
) -> DataFrame:
    """Rows of a fact table for the given words.

    Stored facts hold term ids and are sorted by them. The few ids the words
    stand for are looked up in the dictionary and become a filter that the scan
    prunes by. Facts that still carry their words are filtered directly.
    """
    rows = tables[fact]
    if set(words) <= set(rows.columns):
        return _matching(rows, words, collation)
    ids = _matching(tables[terms], words, collation).select(f"id_{terms}")
    few = ids.limit(MAX_IDS + 1).collect()
    if len(few) > MAX_IDS:
        return rows.join(ids, f"id_{terms}")
    return rows.filter(F.col(f"id_{terms}").isin([row[0] for row in few]))


def page_by_url(tables: Tables, url: str) -> DataFrame:
    return tables["page"].filter(F.col("url") == F.lit(_given("url", url)))


def _ids_of(tables: Tables, url: str) -> list:
    """Ids under a URL (at most one), looked up first so that facts are filtered by a literal."""
    return [row["id_page"] for row in page_by_url(tables, url).select("id_page").limit(2).collect()]


def _pages_of(tables: Tables, facts: DataFrame, page: str, value: Column) -> DataFrame:
    pages = tables["page"].select(F.col("id_page").alias(page), "title", "url")
    return facts.join(pages, page).select(
        F.col("title").alias("TITLE"), F.col("url").alias("URL"), value
    )


def top_pages_by_word(tables: Tables, word: str, collation: str | None = None) -> DataFrame:
    facts = _facts(tables, "word_page", "word", {"word": word}, collation)
    found = _pages_of(tables, facts, "id_page", F.col("quantity").alias("QUANTITY"))
    return found.orderBy(F.desc("QUANTITY"), "URL")


def top_pages_by_gram(
    tables: Tables, *words: str, collation: str | None = None
) -> DataFrame:
    """Pages by occurrences of a word pair or triple."""
    if len(words) not in (2, 3):
        raise ValueError("give two or three words")
    named = {f"word{i}": word for i, word in enumerate(words, 1)}
    terms = f"set{len(words)}"
    facts = _facts(tables, f"{terms}_page", terms, named, collation)
    count = F.col("repetition_count").alias("REPETITION_COUNT")
    found = _pages_of(tables, facts, "id_page", count)
    return found.orderBy(F.desc("REPETITION_COUNT"), "URL")


def _shared_with(tables: Tables, shared: str, url: str) -> DataFrame:
    facts = tables[shared].filter(F.col("id_page1").isin(_ids_of(tables, url)))
    count = F.col("shared_sets_count").alias("SHARED_SETS")
    found = _pages_of(tables, facts, "id_page2", count)
    return found.orderBy(F.desc("SHARED_SETS"), "URL")


def shared_bigrams_of_page(tables: Tables, url: str) -> DataFrame:
    return _shared_with(tables, "shared2", url)


def shared_trigrams_of_page(tables: Tables, url: str) -> DataFrame:
    return _shared_with(tables, "shared3", url)


def _words_of(tables: Tables, url: str) -> DataFrame:
    words = tables["page_word"].filter(F.col("id_page").isin(_ids_of(tables, url)))
    if "word" in words.columns:
        return words
    return words.join(tables["word"].select("id_word", "word"), "id_word")


def words_of_page(tables: Tables, url: str) -> DataFrame:
    words = _words_of(tables, url).select(
        F.col("word").alias("WORD"), F.col("quantity").alias("QUANTITY")
    )
    return words.orderBy(F.desc("QUANTITY"), "WORD")


def word_percentages_of_page(tables: Tables, url: str) -> DataFrame:
    words = _words_of(tables, url).select(
        F.col("word").alias("WORD"), F.col("percentage").alias("PERCENTAGE")
    )
    return words.orderBy(F.desc("PERCENTAGE"), "WORD")


def link_count_of_page(tables: Tables, url: str) -> DataFrame:
    return page_by_url(tables, url).select(
        F.col("title").alias("TITLE"),
        F.col("url").alias("URL"),
        F.col("distinct_links").alias("QUANTITY_URLS"),
    )


def hub_score() -> Column:
    score = F.col("connectivity_score") * F.lit(0.6) + F.col("total_repetitions") * F.lit(0.4)
    return F.round(score, 2)


def top_interconnected(tables: Tables, limit: int | None = 10) -> DataFrame:
    return (
        tables["page"]
        .filter("connectivity_score > 0")
        .orderBy(F.desc("connectivity_score"), F.desc("total_repetitions"), "url")
        .limit(_limit(limit, 10))
        .select(
            F.col("title").alias("TITLE"),
            F.col("url").alias("URL"),
            F.col("connectivity_score").alias("CONNECTIVITY_SCORE"),
            F.col("total_repetitions").alias("TOTAL_REPETITIONS"),
            F.col("edits_per_day").alias("EDITS_PER_DAY"),
        )
    )


def page_connections(tables: Tables, url: str) -> DataFrame:
    return page_by_url(tables, url).select(
        F.col("title").alias("PAGE_TITLE"),
        F.col("url").alias("PAGE_URL"),
        F.col("connectivity_score").alias("CONNECTIVITY_SCORE"),
        hub_score().alias("HUB_SCORE"),
        F.col("total_repetitions").alias("TOTAL_REPETITIONS"),
    )


def top_hub_pages(tables: Tables, limit: int | None = 15) -> DataFrame:
    return (
        tables["page"]
        .filter(MAY_BE_HUB)
        .withColumn("hub_score", hub_score())
        .orderBy(F.desc("hub_score"), "url")
        .limit(_limit(limit, 15))
        .select(
            F.col("title").alias("TITLE"),
            F.col("url").alias("URL"),
            F.col("hub_score").alias("HUB_SCORE"),
            F.col("connectivity_score").alias("CONNECTIVITY_SCORE"),
            F.col("total_repetitions").alias("TOTAL_REPETITIONS"),
            F.col("edits_per_day").alias("EDITS_PER_DAY"),
        )
    )


def word_repetitions(tables: Tables, word: str, collation: str | None = None) -> DataFrame:
    found = _matching(tables["word"], {"word": word}, collation)
    return found.select(
        F.col("word").alias("WORD"), F.col("total_repetitions").alias("TOTAL_REPETITIONS")
    ).orderBy("WORD")


def page_repetitions(tables: Tables, url: str) -> DataFrame:
    return page_by_url(tables, url).select(
        F.col("title").alias("TITLE"),
        F.col("url").alias("URL"),
        F.col("edits_per_day").alias("EDITS_PER_DAY"),
        F.col("total_repetitions").alias("TOTAL_REPETITIONS"),
    )


def row_counts(tables: Tables, names: dict[str, str]) -> DataFrame:
    """One row with the size of each table: output column -> table name."""
    counted = None
    for column, table in names.items():
        size = tables[table].agg(F.count(F.lit(1)).alias("rows"))
        size = size.select(F.lit(column).alias("column"), "rows")
        counted = size if counted is None else counted.unionAll(size)
    columns = [F.max(F.when(F.col("column") == c, F.col("rows"))).alias(c) for c in names]
    return counted.agg(*columns)


def summary(tables: Tables) -> DataFrame:
    return row_counts(
        tables,
        {
            "total_pages": "page",
            "total_words": "word",
            "total_word_pairs": "set2",
            "total_word_triplets": "set3",
        },
    )


def load_check(tables: Tables) -> DataFrame:
    """Row counts looked at after a run."""
    return row_counts(tables, {"pages": "page", "words": "word", "word_pages": "word_page"})


def available_pages(tables: Tables, limit: int = 50) -> DataFrame:
    return tables["page"].orderBy("url").limit(limit).select("url", "title")


def available_words(tables: Tables, limit: int = 100) -> DataFrame:
    words = tables["word"].orderBy(F.desc("total_repetitions"), "word")
    return words.limit(limit).select("word")


def sort_keys(rows: DataFrame, column: str, order: str = "asc") -> list[Column]:
    """Sort expressions for a result: numbers by value, or everything as text.

    ``order`` is ``asc``, ``desc`` or ``alpha``. Text that begins with a number
    sorts by that number. Other text compares by the rules of the ``UNICODE``
    collation, digit runs anywhere in it by their value, so "page 9" comes
    before "page 10". Text that sorts before digits (a null, nothing, white
    space, punctuation) comes before numbers, other text after them. ``alpha``
    compares character by character. ``desc`` is the reverse of ``asc``.
    """
    if order not in ("asc", "desc", "alpha"):
        raise ValueError("order must be asc, desc or alpha")
    text = F.collate(F.col(column).cast("string"), "UNICODE")
    if order == "alpha":
        return [text.asc_nulls_first()]
    if dict(rows.dtypes)[column] == "string":
        leading = F.regexp_extract(F.col(column), LEADING_NUMBER, 1)
        number = F.nullif(leading, F.lit("")).try_cast("double")
        early = F.col(column).isNull() | (text < F.collate(F.lit("0"), "UNICODE"))
        group = F.when(number.isNotNull(), 1).when(early, 0).otherwise(2)
        natural = F.collate(natural_key(F.col(column)), "UNICODE")
        if order == "desc":
            return [group.desc(), number.desc_nulls_first(), natural.desc_nulls_last()]
        return [group.asc(), number.asc_nulls_last(), natural.asc_nulls_first()]
    value = F.col(column)
    return [value.desc_nulls_last() if order == "desc" else value.asc_nulls_first()]


def sorted_result(rows: DataFrame, column: str, order: str = "asc") -> DataFrame:
    """A result ordered by one of its columns, the others breaking ties."""
    others = [name for name in rows.columns if name != column]
    return rows.orderBy(*sort_keys(rows, column, order), *others)


def as_json_array(rows: DataFrame) -> DataFrame:
    """A result of one page or limit as a single JSON array, ordered by its columns.

    For results that are bounded by their limit or by one page's words.
    """
    objects = F.array_sort(F.collect_list(F.struct(*rows.columns)))
    return rows.agg(F.to_json(objects).alias("json"))


def as_json(rows: DataFrame) -> DataFrame:
    """The rows of a result as one JSON object each, in the given order."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
