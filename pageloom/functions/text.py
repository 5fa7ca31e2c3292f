"""Tokens, stop-word removal and n-grams as JVM-side array expressions.

Everything stays inside the page's own row, so none of these needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.stopwords import english

# Letters, numbers and underscore are word characters, combining marks are not.
# Both patterns are understood alike by Java and RE2.
WHITESPACE = r"\p{Z}\s\x{1C}-\x{1F}\x{85}"
PUNCTUATION = rf"[^\p{{L}}\p{{N}}_{WHITESPACE}]"
GAP = rf"[{WHITESPACE}]+"


def tokens(text: Column, stopwords: Iterable[str] = ()) -> Column:
    """Delete punctuation, lowercase, split on white space, drop stop words.

    Order and duplicates are kept. A stop word holding an apostrophe never
    matches, because the apostrophe is deleted first.
    """
    parts = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), PUNCTUATION, "")), GAP)
    dropped = ["", *stopwords]
    return F.filter(parts, lambda word: ~word.isin(dropped))


def kept_words(text: Column, stopwords: Iterable[str] | None = None) -> Column:
    """Tokens without the stop words; English ones unless a list is given."""
    return tokens(text, english() if stopwords is None else stopwords)


def ngrams(words: Column, n: int, shorter: Column | None = None) -> Column:
    """Space-joined n-grams of adjacent words; empty when there are fewer than n.

    Where the (n - 1)-grams are a column already, ``shorter`` names it and they are not made again.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    grams = words if shorter is None else shorter
    for shift in range(1 if shorter is None else n - 1, n):
        # both sides have size(words) - shift elements, so nothing is padded
        width = F.greatest(F.size(words) - shift, F.lit(0))
        grams = F.zip_with(
            F.slice(grams, F.lit(1), width),
            F.slice(words, F.lit(shift + 1), width),
            lambda left, right: F.concat_ws(" ", left, right),
        )
    return grams


def exploded(df: DataFrame, keep: list[str | Column], items: Column, alias: str) -> DataFrame:
    """One row per non-null, non-empty element of ``items``.

    ``explode_outer`` plus a filter gives the rows of ``explode`` but spares
    Catalyst's inferred ``size(items) > 0`` filter, which would evaluate a
    computed array (a tokeniser, say) a second time.
    """
    rows = df.select(*keep, F.explode_outer(items).alias(alias))
    return rows.filter(F.col(alias).isNotNull() & (F.col(alias) != ""))


def natural_key(text: Column) -> Column:
    """A text that sorts as ``text`` does when digit runs count as numbers.

    Each run of ASCII digits loses its leading zeros and gets its own length in
    front, ten digits wide, so a longer number follows a shorter one and numbers
    of one length compare digit by digit. Runs stay in place, so they sort where
    digits sort among other characters.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(?s)[0-9]+|[^0-9]+"), F.lit(0))

    def number(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    keyed = F.transform(runs, lambda run: F.when(run.rlike("^[0-9]"), number(run)).otherwise(run))
    return F.array_join(keyed, "")


def collated(pages: DataFrame, collation: str = "UNICODE_CI_AI") -> DataFrame:
    """Page records whose words compare under a collation.

    Counts and dictionaries over them merge spellings that the collation takes
    as equal, such as those that differ in accents. The default without this is
    binary comparison.
    """
    kind = f"array<string collate {collation}>"
    names = [name for name in ("word_list", "bigrams", "trigrams") if name in pages.columns]
    return pages.withColumns({name: F.col(name).cast(kind) for name in names})
