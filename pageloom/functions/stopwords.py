"""Stop words: the English list of Spark ML, where words are taken from their texts in lower case."""

from __future__ import annotations

from functools import cache


@cache
def english() -> tuple[str, ...]:
    """Loaded from the session that is running."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))
