"""Page-corpus analytics on Spark: words, n-grams, page similarity and the link graph."""
