"""Token counts without materialising ids.

White space separates pre-tokens for a tokenizer that drops it. Each distinct
pre-token of the corpus is encoded once; a document's count is the sum over its
pre-token frequencies. Special strings inside a pre-token count as the library
counts them by default.

Nulls: a null text is empty and has no tokens. Repeated rows give repeated
rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import narrow
from pageloom.llm.vocabulary import FREQUENT, distinct_tokens, document_sums
from pageloom.scratch import materialize


@cache
def load(path: str):
    """The tokenizer in this process, without truncation and padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 2048, most: int = FREQUENT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    ``tokenizer`` is a file of the tokenizers library whose normalizer and
    pre-tokenizer drop white space, readable on every executor.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load(tokenizer)
        for batch in batches:
            out = batch[["key", "n_all"]].copy()
            tokens = [bytes(t).decode() for t in batch["token"]]
            encoded = encoder.encode_batch_fast(tokens, add_special_tokens=False)
            out["pieces"] = [float(len(e)) for e in encoded]
            yield out

    texts = narrow(docs, "doc_id", "text")
    distinct = distinct_tokens(texts.select("text", F.lit(True).alias("_train")))
    table = materialize(
        distinct.select("key", "token", "n_all").mapInPandas(
            encode, "key binary, n_all long, pieces double"
        ),
        "pieces",
    )
    rows = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = document_sums(rows, table, ["pieces"], most=most)
    n_tokens = F.col("pieces").cast("long")
    return counted.select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
