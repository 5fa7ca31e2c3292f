"""Per-document sums of values that depend on the token alone.

A value such as "pieces of this word" is computed once for each distinct token.
``distinct_tokens`` counts the tokens of the corpus; ``document_sums`` adds up
the values of a valued token table over each document. The most frequent tokens
(a bounded number of rows) are broadcast and resolved where the document is
read; only occurrences of rarer tokens are shuffled to meet their values, so no
token is hot there.

Tokens are what lies between ASCII white space. A token of more than KEY_BYTES
bytes is represented by a digest in join keys.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.scratch import materialize

KEY_BYTES = 48
FREQUENT = 300_000
_FLUSH = 1_000_000  # distinct tokens that a task holds before it passes them on


def key_of(token: bytes) -> bytes:
    if len(token) <= KEY_BYTES:
        return token
    return b"\x00" + hashlib.blake2b(token, digest_size=20).digest()


def _tokens(text: bytes, lower: bool) -> list[bytes]:
    # bytes.split() and bytes.lower() know ASCII only, which is what is meant
    return (text.lower() if lower else text).split()


def distinct_tokens(docs: DataFrame, lower: bool = False) -> DataFrame:
    """key, token, n_all, n_train from (text, _train): counts over the whole table."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pd.DataFrame:
            tokens = list(totals[0].keys() | totals[1].keys())
            train = np.fromiter((totals[1][t] for t in tokens), np.int64, len(tokens))
            other = np.fromiter((totals[0][t] for t in tokens), np.int64, len(tokens))
            for total in totals:
                total.clear()
            frame = {"key": [key_of(t) for t in tokens], "token": tokens}
            return pd.DataFrame(frame | {"n_all": train + other, "n_train": train})

        for batch in batches:
            for text, train in zip(batch["text"], batch["_train"]):
                totals[bool(train)].update(_tokens(text, lower))
                if len(totals[0]) + len(totals[1]) > _FLUSH:
                    yield flush()
        yield flush()

    parts = docs.select(F.col("text").cast("binary").alias("text"), "_train").mapInPandas(
        count, "key binary, token binary, n_all long, n_train long"
    )
    return parts.groupBy("key").agg(
        F.min("token").alias("token"), F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train")
    )


def _frequent(table: DataFrame, most: int) -> DataFrame:
    """The most frequent rows, ``most`` at most: all above a count that is found by histogram."""
    scale = F.floor(F.log2("n_all") * 8)
    bins = table.groupBy(scale.alias("bin")).agg(F.count("*").alias("rows")).collect()
    lowest, rows = None, 0
    for row in sorted(bins, key=lambda row: -row["bin"]):
        rows += row["rows"]
        if rows > most:
            break
        lowest = row["bin"]
    return table.filter(scale >= lowest if lowest is not None else F.lit(False))


def document_sums(
    docs: DataFrame,
    table: DataFrame,
    values: list[str],
    lower: bool = False,
    most: int = FREQUENT,
) -> DataFrame:
    """Each row's other columns, ``_tokens`` and the sums of ``values`` (doubles).

    ``docs`` has text and any columns to carry; ``table`` is written and has key,
    n_all and the values. One row comes back for each row of ``docs``.
    """
    spark = docs.sparkSession
    common = _frequent(table, most).select("key", *values).toArrow()
    index = {bytes(k): i for i, k in enumerate(common["key"].to_pylist())}
    matrix = np.empty((len(index) + 1, len(values)))
    for i, name in enumerate(values):
        matrix[:-1, i] = common[name].to_numpy()
    matrix[-1] = 0  # stands for a token that is not among them
    shared = spark.sparkContext.broadcast((index, matrix))
    carried = [c for c in docs.columns if c != "text"]
    known = [f"_known_{v}" for v in values]

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, matrix = shared.value
        absent = len(index)
        # rows are numbered within the task; a retried task numbers them alike
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            sums, keys, counts, owners = [], [], [], []
            for text in batch["text"]:
                tokens = _tokens(text, lower)
                where = np.fromiter((index.get(t, absent) for t in tokens), np.int64, len(tokens))
                sums.append(np.append(matrix[where].sum(axis=0), len(tokens)))
                missing = np.flatnonzero(where == absent)
                if len(missing):
                    rest = Counter(key_of(tokens[i]) for i in missing)
                    owners.append(np.full(len(rest), row))
                    keys.extend(rest)
                    counts.extend(rest.values())
                row += 1
            if not sums:
                continue
            found = pd.DataFrame(np.array(sums), columns=[*known, "_tokens"])
            found["_tokens"] = found["_tokens"].astype("int64")
            found["_row"] = np.arange(row - len(sums), row)
            found = pd.concat([batch.drop(columns="text").reset_index(drop=True), found], axis=1)
            found["_rest"] = None
            yield found
            if keys:
                yield pd.DataFrame({"_row": np.concatenate(owners), "_rest": keys, "_n": counts})

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in look_up(batches):
            yield frame.reindex(columns=columns)

    types = dict(docs.dtypes)
    fields = [(c, types[c]) for c in carried] + [(k, "double") for k in known]
    fields += [("_tokens", "long"), ("_row", "long"), ("_rest", "binary"), ("_n", "long")]
    columns = [name for name, _ in fields]
    passed = materialize(
        docs.withColumn("text", F.col("text").cast("binary")).mapInPandas(
            both, ", ".join(f"`{name}` {kind}" for name, kind in fields)
        ),
        "looked_up",
    )
    rare = (
        passed.filter("_rest is not null")
        .select("_row", F.col("_rest").alias("key"), "_n")
        .join(table.select("key", *values), "key")
        .groupBy("_row")
        .agg(*[F.sum(F.col(v) * F.col("_n")).alias(f"_rare_{v}") for v in values])
    )
    total = [
        (F.col(k) + F.coalesce(F.col(f"_rare_{v}"), F.lit(0.0))).alias(v)
        for k, v in zip(known, values)
    ]
    return (
        passed.filter("_rest is null")
        .join(rare, "_row", "left")
        .select(*carried, "_tokens", *total)
    )
