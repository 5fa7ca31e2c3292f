"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words are what lies between these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

# A joined table of at most this many rows is broadcast. The callers' rows are
# a few numbers and a short key each, so this is tens of megabytes at most.
BROADCAST_ROWS = 200_000
SALTS = 64

# Stands for a missing id in join keys, which cannot be null.
NO_ID = -(1 << 63)


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that others cannot clash; a missing text is empty."""
    return docs.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "text" else F.col(c) for c in columns]
    )


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """Whole rows as ``_doc`` beside computed columns, so that no names clash.

    ``select("_doc.*")`` unpacks them.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *columns)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def document_key() -> list[Column]:
    """Columns ``_id`` and ``_h`` that identify a document (id, text) without its text.

    Rows that agree in both are repetitions of one document.
    """
    return [
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_h"),
    ]


def join_small(facts: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join with a table that is unique on ``key`` and was written before.

    It is counted, and broadcast when it has at most BROADCAST_ROWS rows. A
    larger one meets salted keys, so that a key with a third of all rows is
    dealt over SALTS tasks.
    """
    if dim.count() <= BROADCAST_ROWS:
        return facts.join(F.broadcast(dim), key, how)
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    salt = F.pmod(F.xxhash64(*[c for c in facts.columns if c != key]), F.lit(SALTS)).cast("int")
    salted = facts.withColumn("_salt", salt)
    return salted.join(dim.withColumn("_salt", salts), [key, "_salt"], how).drop("_salt")
