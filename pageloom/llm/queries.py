"""Registered queries: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.decontaminate import leaks
from pageloom.llm.jaccard import near_duplicates
from pageloom.llm.lattice import lattice_scores
from pageloom.llm.mixing import mix_sources
from pageloom.llm.negatives import hard_negatives
from pageloom.llm.pieces import round_trip as piece_round_trip
from pageloom.llm.quality import quality
from pageloom.llm.search import search
from pageloom.llm.secret_scan import secret_scan
from pageloom.llm.sharding import byte_shards
from pageloom.llm.token_counts import token_counts
from pageloom.llm.token_files import round_trip
from pageloom.llm.toxicity import toxicity


def tokenizer_path(name: str) -> str:
    """Place of an installed tokenizer file; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"), 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "end", "edits")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    lines = F.transform("spans", lambda s: F.concat_ws(":", s[0].cast("string"), s[1].cast("string")))
    return judged.select(
        "doc_id", "held_out", "score", "predicted", F.array_join(lines, ",").alias("spans")
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 0)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_shards,
        op2_token_counts,
        op3_secret_scan,
        op4_lattice_score,
        op5_source_mix,
        op6_benchmark_leaks,
        op7_toxicity,
        op8_jaccard_join,
        op9_quality_rules,
        op10_token_files,
        op11_ranked_search,
        op12_hard_negatives,
        op13_piece_round_trip,
    )
}
