"""The registered queries: their columns, and their SQL where there is some."""

import duckdb
import pytest

import __spark_entry__ as entry
from pageloom.llm.oracle import ORACLE

COLUMNS = {
    "op1_byte_shards": "doc_id bigint size bigint text_crc32 bigint law string shard int slot bigint grown_shard int",
    "op2_token_counts": "doc_id bigint n_bytes bigint n_tokens bigint over_limit boolean",
    "op3_secret_scan": "doc_id bigint n_assign bigint n_access bigint n_hex bigint base_sha256 string spans string",
    "op4_lattice_score": "doc_id bigint held_out boolean n_tokens bigint n_known bigint train_tokens bigint base_score double score double",
    "op5_source_mix": "doc_id bigint size bigint source_size bigint target double taken bigint",
    "op6_benchmark_leaks": "doc_id bigint item_id bigint start bigint end bigint edits int",
    "op7_toxicity": "doc_id bigint held_out boolean score double predicted int",
    "op8_jaccard_join": "doc_id bigint class_id bigint copy_class bigint n_links bigint",
    "op9_quality_rules": "doc_id bigint n_words bigint word_chars bigint n_symbols bigint n_dup_lines bigint n_repeat_words bigint base_failed boolean kept boolean",
    "op10_token_files": "doc_id bigint start bigint n_tokens bigint ids_crc32 bigint",
    "op11_ranked_search": "item_id bigint rank int doc_id bigint score bigint",
    "op12_hard_negatives": "anchor_id bigint positive_id bigint rank int negative_id bigint positive_score bigint negative_score bigint",
    "op13_piece_round_trip": "doc_id bigint n_tokens bigint ids_sha256 string decoded_sha256 string",
}
# queries that do not give one row for each document
OTHER_ROWS = {"op6_benchmark_leaks", "op11_ranked_search", "op12_hard_negatives"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf_dir, documents, name):
    result = entry.queries()[name](spark, sf_dir)
    words = COLUMNS[name].split()
    wanted = dict(zip(words[::2], words[1::2]))
    found = dict(result.dtypes)
    assert {c: found[c] for c in wanted} == wanted
    rows = result.count()
    assert rows > 0 if name in OTHER_ROWS else rows == documents.count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    expected = connection.sql(ORACLE[name])
    result = entry.queries()[name](spark, sf_dir)
    assert sorted(result.columns) == sorted(expected.columns)
    found = {tuple(r[c] for c in expected.columns) for r in result.collect()}
    assert found == set(expected.fetchall())
