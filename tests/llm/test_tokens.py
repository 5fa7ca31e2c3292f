import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pageloom.llm.huffman import Code, code_lengths
from pageloom.llm.token_counts import token_counts
from pageloom.llm.token_files import encoder, join_crc, read_ids, round_trip, write_ids
from pageloom.llm import token_files
from tests.llm.conftest import odd_rows, prose

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_equal_library(odd, documents, texts):
    tokenizer = Tokenizer.from_file(WORDS)
    expected = sorted(
        (i is not None, i or 0, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids))
        for i, t, *_ in odd_rows()
    )
    for most in (300_000, 3):
        found = token_counts(odd, WORDS, most=most).collect()
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in found) == expected
    for r in token_counts(documents, WORDS).collect():
        n = len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 2048)


def test_empty(spark, empty, tmp_path):
    assert token_counts(empty, WORDS).count() == 0
    assert round_trip(empty, BYTES).count() == 0


PARTS = st.sampled_from(
    ["a", "don't", "'s", "é", "́", "1", "22", "!", "?!", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0",
     " ", "​", "<|endoftext|>", "<|", "世界", "\U0001f600", "İ", "ß"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_units_encode_alike(text):
    tokenizer = Tokenizer.from_file(BYTES)
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder(BYTES).encode([text, "a", text]) == [
        np.array(x, dtype="<u4").tobytes() for x in (ids, tokenizer.encode("a").ids, ids)
    ]


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_pre_tokens_count_alike(text):
    tokenizer = Tokenizer.from_file(WORDS)
    whole = len(tokenizer.encode(text, add_special_tokens=False).ids)
    split = text.encode().split()
    assert whole == sum(len(tokenizer.encode(t.decode(), add_special_tokens=False).ids) for t in split)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=3000), st.integers(6, 18))
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids, dtype=np.uint32)
    counts = np.bincount(ids, minlength=1)
    lengths = code_lengths(counts, limit)
    assert lengths.max(initial=0) <= limit
    used = lengths[lengths > 0].astype(float)
    assert (2.0**-used).sum() <= 1
    code = Code(lengths)
    payload, marks = code.encode(ids)
    assert (code.decode(payload, marks, len(ids)) == ids).all()


def test_huffman_is_optimal_without_a_tight_limit():
    import heapq

    counts = np.random.default_rng(0).integers(1, 10_000, 300)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        joined = heapq.heappop(heap) + heapq.heappop(heap)
        cost += joined
        heapq.heappush(heap, joined)
    assert (code_lengths(counts, 24) * counts).sum() == cost


def test_join_crc():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"abc", b"defgh" * 100)):
        assert join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def expected_rows(rows):
    tokenizer = Tokenizer.from_file(BYTES)
    ids = [(i is not None, i or 0, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]
    ids.sort(key=lambda r: r[:2])
    return ids


def test_files_round_trip(spark, odd, documents, texts, tmp_path, monkeypatch):
    for size in (token_files.BLOCK_IDS, 1000):
        monkeypatch.setattr(token_files, "BLOCK_IDS", size)
        found = round_trip(documents, BYTES).orderBy("start").collect()
        start = 0
        for r, (_, doc, ids) in zip(found, expected_rows(texts.items()), strict=True):
            crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
            assert tuple(r) == (doc, start, len(ids), crc)
            start += len(ids)
    folder = str(tmp_path / "files")
    write_ids(odd, folder, BYTES, 0)
    found = read_ids(spark, folder).orderBy("start").collect()
    expected = expected_rows([(i, t) for i, t, *_ in odd_rows()])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, list(r["ids"])) for r in found) == sorted(expected)
    assert [r["start"] for r in found][1:] == list(np.cumsum([r["n_tokens"] for r in found])[:-1])
    assert [r["doc_id"] for r in found if r["doc_id"] is not None] == sorted(i for i, *_ in odd_rows() if i is not None)


def test_long_documents_under_one_id(spark, monkeypatch):
    """Pieces of documents above a block meet by their place, not by their id."""
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    same = prose(1, 1500)
    rows = [(None, same)] * 40 + [(7, same)] * 5 + [(i, prose(i, 30)) for i in range(100, 160)] + [(None, prose(9, 2000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = round_trip(docs, BYTES).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(BYTES)
    expected = [(i, np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()) for i, t in rows]
    expected = sorted((str(i), len(b) // 4, zlib.crc32(b)) for i, b in expected)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in found) == expected
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1]]
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_encoder_tells_joined_words_apart(monkeypatch):
    monkeypatch.setattr(token_files, "_JOINED", 3)
    tokenizer = Tokenizer.from_file(BYTES)
    tool = token_files.Encoder(BYTES)
    texts = ["a bb ccc dddd eeeee ffffff", "don't we'll x1y2 Ġ Ġa é́ \U0001f600 中文 -- !!", "one two\nthree four", " lead", "tail ", "", "a  b"]
    for _ in range(2):
        found = [np.frombuffer(b, "<u4").tolist() for b in tool.encode(texts)]
        assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
