"""Piece ids and texts against the library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from pageloom.llm.pieces import Merges, Pieces, decode, encode, round_trip

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def tool():
    return Pieces(MODEL)


def test_merges_take_the_best_pair_and_the_leftmost_of_equals():
    merges = Merges({"ab": -1.0, "bc": -2.0, "abc": -3.0, "aa": -4.0})
    assert merges.apply("abc") == ["abc"]
    assert merges.apply("bcab") == ["bc", "ab"]
    assert merges.apply("aaa") == ["aa", "a"]


def test_made_up_texts(tool, library):
    r = random.Random(7)
    vocabulary = [library.id_to_piece(i) for i in range(3, library.get_piece_size())]
    odd = ["a", "e", "s", " ", "  ", "\n", "é", "ñ", "\U0001f600", "t", "th", "▁", "1", "\t", "中", "<s>", "<0x41>", "\x00", "́", "ﬁ"]
    for _ in range(5000):
        text = "".join(r.choice(vocabulary) if r.random() < 0.6 else r.choice(odd) for _ in range(r.randint(0, 14)))
        assert tool.encode(text) == library.encode(text), text


@pytest.mark.parametrize("text", ["x" * 50_000, "ab" * 40_000, " " * 3_000, "th" * 20_000 + "\n" * 500, "é\U0001f600" * 9_000])
def test_long_words(tool, library, text):
    assert tool.encode(text) == library.encode(text)


def test_tables_of_pairs_hold_beyond_what_is_remembered(library, monkeypatch):
    monkeypatch.setattr("pageloom.llm.pieces._PAIRS", 3)
    monkeypatch.setattr("pageloom.llm.pieces._REMEMBERED", 2)
    small = Pieces(MODEL)
    text = "These words are many more than are remembered, and these words too."
    assert small.encode(text) == library.encode(text) == small.encode(text)


def test_documents(documents, library):
    got = {r["doc_id"]: r for r in round_trip(documents, MODEL).collect()}
    for row in documents.collect():
        ids = [*library.encode(row["text"] or ""), library.eos_id()]
        mine = got[row["doc_id"]]
        assert mine["n_tokens"] == len(ids)
        assert mine["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(odd, library):
    rows = odd.select("doc_id", "text").collect()
    expected = sorted((str(r["doc_id"]), [*library.encode(r["text"] or ""), library.eos_id()]) for r in rows)
    written = encode(odd, MODEL)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in written.collect()) == expected
    read = sorted((str(r["doc_id"]), r["text"]) for r in decode(written, MODEL).collect())
    assert read == sorted((i, library.decode(ids)) for i, ids in expected)
    digests = round_trip(odd, MODEL).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in digests) == sorted((i, len(ids)) for i, ids in expected)


def test_null_ids_decode_to_an_empty_text(spark):
    rows = spark.createDataFrame([(1, None), (None, [])], "doc_id long, ids array<int>")
    assert sorted(map(str, decode(rows, MODEL).collect())) == ["Row(doc_id=1, text='')", "Row(doc_id=None, text='')"]


def test_empty(empty):
    assert round_trip(empty, MODEL).count() == 0
    assert encode(empty, MODEL).count() == 0
