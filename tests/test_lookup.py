"""The sample rows of all tables, and the answers that follow from them."""

import re

import pytest

from pageloom.operators import lookup
from pageloom.schema import TABLES

from .conftest import rows

IA = "https://es.wikipedia.org/wiki/IA"
ML = "https://es.wikipedia.org/wiki/ML"
A, B = "Inteligencia Artificial", "Aprendizaje Automático"

# The sample rows whose answers are known.
SAMPLE = {
    "page": [
        (1, A, IA, 5.0, 8, 10, 7, 0, 0, 8, 8, 200),
        (2, B, ML, 3.0, 5, 8, 4, 0, 0, 5, 5, 150),
    ],
    "word": [
        (1, "inteligencia", 120, 0),
        (2, "artificial", 100, 0),
        (3, "aprendizaje", 90, 0),
        (4, "automático", 80, 0),
    ],
    "set2": [(1, "inteligencia", "artificial"), (2, "aprendizaje", "automático")],
    "set3": [(1, "redes", "neuronales", "artificiales"), (2, "aprendizaje", "no", "supervisado")],
    "word_page": [(1, 1, 30), (3, 2, 30)],
    "set2_page": [(1, 1, 18), (2, 2, 15)],
    "set3_page": [(1, 1, 10), (2, 2, 12)],
    "page_word": [
        (1, 1, 30, 0.15, 0.15),
        (1, 2, 20, 0.10, 0.10),
        (2, 3, 30, 0.20, 0.20),
        (2, 4, 15, 0.10, 0.10),
    ],
    "shared2": [(1, 2, 3, 1)],
    "shared3": [(1, 2, 2, 1)],
}


@pytest.fixture(scope="module")
def tables(spark):
    return {name: spark.createDataFrame(SAMPLE[name], TABLES[name]) for name in TABLES}


def answer(df):
    return [tuple(row) for row in df.collect()]


def test_pages_by_words(tables):
    assert answer(lookup.top_pages_by_word(tables, "INTELIGENCIA")) == [(A, IA, 30)]
    assert answer(lookup.top_pages_by_word(tables, "artificial")) == []
    assert answer(lookup.top_pages_by_gram(tables, "inteligencia", "Artificial")) == [(A, IA, 18)]
    triple = lookup.top_pages_by_gram(tables, "aprendizaje", "no", "supervisado")
    assert answer(triple) == [(B, ML, 12)]


def test_many_ids_are_joined(tables, monkeypatch):
    monkeypatch.setattr(lookup, "MAX_IDS", 0)
    assert answer(lookup.top_pages_by_word(tables, "INTELIGENCIA")) == [(A, IA, 30)]
    facts = tables["word_page"].join(tables["word"].select("id_word", "word"), "id_word")
    worded = {**tables, "word_page": facts}
    assert answer(lookup.top_pages_by_word(worded, "Inteligencia")) == [(A, IA, 30)]


def test_shared_sets(tables):
    assert answer(lookup.shared_bigrams_of_page(tables, IA)) == [(B, ML, 3)]
    assert answer(lookup.shared_bigrams_of_page(tables, ML)) == []
    assert answer(lookup.shared_trigrams_of_page(tables, IA)) == [(B, ML, 2)]


def test_words_of_a_page(tables):
    assert answer(lookup.words_of_page(tables, IA)) == [("inteligencia", 30), ("artificial", 20)]
    shares = answer(lookup.word_percentages_of_page(tables, ML))
    assert shares == [("aprendizaje", 0.20), ("automático", 0.10)]


def test_page_numbers(tables):
    assert answer(lookup.link_count_of_page(tables, IA)) == [(A, IA, 8)]
    assert answer(lookup.page_connections(tables, IA)) == [(A, IA, 8, 84.80, 200)]
    assert answer(lookup.page_repetitions(tables, ML)) == [(B, ML, 3.0, 150)]


def test_rankings(tables):
    ranked = [(A, IA, 8, 200, 5.0), (B, ML, 5, 150, 3.0)]
    for limit in (10, None, 0, -1):
        assert answer(lookup.top_interconnected(tables, limit)) == ranked
    assert answer(lookup.top_interconnected(tables, 1)) == ranked[:1]
    hubs = answer(lookup.top_hub_pages(tables))
    assert hubs == [(A, IA, 84.80, 8, 200, 5.0), (B, ML, 63.00, 5, 150, 3.0)]


def test_totals(tables):
    assert answer(lookup.word_repetitions(tables, "Automático")) == [("automático", 80)]
    assert answer(lookup.summary(tables)) == [(2, 4, 2, 2)]
    assert answer(lookup.load_check(tables)) == [(2, 4, 2)]
    assert answer(lookup.available_words(tables, 2)) == [("inteligencia",), ("artificial",)]
    assert answer(lookup.available_pages(tables, 1)) == [(IA, A)]


def test_collation_ignores_accents(tables):
    assert answer(lookup.word_repetitions(tables, "automatico")) == []
    found = lookup.word_repetitions(tables, "AUTOMATICO", collation="UNICODE_CI_AI")
    assert answer(found) == [("automático", 80)]
    pair = lookup.top_pages_by_gram(
        tables, "Aprendizaje", "automatico", collation="UNICODE_CI_AI"
    )
    assert answer(pair) == [(B, ML, 15)]


def test_null_and_unknown_arguments(tables):
    for call in (
        lambda: lookup.top_pages_by_word(tables, None),
        lambda: lookup.top_pages_by_gram(tables, "a", None),
        lambda: lookup.words_of_page(tables, None),
        lambda: lookup.word_repetitions(tables, None),
    ):
        with pytest.raises(ValueError):
            call()
    assert answer(lookup.words_of_page(tables, "nowhere")) == []
    assert answer(lookup.page_connections(tables, IA.lower())) == []


def test_result_order(spark, tables):
    df = spark.createDataFrame([("10", 1), ("9", 2), ("b", 3), ("a", 4)], "v string, n int")

    def order(kind):
        return [row["v"] for row in lookup.sorted_result(df, "v", kind).collect()]

    assert order("asc") == ["9", "10", "a", "b"]
    assert order("desc") == ["b", "a", "10", "9"]
    assert order("alpha") == ["10", "9", "a", "b"]
    assert answer(lookup.sorted_result(df, "n", "desc"))[0] == ("a", 4)
    with pytest.raises(ValueError):
        lookup.sorted_result(df, "v", "up")


def test_natural_order(spark):
    values = ["page 10", "page 9", "page 09b", "Page 9", "", None, "(a)", "7 up", "-2", "6.5", "1e1 x", "b", "a2b10",
              "a2b9", "page " + "1" * 30, "page " + "2" * 29, "é1", "Infinity"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, n int")

    def order(kind):
        return [row["v"] for row in lookup.sorted_result(df, "v", kind).collect()]

    expected = [
        None, "", "(a)", "-2", "6.5", "7 up", "1e1 x", "Infinity", "a2b9", "a2b10", "b", "é1", "page 9", "Page 9",
        "page 09b", "page 10", "page " + "2" * 29, "page " + "1" * 30,
    ]
    assert order("asc") == expected
    assert order("desc") == expected[::-1]
    assert order("alpha").index("page 10") < order("alpha").index("page 9")


def test_json_rows(tables):
    found = answer(lookup.as_json(lookup.word_repetitions(tables, "artificial")))
    assert found == [('{"WORD":"artificial","TOTAL_REPETITIONS":100}',)]


def test_lookup_reaches_the_stored_table(spark, tables, tmp_path):
    from pageloom.sources.records import read_tables
    from pageloom.sources.sinks import write_tables

    write_tables(tables, str(tmp_path))
    stored = read_tables(spark, str(tmp_path))
    found = lookup.top_pages_by_word(stored, "Inteligencia")
    assert answer(found) == [(A, IA, 30)]
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*id_word", plan)
    words = lookup.word_repetitions(stored, "Inteligencia")
    assert "EqualTo(word_key,inteligencia)" in words._jdf.queryExecution().toString()
    assert rows(stored["shared2"].select("id_page1", "id_page2")) == [(1, 2)]
