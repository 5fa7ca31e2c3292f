import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from pageloom.operators import lookup
from pageloom.operators.prepare import with_terms
from pageloom.plans.job import run
from pageloom.plans.queries import QUERIES
from pageloom.schema import TABLES
from pageloom.scratch import materialize, scratch_root
from pageloom.sources import sinks
from pageloom.sources.records import load_pages, read_first, read_tables, rejected_lines, spread

from .conftest import rows


def record(number, words, links=(), title="t"):
    return {
        "url": f"u{number}",
        "title": title,
        "word_list": words,
        "bigrams": [" ".join(p) for p in zip(words, words[1:])],
        "trigrams": [" ".join(p) for p in zip(words, words[1:], words[2:])],
        "edits_per_day": number / 2,
        "links": list(links),
    }


@pytest.fixture()
def source(tmp_path):
    lines = [
        json.dumps(record(1, "a b c d".split(), ["u2", "u3", "u1"]), ensure_ascii=False),
        "{broken",
        "null",
        json.dumps({"url": "u9"}),
        json.dumps(record(2, "a b c é".split(), ["u3", "u7"], title="ñ"), ensure_ascii=False),
        json.dumps(record(3, "x a b".split(), ["u1", "u2"]), ensure_ascii=False),
    ]
    path = tmp_path / "pages.jsonl"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_load_drops_lines_without_title(spark, source):
    assert [row["url"] for row in load_pages(spark, source).orderBy("url").collect()] == ["u1", "u2", "u3"]
    assert rows(rejected_lines(spark, source)) == [("null",), ("{broken",)]


def test_jsonl_round_trip(spark, source, tmp_path):
    pages = load_pages(spark, source)
    sinks.write_jsonl(pages, str(tmp_path / "copy"))
    assert rows(load_pages(spark, str(tmp_path / "copy"))) == rows(pages)


def test_jsonl_is_written_compressed(spark, tmp_path):
    words = ["word"] * 5000
    pages = spark.createDataFrame([("u", "t", words)], "url string, title string, word_list array<string>")
    sizes = {}
    for kind in ("gzip", "none"):
        sinks.write_jsonl(pages, str(tmp_path / kind), *([] if kind == "gzip" else [kind]))
        files = list((tmp_path / kind).glob("part-*"))
        assert all(file.name.endswith(".json.gz" if kind == "gzip" else ".json") for file in files)
        sizes[kind] = sum(file.stat().st_size for file in files)
        assert load_pages(spark, str(tmp_path / kind)).first()["word_list"] == words
    assert sizes["gzip"] < sizes["none"] / 5


def test_complete_job(spark, source, tmp_path):
    folder = str(tmp_path / "tables")
    run(spark, source, folder)
    first = {name: rows(df) for name, df in read_tables(spark, folder).items()}
    run(spark, source, folder)
    tables = read_tables(spark, folder)
    assert {name: rows(df) for name, df in tables.items()} == first
    for name, schema in TABLES.items():
        assert set(schema.names) <= set(tables[name].columns)
    page = {row["url"]: row for row in tables["page"].collect()}
    assert page["u1"]["distinct_links"] == 3 and page["u1"]["connectivity_score"] == 3
    assert page["u1"]["total_repetitions"] == 2
    assert [row["id_page"] for row in tables["page"].orderBy("url").collect()] == [1, 2, 3]
    # pairs look onward only, triples both ways
    assert rows(tables["shared2"].select("id_page1", "id_page2", "shared_sets_count")) == [
        (1, 2, 2), (1, 3, 1), (2, 3, 1),
    ]
    assert rows(tables["shared3"].select("id_page1", "id_page2", "shared_sets_count")) == [
        (1, 2, 1), (2, 1, 1),
    ]
    words = {row["word"]: row for row in tables["word"].collect()}
    assert words["a"]["total_repetitions"] == 3
    assert words["a"]["link_repetitions"] == 6
    assert lookup.summary(tables).first()["total_words"] == len(words) == 6


def test_empty_tables_keep_their_schema(spark, tmp_path):
    sinks.empty_tables(spark, str(tmp_path))
    tables = read_tables(spark, str(tmp_path))
    assert tables["page"].columns == TABLES["page"].names
    assert tuple(lookup.summary(tables).first()) == (0, 0, 0, 0)


def test_insert_if_absent(spark):
    existing = spark.createDataFrame([(1, "b"), (2, "d")], "id long, word string")
    incoming = spark.createDataFrame([("c",), ("b",), ("a",), ("a",)], "word string")
    merged = sinks.insert_if_absent(existing, incoming, ["word"], "id")
    assert rows(merged) == [(1, "b"), (2, "d"), (3, "a"), (4, "c")]
    again = sinks.insert_if_absent(materialize(merged), incoming, ["word"], "id")
    assert rows(again) == rows(merged)
    facts = spark.createDataFrame([("a", 1)], "word string, n long")
    more = spark.createDataFrame([("a", 9), ("b", 2)], "word string, n long")
    assert rows(sinks.insert_if_absent(facts, more, ["word"])) == [("a", 1), ("b", 2)]


def test_upsert_and_update(spark):
    existing = spark.createDataFrame([("a", 1), ("b", 2)], "word string, n long")
    incoming = spark.createDataFrame([("b", 5, 1), ("b", 7, 2), ("c", 3, 1)], "word string, n long, at long")
    latest = sinks.latest_per_key(incoming, ["word"], "at")
    assert rows(sinks.upsert(existing, latest, ["word"])) == [("a", 1), ("b", 7), ("c", 3)]
    changed = sinks.update_by_key(existing, latest, "word", {"n": "at"})
    assert rows(changed) == [("a", 1), ("b", 2)]


def test_rewrite_reads_its_own_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(5), path, ["id"])
    sinks.rewrite(spark.read.parquet(path).filter("id > 2"), path)
    assert rows(spark.read.parquet(path)) == [(3,), (4,)]


def test_spread_leaves_wide_inputs_alone(spark):
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide, "id") is wide
    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() > 1


class Session:
    """Just the settings that the scratch folder depends on."""

    def __init__(self, **settings):
        self.conf = {name.replace("_", "."): value for name, value in settings.items()}
        self.sparkContext = type("Context", (), {"applicationId": "app"})


def test_scratch_follows_the_session():
    cluster = Session(spark_checkpoint_dir="/shared/folder/", spark_master="yarn")
    assert scratch_root(cluster) == "/shared/folder/pageloom-app"
    with pytest.raises(RuntimeError):
        scratch_root(Session(spark_master="yarn"))
    with pytest.raises(RuntimeError):
        scratch_root(Session(spark_master="local[2]"))


def test_ranked_copy_opens_the_first_files_only(spark, tmp_path):
    path = str(tmp_path / "ranked")
    table = spark.range(1000).selectExpr("id", "id % 7 as score").repartition(5)
    order = [F.desc("score"), F.asc("id")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    sinks.write_ranked(table, path, order)
    expected = sorted(((i % 7, i) for i in range(1000)), key=lambda r: (-r[0], r[1]))
    for limit in (1, 10, 300, 2000):
        first = read_first(spark, path, limit)
        found = [(r.score, r.id) for r in first.orderBy(*order).limit(limit).collect()]
        assert found == expected[:limit]
    every = len(spark.read.parquet(path).inputFiles())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert every > 2
    plan = read_first(spark, path, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan
    sinks.write_ranked(table.limit(0), path, order)
    assert read_first(spark, path, 10).count() == 0


def test_dictionaries_follow_from_one_pass_over_the_texts(spark, sf_dir, tmp_path, monkeypatch):
    texts = ["", None, "solo", "zwei worte", "eins zwei drei", "eins zwei drei", "drei eins zwei drei eins", "! ?"]
    pages = with_terms(spark.createDataFrame(list(enumerate(texts)), "id_page long, text string"), stopwords=[])
    words = [(text or "").replace("!", "").replace("?", "").split() for text in texts]
    stored = sinks.write_dictionaries(pages, {n: str(tmp_path / f"d{n}") for n in (1, 2, 3)})
    for n, folder in stored.items():
        expected = {" ".join(w[i : i + n]) for w in words for i in range(len(w) - n + 1)}
        assert rows(spark.read.parquet(folder)) == sorted((item,) for item in expected)
    empty = sinks.write_dictionaries(pages.limit(0), {n: str(tmp_path / f"e{n}") for n in (1, 2, 3)})
    assert [spark.read.parquet(empty[n]).count() for n in (1, 2, 3)] == [0, 0, 0]

    cut = []

    def counted(writer, path, *args, write=DataFrameWriter.parquet, **options):
        cut.append("regexp_replace" in writer._df._jdf.queryExecution().optimizedPlan().toString())
        return write(writer, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    found = QUERIES["summary"](spark, sf_dir).first()
    assert found["total_pages"] > 0 and found["total_words"] < found["total_word_pairs"] < found["total_word_triplets"]
    assert sum(cut) == 1
