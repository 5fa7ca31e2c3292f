import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pageloom.llm.mixing import mix_sources, mixture
from pageloom.llm.sharding import byte_shards
from tests.llm.conftest import odd_rows, prose


def test_shards_are_contiguous_and_equal(odd):
    found = byte_shards(odd, 4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows()
    )
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r["shard"]].append(r)
    for rows in by_shard.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    order = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"]) for r in order]
    assert keys == sorted(keys)


def test_shard_sizes(documents):
    sizes = Counter()
    largest = 0
    for r in byte_shards(documents, 8).collect():
        sizes[r["shard"]] += r["size"]
        largest = max(largest, r["size"])
    target = sum(sizes.values()) / 8
    assert set(sizes) == set(range(8))
    assert all(abs(s - target) <= largest for s in sizes.values())


def test_empty_tables(empty):
    assert byte_shards(empty).count() == 0
    assert mix_sources(empty).count() == 0
    assert mixture(empty).columns == empty.columns


def test_mix(odd):
    found = mix_sources(odd).collect()
    again = mix_sources(odd.repartition(5)).collect()
    assert Counter(found) == Counter(again)
    assert len(found) == len(odd_rows())
    for r in found:
        assert r["size"] in (0, r["taken"], r["taken"] / 2) or r["taken"] == 0
    kept = mixture(odd)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r["times"] for r in found)


def water_level(sizes, weights, share, most):
    """Targets by handing the excess round until none is left."""
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = share * sum(sizes.values()), set(sizes)
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        target = {s: t + left * weights[s] / total if s in open_ else t for s, t in target.items()}
        left = sum(max(0, target[s] - most * sizes[s]) for s in open_)
        full = {s for s in open_ if target[s] >= most * sizes[s]}
        target.update({s: most * sizes[s] for s in full})
        open_ -= full
    return target


def test_mix_meets_targets(spark, documents):
    found = documents.select("doc_id", "source").join(mix_sources(documents), "doc_id").collect()
    size, taken, given, largest = Counter(), Counter(), {}, Counter()
    for r in found:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        given[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    wanted = water_level(size, weights, 1.5, 2)
    for s in size:
        assert abs(given[s] - wanted[s]) < 1e-6 * wanted[s]
        assert abs(taken[s] - given[s]) <= largest[s]


def test_smaller_mix_is_nested(documents):
    small = {r["doc_id"]: r["times"] for r in mix_sources(documents, share=0.4).collect()}
    large = {r["doc_id"]: r["times"] for r in mix_sources(documents, share=0.7).collect()}
    assert all(large[i] >= n for i, n in small.items())


def test_targets_hold_where_one_id_has_a_third_of_a_source(spark):
    """Equal rows are counted out, so the words taken lie within half a row of the target."""
    rows = [(None, "one two three", "a")] * 700 + [(5, "four five", "b")] * 900
    rows += [(i, prose(i, 1 + i % 9), "ab"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for seed in ("mix", "one", "two", "three"):
        found = mix_sources(docs, seed=seed).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
        assert len(found) == 2
        assert all(abs(r["taken"] - r["target"]) <= 9 for r in found)
    again = mix_sources(docs.repartition(3))
    assert Counter(again.collect()) == Counter(mix_sources(docs).collect())
    assert mixture(docs).count() == mix_sources(docs).agg(F.sum("times")).first()[0]


def test_shards_of_equal_rows(spark):
    rows = [(None, None)] * 500 + [(3, "same text")] * 700 + [(i, "x" * i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = byte_shards(docs).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for r in found:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in found)
    for shard in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
