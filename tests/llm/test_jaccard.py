import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import jaccard
from pageloom.llm.jaccard import choose_bands, compare, connected, near_duplicates, one_of_each
from tests.llm.conftest import odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def gram_sets(texts):
    out = []
    for t in texts:
        words = WORD.findall(t or "")
        n = min(5, len(words))
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    return out


def brute(texts, similarity=0.8):
    """Links and class (first member's place) of each text."""
    sets = gram_sets(texts)
    holders, common = defaultdict(list), Counter()
    for i, grams in enumerate(sets):
        for gram in grams:
            for j in holders[gram]:
                common[j, i] += 1
            holders[gram].append(i)
    links, parent = [0] * len(texts), list(range(len(texts)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for (j, i), c in common.items():
        if c >= similarity * (len(sets[i]) + len(sets[j]) - c):
            links[i] += 1
            links[j] += 1
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return links, [root(i) for i in range(len(texts))]


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_duplicates(df).orderBy("doc_id").collect()
    links, classes = brute(texts)
    assert [r["n_links"] for r in found] == links
    assert [r["class_id"] for r in found] == classes
    kept = one_of_each(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes))


def varied(seed, copies, words=150):
    """Copies with a few changed words, so that some pairs lie at either side of the bound."""
    chosen = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(copies):
        copy = list(base)
        for _ in range(chosen.randrange(0, 4)):
            copy[chosen.randrange(len(copy))] = f"w{chosen.randrange(1000)}"
        out.append(" ".join(copy))
    return out


def test_groups_and_singles(spark):
    texts = [prose(10_000 + i, 60 + i) for i in range(60)]
    for seed, copies in ((1, 2), (2, 5), (3, 40)):
        texts += varied(seed, copies)
    random.Random(0).shuffle(texts)
    check(spark, texts + texts[:7])


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    monkeypatch.setattr(jaccard, "_COLUMNS", 50)
    check(spark, varied(4, 150) + varied(5, 3) + [prose(20_000 + i, 80) for i in range(20)])


def test_empty_blocks(spark, monkeypatch):
    """More blocks than rows: no link is counted again in a pair with an empty block."""
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 300)
    check(spark, [t for seed in range(30, 42) for t in varied(seed, 4)])


def test_blocks_of_a_pair():
    sets = [np.arange(i, i + 20, dtype=np.uint64) for i in range(3)]
    one = np.ones(3, dtype=np.int64)
    assert compare(sets, one, np.array([1, 1, 1]), 0.8, across=True)[0].tolist() == [0, 0, 0]
    assert compare(sets, one, np.array([0, 0, 1]), 0.8, across=True)[0].tolist() == [1, 1, 2]


def test_real_documents(documents, texts):
    found = near_duplicates(documents).orderBy("doc_id").collect()
    ids = sorted(texts)
    links, classes = brute([texts[i] for i in ids])
    assert [r["n_links"] for r in found] == links
    assert [r["class_id"] for r in found] == [ids[c] for c in classes]


def test_odd_rows(odd, empty):
    found = near_duplicates(odd).collect()
    assert len(found) == len(odd_rows())
    links = {(r["doc_id"], r["n_links"]) for r in found}
    assert {(1, 2), (2, 2), (3, 1), (4, 1), (5, 0), (6, 0), (7, 0), (11, 1), (12, 1)} <= links
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 5, 6, 7, None, None, 8, 9, 10, 11, 13, -5])
    assert near_duplicates(empty).count() == 0
    assert one_of_each(empty).count() == 0


def test_row_that_stays_does_not_depend_on_order(spark):
    rows = [(1, prose(50, 40), f"source {i}") for i in range(9)] + [(None, None, f"source {i}") for i in range(9)]
    kept = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, source string").coalesce(1)
        kept.append(sorted(one_of_each(df).collect(), key=str))
    assert len(kept[0]) == 2 and kept[0] == kept[1]


@pytest.mark.parametrize("recall", [0.9, 0.999])
def test_bands_reach_the_recall(recall):
    bands, rows = choose_bands(0.8, recall)
    assert 1 - (1 - 0.8**rows) ** bands >= recall
    assert bands * rows <= 160


def test_recall_of_signatures():
    bands, rows = choose_bands(0.8, 0.999)
    signatures = jaccard.Signatures(bands, rows)
    random_ = np.random.default_rng(1)
    found = {0.8: 0, 0.3: 0}
    for similarity in found:
        for _ in range(300):
            n = 200
            common = round(2 * n * similarity / (1 + similarity))
            grams = random_.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            a, b = signatures.of(grams[:n]), signatures.of(np.append(grams[:common], grams[n:]))
            found[similarity] += bool((a == b).any())
    assert found[0.8] >= 297 and found[0.3] <= 30


def test_connected_parts(spark):
    chosen = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)]
    edges += [(200 + chosen.randrange(40), 200 + chosen.randrange(40)) for _ in range(25)]
    chosen.shuffle(edges)
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["part"] for r in found} == {n: root(n) for n in list(parent) if n not in alone}
    assert connected(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_forest_connects_what_links_connect():
    sets = [np.arange(i, i + 20, dtype=np.uint64) for i in range(0, 30)]
    links, forest = compare(sets, np.ones(30, dtype=np.int64), np.zeros(30, dtype=np.int64), 0.8)
    assert links.tolist() == [min(i, 2) + min(29 - i, 2) for i in range(30)]
    assert len(forest) == 29
