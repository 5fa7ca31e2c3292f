"""Hard negatives against all scores."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import negatives
from pageloom.llm.negatives import Sought, hard_negatives, hilbert_keys, ranges

SCHEMA = "vec_id long, embedding array<float>, label int"
ASKED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
LAST = 1 << 62


def brute_force(rows, every=100, positives=5, k=10):
    clean = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        moved = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        clean.append((i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist(), moved))
    out = []
    for a, (i, v, label) in enumerate(clean):
        if i is None or i % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w)), LAST if j is None else j, b, other)
            for b, (j, w, other) in enumerate(clean)
            if b != a
        )
        for p in [s for s in scored if s[3] == label][:positives]:
            window = [s for s in scored if s[3] != label and -30 * p[0] <= -100 * s[0] <= -90 * p[0]]
            for rank, s in enumerate(window[:k], 1):
                out.append((i, None if p[1] == LAST else p[1], rank, None if s[1] == LAST else s[1], -p[0], -s[0]))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select(*ASKED).collect()), key=str)


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def odd_vectors():
    r = random.Random(1)
    one = [0.5, 0.25, -0.125, 0.0]
    rows = [(i, [r.gauss(0, 0.3) for _ in range(4)], r.randrange(3)) for i in range(400)]
    rows += [(1000 + i, one, i % 2) for i in range(300)]  # equal vectors
    rows += [(100, one, 1), (100, one, 1), (100, one, 0)]  # repeated ids
    rows += [(None, one, 1), (None, one, 0), (None, [0.1, 0.1, 0.1, 0.1], 2)]
    rows += [(2000, None, 1), (2001, one, None), (2002, [1.0, None, 0.0, 0.0], 1)]
    rows += [(2100, [float("nan"), 0.0, 0.0, 0.0], 1), (2200, [float("inf"), 0.0, 0.0, 0.0], 1)]
    rows += [(3000, [], 1), (3001, [0.5], 1), (3100, [0.5, 0.5], 0), (-100, one, 2), (4000, [-1.0] * 4, 5)]
    rows += [(5000, [0.0] * 4, 1), (5100, [100.0, -100.0, 3.0, 0.5], 2)]
    return rows


def test_table(vectors):
    assert found(hard_negatives(vectors)) == brute_force([tuple(r) for r in vectors.collect()])


def test_odd_rows_and_block_sizes(spark):
    rows = odd_vectors()
    clash = {c: F.lit("clash") for c in ("v", "key", "block", "label_", "n", "ids", "anchor", "score", "rank", "_tie")}
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns(clash)
    expected = brute_force(rows)
    assert found(hard_negatives(df)) == expected
    assert found(hard_negatives(df, rows=7, most=3)) == expected


def test_all_vectors_equal(spark):
    rows = [(i, [0.5, 0.5], i % 3) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(hard_negatives(df, rows=16)) == brute_force(rows)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty).count() == 0
    assert hard_negatives(spark.createDataFrame([(1, [0.5], 1)], SCHEMA)).count() == 0


def test_scores_that_do_not_fit(spark):
    with pytest.raises(ValueError):
        hard_negatives(spark.createDataFrame([(100, [3e9], 1)], SCHEMA))


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_ranges_hold_all_scores():
    r = np.random.default_rng(3)
    anchors, block = r.integers(-50, 50, (20, 8)), r.integers(-50, 50, (30, 8))
    low, high = ranges(anchors, block.min(axis=0)[None], block.max(axis=0)[None])
    got = anchors @ block.T
    assert (low <= got).all() and (got <= high).all()


def test_zone_maps_keep_far_blocks_unread(spark):
    """Far clusters of another sign are neither read for positives nor for windows."""
    r = np.random.default_rng(4)
    rows = []
    for i in range(2000):
        side = 1.0 if i % 2 else -1.0
        rows.append((i, [float(x) for x in side + r.normal(0, 0.01, 4)], i % 5))
    chosen = []
    blocks = negatives._blocks(spark.createDataFrame(rows, SCHEMA), "embedding", 7, 64)
    anchors = next(negatives._anchors(blocks, 100, 100))
    everywhere = np.full((len(anchors), 1), np.iinfo(np.int64).min), np.full((len(anchors), 1), 1 << 60)
    sought = Sought(anchors, True, 5, *everywhere)
    zones = list(negatives._zones(blocks.toPandas()))
    least = sought.low.copy()
    for _, label, n, low, high in zones:
        who = sought.of_label(label)
        bottom, top = ranges(anchors.vectors[who], low, high)
        least[who] = np.maximum(least[who], sought.sure(bottom[:, 0], top[:, 0], n, who))
    for _, label, _, low, high in zones:
        who = sought.of_label(label)
        bottom, top = ranges(anchors.vectors[who], low, high)
        chosen.append(sought.needed(bottom[:, 0], top[:, 0], least, who).mean() if len(who) else 0)
    assert np.mean(chosen) < 0.6
    assert found(hard_negatives(spark.createDataFrame(rows, SCHEMA), rows=64)) == brute_force(rows)
