import random

import numpy as np
import pytest

from pageloom.llm.decontaminate import Block, aligned, leaks, normalised, without_leaks
from tests.llm.conftest import odd_rows, prose


def best_edits(item, text):
    """Least edits of the item against any substring."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(text, n, chosen):
    letters = list(text)
    for _ in range(n):
        at = chosen.randrange(len(letters))
        kind = chosen.choice("ids")
        if kind == "i":
            letters.insert(at, chosen.choice("qxz "))
        elif kind == "d" and len(letters) > 1:
            letters.pop(at)
        else:
            letters[at] = chosen.choice("qxz")
    return "".join(letters)


@pytest.mark.parametrize("seed", range(60))
def test_banded_alignment(seed):
    chosen = random.Random(seed)
    item = prose(seed, 12)
    n = chosen.randrange(0, 9)
    before, after = prose(seed + 500, chosen.randrange(0, 20)), prose(seed + 900, chosen.randrange(0, 20))
    inside = edited(item, n, chosen)
    text = normalised(before + inside + after)
    k = 8
    start = len(before)
    found = aligned(normalised(item), text, max(0, start - 3), min(len(text), start + 3), k)
    least = best_edits(normalised(item).tolist(), text.tolist())
    assert (found is None) or found[2] >= least
    if n <= k - 3:
        assert found is not None and found[2] <= n
        again = text[found[0] : found[1]].tolist()
        assert best_edits(again, again) == 0
        assert distance(normalised(item).tolist(), again) == found[2]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_every_occurrence_within_the_budget_is_found():
    chosen = random.Random(5)
    items = [prose(40 + i, 10 + 3 * i) for i in range(6)]
    block = Block(list(range(6)), items, 8, 0.1)
    for trial in range(120):
        parts = [prose(3000 + trial, 30)]
        wanted = []
        for i in chosen.sample(range(6), 2):
            parts += [edited(items[i], chosen.randrange(0, int(block.budget[i]) + 1), chosen), prose(trial * 7 + i, 20)]
            wanted.append(i)
        text = " ".join(parts)
        found = block.search(text)
        assert set(wanted) <= {f[0] for f in found}
        for which, start, end, edits in found:
            codes = normalised(text)[start:end].tolist()
            assert distance(normalised(items[which]).tolist(), codes) == edits <= block.budget[which]


def test_unrelated_texts():
    items = [prose(40 + i, 30) for i in range(6)]
    block = Block(list(range(6)), items, 8, 0.1)
    assert all(block.search(prose(8000 + i, 400)) == [] for i in range(20))


def test_stretches(monkeypatch):
    from pageloom.llm import decontaminate

    item = prose(77, 30)
    monkeypatch.setattr(decontaminate, "_STRETCH", 100)
    block = Block([5], [item], 8, 0.1)
    for shift in range(0, 130, 13):
        text = "é" * shift + item + prose(78, 50)
        assert block.search(text) == [(0, shift, shift + len(item), 0)]


def test_leaks(spark, odd, empty):
    item = prose(3, 120)[20:300]
    items = spark.createDataFrame(
        [(1, item), (2, item), (3, None), (4, ""), (5, "café"), (6, "nowhere to be found in these texts"), (None, "one two")],
        "item_id long, text string",
    )
    for block in (4_000_000, 50):
        found = sorted(leaks(odd, items, block=block).select("doc_id", "item_id", "start", "end", "edits").collect(), key=str)
        hits = [(r["doc_id"], r["item_id"]) for r in found]
        assert sorted(hits, key=str) == sorted(
            [(1, 1), (1, 1), (2, 1), (1, 2), (1, 2), (2, 2), (10, 5), (11, None), (12, None)], key=str
        )
        assert {(r["start"], r["end"], r["edits"]) for r in found if r["item_id"] == 1} == {(20, 300, 0)}
    kept = without_leaks(odd, items)
    assert kept.columns == odd.columns
    assert kept.count() == len(odd_rows()) - 6
    assert leaks(empty, items).count() == 0
    assert without_leaks(odd, items.limit(0)).count() == len(odd_rows())


def test_planted_passages(spark, sf_dir, documents, texts):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    passages = {r["item_id"]: r["text"] for r in items.collect()}
    found = {(r["doc_id"], r["item_id"]) for r in leaks(documents, items).collect()}
    flat = {i: normalised(t).tobytes() for i, t in texts.items()}
    exact = {(d, i) for i, p in passages.items() for d, t in flat.items() if normalised(p).tobytes() in t}
    assert exact and exact <= found
    assert len({d for d, _ in found} - {d for d, _ in exact}) <= 0.02 * len(texts)
    assert np.mean([d for d, _ in found]) >= 0
