import math
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers

from pageloom.llm import lattice as lattice_module
from pageloom.llm.lattice import START, Lattice, lattice_scores, read_pieces
from tests.llm.conftest import odd_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], START, START + "a", "a", "b", "ab", "ba", "aba", START + "ab"]


def small():
    scores = np.log(np.arange(1, len(PIECES) + 1) / 1000.0)
    return Lattice(PIECES, scores)


def brute(lattice, word):
    """Sum over all segmentations, and the expected uses of pieces."""
    text = START + word

    @cache
    def walk(at):
        if at == len(text):
            return [((), 0.0)]
        out = []
        for end in range(at + 1, len(text) + 1):
            piece = lattice.ids.get(text[at:end])
            if piece is not None:
                step = ((piece,), lattice.logp[piece])
            elif end == at + 1:
                used = tuple(int(lattice.byte[b]) for b in text[at].encode())
                step = (used, sum(lattice.logp[list(used)]))
            else:
                continue
            out += [(step[0] + rest, step[1] + p) for rest, p in walk(end)]
        return out

    paths = walk(0)
    total = sum(math.exp(p) for _, p in paths)
    uses = Counter()
    for pieces, p in paths:
        for piece in pieces:
            uses[piece] += math.exp(p) / total
    return math.log(total), uses


def test_forward_recursion_sums_all_segmentations():
    lattice = small()
    words = ["a", "ab", "aba", "abab", "bé", "aéb", "世", "", "bbbb", "ababa", "\U0001f600a"]
    found = lattice.log_probabilities(words)
    assert np.allclose(found, [brute(lattice, w)[0] for w in words])
    assert np.allclose(found, [lattice._walk(w) for w in words])
    weights = np.arange(1.0, len(words) + 1)
    expected = np.zeros(len(lattice.logp))
    for w, n in zip(words, weights):
        for piece, use in brute(lattice, w)[1].items():
            expected[piece] += n * use
    assert np.allclose(lattice.expected_counts(words, weights), expected)


def test_long_words():
    lattice = small()
    word = "ab" * 3000
    assert lattice.log_probabilities([word, "ab"])[1] == lattice.log_probabilities(["ab"])[0]
    assert np.isfinite(lattice.log_probabilities([word])).all()


def test_long_words_count_in_the_fit(monkeypatch):
    lattice = small()
    words = ["a", "abab", "aéb", "", "bbbb", "ababa", "世ab\U0001f600", "abaéabab", "ab" * 40]
    weights = np.arange(1.0, len(words) + 1)
    expected = lattice.expected_counts(words, weights)
    # every segmentation spells the 80 letters and the start
    spelled = sum(n * len(p) for p, n in ((p, lattice.expected_counts(["ab" * 40], np.ones(1))[i]) for p, i in lattice.ids.items()))
    assert abs(spelled - 81) < 1e-6
    monkeypatch.setattr(lattice_module, "LONGEST", 2)
    assert np.allclose(lattice.expected_counts(words, weights), expected)
    monkeypatch.setattr(lattice_module, "LONGEST", 100)
    assert np.allclose(lattice.expected_counts(words, weights), expected)


def test_long_words_are_learned(spark):
    run = "qxjzk" * 30
    docs = spark.createDataFrame([(i, run + " house") for i in range(40)], "doc_id long, text string")
    before = {r["doc_id"]: r["score"] for r in lattice_scores(docs, MODEL, rounds=0).collect()}
    after = {r["doc_id"]: r["score"] for r in lattice_scores(docs, MODEL).collect()}
    assert all(after[i] > 0.7 * before[i] for i in before)


def test_installed_vocabulary_has_no_clashing_hashes():
    lattice = Lattice(*read_pieces(MODEL), ranks=True)
    words = ["the", "house", "thtionre", "naïve"]
    assert np.allclose(lattice.log_probabilities(words), [lattice._walk(w) for w in words])


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def check_base(rows, found):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", lowered(t or ""))) for i, t in rows]
    train = Counter()
    ends = 0
    for i, w in words:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            train.update(w)
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + 1

    def one(c):
        return math.log10((c + 1) / (n + v + 1))

    expected = sorted(
        (i is not None, i or 0, len(w) + 1, sum(train[x] > 0 for x in w) + 1, n, sum(map(one, (train[x] for x in w))) + one(ends))
        for i, w in words
    )
    found = sorted(
        (r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"])
        for r in found
    )
    for a, b in zip(found, expected, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))


def test_scores(odd, documents, texts):
    check_base([(i, t) for i, t, *_ in odd_rows()], lattice_scores(odd, MODEL, most=5).collect())
    none = {r["doc_id"]: r for r in lattice_scores(documents, MODEL, rounds=0).collect()}
    found = lattice_scores(documents, MODEL).collect()
    check_base(texts.items(), found)
    assert all(r["score"] < 0 for r in found)
    held = [r for r in found if r["held_out"]]
    # what is learned from the other rows helps on those held out
    assert sum(r["score"] for r in held) > sum(none[r["doc_id"]]["score"] for r in held)


def test_empty(empty):
    assert lattice_scores(empty, MODEL).count() == 0


def test_given_log_probabilities_are_kept(spark, monkeypatch):
    """Scores are ranks only where that is said, whatever their size."""
    scores = np.log(np.arange(1, len(PIECES) + 1) / 1000.0)
    scores[PIECES.index("aba")] = -1500.0
    lattice = Lattice(PIECES, scores)
    used = sorted(set(lattice.ids.values()) - {PIECES.index("aba")})
    assert np.ptp(lattice.logp[used] - scores[used]) < 1e-12
    ranked = Lattice(PIECES, -np.arange(len(PIECES), dtype=float), ranks=True)
    weights = np.exp(ranked.logp[[PIECES.index(START), PIECES.index(START + "a")]])
    assert abs(weights[0] / weights[1] - (1 + lattice_module.RANK_OFFSET) / lattice_module.RANK_OFFSET) < 1e-9
    # without rounds the given model scores the texts
    monkeypatch.setattr(lattice_module, "read_pieces", lambda path: (PIECES, scores))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["ab ba", "aab", ""])], "doc_id long, text string")
    for r in lattice_scores(docs, "", rounds=0, ranks=False).collect():
        text = ["ab ba", "aab", ""][r["doc_id"]]
        expected = (sum(lattice.log_probabilities(text.split())) if text else 0.0) + lattice.logp[-1]
        assert abs(r["score"] - expected / math.log(10)) < 1e-9
