"""Language-model scores from a subword lattice.

A document is a sequence of words and an end. A word is spelled by pieces of an
existing vocabulary, and its probability is the sum over all segmentations of
the product of piece probabilities: a forward recursion in log space over the
lattice of its pieces. Pieces do not cross words, so each distinct word of the
corpus is scored once and a document adds up its words.

The vocabulary's scores give the first weights. Where they are ranks (BPE
files), rank r weighs 1 / (r + RANK_OFFSET). They are then fitted to the
training rows by expectation maximisation over every distinct word of them,
weighted by count. Characters outside the vocabulary are spelled by bytes.

Nulls: a null text is empty, so it is its end alone; a null id counts as ''.
Repeated rows give repeated rows and count as often in training. An empty
table gives no rows; without training rows the first weights stay.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import narrow, remainder
from pageloom.llm.vocabulary import FREQUENT, distinct_tokens, document_sums
from pageloom.scratch import materialize

RANK_OFFSET = 100.0
START = "▁"  # marks the start of a word in the vocabulary
LONGEST = 64  # words above it are walked one by one instead of in batches
_BATCH = 4096
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20  # bits of the hash table


def read_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece model and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [model.id_to_piece(i) for i in range(n)], np.array([model.get_score(i) for i in range(n)])


def _mix(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return codes ^ (codes >> np.uint64(32))


class Lattice:
    """Word probabilities under piece log-probabilities; picklable, bounded by the vocabulary."""

    def __init__(self, pieces: list[str], scores: np.ndarray, ranks: bool = False):
        self.byte = np.full(256, -1)
        self.ids: dict[str, int] = {}
        for i, piece in enumerate(pieces):
            if len(piece) == 6 and piece.startswith("<0x"):
                self.byte[int(piece[3:5], 16)] = i
            elif piece and not (piece[0] == "<" and piece[-1] == ">") and START not in piece[1:]:
                self.ids[piece] = i
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks byte pieces")
        used = np.array(sorted(self.ids.values()))
        weights = np.zeros(len(pieces) + 1)  # the last is the end of a document
        if ranks:  # the order of pieces, not their log-probabilities
            rank = np.argsort(np.argsort(-scores[used], kind="stable"), kind="stable")
            weights[used] = 1 / (rank + RANK_OFFSET)
        else:
            weights[used] = np.exp(scores[used])
        weights[self.byte] = weights[used].min() if len(used) else 1.0
        weights[-1] = weights.sum() / 500
        self.live = weights > 0
        self.set_weights(weights)
        self.longest = max(map(len, self.ids), default=1)
        hashes = np.array([self._hash(p) for p in self.ids], dtype=np.uint64)
        self._order = np.argsort(hashes)
        self._hashes = hashes[self._order]
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        self._piece_of = np.array(list(self.ids.values()), dtype=np.int64)[self._order]
        # open addressing: slot of a hash holds a place in the sorted hashes, or -1
        self._table = np.full(1 << _SLOTS, -1, dtype=np.int32)
        for place, h in enumerate(self._hashes):
            slot = int(h) >> (64 - _SLOTS)
            while self._table[slot] >= 0:
                slot = (slot + 1) & ((1 << _SLOTS) - 1)
            self._table[slot] = place
        runs, run = 0, 0
        for full in (self._table >= 0).tolist():
            run = run + 1 if full else 0
            runs = max(runs, run)
        self._probes = runs

    def set_weights(self, weights: np.ndarray) -> None:
        with np.errstate(divide="ignore"):
            self.logp = np.log(weights / weights.sum())

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_PRIME) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return int(_mix(np.array([h], dtype=np.uint64))[0])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 where there is none."""
        found = np.full(len(hashes), -1, dtype=np.int64)
        slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        todo = np.arange(len(hashes))
        for _ in range(self._probes + 1):
            place = self._table[slot[todo]]
            todo, place = todo[place >= 0], place[place >= 0]
            if not len(todo):
                break
            same = self._hashes[place] == hashes[todo]
            found[todo[same]] = self._piece_of[place[same]]
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & ((1 << _SLOTS) - 1)
        return found

    def _edges(self, codes: np.ndarray):
        """Edges (end, width, rows, ids or -1 for bytes, log weight) of equally long words."""
        n, length = codes.shape
        for end in range(1, length + 1):
            h = np.zeros(n, dtype=np.uint64)
            # hash from left to right needs each start anew; extend leftwards by powers instead
            power = np.uint64(1)
            for width in range(1, min(end, self.longest) + 1):
                h = h + (codes[:, end - width] + np.uint64(1)) * power
                power = power * _PRIME
                ids = self._find(_mix(h))
                rows = np.flatnonzero(ids >= 0)
                if len(rows):
                    yield end, width, rows, ids[rows], self.logp[ids[rows]]
                if width == 1:
                    rest = np.flatnonzero(ids < 0)
                    if len(rest):
                        yield end, 1, rest, None, self._spelled(codes[rest, end - 1])

    def _spelled(self, chars: np.ndarray) -> np.ndarray:
        values, back = np.unique(chars, return_inverse=True)
        cost = [self.logp[self.byte[list(chr(int(c)).encode())]].sum() for c in values]
        return np.array(cost)[back]

    def _batch(self, codes: np.ndarray, weights: np.ndarray | None, expected: np.ndarray | None):
        n, length = codes.shape
        forward = np.full((length + 1, n), -np.inf)
        forward[0] = 0
        edges = []
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            for edge in self._edges(codes):
                end, width, rows, _, logp = edge
                forward[end, rows] = np.logaddexp(forward[end, rows], forward[end - width, rows] + logp)
                if expected is not None:
                    edges.append(edge)
            total = forward[length]
            if expected is None:
                return total
            backward = np.full((length + 1, n), -np.inf)
            backward[length] = 0
            for end, width, rows, ids, logp in reversed(edges):
                start = end - width
                through = backward[end, rows] + logp
                backward[start, rows] = np.logaddexp(backward[start, rows], through)
                share = weights[rows] * np.exp(forward[start, rows] + through - total[rows])
                if ids is not None:
                    np.add.at(expected, ids, share)
                else:
                    for c, s in zip(codes[rows, end - 1], share):
                        for b in chr(int(c)).encode():
                            expected[self.byte[b]] += s
        return total

    def _words(self, words: list[str]):
        """Indices and code matrices of words of one length, in batches."""
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, members in by_length.items():
            step = _BATCH if length <= LONGEST else 1
            for k in range(0, len(members), step):
                part = members[k : k + step]
                text = "".join(START + words[i] for i in part).encode("utf-32-le")
                codes = np.frombuffer(text, dtype=np.uint32).reshape(len(part), length + 1)
                yield part, codes.astype(np.uint64)

    def _steps(self, text: str, end: int):
        """Edges (start, piece ids, log weight) of the lattice that end at a place of a word."""
        for width in range(1, min(end, self.longest) + 1):
            piece = self.ids.get(text[end - width : end])
            if piece is not None:
                yield end - width, [piece], float(self.logp[piece])
            elif width == 1:
                bytes_ = self.byte[list(text[end - 1].encode())]
                yield end - 1, bytes_, float(self.logp[bytes_].sum())

    def _walk(self, word: str, weight: float = 1.0, expected: np.ndarray | None = None) -> float:
        """Forward recursion of one long word; adds its weighted uses of pieces to ``expected``.

        The backward pass keeps the last ``longest`` places alone.
        """
        text = START + word
        forward = array("d", [0.0])
        for end in range(1, len(text) + 1):
            terms = [forward[start] + logp for start, _, logp in self._steps(text, end)]
            top = max(terms)
            forward.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        total = forward[-1]
        if expected is None:
            return total
        # terms of the places that edges seen so far start from
        behind: dict[int, list[float]] = {len(text): [0.0]}
        for end in range(len(text), 0, -1):
            terms = behind.pop(end, None)
            if terms is None:  # no way from here to the end
                continue
            top = max(terms)
            backward = top + math.log(sum(math.exp(t - top) for t in terms))
            for start, pieces, logp in self._steps(text, end):
                through = backward + logp
                behind.setdefault(start, []).append(through)
                share = weight * math.exp(forward[start] + through - total)
                for piece in pieces:
                    expected[piece] += share
        return total

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for part, codes in self._words(words):
            if codes.shape[1] > LONGEST + 1:
                out[part] = [self._walk(words[i]) for i in part]
            else:
                out[part] = self._batch(codes, None, None)
        return out

    def expected_counts(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over the segmentations of weighted words."""
        expected = np.zeros(len(self.logp))
        for part, codes in self._words(words):
            if codes.shape[1] > LONGEST + 1:
                for i in part:
                    self._walk(words[i], float(weights[i]), expected)
            else:
                self._batch(codes, weights[part], expected)
        return expected


def fit(table: DataFrame, lattice: Lattice, ends: int, rounds: int, smoothing: float) -> Lattice:
    """Expectation maximisation; a round is one pass over the distinct training words.

    Each task returns one sum for each piece.
    """
    spark = table.sparkSession
    train = table.filter("n_train > 0").select("token", "n_train")
    for _ in range(rounds if ends else 0):
        shared = spark.sparkContext.broadcast(lattice)

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            model, total = shared.value, 0
            for batch in batches:
                words = [bytes(t).decode() for t in batch["token"]]
                total = total + model.expected_counts(words, batch["n_train"].to_numpy(float))
            if not isinstance(total, int):
                used = np.flatnonzero(total)
                yield pd.DataFrame({"piece": used, "uses": total[used]})

        sums = train.mapInPandas(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses"))
        weights = np.zeros(len(lattice.logp))
        for piece, uses in sums.collect():  # a row for each piece
            weights[piece] = uses
        weights[-1] = ends
        lattice.set_weights(np.where(lattice.live, weights + smoothing, 0))
    return lattice


def lattice_scores(
    docs: DataFrame,
    vocabulary: str,
    modulus: int = 7,
    held: int = 2,
    rounds: int = 2,
    smoothing: float = 0.1,
    most: int = FREQUENT,
    ranks: bool = True,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows with crc32(id) mod ``modulus`` equal to ``held`` are not learned from.
    ``base_score`` is the add-one word unigram, ``score`` the lattice's log10
    probability. ``vocabulary`` is a sentencepiece model with byte pieces, whose
    scores are ``ranks`` (a BPE model) or log-probabilities (a unigram model, to
    be taken with ``rounds=0`` where it should not be fitted again). Sums of
    doubles over shuffles may differ in the last digits between runs.
    """
    texts = narrow(docs, "doc_id", "text").withColumn("held_out", remainder("doc_id", modulus) == held)
    table = materialize(
        distinct_tokens(texts.select("text", (~F.col("held_out")).alias("_train")), lower=True),
        "words",
    )
    ends = texts.filter(~F.col("held_out")).count()
    stats = table.agg(F.sum("n_train"), F.count(F.when(F.col("n_train") > 0, 1))).first()
    tokens = (stats[0] or 0) + ends
    distinct = stats[1] + (1 if ends else 0)
    bottom = math.log10(tokens + distinct + 1)

    lattice = fit(table, Lattice(*read_pieces(vocabulary), ranks), ends, rounds, smoothing)
    shared = docs.sparkSession.sparkContext.broadcast(lattice)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out = batch[["key", "n_all"]].copy()
            words = [bytes(t).decode() for t in batch["token"]]
            out["known"] = (batch["n_train"] > 0).astype(float)
            out["base"] = np.log10(batch["n_train"] + 1.0) - bottom
            out["lattice"] = model.log_probabilities(words) / math.log(10)
            yield out

    valued = materialize(
        table.mapInPandas(
            score, "key binary, n_all long, known double, base double, lattice double"
        ),
        "valued",
    )
    sums = document_sums(
        texts.select("doc_id", "held_out", "text"), valued, ["known", "base", "lattice"], True, most
    )
    end_base = math.log10(ends + 1) - bottom
    end_score = float(lattice.logp[-1]) / math.log(10)
    return sums.select(
        "doc_id",
        "held_out",
        (F.col("_tokens") + 1).alias("n_tokens"),
        (F.col("known").cast("long") + (1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + end_base).alias("base_score"),
        (F.col("lattice") + end_score).alias("score"),
    )
