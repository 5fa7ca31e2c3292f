"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic
function of its words' features, or 0 if it has none of them, so a text is not
suspect for its length. The document's probability is their noisy-or,
1 - prod(1 - p). Only document labels are known; the weights maximise the
likelihood of those labels, so sentences are never labelled. Afterwards the
sentence probabilities say where the offence is.

Features of a word are the word itself (lower case) and its character 4- and
5-grams with the word's borders, so inflected and joined forms share evidence.
The fit uses a sample of about ``sample`` labelled rows, chosen by hash of the
id, with every row of a chosen id; the features are the ``most`` that toxic documents have
most above clean ones. Rows and texts stay with the executors, however many a
chosen id has. Scoring covers every whole text.

Nulls: a null text is empty; a document without words or features has the score
0. Rows with a null label, or with an id that is not unique in ``labels``
with different labels, are not learned from. Repeated rows give repeated rows.
Without labels of both kinds there are no features and every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pageloom.llm.common import narrow, packed, remainder
from pageloom.scratch import materialize

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\w+")
_CACHE = 200_000  # words whose weight a task remembers
_SLICE = 20_000  # sentences that a step of the fit looks at together
_TEXT = 200_000  # characters of a text whose features are counted together
_UNIT = 2.0**-32  # of slopes; sums below 2 ** 21 of them are exact
_LOCAL = 8 << 20  # bytes of bags that are fitted in one process, or looked at together
_PART = 16 << 20  # bytes of bags a partition
LONGEST_WORD = 40  # features of longer words are not remembered or listed


def word_features(word: str) -> Iterable[str]:
    edged = f"<{word}>"
    grams = (edged[i : i + n] for n in (4, 5) for i in range(len(edged) - n + 1))
    features = chain((f"={word}",), grams)
    return features if len(word) > LONGEST_WORD else list(features)


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and lower-case words of each sentence that has words."""
    for found in _SENTENCE.finditer(text):
        words = set(_WORD.findall(found[0].lower()))
        if words:
            yield found.start(), found.end(), words


class _Found(dict):
    """Features of a word that have a weight; the first _CACHE words are remembered."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self._names = frozenset(weights)

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = tuple(self._names.intersection(word_features(word)))
        if len(self) < _CACHE and len(word) <= LONGEST_WORD:
            self[word] = found
        return found


class NoisyOr:
    """Weights of features and the bias; bounded by the number of features."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._found = _Found(weights)

    def __reduce__(self):
        return NoisyOr, (self.weights, self.bias)

    def score(self, text: str, locate: float) -> tuple[float, list[tuple[int, int]]]:
        """Probability of the text and the spans of sentences of at least ``locate``."""
        clean, spans = 0.0, []
        features = self._found.__getitem__
        for sentence in _SENTENCE.finditer(text):
            words = _WORD.findall(sentence[0].lower())
            found = set().union(*filter(None, map(features, words)))
            if not found:
                continue
            z = self.bias + sum([self.weights[f] for f in sorted(found)])
            clean += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
            if 1 / (1 + math.exp(-max(-500.0, z))) >= locate:
                spans.append(sentence.span())
        return -math.expm1(-clean), spans


def gradient(
    value: np.ndarray,
    label: np.ndarray,
    times: np.ndarray,
    owner: np.ndarray,
    size: np.ndarray,
    column: np.ndarray,
) -> np.ndarray:
    """Summed slopes of the loss in the weights and the bias (the last of ``value``).

    ``label`` and ``times`` (how often it occurs) are those of each bag,
    ``owner`` names the bag of each sentence that has features and ``size`` how
    many of ``column``, the features in order of sentences, are its own.
    Sentences are gone through in slices, so what is held besides the features
    stays small.

    The loss of a clean document is A = sum of softplus(z) over its sentences,
    that of a toxic one -log(1 - exp(-A)); its slope in z is sigmoid(z) times 1
    or -1 / (exp(A) - 1). Slopes are rounded to a unit of which sums are exact,
    so they do not depend on the order of bags or on how bags are dealt out.
    """
    weights, bias = value[:-1], value[-1]
    place = np.append(0, np.cumsum(size, dtype=np.int64))
    slices = [slice(i, min(i + _SLICE, len(owner))) for i in range(0, len(owner), _SLICE)]
    z = np.zeros(len(owner))
    for part in slices:
        at = place[part]
        own = column[at[0] : place[part.stop]]
        z[part] = bias + np.add.reduceat(weights[own], at - at[0])
    total = np.bincount(owner, np.logaddexp(0, z), minlength=len(label))
    slope = np.where(label, -1 / np.expm1(np.clip(total, 1e-12, 500)), 1.0)
    each = slope[owner] / (1 + np.exp(-np.clip(z, -500, 500)))
    each = np.rint(each / _UNIT) * _UNIT * times[owner]
    grad = np.append(np.zeros(len(weights)), each.sum())
    for part in slices:
        own = column[place[part.start] : place[part.stop]]
        grad[:-1] += np.bincount(own, np.repeat(each[part], size[part]), minlength=len(weights))
    return grad


def descend(
    slopes: Callable[[np.ndarray], np.ndarray],
    bags: int,
    features: int,
    steps: int = 400,
    rate: float = 0.1,
    ridge: float = 1e-3,
) -> tuple[np.ndarray, float]:
    """Weights and bias where the loss is least; ``slopes`` sums its gradient over all bags."""
    value = np.append(np.zeros(features), -4.0)
    first, second = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, steps + 1):
        grad = slopes(value) / bags
        grad[:-1] += ridge * value[:-1] / max(1, bags) ** 0.5
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        value = value - rate * (first / (1 - 0.9**step)) / (
            np.sqrt(second / (1 - 0.999**step)) + 1e-8
        )
    return value[:-1], float(value[-1])


def fit_weights(
    label: np.ndarray,
    owner: np.ndarray,
    size: np.ndarray,
    column: np.ndarray,
    features: int,
    steps: int = 400,
    rate: float = 0.1,
    ridge: float = 1e-3,
    times: np.ndarray | None = None,
) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled bags that are held here, as ``gradient`` takes them."""
    label = label.astype(bool)
    times = np.ones(len(label), dtype=np.int64) if times is None else times
    return descend(
        lambda value: gradient(value, label, times, owner, size, column),
        int(times.sum()), features, steps, rate, ridge,
    )


def _flat(rows: list[Row]) -> tuple[np.ndarray, ...]:
    """label, times, owner, size and column of rows of bags."""
    label = np.array([r["_y"] for r in rows], dtype=bool)
    times = np.array([r["times"] for r in rows], dtype=np.int64)
    sizes = [np.frombuffer(r["sizes"], dtype=np.uint16) for r in rows]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(s) for s in sizes])
    column = [np.frombuffer(r["columns"], dtype=np.uint16) for r in rows]
    return label, times, owner, np.concatenate(sizes), np.concatenate(column)


def fit_bags(bags: DataFrame, features: int) -> tuple[np.ndarray, float]:
    """Weights and bias from written bags: _y, sizes, columns, times.

    Bags of at most _LOCAL bytes are fitted in the driver. Larger ones stay with
    the executors: each step sums the gradient there, and only one number for
    each feature comes back. Both give the same weights.
    """
    volume = F.sum(F.octet_length("sizes").cast("long") + F.octet_length("columns"))
    count, bytes_ = bags.agg(F.sum("times"), volume).first()
    if bytes_ <= _LOCAL:
        label, times, owner, size, column = _flat(bags.collect())
        return fit_weights(label, owner, size, column, features, times=times)

    def chunks(rows: Iterator[Row]) -> Iterator[tuple[np.ndarray, ...]]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row["columns"])
            if size > _LOCAL:
                yield _flat(held)
                held, size = [], 0
        if held:
            yield _flat(held)

    parts = max(bags.sparkSession.sparkContext.defaultParallelism, bytes_ // _PART)
    dealt = bags.rdd.coalesce(parts).mapPartitions(chunks).persist(StorageLevel.MEMORY_AND_DISK)

    def slopes(value: np.ndarray) -> np.ndarray:
        def add(held: Iterator[tuple[np.ndarray, ...]]) -> Iterator[np.ndarray]:
            yield sum((gradient(value, *chunk) for chunk in held), np.zeros(len(value)))

        return dealt.mapPartitions(add).treeReduce(np.add, 1 if parts <= 64 else 2)

    try:
        return descend(slopes, count, features)
    finally:
        dealt.unpersist()


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    modulus: int = 5,
    held: int | None = 0,
    sample: int = 20_000,
    most: int = 4000,  # below 2 ** 16
    least: int = 4,
) -> NoisyOr:
    """Fit on about ``sample`` labelled rows, leaving out crc32(id) mod ``modulus`` == ``held``."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if held is not None:
        known = known.filter(remainder("doc_id", modulus) != held)
    known = (
        known.groupBy("doc_id")
        .agg(F.min(label).alias("_y"), F.max(label).alias("_same"))
        .filter("_y = _same")
    )
    count = known.count()
    share = min(1.0, sample / max(1, count))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))
    # about `sample` rows of two numbers
    picked = F.broadcast(known.filter(chosen).select("doc_id", (F.col("_y") > 0).alias("_y")))
    rows = materialize(narrow(docs, "doc_id", "text").join(picked, "doc_id"), "sample")

    def count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pd.DataFrame:
            names = list(counts[0].keys() | counts[1].keys())
            # plain objects: Arrow-backed strings may come in chunks, which cannot be passed on
            frame = {"feature": pd.Series(names, dtype=object), "clean": [counts[0][n] for n in names]}
            frame["toxic"] = [counts[1][n] for n in names]
            for c in counts:
                c.clear()
            return pd.DataFrame(frame)

        for batch in batches:
            for text, y in zip(batch["text"], batch["_y"]):
                words = set(_WORD.findall(text.lower()))
                # long texts take their features by parts, each feature in one of them
                parts = 1 + len(text) // _TEXT
                for k in range(parts):
                    counts[bool(y)].update(
                        {f for w in words for f in word_features(w) if parts == 1 or hash(f) % parts == k}
                    )
                    if len(counts[0]) + len(counts[1]) > 500_000:
                        yield flush()
        yield flush()

    sizes = {bool(r["_y"]): r["count"] for r in rows.groupBy("_y").count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return NoisyOr({}, 0.0)
    seen = (
        rows.select("text", "_y")
        .mapInPandas(count_features, "feature string, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("clean") + F.col("toxic") >= least)
    )
    # two-proportion z statistic
    both = (F.col("toxic") + F.col("clean")) / F.lit(toxic + clean)
    spread = F.sqrt(both * (1 - both) * F.lit(1 / toxic + 1 / clean)) + 1e-9
    z = (F.col("toxic") / toxic - F.col("clean") / clean) / spread
    top = seen.withColumn("z", F.round(z, 6)).filter("z > 4")
    names = [r["feature"] for r in top.orderBy(F.desc("z"), "feature").limit(most).collect()]
    index = {name: i for i, name in enumerate(names)}

    def bag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, columns = [], []
            for text in batch["text"]:
                found = [
                    sorted({index[f] for w in words for f in word_features(w) if f in index})
                    for _, _, words in sentences(text)
                ]
                held_ = [f for f in found if f]
                sizes.append(np.array([len(f) for f in held_], dtype=np.uint16).tobytes())
                columns.append(np.array([i for f in held_ for i in f], dtype=np.uint16).tobytes())
            yield pd.DataFrame({"_y": batch["_y"], "sizes": sizes, "columns": columns})

    # two bytes for each sentence and for each feature that is present; equal bags are one
    bags = rows.select("text", "_y").mapInPandas(bag, "_y boolean, sizes binary, columns binary")
    bags = bags.groupBy("_y", "sizes", "columns").agg(F.count("*").alias("times"))
    weights, bias = fit_bags(materialize(bags, "bags"), len(names))
    return NoisyOr(dict(zip(names, map(float, weights))), bias)


def score(docs: DataFrame, model: NoisyOr, locate: float = 0.5) -> DataFrame:
    """``_doc`` (the whole row), ``_score`` and ``_spans`` of each row of ``docs``.

    Spans are [start, end] in code points of the sentences that offend.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, spans array<array<int>>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.score(t or "", locate) for t in texts]
        spans = [[list(s) for s in f[1]] for f in found]
        return pd.DataFrame({"score": [f[0] for f in found], "spans": spans})

    return packed(docs, judged(F.col("text")).alias("_judged")).select(
        "_doc", F.col("_judged.score").alias("_score"), F.col("_judged.spans").alias("_spans")
    )


def toxicity(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, **fit
) -> DataFrame:
    """doc_id, held_out, score, predicted (score at least 0.5), spans of offending sentences."""
    model = train(docs, labels, modulus=modulus, held=held, **fit)
    return score(narrow(docs, "doc_id", "text"), model).select(
        "_doc.doc_id",
        (remainder("_doc.doc_id", modulus) == held).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        F.col("_spans").alias("spans"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """Rows of ``docs`` whose score is below 0.5, learned from all labels."""
    model = train(docs, labels, held=None, **fit)
    return score(docs, model).filter("_score < 0.5").select("_doc.*")
