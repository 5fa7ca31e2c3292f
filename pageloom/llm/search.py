"""Ranked lexical search: the best documents of each item by weighted terms.

Terms are runs of characters other than ASCII punctuation, symbols, white space
and controls; A-Z are lowered. With N documents that hold a term, L terms in
all, n terms in a document, df documents with a term and tf its occurrences in
a document, in 64-bit integers with division rounding down:

    w = floor(1000 ln((2 N + 2) / (2 df + 1)))
    m = 25 + 75 n N div L
    score = sum over the item's terms, repeats included, of w (10^9 tf div (1000 tf + 8 m))

Documents are read once for each block of items: what they hold of the block's
terms is written, and N, L and df are counted on the way. The search then takes
the written rows in blocks of documents. In a block each term has a bitmap of
the documents that hold it; an item's bitmaps, laid side by side, give each
document the mask of the item's terms that it holds, and documents of equal
mask form a group. A group's highest possible score is the sum of the block's
highest contributions of the mask's terms. Groups are scored from the highest
such bound down until the bound is below the lowest score that still counts, so
most documents are never scored. That score is carried from block to block.
A task passes on no more than the asked number of rows for each item.

Nulls: a null text, and one without terms, matches nothing and does not count in
N. A null doc_id ranks after the others of equal score. An item without terms
has no rows. Repeated documents are ranked each by itself; repeated items give
repeated rows. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import narrow
from pageloom.scratch import materialize

BLOCK = 2_000_000  # characters of items whose terms are sought at once
ROWS = 8192  # documents of a search block
POSTINGS = 4_000_000  # or so many terms of them
CELLS = 4_000_000  # bits of masks that are laid out at once
_NO_ID = np.iinfo(np.int64).max  # sorts after every id

_SEPARATES = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(
    0x20 if b in set(_SEPARATES) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)


def _words(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8; bytes outside ASCII never separate."""
    return text.translate(_TABLE).split()


class Items:
    """A block of items: their terms as numbers, with how often each item has them."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        self.ids = ids
        self.number: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        for text in texts:
            counted = Counter(_words(text.encode()))
            numbers = [self.number.setdefault(t, len(self.number)) for t in counted]
            self.terms.append(np.array(numbers, dtype=np.int64))
            self.times.append(np.array(list(counted.values()), dtype=np.int64))


def item_blocks(items: DataFrame, most: int) -> Iterator[Items]:
    """The items, brought in one by one, in blocks of at most ``most`` characters (or one item)."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for row in narrow(items, "item_id", "text").filter("text <> ''").toLocalIterator():
        if texts and size + len(row["text"]) > most:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
    if texts:
        yield Items(ids, texts)


def _postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """What each document holds of the numbered terms, and counts.

    Rows with ``terms``: doc_id, n, terms and times (32-bit numbers). Rows
    without: per task the documents (``df``) of each term, and under term -1
    and -2 the documents and the terms of all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = shared.value
        get = number.get
        df = np.zeros(len(number), dtype=np.int64)
        documents = total = 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                words = _words(text)
                if not words:
                    continue
                documents += 1
                total += len(words)
                known = np.array([i for i in map(get, words) if i is not None], dtype=np.int32)
                if not len(known):
                    continue
                held, times = np.unique(known, return_counts=True)
                df[held] += 1
                rows.append((doc, len(words), held.astype("<i4").tobytes(), times.astype("<i4").tobytes()))
            if rows:
                frame = pd.DataFrame(rows, columns=["doc_id", "n", "terms", "times"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame.assign(term=pd.NA, df=pd.NA).astype({"term": "Int64", "df": "Int64"})
        used = np.flatnonzero(df)
        counts = pd.DataFrame({"term": [-1, -2, *used], "df": [documents, total, *df[used]]})
        counts = counts.assign(doc_id=pd.NA, n=pd.NA, terms=None, times=None)
        yield counts[["doc_id", "n", "terms", "times", "term", "df"]].astype({"doc_id": "Int64", "n": "Int64"})

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, n long, terms binary, times binary, term long, df long"
    return materialize(texts.mapInPandas(run, schema), "postings")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array(
        [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64
    )


class Best:
    """The highest ``k`` rows so far: by score, then by id."""

    def __init__(self, k: int):
        self.k = k
        self.scores = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int64)

    @property
    def least(self) -> int:
        """A row below this score cannot count any more; rows without a positive score never do."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        kept = scores >= self.least
        scores = np.concatenate([self.scores, scores[kept]])
        ids = np.concatenate([self.ids, ids[kept]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Documents:
    """A block of documents: for each term its documents' bitmap, places and contributions."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, held: list, times: list, w: np.ndarray, documents: int, total: int):
        self.ids = ids
        doc = np.repeat(np.arange(len(ids)), [len(h) for h in held])
        term = np.concatenate(held).astype(np.int64)
        tf = np.concatenate(times).astype(np.int64)
        m = np.array([25 + 75 * int(x) * documents // total for x in n], dtype=np.int64)
        gain = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((doc, term))
        doc, term, gain = doc[order], term[order], gain[order]
        self.present, first = np.unique(term, return_index=True)
        bounds = np.append(first, len(term))
        self.place = {int(t): i for i, t in enumerate(self.present)}
        self.docs = [doc[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        self.gains = [gain[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        self.highest = np.maximum.reduceat(gain, first)
        self.bitmaps = np.zeros((len(self.present), (len(ids) + 7) // 8), dtype=np.uint8)
        for bitmap, where in zip(self.bitmaps, self.docs):
            bits = np.zeros(len(ids), dtype=bool)
            bits[where] = True
            bitmap[:] = np.packbits(bits)

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Bring ``best`` up to date with this block's documents."""
        found = [(self.place[int(t)], int(q)) for t, q in zip(terms, times) if int(t) in self.place]
        if not found:
            return
        places = np.array([p for p, _ in found])
        often = np.array([q for _, q in found], dtype=np.int64)
        bound = self.highest[places] * often
        # items of very many terms meet fewer documents at once
        step = max(8, CELLS // len(places) // 8 * 8)
        for start in range(0, len(self.ids), step):
            self._search_part(start, min(step, len(self.ids) - start), places, often, bound, best)

    def _search_part(self, start: int, n: int, places: np.ndarray, often: np.ndarray, bound: np.ndarray, best: Best) -> None:
        # bitmaps side by side, turned: a row of bits, the mask, for each document
        bitmaps = self.bitmaps[places, start // 8 : (start + n + 7) // 8]
        bits = np.unpackbits(bitmaps, axis=1, count=n).T
        some = np.flatnonzero(bits.any(axis=1))
        if not len(some):
            return
        masks = np.packbits(bits[some], axis=1)
        wide = np.zeros((len(some), -(-masks.shape[1] // 8) * 8), dtype=np.uint8)
        wide[:, : masks.shape[1]] = masks
        key = wide.view(np.uint64 if wide.shape[1] == 8 else f"V{wide.shape[1]}")[:, 0]
        _, one, group = np.unique(key, return_index=True, return_inverse=True)
        highest = bits[some[one]].astype(np.int64) @ bound
        order = np.argsort(-highest, kind="stable")
        members = start + some[np.argsort(group, kind="stable")]
        ends = np.cumsum(np.bincount(group, minlength=len(one)))
        starts = np.append(0, ends[:-1])
        at, width = 0, 16
        while at < len(order) and highest[order[at]] >= best.least:
            chosen = order[at : at + width]
            chosen = chosen[highest[chosen] >= best.least]
            rows = np.sort(np.concatenate([members[starts[g] : ends[g]] for g in chosen]))
            best.add(self._scores(rows, places, often), self.ids[rows])
            at += width
            width *= 2

    def _scores(self, rows: np.ndarray, places: np.ndarray, often: np.ndarray) -> np.ndarray:
        scores = np.zeros(len(rows), dtype=np.int64)
        for place, q in zip(places, often):
            docs, gains = self.docs[place], self.gains[place]
            where = np.minimum(np.searchsorted(docs, rows), len(docs) - 1)
            scores += np.where(docs[where] == rows, gains[where] * q, 0)
        return scores


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents with a score above 0.

    Equal scores are ranked by ascending doc_id. ``block`` bounds the characters
    of items for which documents are read once, ``rows`` the documents that are
    grouped together; neither changes the result.
    """
    spark = docs.sparkSession
    texts = narrow(docs, "doc_id", "text")
    result = None
    for index in item_blocks(items, block):
        written = _postings(texts, index.number)
        counted = dict(
            written.filter("terms is null").groupBy("term").agg(F.sum("df").alias("df")).collect()
        )  # a row for each term of the block
        documents, total = counted.get(-1, 0), counted.get(-2, 0)
        if not documents:
            continue
        w = weights(np.array([counted.get(i, 0) for i in range(len(index.number))]), documents)
        shared = spark.sparkContext.broadcast((index.terms, index.times, w))

        def best_of(batches: Iterator[pd.DataFrame], shared=shared, documents=documents, total=total) -> Iterator[pd.DataFrame]:
            terms, times, w = shared.value
            best = [Best(k) for _ in terms]

            def look(held: list[tuple]) -> None:
                ids, n, have, tf = zip(*held)
                part = Documents(np.array(ids), np.array(n), have, tf, w, documents, total)
                for item, (t, q) in enumerate(zip(terms, times)):
                    part.search(t, q, best[item])

            held: list[tuple] = []
            size = 0
            for batch in batches:
                ids = batch["doc_id"].astype("Int64").fillna(_NO_ID)
                for doc, n, have, tf in zip(ids, batch["n"], batch["terms"], batch["times"]):
                    held.append((doc, n, np.frombuffer(have, "<i4"), np.frombuffer(tf, "<i4")))
                    size += len(have) // 4
                    if len(held) >= rows or size >= POSTINGS:
                        look(held)
                        held, size = [], 0
            if held:
                look(held)
            found = [(item, i, s) for item, b in enumerate(best) for i, s in zip(b.ids, b.scores)]
            frame = pd.DataFrame(found, columns=["item", "doc_id", "score"], dtype=np.int64)
            yield frame

        near = written.filter("terms is not null").select("doc_id", "n", "terms", "times")
        found = near.mapInPandas(best_of, "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(index.ids)), "item long, item_id long")
        part = materialize(
            ranked.join(F.broadcast(names), "item").select(
                "item_id", "rank", F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "score"
            ),
            "ranked",
        )
        shared.unpersist()
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return result
