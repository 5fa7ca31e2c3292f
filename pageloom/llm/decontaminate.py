"""Benchmark passages in documents, found by the q-gram lemma.

An occurrence of an item of m characters with at most k edits shares at least
m + 1 - q (k + 1) q-grams with the item, and all of them lie on 2 k + 1
neighbouring diagonals (place in the text minus place in the item) around its
start. Shared q-grams are counted in diagonal bands that overlap so that each
such group of diagonals lies within one band, and within a stretch of the text
no longer than the occurrence. A region that reaches the bound is verified by
banded alignment: edit distance of the whole item to the best substring.

Letters are compared in ASCII lower case and white space as a blank; nothing
else is changed, so spans are places in the text as it stands. The edit budget
is ``rate`` of the item's length, lowered where needed for the bound to stay
above zero; items shorter than q characters are looked for as they are.

The benchmark is a query set. It is read in blocks of at most ``block``
characters; each block is broadcast and meets all documents.

Nulls: null texts are empty, in documents and items; empty items are found
nowhere. Equal items are found each under its own id, repeated rows give
repeated rows. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import document_key, narrow, packed
from pageloom.scratch import materialize

Q = 8
RATE = 0.1
BLOCK = 4_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20
_STRETCH = 1 << 16  # of a text that is looked at in one go


def normalised(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).copy()
    codes[(codes >= 65) & (codes <= 90)] += 32
    codes[(codes >= 9) & (codes <= 13)] = 32
    return codes


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    if len(codes) < q:
        return np.empty(0, dtype=np.uint64)
    # a gram's hash from those of its parts, which double in length
    part, length = codes.astype(np.uint64) + np.uint64(1), 1
    h, done, n = np.zeros(len(codes) - q + 1, dtype=np.uint64), 0, len(codes) - q + 1
    while True:
        if q & length:
            h = h * np.uint64(pow(int(_PRIME), length, 1 << 64)) + part[done : done + n]
            done += length
        if done == q:
            break
        factor = np.uint64(pow(int(_PRIME), length, 1 << 64))
        part = part[:-length] * factor + part[length:]
        length *= 2
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def least_edits(item: np.ndarray, text: np.ndarray) -> int:
    """Least edits of ``item`` against any substring of ``text``.

    One column of the alignment at a time, its steps of +1 and -1 held as the
    bits of two whole numbers (Myers 1999).
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    rows: dict[int, int] = {}
    for i, letter in enumerate(item.tolist()):
        rows[letter] = rows.get(letter, 0) | 1 << i
    up, down, score = full, 0, m
    best = score
    for letter in text.tolist():
        match = rows.get(letter, 0)
        zero = (((match & up) + up) ^ up) | match | down
        right_up = down | ~(zero | up) & full
        right_down = up & zero
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
            best = min(best, score)
        right_up = right_up << 1 & full
        right_down = right_down << 1 & full
        up = right_down | ~(zero | right_up) & full
        down = right_up & zero
    return best


def aligned(item: np.ndarray, text: np.ndarray, first: int, last: int, k: int):
    """Start, end and edits of the best match of all of ``item`` in ``text``.

    Starts ``first`` to ``last`` and k diagonals to either side are allowed for.
    None if it takes more than k edits. Among equal edits the first end counts,
    with the latest start. A match without edits is compared directly.
    """
    window, wanted = text[max(0, first) : last + len(item)].tobytes(), item.tobytes()
    at = window.find(wanted)
    while at >= 0 and at % item.itemsize:
        at = window.find(wanted, at + 1)
    if at >= 0:
        begin = max(0, first) + at // item.itemsize
        return begin, begin + len(item), 0
    if least_edits(item, text[max(0, first - k) : last + len(item) + k]) > k:
        return None
    low, high = first - k, last + k
    width = high - low + 1
    far = k + 1
    # cell d of row i is item[:i] against text up to place i + low + d
    places = low + np.arange(width)
    cost = np.where((places >= 0) & (places <= len(text)) & (places >= first) & (places <= last), 0, far)
    start = places.copy()
    for i in range(1, len(item) + 1):
        places = i + low + np.arange(width)
        inside = (places >= 1) & (places <= len(text))
        letter = text[np.clip(places - 1, 0, max(0, len(text) - 1))] if len(text) else None
        same = inside & (letter == item[i - 1]) if letter is not None else inside
        across = np.where(inside, cost + ~same, far)
        down = np.append(cost[1:] + 1, far)
        down_start = np.append(start[1:], 0)
        new = np.where(down < across, down, across)
        begin = np.where(down < across, down_start, start)
        new = np.where((places >= 0) & (places <= len(text)), new, far)
        # an inserted letter costs one and moves right: running minimum of cost minus place
        steps = np.arange(width)
        keyed = (new - steps) * (width + 1) + (width - steps)  # ties go to the nearest origin
        origin = width - np.minimum.accumulate(keyed) % (width + 1)
        reach = new[origin] + steps - origin
        better = reach < new
        cost = np.minimum(np.where(better, reach, new), far)
        start = np.where(better, begin[origin], begin)
        cost = np.where((places >= 0) & (places <= len(text)), cost, far)
    best = int(cost.argmin())
    if cost[best] > k:
        return None
    return int(start[best]), int(len(item) + low + best), int(cost[best])


class Block:
    """Index of the q-grams of a bounded block of items."""

    def __init__(self, ids: list[int], texts: list[str], q: int, rate: float):
        self.ids, self.q = ids, q
        self.items = [normalised(t) for t in texts]
        self.lengths = np.array([len(i) for i in self.items], dtype=np.int64)
        budget = (rate * self.lengths).astype(np.int64)
        # the bound m + 1 - q (k + 1) must be positive
        self.budget = np.maximum(0, np.minimum(budget, self.lengths // q - 1))
        self.bound = self.lengths + 1 - q * (self.budget + 1)
        self.short = [i for i, n in enumerate(self.lengths) if 0 < n < q]
        hashes = [gram_hashes(i, q) for i in self.items]
        owner = np.repeat(np.arange(len(ids)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes] or [np.empty(0, np.int64)])
        every = np.concatenate(hashes or [np.empty(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order].astype(np.int64)
        self.grams, self.at = np.unique(every[order], return_index=True)
        self.at = np.append(self.at, len(every))
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[self.grams >> np.uint64(64 - _BITS)] = True

    def _hits(self, text: np.ndarray):
        """Places in the text and rows of the index that share a q-gram."""
        h = gram_hashes(text, self.q)
        places = np.flatnonzero(self.bits[h >> np.uint64(64 - _BITS)])
        if not len(places) or not len(self.grams):
            return None
        row = np.searchsorted(self.grams, h[places])
        row[row == len(self.grams)] = 0
        same = self.grams[row] == h[places]
        return places[same], row[same]

    def _regions(self, text: np.ndarray, offset: int):
        """Regions (item, first and last start) of a stretch that reach the bound."""
        hits = self._hits(text)
        if hits is None or not len(hits[0]):
            return
        places, rows = hits
        # a stretch cannot reach any bound when its places with a known gram are too few
        lowest = self.bound[self.lengths >= self.q].min()
        reach = int((self.lengths + self.budget).max())
        later = np.searchsorted(places, places + reach)
        dense = np.flatnonzero(later - np.arange(len(places)) >= lowest)
        if not len(dense):
            return
        mark = np.zeros(len(places) + 1, dtype=np.int64)
        np.add.at(mark, dense, 1)
        np.add.at(mark, later[dense], -1)
        keep = np.cumsum(mark[:-1]) > 0
        places, rows = places[keep], rows[keep]
        count = self.at[rows + 1] - self.at[rows]
        entry = np.repeat(self.at[rows], count) + (
            np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        )
        place = np.repeat(places, count)
        item = self.owner[entry]
        diagonal = place - self.place[entry] + reach  # not negative
        # bands of 2 (2 k + 1) diagonals, the next begins 2 k + 1 later
        wide = 2 * self.budget[item] + 1
        band = diagonal // wide
        size = int(diagonal.max()) + 2
        keys = np.concatenate([item * size + band, item * size + band - 1])
        where = np.concatenate([place, place])
        order = np.lexsort((where, keys))
        keys, where = keys[order], where[order]
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(head, len(keys)))
        owners = (keys[head] + 1) // size  # band -1 of an item lies just before its others
        enough = sizes >= self.bound[owners]
        inside = np.concatenate([self.place[entry], self.place[entry]])[order]
        for begin, n, which in zip(head[enough], sizes[enough], owners[enough].tolist()):
            k = int(self.budget[which])
            distinct = np.unique(where[begin : begin + n])
            # within the length of an occurrence
            span = int(self.lengths[which]) + k
            # as many places of the item take part
            if min(len(distinct), len(np.unique(inside[begin : begin + n]))) < self.bound[which]:
                continue
            far = np.searchsorted(distinct, distinct + span) - np.arange(len(distinct))
            if far.max() < self.bound[which]:
                continue
            number = int(keys[begin] - which * size)
            low = number * (2 * k + 1) - reach
            yield which, low + offset, low + 2 * (2 * k + 1) - 1 + offset

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits), the best match of each item's overlapping ones."""
        codes = normalised(text)
        regions = set()
        if len(self.grams):
            reach = int((self.lengths + 2 * self.budget).max()) + self.q
            for at in range(0, max(1, len(codes)), _STRETCH):
                part = codes[max(0, at - reach) : at + _STRETCH + reach]
                regions.update(self._regions(part, max(0, at - reach)))
        found = []
        for which, first, last in sorted(regions):
            k = int(self.budget[which])
            first, last = max(0, first), min(len(codes), last)
            if first > last:
                continue
            match = aligned(self.items[which], codes, first, last, k)
            if match:
                found.append((which, *match))
        for which in self.short:
            item = self.items[which]
            n = len(item)
            for at in range(len(codes) - n + 1):
                if codes[at] == item[0] and (codes[at : at + n] == item).all():
                    found.append((which, at, at + n, 0))
        best = []
        for which, start, end, edits in sorted(set(found), key=lambda f: (f[0], f[3], f[1], f[2])):
            if all(w != which or start >= e or end <= s for w, s, e, _ in best):
                best.append((which, start, end, edits))
        return sorted(best)


def blocks(items: DataFrame, q: int, rate: float, most: int) -> Iterator[Block]:
    """Indices of at most ``most`` characters each (or of one item), brought in one by one."""
    sized = materialize(
        narrow(items, "item_id", "text").filter("text <> ''").withColumn("_size", F.length("text")),
        "items",
    )
    # buckets of ids by hash, each about half a block
    number = int((sized.agg(F.sum("_size")).first()[0] or 0) * 2 // most + 1)
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(number))
    for i in range(number):
        part: list = []
        size = 0
        for row in sized.filter(bucket == i).orderBy("item_id", "text").toLocalIterator():
            if part and size + row["_size"] > most:
                yield Block([r["item_id"] for r in part], [r["text"] for r in part], q, rate)
                part, size = [], 0
            part.append(row)
            size += row["_size"]
        if part:
            yield Block([r["item_id"] for r in part], [r["text"] for r in part], q, rate)


def leaks(
    docs: DataFrame, items: DataFrame, q: int = Q, rate: float = RATE, block: int = BLOCK
) -> DataFrame:
    """doc_id, item_id, start, end (code points, end exclusive), edits; also the document's key."""
    texts = docs.select("doc_id", *document_key(), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, _id long, _h long, item_id long, start long, end long, edits int"
    names = ["doc_id", "_id", "_h", "item_id", "start", "end", "edits"]
    found = None
    for index in blocks(items, q, rate, block):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def look(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                rows = [
                    (doc, key, h, index.ids[which], start, end, edits)
                    for doc, key, h, text in zip(*[batch[c] for c in ("doc_id", "_id", "_h", "text")])
                    for which, start, end, edits in index.search(text)
                ]
                frame = pd.DataFrame(rows, columns=names)
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

        part = materialize(texts.mapInPandas(look, schema), "leaks")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` in which no item is found."""
    found = leaks(docs, items, **options).select("_id", "_h").distinct()
    return packed(docs, *document_key()).join(found, ["_id", "_h"], "left_anti").select("_doc.*")
