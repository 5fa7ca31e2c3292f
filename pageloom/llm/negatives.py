"""Hard negatives: for each anchor and positive, the best rows of other labels within a score window.

Components become the integer floor(256 x); a row's score is its inner product
with the anchor. Higher scores come first, equal ones by smaller vec_id. An
anchor's positives are its first other rows of the same label; a window around
each positive's score admits the negatives.

Rows are ordered by label and by their place on a Hilbert curve through all
dimensions, and written as Parquet in blocks of neighbours, a row each, with
the least and greatest value of every dimension (a zone map). For an anchor,
interval arithmetic over a zone map gives the range in which all scores of the
block lie. A pass over the zone maps alone finds how many rows certainly lie
above which score, and from it the blocks that each anchor must read: for
positives, those whose range reaches the surely attained rank; for windows,
those whose range meets one of the anchor's windows and reaches what is surely
attained there. Only these blocks are read. While it reads, a task carries the
lowest score that still counts for each anchor and window, and a block that
cannot reach it for an anchor any more is not scored for it.

Anchors are taken in blocks of bounded size, all other data stays distributed.

Rows with a null label, a null vector, or a null or non-finite component take
no part. A vector that is shorter than the longest counts as 0 in what it
lacks. A null vec_id is no anchor and comes after others of equal score; such
a row's id is null in results. Repeated rows are rows of their own. Scores must
fit in 64 bits; larger components raise ValueError. An empty table, or one
without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import BROADCAST_ROWS
from pageloom.scratch import materialize

ROWS = 256  # rows of a block
ANCHORS = 16_384  # anchors that are dealt with at once
BITS = 4  # of each dimension, for the place on the curve
_NO_ID = np.iinfo(np.int64).max  # sorts after every id
_LOWEST = np.iinfo(np.int64).min


def hilbert_keys(points: np.ndarray, bits: int) -> list[bytes]:
    """Places of points (rows of ``bits``-bit numbers) on the Hilbert curve, as sortable bytes.

    The coordinates are turned, from the highest bit down, into those of the
    curve's cell that holds the point, then Gray-coded across dimensions.
    """
    x = points.astype(np.uint32).T.copy()
    dims = len(x)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        below = np.uint32(q - 1)
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(up, below, swap)
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= flip
    # the highest bits of all dimensions come first
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in reversed(range(bits))]
    laid = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in laid]


def scores(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products, anchors by vectors, as 64-bit integers."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * anchors.shape[1]
    if most < 2.0**53:
        return (anchors.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return anchors @ vectors.T
    raise ValueError("scores do not fit in 64 bits")


def ranges(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score, anchors by blocks, from the blocks' zone maps."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return scores(up, low) + scores(down, high), scores(up, high) + scores(down, low)


def _blocks(table: DataFrame, vector: str, moved: int, rows: int) -> DataFrame:
    """Written blocks: block, label, n, low, high (zone map), ids and vectors (64-bit numbers)."""
    finite = f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    shifted = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    clean = table.filter(f"label is not null and {vector} is not null").filter(finite).select(
        "vec_id",
        shifted.cast("int").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * 256)).alias("v"),
    )
    shape = clean.agg(
        F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))
    ).first()
    dims, least, most = int(shape[0] or 0), int(shape[1] or 0), int(shape[2] or 0)
    if max(-least, most) > 1 << 30:
        raise ValueError("scores do not fit in 64 bits")
    dims = max(dims, 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        span = max(most - least + 1, 1)
        for batch in batches:
            if not len(batch):
                continue
            v = np.zeros((len(batch), dims), dtype=np.int64)
            for row, values in zip(v, batch["v"]):
                row[: len(values)] = values
            key = hilbert_keys(((v - least) << BITS) // span, BITS)
            packed = [row.tobytes() for row in v.astype("<i4")]
            frame = batch[["vec_id", "label"]].assign(key=key, v=packed)
            yield frame.astype({"vec_id": "Int64"})

    placed = clean.mapInPandas(place, "vec_id long, label int, key binary, v binary")
    # equal rows are interchangeable; the last column deals them out
    tie = F.xxhash64(F.monotonically_increasing_id())
    order = ["label", "key", "vec_id", "_tie"]
    ordered = placed.withColumn("_tie", tie).repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        number, part = 0, 0

        def close() -> pd.DataFrame:
            nonlocal held, number
            ids, labels, packed = zip(*held)
            v = np.frombuffer(b"".join(packed), "<i4").reshape(len(ids), dims)
            row = {
                "block": (part << 32) + number, "label": labels[0], "n": len(ids),
                "low": v.min(axis=0).tobytes(), "high": v.max(axis=0).tobytes(),
                "ids": np.array(ids, "<i8").tobytes(), "vectors": v.tobytes(),
            }
            held, number = [], number + 1
            return pd.DataFrame([row])

        for batch in batches:
            ids = batch["vec_id"].astype("Int64").fillna(_NO_ID)
            for vec, label, v, here in zip(ids, batch["label"], batch["v"], batch["_part"]):
                if held and (len(held) == rows or held[0][1] != label):
                    yield close()
                part = here
                held.append((vec, label, v))
        if held:
            yield close()

    return materialize(
        ordered.withColumn("_part", F.spark_partition_id().cast("long")).mapInPandas(
            pack, "block long, label int, n int, low binary, high binary, ids binary, vectors binary"
        ),
        "vector_blocks",
    )


class Anchors:
    """A block of anchors: where they lie, ids, labels and vectors."""

    def __init__(self, rows: list[tuple]):
        block, place, ids, labels, vectors = zip(*rows)
        self.block = np.array(block, dtype=np.int64)
        self.place = np.array(place, dtype=np.int64)
        self.ids = np.array(ids, dtype=np.int64)
        self.labels = np.array(labels, dtype=np.int64)
        self.vectors = np.stack([np.frombuffer(v, "<i4") for v in vectors]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.ids)


def _anchors(blocks: DataFrame, every: int, most: int) -> Iterator[Anchors]:
    """The anchors, brought in one by one, in blocks of at most ``most``."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, label, ids, vectors in zip(batch["block"], batch["label"], batch["ids"], batch["vectors"]):
                ids = np.frombuffer(ids, "<i8")
                v = np.frombuffer(vectors, "<i4").reshape(len(ids), -1)
                at = np.flatnonzero((ids % every == 0) & (ids != _NO_ID))
                if len(at):
                    yield pd.DataFrame({"block": block, "place": at, "vec_id": ids[at], "label": label, "v": [v[i].tobytes() for i in at]})

    found = blocks.select("block", "label", "ids", "vectors").mapInPandas(
        pick, "block long, place long, vec_id long, label long, v binary"
    )
    held: list[tuple] = []
    for row in materialize(found, "anchors").toLocalIterator():
        held.append(tuple(row))
        if len(held) == most:
            yield Anchors(held)
            held = []
    if held:
        yield Anchors(held)


class Sought:
    """What each anchor of a block looks for: windows of scores, and the k best rows in each.

    ``same`` tells whether rows of the anchor's label or of the others are
    meant. ``low`` and ``high`` are anchors by windows; where low is above high
    there is no window.
    """

    def __init__(self, anchors: Anchors, same: bool, k: int, low: np.ndarray, high: np.ndarray):
        self.anchors, self.same, self.k = anchors, same, k
        self.low, self.high = low, high

    def of_label(self, label: int) -> np.ndarray:
        return np.flatnonzero((self.anchors.labels == label) == self.same)

    def sure(self, low: np.ndarray, high: np.ndarray, n: int, who: np.ndarray) -> np.ndarray:
        """What a block alone proves the k-th best of each window to reach (who by windows)."""
        others = n - 1 if self.same else n  # one of them may be the anchor
        inside = (low[:, None] >= self.low[who]) & (high[:, None] <= self.high[who])
        return np.where(inside & (others >= self.k), low[:, None], self.low[who])

    def needed(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Which anchors must read a block of this range."""
        return ((high[:, None] >= least[who]) & (low[:, None] <= self.high[who])).any(axis=1)


def _zones(batch: pd.DataFrame) -> Iterator[tuple]:
    for block, label, n, low, high in zip(*[batch[c] for c in ("block", "label", "n", "low", "high")]):
        yield block, label, n, np.frombuffer(low, "<i4")[None, :].astype(np.int64), np.frombuffer(high, "<i4")[None, :].astype(np.int64)


def _best(blocks: DataFrame, sought: Sought) -> DataFrame:
    """anchor, window (their numbers), vec_id, score and rank of what is sought."""
    spark = blocks.sparkSession
    zones = blocks.select("block", "label", "n", "low", "high")
    shared = spark.sparkContext.broadcast(sought)
    windows = sought.low.shape[1]

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sought = shared.value
        least = sought.low.copy()
        for batch in batches:
            for _, label, n, low, high in _zones(batch):
                who = sought.of_label(label)
                if len(who):
                    bottom, top = ranges(sought.anchors.vectors[who], low, high)
                    least[who] = np.maximum(least[who], sought.sure(bottom[:, 0], top[:, 0], n, who))
        a, w = np.nonzero(least > sought.low)
        yield pd.DataFrame({"anchor": a, "window": w, "least": least[a, w]}).astype("int64")

    proved = (
        zones.mapInPandas(prove, "anchor long, window long, least long")
        .groupBy("anchor", "window")
        .agg(F.max("least").alias("least"))
    )
    least = sought.low.copy()
    for row in proved.collect():  # at most one for each window of this block of anchors
        least[row["anchor"], row["window"]] = row["least"]
    bounds = spark.sparkContext.broadcast(least)

    def reading(sought: Sought, least: np.ndarray, label: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The anchors that must read a block of this label and range."""
        who = sought.of_label(label)
        if len(who):
            bottom, top = ranges(sought.anchors.vectors[who], low, high)
            who = who[sought.needed(bottom[:, 0], top[:, 0], least, who)]
        return who

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sought, least = shared.value, bounds.value
        for batch in batches:
            needed = [block for block, label, _, low, high in _zones(batch) if len(reading(sought, least, label, low, high))]
            yield pd.DataFrame({"block": needed}, dtype="int64")

    chosen = materialize(zones.mapInPandas(choose, "block long"), "chosen")
    # block numbers alone; beyond what may be broadcast all blocks are opened and most of them used
    payload = blocks.join(F.broadcast(chosen), "block") if chosen.count() <= BROADCAST_ROWS else blocks

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sought, least = shared.value, bounds.value.copy()
        anchors, k = sought.anchors, sought.k
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for (block, label, _, low, high), ids, vectors in zip(_zones(batch), batch["ids"], batch["vectors"]):
                who = reading(sought, least, label, low, high)
                if not len(who):
                    continue
                ids = np.frombuffer(ids, "<i8")
                v = np.frombuffer(vectors, "<i4").reshape(len(ids), -1).astype(np.int64)
                found = scores(anchors.vectors[who], v)
                itself = np.flatnonzero(anchors.block[who] == block)
                for window in range(windows):
                    fits = (found >= least[who, window, None]) & (found <= sought.high[who, window, None])
                    if sought.same:
                        fits[itself, anchors.place[who[itself]]] = False
                    for i in np.flatnonzero(fits.any(axis=1)):
                        here = np.flatnonzero(fits[i])
                        anchor = int(who[i])
                        s, d = found[i, here], ids[here]
                        if (anchor, window) in kept:
                            s = np.concatenate([kept[anchor, window][0], s])
                            d = np.concatenate([kept[anchor, window][1], d])
                        order = np.lexsort((d, -s))[:k]
                        kept[anchor, window] = s[order], d[order]
                        if len(order) == k:
                            least[anchor, window] = max(least[anchor, window], s[order[-1]])
        if kept:
            sizes = [len(s) for s, _ in kept.values()]
            keys = np.repeat(np.array(list(kept)), sizes, axis=0)
            s, d = (np.concatenate(part) for part in zip(*kept.values()))
            yield pd.DataFrame({"anchor": keys[:, 0], "window": keys[:, 1], "vec_id": d, "score": s})

    found = payload.select(*zones.columns, "ids", "vectors").mapInPandas(
        read, "anchor long, window long, vec_id long, score long"
    )
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sought.k)
    return materialize(ranked, "best")


def hard_negatives(
    table: DataFrame,
    vector: str = "embedding",
    every: int = 100,
    moved: int = 7,
    positives: int = 5,
    k: int = 10,
    window: tuple[int, int] = (30, 90),
    rows: int = ROWS,
    most: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are rows whose vec_id ``every`` divides; where ``moved`` divides it,
    the label becomes (label + 1) % 10 first. A negative's score lies between
    the ``window``'s percentages of the positive's. ``rows`` is the size of a
    block, ``most`` the number of anchors dealt with at once; neither changes
    the result.
    """
    spark = table.sparkSession
    blocks = _blocks(table, vector, moved, rows)
    result = None
    for anchors in _anchors(blocks, every, most):
        everywhere = np.full((len(anchors), 1), _LOWEST), np.full((len(anchors), 1), _NO_ID)
        near = _best(blocks, Sought(anchors, True, positives, *everywhere)).collect()  # some rows an anchor
        ids = np.full((len(anchors), positives), _NO_ID)
        low, high = np.ones((2, len(anchors), positives), dtype=np.int64)
        high[:] = 0  # no window where there is no positive
        value = np.zeros_like(low)
        for row in near:
            at, score = (row["anchor"], row["rank"] - 1), row["score"]
            ids[at], value[at] = row["vec_id"], score
            low[at], high[at] = -(-window[0] * score // 100), window[1] * score // 100
        found = _best(blocks, Sought(anchors, False, k, low, high))
        have = sorted((r["anchor"], r["rank"] - 1) for r in near)
        known = [(int(a), int(p), int(anchors.ids[a]), int(ids[a, p]), int(value[a, p])) for a, p in have]
        names = spark.createDataFrame(known, "anchor long, window long, anchor_id long, positive_id long, positive_score long")
        part = found.join(F.broadcast(names), ["anchor", "window"]).select(
            "anchor_id",
            F.nullif("positive_id", F.lit(int(_NO_ID))).alias("positive_id"),
            "rank",
            F.nullif("vec_id", F.lit(int(_NO_ID))).alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    return result
