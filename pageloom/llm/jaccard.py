"""Near-duplicate documents: Jaccard join of word n-gram sets by MinHash banding.

1. Every text becomes its set of n-grams (64-bit hashes of n words; a text of
   fewer words is one gram). Texts with equal sets form a class and go on as one
   weighted representative. A set's MinHash signature is cut into bands, whose
   number and height follow from the recall that is asked for.
2. Representatives are shuffled on band hashes. A band value that several share
   links each of them to the first; the connected parts of these links are
   candidate groups. No pairs are written.
3. Full sets of representatives that are in a group are compared exactly, group
   by group: small groups together in bins, a large group in blocks, each block
   against each. A task multiplies incidence matrices in slices and returns, per
   document, the number of links, and links enough to keep connected what is
   connected (at most one less than its rows).
4. Connected parts of the verified links are the classes of the result.

Comparing inside candidate groups finds every pair that shares a band, and more.
Sets are named by 64-bit hashes of a 128-bit fingerprint: with 10^9 different
sets the chance that any two share a name is about 3 in 100.

Nulls: null and wordless texts have no grams: each is its own class and has no
links. A null id is kept and orders first. Repeated rows are copies of each
other. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import document_key, narrow, packed
from pageloom.scratch import materialize

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_MASK = (1 << 64) - 1
_SLICE = 1024  # grams whose permutations are taken at once
_COLUMNS = 4096  # grams of an incidence matrix at once
BLOCK_BYTES = 8_000_000  # gram hashes of a block of a group
BLOCK_ROWS = 1024


def choose_bands(similarity: float, recall: float, most: int = 160) -> tuple[int, int]:
    """Bands and rows: the tallest bands for which pairs at ``similarity`` are found with ``recall``."""
    best = (1, 1)
    for rows in range(1, most + 1):
        hit = similarity**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _mix(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    codes = (codes ^ (codes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return codes ^ (codes >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class Grams:
    """Sets of n-gram hashes; polynomial hashes of words, all words of a text at once."""

    def __init__(self, n: int):
        self.n = n
        self._up, self._down = _powers(_PRIME, 0), _powers(_INVERSE, 0)

    def words(self, text: bytes) -> np.ndarray:
        raw = np.frombuffer(text, dtype=np.uint8)
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(self._up) < len(raw) + 1:
            size = 2 * len(raw) + 1
            self._up, self._down = _powers(_PRIME, size), _powers(_INVERSE, size)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._up[: len(raw)], out=sums[1:])
        return _mix((sums[end] - sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def of(self, text: bytes) -> np.ndarray:
        """Sorted distinct gram hashes of a text."""
        words = self.words(text)
        n = min(self.n, len(words))
        if not n:
            return words
        grams = np.zeros(len(words) - n + 1, dtype=np.uint64)
        for i in range(n):
            grams = grams * np.uint64(_PRIME) + words[i : len(words) - n + 1 + i]
        return np.unique(_mix(grams))


class Signatures:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        random = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self._factor = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._term = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """A hash for each band."""
        least = np.full(len(self._factor), _MASK, dtype=np.uint64)
        for at in range(0, len(grams), _SLICE):
            part = grams[at : at + _SLICE]
            mixed = self._factor[:, None] * part[None, :] + self._term[:, None]
            # high bits of a product depend on all bits
            np.minimum(least, (mixed >> np.uint64(16)).min(axis=1), out=least)
        bands = np.zeros(self.bands, dtype=np.uint64)
        for row in least.reshape(self.bands, self.rows).T:
            bands = _mix(bands * np.uint64(_PRIME) + row)
        return bands


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, _id, _h, grams (number), f1 and f2 (fingerprint of the set), bands."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, signatures = Grams(n), Signatures(bands, rows)
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = grams.of(text)
                first = int(found.sum(dtype=np.uint64))
                second = int(_mix(found ^ np.uint64(_PRIME)).sum(dtype=np.uint64))
                values = signatures.of(found).view(np.int64) if len(found) else None
                out.append((len(found), first, second, values))
            frame = batch.drop(columns="text")
            frame["grams"] = [o[0] for o in out]
            frame["f1"] = np.array([o[1] for o in out], dtype=np.uint64).view(np.int64)
            frame["f2"] = np.array([o[2] for o in out], dtype=np.uint64).view(np.int64)
            frame["bands"] = [o[3] for o in out]
            yield frame

    keyed = docs.select("doc_id", *document_key(), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return keyed.mapInPandas(
        sketch,
        "doc_id long, _id long, _h long, grams long, f1 long, f2 long, bands array<long>",
    )


def connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, part for the ends of ``edges`` (a, b: longs); the part is its least node.

    Each round takes the least label among the neighbours and then the label of
    that label, so the rounds grow with the logarithm of the longest path.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "links"
    )
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("part")),
        "labels",
    )
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("part").alias("near"))
        )
        lowered = materialize(
            labels.join(near, "node").select(
                "node", F.col("part").alias("old"), F.least("part", "near").alias("part")
            ),
            "labels",
        )
        above = lowered.select(F.col("node").alias("part"), F.col("part").alias("above"))
        jumped = materialize(
            lowered.join(above, "part").select(
                "node", "old", F.least("part", "above").alias("part")
            ),
            "labels",
        )
        labels = jumped.select("node", "part")
        if jumped.filter("old <> part").isEmpty():
            return labels


def compare(
    sets: list[np.ndarray],
    weight: np.ndarray,
    block: np.ndarray,
    similarity: float,
    across: bool = False,
):
    """Links between representatives: summed weights per row, and a spanning part of them.

    With ``across`` rows of different blocks are compared alone, as those of one
    block meet elsewhere. Sets are sorted and distinct.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = times[column] > 1  # a gram of one row adds to no intersection
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, _COLUMNS):
        low, high = np.searchsorted(column, [at, at + _COLUMNS])
        matrix = np.zeros((len(sets), min(_COLUMNS, width - at)), dtype=np.float32)
        matrix[row[low:high], column[low:high] - at] = 1
        common += matrix @ matrix.T
    union = size[:, None] + size[None, :] - common
    linked = common >= similarity * union - 1e-6
    np.fill_diagonal(linked, False)
    if across:
        linked &= block[:, None] != block[None, :]
    links = linked @ weight
    # a forest of the links: search from each row not reached yet
    reached = np.zeros(len(sets), dtype=bool)
    forest = []
    for root in range(len(sets)):
        if reached[root]:
            continue
        reached[root] = True
        front = [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & ~reached)
            reached[new] = True
            forest.extend((at, int(to)) for to in new)
            front.extend(new.tolist())
    return links, forest


def join_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """node, links or a, b of verified links, from (node, part, weight, grams as binary).

    ``links`` is the number of documents linked to the representative.
    """
    sizes = sets.groupBy("part").agg(
        F.count("*").alias("_rows"), F.sum(F.octet_length("set")).alias("_bytes")
    )
    cuts = F.greatest(
        F.ceil(F.col("_rows") / BLOCK_ROWS), F.ceil(F.col("_bytes") / BLOCK_BYTES)
    ).cast("int")
    sizes = materialize(sizes.withColumn("_cuts", cuts), "groups")
    small = sizes.filter("_cuts = 1").agg(F.sum("_bytes"), F.sum("_rows")).first()
    bins = max(1, (small[0] or 0) // BLOCK_BYTES, (small[1] or 0) // BLOCK_ROWS) * 2
    sized = sets.join(sizes.select("part", "_cuts"), "part")
    mine = F.pmod(F.xxhash64("node", F.lit("block")), F.col("_cuts")).cast("int")
    blocked = sized.withColumn("_mine", mine)
    # a block meets each block, itself included
    dealt = blocked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)))
    dealt = dealt.select(
        "node", "part", "weight", "set", "_mine",
        F.when(F.col("_cuts") > 1, F.col("part")).otherwise(F.pmod(F.xxhash64("part"), F.lit(bins))).alias("_bin"),
        (F.col("_cuts") > 1).alias("_large"),
        F.least("_mine", "_other").alias("_i"),
        F.greatest("_mine", "_other").alias("_j"),
    )

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, counts, left, right = [], [], [], []
        across = bool(frame["_i"].iloc[0] != frame["_j"].iloc[0])
        for _, group in frame.groupby("part", sort=False):
            if across and group["_mine"].nunique() == 1:
                continue  # the other block has no rows
            node, weight = group["node"].to_numpy(), group["weight"].to_numpy(np.int64)
            arrays = [np.frombuffer(s, dtype=np.uint64) for s in group["set"]]
            links, forest = compare(arrays, weight, group["_mine"].to_numpy(), similarity, across)
            some = np.flatnonzero(links)
            nodes.extend(node[some])
            counts.extend(links[some])
            left.extend(node[a] for a, _ in forest)
            right.extend(node[b] for _, b in forest)
        none, gap = [None] * len(left), [None] * len(nodes)
        columns = {"node": nodes + none, "links": counts + none, "a": gap + left, "b": gap + right}
        return pd.DataFrame({name: pd.array(v, dtype="Int64") for name, v in columns.items()})

    return dealt.groupBy("_bin", "_large", "_i", "_j").applyInPandas(
        verify, "node long, links long, a long, b long"
    )


def jaccard_join(
    docs: DataFrame, similarity: float = 0.8, n: int = 5, recall: float = 0.999
) -> DataFrame:
    """doc_id, class_id, copy_class, n_links; also _id and _h that identify the document.

    ``copy_class`` numbers the documents with equal gram sets, ``class_id`` the
    connected documents; a class that holds one copy class has its number.
    ``n_links`` is the number of other documents at ``similarity`` or above.
    """
    bands, rows = choose_bands(similarity, recall)
    rows_ = materialize(sketches(narrow(docs, "doc_id", "text"), n, bands, rows), "sketches")
    full = rows_.filter("grams > 0")
    # the representative of a set is its first document; its fingerprint names it
    classes = materialize(
        full.groupBy("f1", "f2").agg(
            F.min(F.struct("_id", "_h")).alias("first"),
            F.count("*").alias("weight"),
            F.first("bands").alias("bands"),
        ).select("f1", "f2", "weight", "bands", F.xxhash64("f1", "f2").alias("node"), "first._id", "first._h"),
        "classes",
    )
    banded = classes.select("node", F.posexplode("bands").alias("band", "value"))
    heads = (
        banded.groupBy("band", "value")
        .agg(F.min("node").alias("head"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    stars = banded.join(heads, ["band", "value"]).filter("node <> head")
    stars = stars.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    groups = connected(stars)

    active = classes.join(groups, "node").select("node", "part", "weight", "_id", "_h")
    keyed = docs.select(*document_key(), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(n)
        for batch in batches:
            out = batch.drop(columns="text")
            out["set"] = [grams.of(t).tobytes() for t in batch["text"]]
            yield out

    sets = materialize(
        keyed.join(active, ["_id", "_h"])
        .dropDuplicates(["_id", "_h"])
        .select("node", "part", "weight", "text")
        .mapInPandas(full_sets, "node long, part long, weight long, set binary"),
        "sets",
    )
    verified = materialize(join_sets(sets, similarity), "verified")
    parts = connected(verified.filter("a is not null").select("a", "b"))
    links = verified.filter("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    numbered = classes.select("node", "weight", F.struct("_id", "_h").alias("own"))
    in_parts = numbered.join(parts, "node").join(links, "node", "left")
    least = in_parts.groupBy("part").agg(F.min("own").alias("first"))
    named = materialize(
        in_parts.join(least, "part").select("node", "links", "first"), "named"
    )
    by_set = materialize(
        classes.join(named, "node", "left").select(
            "f1", "f2", "weight",
            F.struct("_id", "_h").alias("own"),
            F.coalesce("first", F.struct("_id", "_h")).alias("first"),
            F.coalesce("links", F.lit(0)).alias("links"),
        ),
        "by_set",
    )
    found = full.drop("bands", "grams").join(by_set, ["f1", "f2"]).select(
        "doc_id", "_id", "_h", "own", "first", (F.col("links") + F.col("weight") - 1).alias("n_links")
    )
    alone = rows_.filter("grams = 0").select(
        "doc_id", "_id", "_h",
        F.struct("_id", "_h").alias("own"), F.struct("_id", "_h").alias("first"), F.lit(0).cast("long").alias("n_links"),
    )
    return found.unionByName(alone)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, copy_class, n_links: the first document's id names a class."""
    return jaccard_join(docs, **options).select(
        "doc_id",
        F.col("first._id").alias("class_id"),
        F.col("own._id").alias("copy_class"),
        "n_links",
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` without near duplicates: the first document of each class stays, once."""
    found = jaccard_join(docs, **options)
    kept = found.filter("_id = first._id and _h = first._h").select("_id", "_h").distinct()
    # of rows that share id and text the one whose other columns hash lowest stays; combined map-side
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    order = F.struct(F.xxhash64(others), F.col("text").isNull())
    rows = packed(docs, *document_key(), order.alias("_order"))
    single = rows.groupBy("_id", "_h").agg(F.min_by("_doc", "_order").alias("_doc"))
    return single.join(kept, ["_id", "_h"], "left_semi").select("_doc.*")
