"""Token ids as compressed binary files, and back.

Each document is encoded, an end id is appended, and the ids of all documents
are written in ascending order of doc_id (a null first; then by a hash of the
ids), with a canonical Huffman code of limited length from the global counts of ids.

The format is a folder with two tables:

``code``: one row, the code length of each id as bytes.
``blocks``: part and number (their order is that of the documents), before
(ids of earlier blocks of the part), n_ids, payload (bits of the ids), checkpoints (bit offsets of every CHECKPOINT-th id,
little-endian 32-bit), docs (doc_id or null, how many of the block's ids are
its own, how many of its ids are done in earlier blocks, and ``last`` where the
document ends in this block). A block has at
most BLOCK_IDS ids; a longer document goes through several.

Blocks decode independently, so a lost executor loses a block's work at most.

A vocabulary in use that needs codes of more than 24 bits (some four million
ids) raises ValueError.

Nulls: a null text is empty, so it is its end id alone. Repeated rows are
written repeatedly. An empty table gives a code without ids and no blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm.common import narrow
from pageloom.llm.huffman import LIMIT, Code, code_lengths
from pageloom.llm.token_counts import load
from pageloom.scratch import materialize, scratch_path

BLOCK_IDS = 1 << 18
_CACHE = 600_000  # words whose ids a process remembers
_CACHED_LENGTH = 64
_JOINED = 4096  # words encoded as one text

# The white space of the tokenizer's pattern.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A byte-level tokenizer splits before a blank that leads a word, and a run of
# white space stays together but for its last character. Units end where it
# always splits, so encoding them one by one gives the same ids.
_UNIT = re.compile(f"[{_WHITE}]+(?![^{_WHITE}])| ?[^{_WHITE}]+|[{_WHITE}]")


class _Ids(dict):
    """Ids of units as bytes; those of a new unit are filled in later."""

    def __init__(self):
        super().__init__()
        self.wanted: list[str] = []

    def __missing__(self, unit: str) -> bytearray:
        self[unit] = ids = bytearray()
        self.wanted.append(unit)
        return ids

    def forget(self) -> None:
        """Drop new units that are not to be remembered."""
        room = _CACHE - len(self) + len(self.wanted)
        for at, unit in enumerate(self.wanted):
            if at >= room or len(unit) > _CACHED_LENGTH:
                del self[unit]
        self.wanted = []


def _even(text: str) -> bool:
    """Whether the text is words between single blanks and line breaks."""
    words = text.split()
    between = text.count(" ") + text.count("\n")
    return between == len(words) - 1 and between + sum(map(len, words)) == len(text)


class Encoder:
    """Encodes texts of a byte-level tokenizer file from remembered units.

    Units that are not known are collected over a batch of texts and encoded
    together: words after a blank as one text, whose ids are told apart by the
    blanks that they begin with.
    """

    def __init__(self, path: str):
        self._tokenizer = load(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self._tokenizer.get_vocab()
        self._leads = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        # fixed value: how a byte-level tokenizer writes a blank
        self._leads[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True
        self._units, self._after_blank = _Ids(), _Ids()

    def _parts(self, text: str) -> list[bytes | bytearray]:
        if any(s in text for s in self._special):
            # special strings are found before units are
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
            return [np.array(ids, dtype="<u4").tobytes()]
        units, after = self._units.__getitem__, self._after_blank.__getitem__
        if not _even(text):
            return list(map(units, _UNIT.findall(text)))
        parts: list[bytes | bytearray] = []
        for line in text.split("\n"):
            words = iter(line.split(" "))
            parts.append(units(next(words)))
            parts.extend(map(after, words))
            parts.append(units("\n"))
        parts.pop()
        return parts

    def _fill(self) -> None:
        """Encode the units that were asked for and not known."""
        known, wanted = self._after_blank, self._after_blank.wanted
        for at in range(0, len(wanted), _JOINED):
            part = wanted[at : at + _JOINED]
            encoded = self._tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)
            ids = np.array(encoded[0].ids, dtype="<u4")
            first = 4 * np.flatnonzero(self._leads[ids])
            if len(first) != len(part):
                raise ValueError("the tokenizer does not split before a blank that leads a word")
            packed = ids.tobytes()
            starts = first.tolist()
            for unit, start, end in zip(part, starts, [*starts[1:], len(packed)]):
                known[unit] += packed[start:end]
        encoded = self._tokenizer.encode_batch_fast(self._units.wanted, add_special_tokens=False)
        for unit, e in zip(self._units.wanted, encoded):
            self._units[unit] += np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        parts = [self._parts(text) for text in texts]
        self._fill()
        found = [b"".join(p) for p in parts]
        self._units.forget()
        self._after_blank.forget()
        return found


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process keeps one, so tasks go on with what earlier ones learned."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pack(ids: bytes) -> bytes:
    """Ids in two bytes each where they fit, marked by a last byte."""
    wide = np.frombuffer(ids, dtype="<u4")
    return wide.astype("<u2").tobytes() + b"\x02" if wide.max(initial=0) < 1 << 16 else ids + b"\x04"


def _unpack(packed: bytes) -> np.ndarray:
    kind = "<u2" if packed[-1] == 2 else "<u4"
    return np.frombuffer(packed, dtype=kind, count=(len(packed) - 1) // int(packed[-1]))


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end: int) -> None:
    """Encode all texts and write the two tables of the format under ``folder``."""

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, tail = encoder(tokenizer).encode, np.array([end], dtype="<u4").tobytes()
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                texts = part["text"].tolist()
                distinct = dict.fromkeys(texts)
                for text, ids in zip(distinct, encode(list(distinct))):
                    distinct[text] = ids + tail
                ids = [distinct[text] for text in texts]
                found = np.bincount(np.frombuffer(b"".join(ids), "<u4"))
                if len(found) > len(total):
                    total = np.append(total, np.zeros(len(found) - len(total), dtype=np.int64))
                total[: len(found)] += found
                frame = pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": list(map(_pack, ids))})
                yield frame.assign(id=pd.NA, n=pd.NA).astype({"id": "Int64", "n": "Int64"})
        used = np.flatnonzero(total)
        counts = pd.DataFrame({"doc_id": pd.NA, "ids": None, "id": used, "n": total[used]})
        yield counts.astype({"doc_id": "Int64", "id": "Int64", "n": "Int64"})

    # documents, and how often each task's documents have an id
    written = materialize(
        narrow(docs, "doc_id", "text").mapInPandas(tokenise, "doc_id long, ids binary, id long, n long"), "ids"
    )
    encoded = written.filter("id is null").select("doc_id", "ids")
    counted = written.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    pairs = counted.collect()  # a row for each id of the vocabulary
    counts = np.zeros(max((r["id"] for r in pairs), default=-1) + 1, dtype=np.int64)
    for row in pairs:
        counts[row["id"]] = row["n"]
    limit = max(LIMIT, int(np.ceil(np.log2(max(2, len(pairs))))) + 2)
    if limit > 24:
        raise ValueError("a code must fit four bytes from any bit on")
    lengths = code_lengths(counts, limit)
    spark = docs.sparkSession
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{folder}/code")
    shared = spark.sparkContext.broadcast(lengths)

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _encoders.clear()
        code = Code(shared.value)
        held: list[np.ndarray] = []
        owners: list[dict] = []
        size = number = before = 0
        part = None

        def close() -> pd.DataFrame:
            nonlocal held, owners, size, number, before
            ids = np.concatenate(held)
            payload, checkpoints = code.encode(ids)
            row = {
                "part": part, "number": number, "before": before, "n_ids": len(ids), "payload": payload,
                "checkpoints": checkpoints.astype("<u4").tobytes(), "docs": owners,
            }
            held, owners, size, number, before = [], [], 0, number + 1, before + len(ids)
            return pd.DataFrame([row])

        for batch in batches:
            for doc, packed, here in zip(batch["doc_id"], batch["ids"], batch["part"]):
                part = int(here)
                ids = _unpack(packed)
                doc = None if pd.isna(doc) else int(doc)
                done = 0
                while done < len(ids):
                    room = ids[done : done + BLOCK_IDS - size]
                    held.append(room)
                    last = done + len(room) == len(ids)
                    owners.append({"doc_id": doc, "n": len(room), "done": done, "last": last})
                    done += len(room)
                    size += len(room)
                    if size == BLOCK_IDS:
                        yield close()
        if held:
            yield close()

    # the range is found from samples that the driver sees, so ids stand in it by a hash;
    # rows that agree in it are interchangeable, and the last column deals them out
    order = ["doc_id", "_h", "_tie"]
    keyed = encoded.withColumns({"_h": F.xxhash64("ids"), "_tie": F.xxhash64(F.monotonically_increasing_id())})
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    ordered.withColumn("part", F.spark_partition_id()).mapInPandas(
        block,
        "part int, number int, before long, n_ids long, payload binary, checkpoints binary, "
        "docs array<struct<doc_id: long, n: long, done: long, last: boolean>>",
    ).write.parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (array) of each document, or with ``digest`` ids_crc32.

    Start counts the ids of all documents before. Pieces of a document that
    lies in several blocks are put together again; a checksum of pieces is
    carried on from piece to piece, so long documents need no array.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    # sizes only: one row for each part
    parts = materialize(blocks.groupBy("part").agg(F.sum("n_ids").alias("_ids")), "parts")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_offset"))
    lengths = spark.read.parquet(f"{folder}/code").first()["lengths"]
    shared = spark.sparkContext.broadcast(np.frombuffer(bytes(lengths), dtype=np.uint8))
    name, kind = ("ids_crc32", "long") if digest else ("ids", "array<long>")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Code(shared.value)
        for batch in batches:
            for payload, marks, n, docs, place in zip(
                batch["payload"], batch["checkpoints"], batch["n_ids"], batch["docs"], batch["place"]
            ):
                ids = code.decode(payload, np.frombuffer(marks, dtype="<u4"), int(n))
                at, rows = int(place), []
                for doc in docs:
                    mine = ids[at - int(place) :][: int(doc["n"])]
                    got = zlib.crc32(mine) if digest else mine.astype(np.int64)
                    rows.append((doc["doc_id"], at - int(doc["done"]), int(doc["done"]), len(mine), doc["last"], got))
                    at += len(mine)
                frame = pd.DataFrame(rows, columns=["doc_id", "start", "done", "n", "last", name])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    pieces = materialize(
        blocks.join(F.broadcast(offsets), "part")
        .select("payload", "checkpoints", "n_ids", "docs", (F.col("_offset") + F.col("before")).alias("place"))
        .mapInPandas(decode, f"doc_id long, start long, done long, n long, last boolean, {name} {kind}"),
        "pieces",
    )
    alone = F.col("last") & (F.col("done") == 0)
    whole = pieces.filter(alone).select("doc_id", "start", F.col("n").alias("n_tokens"), name)

    def put_together(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("done")
        if digest:
            value = 0
            for got, n in zip(frame[name], frame["n"]):
                value = join_crc(int(value), int(got), 4 * int(n))
        else:
            value = np.concatenate(list(frame[name]))
        row = (frame["doc_id"].iloc[0], frame["start"].iloc[0], frame["n"].sum(), value)
        out = pd.DataFrame([row], columns=["doc_id", "start", "n_tokens", name])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    # the pieces of one document above a block share its start
    long = pieces.filter(~alone).groupBy("start").applyInPandas(
        put_together, f"doc_id long, start long, n_tokens long, {name} {kind}"
    )
    return whole.unionByName(long)


def _times(matrix: list[int], vector: int) -> int:
    out = i = 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@cache
def _zeros(power: int) -> list[int]:
    """How 2 ** power appended zero bytes change a checksum: a linear map, by columns."""
    if power:
        half = _zeros(power - 1)
        return [_times(half, column) for column in half]
    bit = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit; the CRC-32 polynomial
    for _ in range(3):
        bit = [_times(bit, column) for column in bit]
    return bit


def join_crc(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings put together, from theirs and the second's length."""
    for power in range(length.bit_length()):
        if length >> power & 1:
            first = _times(_zeros(power), first)
    return first ^ second


def round_trip(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """Write the files to the shared folder and return what is read from them."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token_files")
    write_ids(docs, folder, tokenizer, end)
    return read_ids(spark, folder, digest=True)
