"""Canonical Huffman codes of limited length, and blocks of ids written with them.

A block can be decoded by itself. Every ``CHECKPOINT`` ids its bit offset is
recorded, so that a block is decoded from all checkpoints at once with one
table lookup for each id.
"""

from __future__ import annotations

import numpy as np

CHECKPOINT = 128
LIMIT = 18  # bits; raised for vocabularies that need more


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code length of each symbol by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    # row by row: weights of the merged list and which of its items are packages
    weights, packages = leaf, [np.zeros(len(leaf), dtype=bool)]
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaf, pairs])
        place = np.argsort(merged, kind="stable")
        weights = merged[place]
        packages.append(place >= len(leaf))
    # walk back: of each list the first `take` items are chosen
    take = 2 * len(leaf) - 2
    depth = np.zeros(len(leaf), dtype=np.int64)
    for level in reversed(packages):
        chosen = level[:take]
        from_packages = int(chosen.sum())
        depth[: take - from_packages] += 1
        take = 2 * from_packages
    lengths[order] = depth
    return lengths


class Code:
    """Codes and decoding table of a set of code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        self.width = int(lengths.max(initial=1))
        order = used[np.lexsort((used, lengths[used]))]
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        # in units of the longest code, canonical codes follow each other
        spans = np.uint64(1) << (self.width - lengths[order].astype(np.int64)).astype(np.uint64)
        starts = np.cumsum(spans) - spans
        self.codes[order] = starts >> (self.width - lengths[order].astype(np.int64)).astype(np.uint64)
        self.symbol = np.zeros(1 << self.width, dtype=np.uint32)
        self.step = np.ones(1 << self.width, dtype=np.uint8)
        filled = int(spans.sum())
        self.symbol[:filled] = np.repeat(order, spans.astype(np.int64))
        self.step[:filled] = np.repeat(lengths[order], spans.astype(np.int64))

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Payload and the bit offsets of the checkpoints."""
        size = self.lengths[ids].astype(np.int64)
        if len(ids) and not size.min():
            raise ValueError("an id has no code")
        end = np.cumsum(size)
        start = end - size
        marks = start[::CHECKPOINT].astype(np.uint32)
        if not len(ids):
            return b"", marks
        total = int(end[-1])
        # a code lies in the 64-bit word of its first bit, and may reach into the next
        word, room = start >> 6, 64 - (start & 63) - size
        codes = self.codes[ids]
        over = np.flatnonzero(room < 0)
        shifted = codes << np.maximum(room, 0).astype(np.uint64)
        shifted[over] = codes[over] >> (-room[over]).astype(np.uint64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out = np.zeros(total // 64 + 2, dtype=np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(shifted, first)
        out[word[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: (total + 7) // 8], marks

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        raw = np.frombuffer(payload + bytes(8), dtype=np.uint8).astype(np.uint32)
        words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((CHECKPOINT, len(at)), dtype=np.uint32)
        last, mask = len(words) - 1, (1 << self.width) - 1
        for i in range(CHECKPOINT):
            peek = (words[np.minimum(at >> 3, last)] >> (32 - self.width - (at & 7)).astype(np.uint32)) & mask
            out[i] = self.symbol[peek]
            at = at + self.step[peek]
        return out.T.reshape(-1)[:n]
