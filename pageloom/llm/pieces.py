"""Encoding and decoding with a BPE model file of the sentencepiece library.

The ids of a text are found without running merges over it. For every prefix
of a word the table holds the one token that ends the prefix's encoding: of the
tokens that end there (an automaton over the vocabulary gives them) it is the
one whose predecessor, the last token of the shorter prefix, may stand beside
it. Two tokens may stand side by side if merging their joined characters gives
the two again. A merge across a border depends on the two tokens at the border
alone, so borders that hold pair by pair hold together, and the table is right
for any length. The ids are read off backwards from the last prefix, in time
linear in the length of the text.

Only words between white space are looked at one by one, and only if no piece
goes on behind white space; a process remembers those it has met.

Models with user-defined pieces are not supported: the library matches those
before it merges.

Nulls: a null text is empty, which is the end id alone; a null doc_id stays.
Repeated rows give repeated rows. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import narrow

_SPACE = "▁"  # fixed value: how the library writes a blank
_REMEMBERED = 500_000  # words that a process remembers
_REMEMBERED_LENGTH = 64
_PAIRS = 1_000_000  # pairs of tokens that a process remembers
_START, _NONE = -1, -2


class Merges:
    """Scores of the pieces that merging may make."""

    def __init__(self, scores: dict[str, float]):
        self._scores = scores

    def apply(self, text: str) -> list[str]:
        """Merge the best pair, the leftmost of equals, until none is left; for short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self._scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Words(dict):
    """Ids of words, found when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self._encode(word))
        if len(word) <= _REMEMBERED_LENGTH and len(self) < _REMEMBERED:
            self[word] = ids
        return ids


class Pieces:
    """Encoder of one model file; ``encode`` equals the library's without added ids."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(self.library.get_piece_size())
        special = (self.library.is_control, self.library.is_unknown, self.library.is_byte)
        normal = [i for i in every if not any(test(i) for test in special)]
        if any(self.library.is_unused(i) for i in normal):
            raise ValueError("a model with unused pieces is not supported")
        self._piece = {i: self.library.id_to_piece(i) for i in normal}
        self._length = {i: len(piece) for i, piece in self._piece.items()}
        self._merges = Merges({p: self.library.get_score(i) for i, p in self._piece.items()})
        self._known = {piece for piece in self._piece.values() if len(piece) == 1}
        if not self._known.issuperset("".join(self._piece.values())):
            raise ValueError("a piece holds a character that is no piece")
        # how a character without a piece is written
        self._byte = {i: self.library.piece_to_id(f"<0x{i:02X}>") for i in range(256)}
        self._falls_back = all(self.library.is_byte(i) for i in self._byte.values())
        self._automaton = ahocorasick.Automaton()
        for i, piece in self._piece.items():
            # a piece that merging its own characters does not give is never used
            if self._merges.apply(piece) == [piece]:
                self._automaton.add_word(piece, (i, len(piece)))
        self._automaton.make_automaton()
        self._beside: dict[int, bool] = {}
        self._words = Words(self._word)
        self._split = self._borders()

    def _borders(self) -> re.Pattern:
        """Splits a normalised text where no piece crosses."""
        inner = re.compile(f"[^{_SPACE}]{_SPACE}")
        if any(inner.search(piece) for piece in self._piece.values()):
            return re.compile(r"(?s).+")
        if "\n" in self._known:
            return re.compile(f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+")
        return re.compile(f"{_SPACE}+[^{_SPACE}\n]*|[^{_SPACE}\n]+|\n")

    def _compatible(self, first: int, second: int) -> bool:
        """Whether merging the characters of two tokens gives the two again."""
        parts = [self._piece[first], self._piece[second]]
        found = self._merges.apply(parts[0] + parts[1]) == parts
        if len(self._beside) < _PAIRS:
            self._beside[first << 32 | second] = found
        return found

    def _run(self, run: str) -> list[int]:
        """Ids of characters that all are pieces, by the table of prefixes."""
        beside, compatible = self._beside.get, self._compatible
        last = [_NONE] * (len(run) + 1)
        last[0] = _START
        for end, (token, length) in self._automaton.iter(run):
            if last[end + 1] != _NONE:
                continue
            before = last[end + 1 - length]
            if before >= 0:
                fits = beside(before << 32 | token)
                if fits is None:
                    fits = compatible(before, token)
                if fits:
                    last[end + 1] = token
            elif before == _START:
                last[end + 1] = token
        ids, at = [], len(run)
        while at:
            token = last[at]
            ids.append(token)
            at -= self._length[token]
        ids.reverse()
        return ids

    def _word(self, word: str) -> list[int]:
        if self._known.issuperset(word):
            return self._run(word)
        ids: list[int] = []
        start = 0
        for at, character in enumerate(word):
            if character not in self._known:
                ids += self._run(word[start:at])
                if self._falls_back:
                    ids += [self._byte[octet] for octet in character.encode()]
                elif not ids or ids[-1] != self.library.unk_id() or start != at:
                    ids.append(self.library.unk_id())  # neighbours share one
                start = at + 1
        return ids + self._run(word[start:])

    def encode(self, text: str) -> list[int]:
        words = self._split.findall(self.library.normalize(text))
        return [i for word in words for i in self._words[word]]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    @property
    def end(self) -> int:
        return self.library.eos_id()


@cache
def pieces(path: str) -> Pieces:
    """The encoder that this process keeps."""
    return Pieces(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (with the end id) of each row.

    ``model`` is a file that every executor can read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = pieces(model)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                ids = [[*tool.encode(text), tool.end] for text in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": pd.Series(ids, part.index, dtype=object)})

    return narrow(docs, "doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = pieces(model)
        for batch in batches:
            texts = [tool.decode([int(i) for i in ids]) for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": pd.Series(texts, batch.index, dtype=object)})

    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return rows.select("doc_id", ids).mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row.

    The same as ``encode`` and ``decode`` one after the other, with checksums in
    place of ids and texts, so neither leaves the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = pieces(model)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                ids = [*tool.encode(text), tool.end]
                written = " ".join(map(str, ids)).encode()
                read = tool.decode(ids).encode()
                rows.append((doc, len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(read).hexdigest()))
            frame = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            yield frame.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return narrow(docs, "doc_id", "text").mapInPandas(run, schema)
