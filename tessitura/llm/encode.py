"""Token ids of texts by a byte-level BPE vocabulary, without running merges."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the public pattern that splits text into pieces before any merge.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary is sent to every task: its file may have this many bytes at most. Pieces and pairs remembered by a task.
MOST_BYTES, REMEMBERED = 32_000_000, 400_000
NEVER = 1 << 60


def read_ranks(text: str) -> dict[str, int]:
    """Tokens, their bytes as Latin-1 characters, with their ranks, which are their ids: "base64 rank" in each line."""
    return {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in (line.split() for line in text.splitlines() if line.strip())}


class BytePairEncoder:
    """Encodes as the merges of a rank file do, in time linear in the text.

    From each position the longest token (found by an Aho-Corasick automaton over all tokens) is tried, then the ever
    shorter ones that it starts with. A token may follow another if merging the bytes of both gives back just these
    two; a position that no token leaves is given up for good. The sequence found is the only one whose neighbours
    are all compatible, so it is that of the merges.
    """

    def __init__(self, ranks: dict[str, int], pattern: str = PIECES) -> None:
        self.rank, self.pattern = ranks, regex.compile(pattern)
        most = max(ranks.values()) + 1
        self.length, self.shorter = [0] * most, [-1] * most
        self.parts: list[tuple[int, int] | None] = [None] * most
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.length[i] = len(token)
            found = len(token) == 1
            for at in range(len(token) - 1, 0, -1):
                first, second = ranks.get(token[:at], NEVER), ranks.get(token[at:], NEVER)
                if self.shorter[i] < 0 and first != NEVER:
                    self.shorter[i] = first
                if not found and max(first, second) < i and self._compatible(first, second):
                    self.parts[i], self.joined[first, second], found = (first, second), i, True
            if found:  # else no merge makes it
                self.automaton.add_word(token, i)
        for i, x in enumerate(self.shorter):
            while x >= 0 and self.length[x] > 1 and self.parts[x] is None:
                x = self.shorter[x]
            self.shorter[i] = x
        self.automaton.make_automaton()
        self.fits.clear()

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between the two tokens.

        Back in time, the token at the border that was made last is undone (of equals the right one, as merges of one
        rank run from the left). Two border tokens join if their rank comes before what ends either of them: strictly
        before on the left, where an equal merge is done first.
        """
        left_until = right_until = NEVER
        while True:
            rank = self.joined.get((left, right))
            if rank is not None and rank < left_until and rank <= right_until:
                return False
            if left > right:
                if (made := self.parts[left]) is None:
                    return True
                left_until, left = left, made[1]
            else:
                if (made := self.parts[right]) is None:
                    return True
                right_until, right = right, made[0]

    def _fit(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _longest(self, piece: str, at: int) -> int:
        return next(self.automaton.iter_long(piece, at))[1]

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece (bytes as Latin-1)."""
        out: list[int] = []
        at, end, given_up = 0, len(piece), bytearray(len(piece) + 1)
        token = self._longest(piece, 0) if piece else -1
        while token >= 0:
            to = at + self.length[token]
            if not given_up[to] and (not out or self._fit(out[-1], token)):
                out.append(token)
                at = to
                token = self._longest(piece, at) if at < end else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                given_up[at] = 1
                token = out.pop()
                at -= self.length[token]
        return out

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.pieces
        for piece in self.pattern.findall(text):
            found = known.get(piece)
            if found is None:
                found = tuple(self.piece(piece.encode().decode("latin-1")))
                if len(piece) <= 64:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids


@cache
def _encoder(ranks: str) -> BytePairEncoder:
    return BytePairEncoder(read_ranks(ranks))


def _vocabulary(spark: SparkSession, path: str):
    """The rank file, read where the driver is and sent to the tasks: its size is fixed and checked."""
    file = Path(path)
    if file.stat().st_size > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} bytes")
    return spark.sparkContext.broadcast(file.read_text())


def encode(df: DataFrame, ident: str, text: str, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every text, whole, without special tokens.

    Strings of special tokens are ordinary text. Null, and the empty text, have the empty list; white space is text. No
    shuffle; one row for each row, repeated ids and null ids included; other columns are not read.
    """
    ranks = _vocabulary(df.sparkSession, vocabulary)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for batch in batches:
            lists = [encoder.encode(x) if x else [] for x in batch["text"].to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"])

    return df.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(ids, f"id {dict(df.dtypes)[ident]}, ids array<int>")


def count_tokens(df: DataFrame, ident: str, text: str, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, size): how many tokens encode() gives."""
    ranks = _vocabulary(df.sparkSession, vocabulary)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for batch in batches:
            size = [len(encoder.encode(x)) if x else 0 for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(size, pa.int64())], ["id", "size"])

    return df.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(sizes, f"id {dict(df.dtypes)[ident]}, size long")
