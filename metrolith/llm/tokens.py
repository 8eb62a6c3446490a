"""Byte-level BPE over a public vocabulary.

The text is cut by the vocabulary's pattern; each piece starts as a doubly linked list of bytes
whose neighbouring pairs sit in a heap by merge rank. A popped pair that no longer exists is
skipped. Pieces recur, so each Python worker keeps a bounded table of encoded ones.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of the rank file (a token in base64 and its id on each line).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Pieces(dict):
    """Encoded pieces by text, at most ``limit`` short ones."""

    def __init__(self, encode, limit: int = 400_000, longest: int = 48):
        super().__init__()
        self.encode, self.limit, self.longest = encode, limit, longest

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece.encode("utf-8"))
        if len(piece) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = {i: w for w, i in self.ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.pieces = _Pieces(self.merge)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece: always the pair of the lowest rank first, the leftmost of equals."""
        ranks = self.ranks
        n = len(piece)
        if n == 1:
            return (ranks[piece],)
        sym: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            a = sym[i]
            if a is None or (j := nxt[i]) >= n:
                continue
            both = a + sym[j]
            if ranks.get(both) != r:
                continue  # stale: one side has been merged since
            sym[i], sym[j] = both, None
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (q := ranks.get(both + sym[k])) is not None:
                    heapq.heappush(heap, (q, i))
            if (h := prv[i]) >= 0 and (q := ranks.get(sym[h] + both)) is not None:
                heapq.heappush(heap, (q, h))
        return tuple(ranks[s] for s in sym if s is not None)

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens, whose names are ordinary text; none for a null or empty text."""
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.cut(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.pieces.__getitem__, self.cut(text)))) if text else 0

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.words.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def bpe(path: str = VOCABULARY) -> Bpe:
    """The encoder of a rank file, loaded once a process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every row: an empty list for a null or empty text. Blank texts have ids; texts are encoded whole; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(vocabulary)
        for b in batches:
            ids = [np.array(enc.encode(t), np.int32) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of the ids of each row: an empty text for an empty list, null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else enc.decode(x) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens of every row; 0 for a null or empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([enc.count(t) for t in b.column("text").to_pylist()], pa.int64())], names=["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, tokens long")
