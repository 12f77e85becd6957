"""Encoding by a byte-level BPE vocabulary (problem 8).

A piece's adjacent pair ranks lie in a segment tree whose root gives the leftmost lowest-ranked merge; a merge
updates three leaves in logarithmic time, so even a piece of megabytes without a blank stays near-linear.
Finished pieces are remembered, as most pieces of a corpus recur.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = os.environ.get("ARBORLAKE_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published splitting pattern of this kind of vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 30


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the leftmost lowest-ranked adjacent pair until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << (n - 1).bit_length() if n > 1 else 1
    end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [(NONE, i) for i in range(-size, size)]

    def rank(i: int) -> int:
        j = nxt[i]
        return ranks.get(piece[i : end[j]], NONE) if j < n else NONE

    for i in range(n - 1):
        tree[size + i] = (rank(i), i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def update(i: int, value: int) -> None:
        k = size + i
        tree[k] = (value, i)
        k >>= 1
        while k:
            best = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
            k >>= 1

    while tree[1][0] != NONE:
        i = tree[1][1]
        j = nxt[i]
        end[i], nxt[i] = end[j], nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        update(j, NONE)
        update(i, rank(i))
        if prv[i] >= 0:
            update(prv[i], rank(prv[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class Encoder:
    """Encoder over a file of base64 tokens and ranks; `keep` pieces at most are remembered."""

    def __init__(self, path: str = VOCABULARY, keep: int = 500_000):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split, self.keep, self.known = regex.compile(PATTERN).findall, keep, {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out, known = [], self.known
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= self.keep:
                    known.clear()
                ids = merge(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(df: DataFrame, key: str, text: str, path: str = VOCABULARY, chunk: int = 512) -> DataFrame:
    """key, ids (array of int) of every row; null and empty texts give an empty list, blank text is encoded as it is.

    Repeated rows stay; names of special tokens inside a text are ordinary text. `path` must be readable on all
    executors. No shuffle: one pass over the rows in Arrow batches of `chunk` texts.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                ids = [e.encode(t) for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
