"""Evaluation passages leaking into training text (problem 9).

A passage of a test item with at most one word in `rate` changed falls into error-budget-plus-one pieces of which
one is untouched, so every run of `PIECE` words of an item is a key; a document's exact piece hits are looked up
in those keys and each hit is verified with Myers' bit-parallel distance over words.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.unitext import canonical

#: (words of a window of the item, errors within it): a sixth, from the shortest passage that counts upwards.
WINDOWS = ((15, 2), (18, 3), (24, 4))
PIECE = min(w // (e + 1) for w, e in WINDOWS)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1 << 16)
def _latin(chunk: str) -> str:
    """What stands between two blanks, in its consistent form without accents; the same words come again and again."""
    return "".join(c for c in unicodedata.normalize("NFKD", canonical(chunk, blanks=False)) if not unicodedata.combining(c))


def words(text: str | None) -> list[str]:
    """Lower-case words without accents, markup, punctuation and look-alike characters; None has none."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = " ".join(c if c.isascii() else _latin(c) for c in text.split())
    return _WORD.findall(text.lower())


def distance(pattern: list[int], text: list[int]) -> int:
    """Smallest number of words to replace, add or leave out between pattern and any stretch of text (Myers 1999)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    eq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    pv, mv, score = full, 0, m
    best = m
    for w in text:
        e = eq.get(w, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        best = min(best, score)
    return best


class Items:
    """Pieces and words of a block of test items; items of the same words are one entry.

    Every piece starts a search. Stock phrases are told by the verification, as a phrase shorter than a passage never
    leaves few enough errors.
    """

    def __init__(self, rows: list[tuple[int, str | None]], short: bool = False):
        self.ids = {}
        same: dict[tuple[int, ...], list[int]] = {}
        for item, text in rows:
            w = tuple(self.ids.setdefault(x, len(self.ids)) for x in words(text))
            if len(w) >= (1 if short else WINDOWS[0][0]):
                same.setdefault(w, []).append(item)
        self.sizes: set[int] = set()
        self.items, self.names = [list(w) for w in same], list(same.values())
        self.pieces: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, w in enumerate(self.items):
            size = self._piece(len(w))
            self.sizes.add(size)
            for i in range(len(w) - size + 1):
                self.pieces.setdefault(tuple(w[i : i + size]), []).append((item, i))

    @staticmethod
    def _piece(n: int) -> int:
        """Words of a piece: an item under the shortest passage has a budget of its own, a word in six, and one piece more than that."""
        return PIECE if n >= WINDOWS[0][0] else n // (n // 6 + 1)

    def leaked(self, text: str | None) -> list[int]:
        """The items of which the text holds a passage."""
        get = self.ids.get
        w = [get(x, -1) for x in words(text)]
        found: dict[int, bool] = {}
        hits: list[tuple[int, int, int]] = []
        for size in self.sizes:
            for p in range(len(w) - size + 1):
                if w[p] >= 0 and (at := self.pieces.get(tuple(w[p : p + size]))):
                    hits += [(item, i, p) for item, i in at]
        tried: set[tuple[int, int, int]] = set()
        for item, i, p in hits:
            if item not in found and self._verify(self.items[item], w, i, p, tried, item):
                found[item] = True
        return [x for item in found for x in self.names[item]]

    @staticmethod
    def _verify(item: list[int], doc: list[int], i: int, p: int, tried: set, name: int) -> bool:
        n = len(item)
        for size, errors in WINDOWS if n >= WINDOWS[0][0] else ((n, n // 6),):
            reach = size - Items._piece(n)
            lo, hi = max(0, p - reach - errors), min(len(doc), p + size + errors)
            near = doc[lo:hi]
            around = set(item[max(0, i - reach) : i + size])
            if sum(x in around for x in near) < size - errors:
                continue
            for s in range(max(0, i - reach), min(i, len(item) - size) + 1):
                key = (name * 64 + size, s, p - i)
                if key in tried:
                    continue
                tried.add(key)
                part = item[s : s + size]
                # The passage begins and ends with words of the item, so that a shorter quotation is none.
                if part[0] in near and part[-1] in near and distance(part, near) <= errors:
                    return True
        return False


_blocks: dict[str, Items] = {}


def _block(name: str, index) -> Items:
    """The pieces of a block, built once a worker process; one block is kept."""
    if name not in _blocks:
        _blocks.clear()
        _blocks[name] = Items(*index.value)
    return _blocks[name]


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, block_chars: int = 8_000_000, short: bool = False) -> DataFrame:
    """key, item_key of every document that holds a passage of at least 15 words of a test item.

    With `short` an item of fewer words is searched whole, with an error in six words; without it has no case.

    The test items are the stated query set: they go to the executors in blocks of at most `block_chars`
    characters (one block here), each searched in all documents in one pass without a shuffle. Null and short
    texts have no case; documents that repeat are reported as often as their key comes with another text, each pair
    once.
    """
    spark, kind, item_kind = docs.sparkSession, docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}"
    out, block, size = None, [], 0

    def search(rows: list[tuple[int, str]]) -> DataFrame:
        index, name = spark.sparkContext.broadcast((rows, short)), uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block = _block(name, index)
            for b in batches:
                pairs = [(k, i) for k, t in zip(b[key], b[text]) for i in block.leaked(t)]
                yield pd.DataFrame(pairs, columns=[key, item_key])

        return docs.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, schema)

    for row in items.select(item_key, item_text).where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).distinct().toLocalIterator():
        if block and size + len(row[1]) > block_chars:
            part = search(block)
            out, block, size = part if out is None else out.unionByName(part), [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    part = search(block)
    return (part if out is None else out.unionByName(part)).distinct()
