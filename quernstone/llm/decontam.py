"""Benchmark decontamination by spaced seeds.

Words are lower-cased runs of letters and digits. A fixed mask names the word positions
of a span that count; the others may differ. The hashes of all spans of the benchmark
items form the test side, those of the documents the training side. Around each equal
hash the item is laid along the document, and the overlap is verified word by word: it
is a leak if in some :data:`WINDOW` words of the item (all, if it has fewer) a share of
at least :data:`SHARE` is equal. Any window of 13 words with two replaced has a span that
avoids them both. Shorter items have masks of their own length, one of which avoids any
fifth of its words (two of 10 to 12, one of 5 to 9); below five words all must be equal.

The test side goes to the executors in blocks of items of at most :data:`BLOCK_WORDS`
words; each block scans all documents. An item without a word matches nothing.

Cases: null and empty texts match nothing. A null doc_id or item_id stays null. Repeated
items and documents give a row each. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_small, release
from .words import ALNUM, hashed_words, mix, raw_bytes

#: Places of a span that count. In each 13 words with any two replaced, one of these fits beside them.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 9, 10, 11))
WINDOW = 13
SHARE = 0.8
BLOCK_WORDS = 2_000_000
BITS = 22

SCHEMA = "doc_id long, item_id long, doc_word long, n_words long, matched long, similarity double"


def words(text: str | None) -> np.ndarray:
    return hashed_words(raw_bytes(text.lower() if text else text), ALNUM)[0]


def span_hashes(w: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    n = len(w) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in mask:
            out = (out ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mix(out)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of n words, fewer than WINDOW: beside any n // 5 replaced words one of them fits."""
    out = n // 5
    parts = np.array_split(np.arange(n), out + 2) if out else [np.arange(n)]
    return [tuple(np.concatenate(kept).tolist()) for kept in combinations(parts, len(parts) - out)]


class Seeds:
    """The test side of some items: sorted span hashes, and the item and place of each."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        # (words of the items it is for, or 0 for all of WINDOW or more; mask from its first place on; that place)
        self.masks = [(0, m, 0) for m in MASKS] + [(n, tuple(x - m[0] for x in m), m[0]) for n in sorted({len(w) for w in self.words if 0 < len(w) < WINDOW}) for m in short_masks(n)]
        hashes, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, int)], [np.zeros(0, int)]
        for k, w in enumerate(self.words):
            for salt, (n, mask, first) in enumerate(self.masks):
                if n == (len(w) if len(w) < WINDOW else 0):
                    h = span_hashes(w[first:], mask, salt)
                    h = h[:1] if n else h  # a short item's mask has one place
                    hashes.append(h)
                    item.append(np.full(len(h), k))
                    place.append(np.arange(len(h)) + first)
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.place = h[order], np.concatenate(item)[order], np.concatenate(place)[order]
        self.present = np.zeros(1 << BITS, bool)
        self.present[(self.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def leaks(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item number, document word of the item's first word, equal words, best share of a window) by item."""
        w = words(text)
        found: set[tuple[int, int]] = set()
        for salt, (_, mask, _) in enumerate(self.masks):
            h = span_hashes(w, mask, salt)
            at = np.flatnonzero(self.present[(h >> np.uint64(64 - BITS)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            n = hi - lo
            pos, k = np.repeat(at, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.update(zip(self.item[k].tolist(), (pos - self.place[k]).tolist(), strict=True))
        best: dict[int, tuple[int, int, int, float]] = {}
        for k, start in sorted(found):
            item = self.words[k]
            a, b = max(0, start), min(len(w), start + len(item))
            equal = np.zeros(len(item), np.int64)
            equal[a - start : b - start] = w[a:b] == item[a - start : b - start]
            size = min(WINDOW, len(item))
            total = np.concatenate(([0], np.cumsum(equal)))
            share = float((total[size:] - total[:-size]).max()) / size
            if share >= SHARE and (k not in best or int(total[-1]) > best[k][2]):
                best[k] = (k, start, int(total[-1]), share)
        return list(best.values())


def _scan(docs: DataFrame, items: list[tuple[int | None, str | None]]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_WORDS words and one item more

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        seeds = Seeds(held.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                for k, start, equal, share in seeds.leaks(text):
                    rows.append((doc_id, seeds.ids[k], start, len(seeds.words[k]), equal, share))
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "doc_word", "n_words", "matched", "similarity"])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

    return map_small(docs, run, SCHEMA)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text) and benchmark item (item_id, text) that it leaks: its best alignment."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0  # no fewer than its words
    n_blocks = max(1, -(-total // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    return reduce(DataFrame.unionByName, (_scan(texts, [(r["item_id"], r["text"]) for r in items.where(block == k).collect()]) for k in range(n_blocks)))
