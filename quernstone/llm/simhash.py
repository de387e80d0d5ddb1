"""SimHash near-duplicates with pivot distance tables.

Every text becomes a 64-bit fingerprint of its 3-word shingles. Two fingerprints link
at :data:`RADIUS` or fewer differing bits. Equal fingerprints form a class at once. The
different ones are dealt out so that all pairs that may link meet: of six blocks of
bits, two fingerprints within three bits agree on at least three, so each goes to one
bucket for each choice of three blocks (20). In a bucket a table holds the Hamming
distances of each fingerprint to :data:`PIVOTS` reference fingerprints; by the triangle
inequality a pair whose distances to a pivot differ by more than RADIUS can't link, so
pairs are discarded by their maximum coordinate difference and the survivors verified.
A bucket hands on a spanning forest of its links, not all pairs.

A bucket of more than :data:`BUCKET` different fingerprints is dealt again by the
blocks of its other 32 bits in the same way: then 48 bits agree, so a task holds at
most 65,536. Nothing is capped or sampled.

Cases: a null or empty text, or one without words, has fingerprint zero, linked like
any other. With fewer than three words the whole sequence is the one shingle. Repeated
rows are members like any other. A null doc_id is a member, but never names a component;
a component without another id has a null component_id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_small, materialize, release, shuffle_partitions
from .components import components
from .runs import forest, runs

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
PIVOTS = 32
BUCKET = 4096

_REFERENCES = np.random.default_rng(97).integers(0, 2**64, PIVOTS, dtype=np.uint64, endpoint=False)


def blocks(bits: list[int], n: int = 6) -> list[int]:
    """Masks of ``n`` blocks of about equal size."""
    return [sum(1 << b for b in part) for part in np.array_split(np.array(bits, object), n)]


def choices(bits: list[int]) -> list[int]:
    """Masks of all choices of three out of six blocks."""
    return [a | b | c for a, b, c in combinations(blocks(bits), 3)]


TABLES = choices(list(range(64)))
#: For each table the masks of its second dealing: its own bits and three blocks of the others.
SECOND = [[t | s for s in choices([b for b in range(64) if not t >> b & 1])] for t in TABLES]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    k = min(shingle_words, len(words))
    starts = [0, *ends[: len(words) - k]]
    counts, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        hashes = np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[k - 1 + at : k - 1 + at + (1 << 16)], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp long for all rows, written to the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)})

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(map_small(read, run, "doc_id long, fp long"), "fingerprints")


def pivot_table(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ _REFERENCES[None, :]).astype(np.int8)


def _survivors(fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within RADIUS: the table discards, the fingerprints verify."""
    for k in range(4):
        near = np.abs(table[a, k] - table[b, k]) <= RADIUS
        a, b = a[near], b[near]
    near = (np.abs(table[a] - table[b]) <= RADIUS).all(1)
    a, b = a[near], b[near]
    near = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
    return a[near], b[near]


def linked_pairs(fp: np.ndarray, starts: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links as positions (a, b) within the runs that ``starts`` bounds, a spanning set of each run's links."""
    table = pivot_table(fp)
    size = np.diff(starts)
    of = np.repeat(np.arange(len(size)), size)
    found_a, found_b = [], []
    small = size <= 64
    left = np.flatnonzero(small[of])
    d = 1
    while len(left):
        left = left[(left + d < len(fp))]
        left = left[of[left] == of[np.minimum(left + d, len(fp) - 1)]]
        a, b = _survivors(fp, table, left, left + d)
        found_a.append(a)
        found_b.append(b)
        d += 1
    for k in np.flatnonzero(~small):
        order = np.arange(starts[k], starts[k + 1])
        order = order[np.argsort(table[order, 0], kind="stable")]
        first = table[order, 0]
        stop = np.searchsorted(first, first + RADIUS, "right")
        at = 0
        while at < len(order):
            rows = np.arange(at, min(len(order), at + max(1, step // max(1, int(stop[at : at + 64].max()) - at)), at + 4096))
            n = stop[rows] - rows - 1
            a = np.repeat(rows, n)
            b = a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = _survivors(fp, table, order[a], order[b])
            if len(a):  # a spanning forest of what this step found
                ids, back = np.unique(np.concatenate((a, b)), return_inverse=True)
                root = forest(len(ids), back[: len(a)], back[len(a) :])
                own = root != np.arange(len(ids))
                a, b = ids[own], ids[root[own]]
            found_a.append(a)
            found_b.append(b)
            at = rows[-1] + 1
    a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (found_a, found_b))
    root = forest(len(fp), a, b)
    own = np.flatnonzero(root != np.arange(len(fp)))
    return own, root[own]


def _link(dealt: DataFrame, limit: int | None) -> DataFrame:
    """From (t, value, fp) to (t, a, b): links, or with a null b the members of buckets above the limit."""
    schema = "t int, a long, b long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole, rows, starts in runs(batches, ["t", "value"], limit):
            fp = rows["fp"].to_numpy()
            if not whole:
                yield pd.DataFrame({"t": rows["t"].to_numpy(), "a": fp, "b": pd.array([None] * len(fp), dtype="Int64")})
                continue
            a, b = linked_pairs(fp.view(np.uint64), starts)
            if len(a):
                yield pd.DataFrame({"t": rows["t"].to_numpy()[a], "a": fp[a], "b": pd.array(fp[b], dtype="Int64")})

    n = shuffle_partitions(dealt.sparkSession)
    return dealt.repartition(n, "t", "value").sortWithinPartitions("t", "value").mapInPandas(run, schema)


def links(distinct_fp: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints of (fp) that are within RADIUS of each other."""
    masks = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(_signed(m)).alias("mask")) for k, m in enumerate(TABLES)])
    dealt = distinct_fp.select("fp", F.explode(masks).alias("m")).select(F.col("m.t").alias("t"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("value"), "fp")
    first = materialize(_link(dealt, BUCKET), "simhash-links")
    found = first.where("b IS NOT NULL").select("a", "b")
    hot = first.where("b IS NULL").select("t", F.col("a").alias("fp"))
    if not hot.isEmpty():
        inner = F.array(*[F.array(*[F.lit(_signed(m)) for m in own]) for own in SECOND])
        again = hot.select("t", "fp", F.posexplode(F.get(inner, F.col("t"))).alias("s", "mask")).select((F.col("t") * 100 + F.col("s")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
        found = found.unionByName(_link(again, None).select("a", "b"))
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for all rows of (doc_id, text)."""
    members = fingerprints(docs)
    classes = materialize(members.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes.select("fp")))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return members.join(named, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


