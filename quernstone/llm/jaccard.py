"""Near-duplicates by the Jaccard similarity of 5-word shingles, for the pipeline.

Two texts link if their sets of shingles (of lower-cased words) have a similarity of at
least :data:`SHARE`. Equal sets are one node at once. In any one order of all shingles two
such sets have a common shingle among the first ``n - ceil(SHARE n) + 1`` of each, so the
nodes that meet at a key of these prefixes hold all links. Shingles found often in a
sixteenth of the texts come last in the order; that changes the work, not what is found.

Keys are sorted by ranges once; what is kept is the runs of keys that several nodes have,
each row with its neighbour by size. Candidates are verified in two rounds. The first has
the links of :mod:`simhash` (of 5-word shingles) and these neighbours. The second has all
pairs of nodes at a key that lie in different components by then; where a key has many nodes,
they are compared within tasks in blocks, and not handed on. Candidates leave in order
of cost: sizes and places in the prefixes that rule SHARE out, then signatures, then the
texts. A signature has a byte of the least shingle of each of :data:`BINS` hash ranges; a
pair goes only if pairs of similarity SHARE agree in so few ranges with a probability below
e**-:data:`SURE`, less than that of two shingles having one 64-bit hash. Nothing is capped
or sampled.

Cases: texts of fewer than SHINGLE_WORDS words have one shingle, their words; null texts
and texts without words are one node. Sets and shingles are told apart by 64-bit hashes.
A null doc_id is a member, but never names a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import simhash
from .common import discard, map_large, map_small, materialize, release, shuffle_partitions
from .components import components
from .runs import forest, runs
from .words import VISIBLE, hashed_words, raw_bytes, run_hashes

SHINGLE_WORDS = 5
#: The least similarity, 4 / 5.
SHARE = (4, 5)
#: Shingles in so many texts of the sixteenth come last, the most frequent HOT_KEYS (8 bytes each) at most.
HOT = 4
HOT_KEYS = 1_000_000
#: Hash ranges of a signature, and what its test risks: e**-SURE.
BINS = 256
SURE = 34.0
#: Texts that are fetched for verification are looked up by a broadcast table of hashes (16 bytes each) up to so many.
BROADCAST_TEXTS = 2_000_000
#: Keys of more nodes of different components are compared within tasks, in blocks of about BLOCK nodes; pairs of the others are handed on.
RUN = 64
BLOCK = 1024
#: Shingles (8 bytes each) that a task holds of texts it may meet again.
HELD_SHINGLES = 1_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def shingles(text: str) -> np.ndarray:
    """The sorted set of shingle hashes of a text that :func:`normal` gave."""
    words = hashed_words(raw_bytes(text), VISIBLE)[0]
    return np.unique(run_hashes(words, min(SHINGLE_WORDS, len(words)))) if len(words) else np.zeros(0, np.uint64)


def prefix(found: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The shingles of a set that come first: one of them is in each set that links."""
    n = len(found)
    if not n:
        return found
    at = np.searchsorted(hot, found)
    late = np.append(hot, 0)[at] == found if len(hot) else np.zeros(n, bool)
    late &= at < len(hot)
    return np.concatenate((found[~late], found[late]))[: n - -(-SHARE[0] * n // SHARE[1]) + 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * SHARE[1] >= SHARE[0] * (len(a) + len(b) - common)


_RANGES = np.arange(BINS, dtype=np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """For each range of hashes a byte of the set's least shingle in it, 0 without one."""
    if not len(found):
        return np.zeros(BINS, np.uint8)
    at = np.minimum(np.searchsorted(found, _RANGES << np.uint64(56)), len(found) - 1)
    least = found[at]
    return np.where(least >> np.uint64(56) == _RANGES, 1 + least % np.uint64(255), 0).astype(np.uint8)


def _least_equal() -> np.ndarray:
    """For m ranges that either set has: in how many a pair of similarity SHARE agrees but for a probability of e**-SURE (Chernoff's bound)."""
    share, out = SHARE[0] / SHARE[1], np.zeros(BINS + 1, np.int64)
    for m in range(1, BINS + 1):
        t = np.arange(m + 1) / m
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.nan_to_num(t * np.log(t / share)) + np.nan_to_num((1 - t) * np.log((1 - t) / (1 - share)))
        out[m] = np.flatnonzero((m * far < SURE) | (t >= share))[0]
    return out


LEAST_EQUAL = _least_equal()


def may_link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows of signatures: whether they agree in enough ranges."""
    return ((x == y) & (x > 0)).sum(1) >= LEAST_EQUAL[((x > 0) | (y > 0)).sum(1)]


def _hot(texts: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.uint64), *(shingles(normal(t)) for t in b["text"])]).view(np.int64)})

    part = texts.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).select("text").distinct()
    often = map_small(part, run, "h long", 64).groupBy("h").count().where(F.col("count") >= HOT)
    return np.sort(often.orderBy(F.desc("count"), "h").limit(HOT_KEYS).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), fp (SimHash), node (hash of the set), n (its size), sig and keys (its prefix) for all rows; written."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hot = _hot(texts)
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        hot = held.value
        for b in batches:
            text = [normal(t) for t in b["text"]]
            found = [shingles(t) for t in text]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"].astype("Int64"),
                    "th": b["th"],
                    "fp": np.array([simhash.fingerprint(t, SHINGLE_WORDS) for t in text], np.uint64).view(np.int64),
                    "node": np.array([_node(x) for x in found], np.int64),
                    "n": np.array([len(x) for x in found], np.int32),
                    "sig": [signature(x).tobytes() for x in found],
                    "keys": [prefix(x, hot).view(np.int64) for x in found],
                }
            )

    schema = "doc_id long, th long, fp long, node long, n int, sig binary, keys array<long>"
    return materialize(map_small(texts.select("doc_id", "text", F.xxhash64("text").alias("th")), run, schema, 64), "sketches")


def _node(found: np.ndarray) -> int:
    h = xxh64_intdigest(found.tobytes(), 7)
    return h - 2**64 if h >= 2**63 else h


def _meetings(sketch: DataFrame) -> DataFrame:
    """h, node, n, place of keys that several nodes have, and near, near_n, near_place of the node before by size; written.

    Sorting is by ranges of (key, size, node), so a key of any frequency is spread; rows at
    the edge of a batch are kept unseen, which costs work alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last row so far
        for b in batches:
            if not len(b):
                continue
            b = b.assign(new=True)
            if held is not None:
                b = pd.concat((held, b), ignore_index=True)
            h, node, np_ = (b[c].to_numpy() for c in ("h", "node", "np"))
            once = np.ones(len(b), bool)  # equal sets in other rows
            once[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
            b, h, node, np_ = b[once], h[once], node[once], np_[once]
            same = h[1:] == h[:-1]
            before = np.concatenate(([False], same))
            several = before | np.concatenate((same, [True]))
            several[0] = True  # the partition before may have had its key
            out = pd.DataFrame({"h": h, "node": node, "np": np_, "near": pd.array(np.concatenate(([0], node[:-1])), dtype="Int64"), "near_np": pd.array(np.concatenate(([0], np_[:-1])), dtype="Int64")})
            out.loc[~before, ["near", "near_np"]] = pd.NA
            yield out[several & b["new"].to_numpy()]
            held = b.iloc[-1:].assign(new=False)

    order = ["h", "np", "node"]
    # size and place in one number, sizes first
    rows = sketch.select("node", "n", F.posexplode("keys").alias("place", "h")).select("h", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("place")).alias("np"), "node")
    sorted_ = rows.repartitionByRange(shuffle_partitions(sketch.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(map_large(sorted_, run, "h long, node long, np long, near long, near_np long"), "meetings")


def _possible(a: str, b: str) -> str:
    """SQL over two packed sizes and places: what is common is this shingle and later ones, if it is the first in common."""
    n1, p1, n2, p2 = (f"shiftright({x}, 32)" if k else f"({x} & 4294967295)" for x in (a, b) for k in (1, 0))
    return f"{SHARE[1] + SHARE[0]} * least({n1} - {p1}, {n2} - {p2}) >= {SHARE[0]} * ({n1} + {n2})"


class _Sets:
    """Shingles of texts that a task meets again soon, as joins and sorts leave equal ones together."""

    def __init__(self) -> None:
        self._held: dict[int, np.ndarray] = {}
        self._size = 0

    def of(self, key: int, text: str) -> np.ndarray:
        if key not in self._held:
            if self._size > HELD_SHINGLES:
                self._held, self._size = {}, 0
            self._held[key] = shingles(normal(text))
            self._size += len(self._held[key])
        return self._held[key]


def _texts(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """th, text of the texts with these hashes; written. Documents are scanned, not shuffled, unless very many are wanted."""
    wanted = materialize(hashes.select("th").distinct(), "wanted")
    lookup = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    found = docs.select(F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text")).join(lookup, "th", "left_semi")
    out = materialize(found.groupBy("th").agg(F.min("text").alias("text")), "pair-texts")
    discard(wanted)
    return out


def _verified(pairs: DataFrame, sketch: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link; written."""
    pairs = materialize(pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # the least text hash of a node: one text stands for it
    sigs = materialize(sketch.select("node", "th", "sig").join(used, "node", "left_semi").groupBy("node").agg(F.min_by("sig", "th").alias("sig"), F.min("th").alias("th")), "signatures")

    def filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(-1, BINS) for c in ("x", "y"))
                yield b.loc[may_link(x, y), ["a", "b", "th_a", "th_b"]]

    first = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x"), F.col("th").alias("th_a")), "a")
    both = first.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("y"), F.col("th").alias("th_b")), "b").select("a", "b", "th_a", "th_b", "x", "y")
    left = materialize(map_large(both, filtered, "a long, b long, th_a long, th_b long", 1 << 13), "pairs-left")
    texts = _texts(docs, left.select(F.col("th_a").alias("th")).unionByName(left.select(F.col("th_b").alias("th"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = _Sets()
        for b in batches:
            kept = [similar(sets.of(i, x), sets.of(j, y)) for i, x, j, y in zip(b["th_a"], b["x"], b["th_b"], b["y"], strict=True)]
            yield b.loc[np.array(kept, bool), ["a", "b"]]

    first = left.join(texts.select(F.col("th").alias("th_a"), F.col("text").alias("x")), "th_a")
    both = first.join(texts.select(F.col("th").alias("th_b"), F.col("text").alias("y")), "th_b").select("a", "b", "th_a", "th_b", "x", "y")
    out = materialize(map_small(both, run, "a long, b long", 64), "jaccard-links")
    for done in (pairs, sigs, left, texts):
        discard(done)
    return out


def linked_across(sets: list[np.ndarray], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what similar sets of different roots connect; a's common shingles with all others are counted at once."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    value, by = every[order], owner[order]
    names, counts = np.unique(root, return_counts=True)
    found_a, found_b = [np.zeros(0, int)], [np.zeros(0, int)]
    for i in np.flatnonzero(root != names[counts.argmax()]):  # one end of a pair is outside the largest component
        lo, n = np.searchsorted(value, sets[i], "left"), np.searchsorted(value, sets[i], "right")
        n -= lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(by[at], minlength=len(sets))
        near = np.flatnonzero((common * (SHARE[0] + SHARE[1]) >= SHARE[0] * (size + size[i])) & (root != root[i]))
        found_a.append(np.full(len(near), i))
        found_b.append(near)
    label = forest(len(sets), np.concatenate(found_a), np.concatenate(found_b))
    own = np.flatnonzero(label != np.arange(len(sets)))
    return own, label[own]


def _crossing(meet: DataFrame, found: DataFrame, sketch: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: links between nodes of different components; written.

    Keys of a few nodes hand on their pairs: of components first, so nodes of one never
    meet, if sizes and places may do. At a key of more than RUN nodes pairs would grow
    with the square of its nodes: there texts are compared within tasks, in blocks of
    about BLOCK nodes, each two blocks in one task, which hands on a spanning forest.
    """
    rooted = materialize(meet.select("h", "node", "np").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    several = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("nodes")).where("lo < hi").select("h", "nodes")
    crossing = materialize(rooted.join(several, "h"), "crossing")
    few = crossing.where(F.col("nodes") <= RUN)
    groups = few.select("h", "root").distinct()
    two = groups.select("h", F.col("root").alias("r1")).join(groups.select("h", F.col("root").alias("r2")), "h").where("r1 < r2")
    x = few.select("h", F.col("root").alias("r1"), F.col("node").alias("a"), F.col("np").alias("np1"))
    y = few.select("h", F.col("root").alias("r2"), F.col("node").alias("b"), F.col("np").alias("np2"))
    pairs = materialize(two.join(x, ["h", "r1"]).join(y, ["h", "r2"]).where(_possible("np1", "np2")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "crossing-pairs")
    links = _verified(pairs, sketch, docs)
    many = crossing.where(F.col("nodes") > RUN)
    if not many.isEmpty():
        links = links.unionByName(_compared(many, sketch, docs))
    for done in (rooted, crossing, pairs):
        discard(done)
    return links


def _compared(many: DataFrame, sketch: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: links of (h, node, root, nodes) at keys of many nodes; written."""
    nodes = materialize(sketch.select("node", "th").join(many.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("th").alias("th")), "nodes")
    texts = _texts(docs, nodes)
    blocks = F.ceil(F.col("nodes") / BLOCK).cast("int")
    placed = many.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    by = ["h", "p", "q"]
    placed = placed.select("h", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node", "root")
    rows = placed.join(nodes, "node").join(texts, "th").select(*by, "node", "root", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = _Sets()
        for _, b, starts in runs(batches, by, None):
            node, root = b["node"].to_numpy(), b["root"].to_numpy()
            own = [sets.of(i, t) for i, t in zip(node, b["text"], strict=True)]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                x, y = linked_across(own[lo:hi], root[lo:hi])
                yield pd.DataFrame({"a": node[lo:hi][x], "b": node[lo:hi][y]})

    sorted_ = rows.repartition(shuffle_partitions(docs.sparkSession), *by).sortWithinPartitions(*by)
    out = materialize(map_small(sorted_, run, "a long, b long"), "compared")
    discard(nodes)
    discard(texts)
    return out


def near_duplicates(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, component_id for all rows of (doc_id, text); ``more``: th (hash of the text), root (of the component, its least node)."""
    sketch = sketches(docs)
    meet = _meetings(sketch)
    classes = materialize(sketch.groupBy("fp").agg(F.min("node").alias("rep")), "fp-nodes")
    bits = simhash.links(classes.select("fp"))
    bits = bits.join(classes.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(classes.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b")
    near = meet.where(f"near IS NOT NULL AND {_possible('np', 'near_np')}").select(F.col("node").alias("a"), F.col("near").alias("b"))
    first = _verified(bits.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(near), sketch, docs)
    found = components(first.unionByName(_crossing(meet, components(first), sketch, docs)))
    least = sketch.groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = materialize(least.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id", "root")
    out = sketch.select("doc_id", "th", "node").join(named, "node").select("doc_id", "component_id", *more)
    discard(meet)
    discard(classes)
    return out
