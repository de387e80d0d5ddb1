"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Hadamard transform; a vector's hash is
the signed axis nearest to it. A table joins two such hashes; a vector lies in the bucket
of its nearest axes and, as probes, in those with the second-nearest axis in either.
Vectors of a label that share a bucket of any table are compared by cosine in double
precision. A pair counts only in the first bucket it shares, so each link is counted once
without gathering pairs: a bucket hands on numbers of links and a spanning forest.

Equal vectors of a label are one class with a count. A bucket of more than
:data:`BUCKET` classes is cut into blocks of about :data:`BLOCK`, and each two blocks are
compared in a task of their own; nothing is capped.

Cases: a null vector or label, a vector that is zero or empty or holds a null or
non-finite number links with nothing; nor do vectors of different lengths. A null vec_id
is a member but names no component. Repeated rows link with each other. An empty table
gives no rows. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions
from .components import components
from .runs import forest, runs

THRESHOLD = 0.98
TABLES = 6
PROBES = 3
BUCKET = 2048
BLOCK = 1024

_ROW = "label long, t int, bucket long, p int, q int, block int, cid long, n long, keys binary, vec binary"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of rows; their length is a power of two."""
    size, h = x.shape[1], 1
    while h < size:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), size)
        h *= 2
    return x / np.sqrt(size)


def probes(x: np.ndarray, tables: int = TABLES, seed: int = 1000) -> np.ndarray:
    """Buckets of rows of x: rows x tables x PROBES."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    out = np.empty((len(x), tables, PROBES), np.int64)
    for t in range(tables):
        nearest = []
        for r in range(2):
            draw, y = np.random.default_rng([seed, t, r]), x
            for _ in range(3):
                y = hadamard(y * draw.choice([-1.0, 1.0], size))
            axes = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :2]
            nearest.append(axes * 2 + (np.take_along_axis(y, axes, 1) > 0))
        (a, b), many = nearest, 2 * size
        out[:, t] = np.stack([a[:, 0] * many + b[:, 0], a[:, 1] * many + b[:, 0], a[:, 0] * many + b[:, 1]], 1)
    return out


def _units(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(1, keepdims=True)  # squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _dealt(classes: DataFrame, tables: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["vec"].map(len)
            for n, own in batch.groupby(lengths):
                x = np.stack([np.asarray(v, np.float64) for v in own["vec"]])
                keys = probes(_units(x), tables)
                for at in range(0, len(own), 1000):
                    part, k = own.iloc[at : at + 1000], keys[at : at + 1000]
                    many = tables * PROBES
                    rep = lambda c, part=part, many=many: np.repeat(part[c].to_numpy(), many)
                    # the length is part of the bucket, so vectors of different lengths never meet
                    yield pd.DataFrame(
                        {
                            "label": rep("label"), "t": np.tile(np.repeat(np.arange(tables), PROBES), len(part)), "bucket": k.reshape(-1) + (n << 40), "p": 0, "q": 0, "block": 0,
                            "cid": rep("cid"), "n": rep("n"), "keys": np.repeat(np.array([r.astype("<i4").tobytes() for r in k], object), many), "vec": np.repeat(np.array([r.tobytes() for r in x[at : at + 1000]], object), many),
                        }
                    )

    return classes.select("label", "cid", "n", "vec").mapInPandas(run, _ROW)


def _pairs(x: np.ndarray, keys: np.ndarray, t: np.ndarray, bucket: np.ndarray, block: np.ndarray, cross: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of positions within runs, each only where its first shared bucket is this one."""

    def first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(a), bool)
        for at in range(0, len(a), 1 << 16):
            i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            same = (keys[i][:, :, :, None] == keys[j][:, :, None, :]).any(3)  # pairs x tables x probes
            flat = same.reshape(len(i), -1)
            k = flat.argmax(1)
            own = keys[i].reshape(len(i), -1)[np.arange(len(i)), k]
            keep[at : at + (1 << 16)] = (k // PROBES == t[i]) & (own == (bucket[i] & ((1 << 40) - 1)))
        return keep

    size = np.diff(starts)
    of = np.repeat(np.arange(len(size)), size)
    left, d = np.flatnonzero((size <= 32)[of]), 1
    while len(left):
        left = left[left + d < len(x)]
        left = left[of[left] == of[left + d]]
        a, b = left, left + d
        ok = ~cross[a] | (block[a] != block[b])
        a, b = a[ok], b[ok]
        near = np.zeros(len(a), bool)
        for at in range(0, len(a), 1 << 15):
            near[at : at + (1 << 15)] = (x[a[at : at + (1 << 15)]] * x[b[at : at + (1 << 15)]]).sum(1) >= THRESHOLD
        a, b = a[near], b[near]
        keep = first(a, b)
        yield a[keep], b[keep]
        d += 1
    for k in np.flatnonzero(size > 32):
        lo, hi = starts[k], starts[k + 1]
        for at in range(lo, hi, 512):
            a, b = np.nonzero(x[at : min(at + 512, hi)] @ x[at:hi].T >= THRESHOLD)
            a, b = a[a < b] + at, b[a < b] + at
            ok = ~cross[a] | (block[a] != block[b])
            a, b = a[ok], b[ok]
            keep = first(a, b)
            yield a[keep], b[keep]


def _link(dealt: DataFrame, limit: int | None, tables: int) -> DataFrame:
    """Rows with links not null: a class's links found here, and one it is connected to; others: members of large buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole, rows, starts in runs(batches, ["label", "t", "bucket", "p", "q"], limit):
            if not whole:
                yield rows.assign(root=pd.array([None] * len(rows), dtype="Int64"), links=pd.array([None] * len(rows), dtype="Int64"))
                continue
            for n, own in rows.groupby(rows["vec"].map(len)) if rows["vec"].map(len).nunique() > 1 else [(0, rows)]:
                if n:  # runs of one length each; their bounds anew
                    named = own[["label", "t", "bucket", "p", "q"]].to_numpy()
                    starts = np.concatenate(([0], np.flatnonzero((named[1:] != named[:-1]).any(1)) + 1, [len(own)]))
                x = _units(np.stack([np.frombuffer(v, np.float64) for v in own["vec"]]))
                keys = np.stack([np.frombuffer(v, "<i4") for v in own["keys"]]).astype(np.int64).reshape(len(own), tables, PROBES)
                t, bucket, block, cross = (own[c].to_numpy() for c in ("t", "bucket", "block", "p"))
                copies, links = own["n"].to_numpy(), np.zeros(len(own), np.int64)
                found_a, found_b = [], []
                for a, b in _pairs(x, keys, t, bucket, block, cross != own["q"].to_numpy(), starts):
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    found_a.append(a)
                    found_b.append(b)
                a, b = (np.concatenate(f) if f else np.zeros(0, int) for f in (found_a, found_b))
                root = forest(len(own), a, b)
                keep = links > 0
                if keep.any():
                    out, cid = own[keep], own["cid"].to_numpy()
                    yield out.assign(keys=None, vec=None, root=cid[root[keep]], links=links[keep])

    spark = dealt.sparkSession
    by = ["label", "t", "bucket", "p", "q"]
    return dealt.repartition(shuffle_partitions(spark), *by).sortWithinPartitions(*by).mapInPandas(run, f"{_ROW}, root long, links long")


def near_duplicates(vectors: DataFrame, tables: int = TABLES) -> DataFrame:
    """vec_id, n_links, component_id, kept for all rows of (vec_id, embedding, label)."""
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    valid = rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)))
    classes = materialize(valid.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()), "vectors")
    found = materialize(_link(_dealt(classes, tables), BUCKET, tables), "vector-links")
    done = found.where("links IS NOT NULL").select("cid", "root", "links")
    hot = found.where("links IS NULL").drop("root", "links", "p", "q", "block")
    if not hot.isEmpty():
        by = ["label", "t", "bucket"]
        blocks = hot.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"))
        placed = hot.join(blocks, by).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        placed = placed.select("label", "t", "bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "cid", "n", "keys", "vec")
        again = materialize(_link(placed, None, tables), "vector-links")
        done = done.unionByName(again.select("cid", "root", "links"))
    roots = components(done.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    linked = done.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.join(linked, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left").select("label", "vec", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    named = materialize(named, "vector-classes")
    result = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("label", "vec", "n_links", "component_id", F.lit(True).alias("_valid"))
    return rows.join(result, ["label", "vec"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("_valid"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: DuckDB SQL by comparing all pairs; for small tables.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.c, e.vec_id)) AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
