"""Connected components by alternating large and small stars.

Each round replaces edges so that nodes point to smaller ones until every component is
a star around its least node. A node's neighbours are never gathered: a round has two
minima per node, summed map-side, and two joins whose large partitions AQE may split.
Rounds are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    # a sum of hashes that can't overflow in ANSI mode
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """From links (a long, b long) to (node long, root long) for all nodes in links; root is the least node reached.

    Links of a node to itself and null ends are ignored. No links give no rows.
    """
    edges = materialize(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written, so that both sides of a join are plain exchanges, which AQE can split at a hub
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(small, "links")
        for done in (edges, least, large, low):
            discard(done)
        edges, before = new, state
        state = _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components didn't settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
