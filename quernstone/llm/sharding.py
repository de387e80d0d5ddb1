"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows of each input part go to each shard follows the multivariate
hypergeometric law, so every shard ends with exactly its size. The matrix is drawn by
halves: of a range of parts and the room it has in each shard, the first half of the
parts takes a hypergeometric draw, seeded by the range, and the rest is the second
half's. A task walks from the whole range down to its part, so the driver holds no more
than the parts' sizes, whatever the number of shards. Each part permutes its rows and
deals them out by its row of the matrix; each shard permutes what arrives. Both
permutations are keyed bijections on 0..n-1, computed for a row from its number alone,
so no task holds a part or a shard, and a task run again gives the same result.

Draws are numpy's up to its limit of 10**9, and above it by the ratio of uniforms with a
log-probability that doesn't cancel at any size; both follow the law to double precision.

Cases: null texts have no bytes and crc32 0. Repeated rows and repeated or null ids
are rows like any other. An empty table gives no rows. Input columns named like an
output column are replaced; other columns stay.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, unused

#: numpy's limit for the population of a hypergeometric draw.
NUMPY_LIMIT = 10**9

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Each index's image under the permutation of 0..size-1 that ``key`` selects.

    A balanced Feistel network over the least even number of bits that holds size,
    walked until the value is below size.
    """
    index, size, key = (np.asarray(x).astype(np.uint64) for x in np.broadcast_arrays(index, size, key))
    top = np.maximum(size, np.uint64(2)) - np.uint64(1)
    half = np.zeros(len(top), np.uint64)
    while (grow := (top >> (np.uint64(2) * half)) > 0).any():
        half[grow] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = out[todo] >> h, out[todo] & m
            for r in range(rounds):
                left, right = right, left ^ (_mix(right + _mix(k + np.uint64(r + 1) * _MIX)) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def shard_sizes(total: int, n_shards: int) -> np.ndarray:
    """At most one apart."""
    room = np.full(n_shards, total // n_shards, np.int64)
    room[: total % n_shards] += 1
    return room


def matrix_row(before: np.ndarray, part: int, n_shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A part's row of the communication matrix, and the sum of the rows of the parts before it.

    ``before`` has the number of rows before each part, and of all.
    """
    lo, hi = 0, len(before) - 1
    room = shard_sizes(int(before[-1]), n_shards)
    arrived = np.zeros(n_shards, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = _dealt(np.random.default_rng([seed, lo, hi]), room, int(before[mid] - before[lo]))
        if part < mid:
            room, hi = first, mid
        else:
            room, arrived, lo = room - first, arrived + first, mid
    return room, arrived


def _dealt(draw: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows go to each shard: a multivariate hypergeometric draw, a marginal at a time."""
    if int(room.sum()) < NUMPY_LIMIT:
        return draw.multivariate_hypergeometric(room, n, method="marginals")
    out, rest = np.zeros(len(room), np.int64), int(room.sum())
    for j, good in enumerate(room.tolist()):
        rest -= good
        out[j] = hypergeometric(draw, good, rest, n)
        n -= int(out[j])
    return out


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    if not n or not good:
        return 0
    if not bad or n == good + bad:
        return min(good, n)
    if good + bad < NUMPY_LIMIT:
        return int(draw.hypergeometric(good, bad, n))
    return ratio_of_uniforms(draw, good, bad, n)


def ratio_of_uniforms(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw by Stadlober's rejection from a table mountain hat."""
    total = good + bad
    mean = n * good / total
    sd = math.sqrt(mean * (bad / total) * ((total - n) / (total - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * sd + 3 - 2 * math.sqrt(3 / math.e)
    least, most = max(0, n - bad), min(good, n)
    mode = min(max((n + 1) * (good + 1) // (total + 2), least), most)
    top = log_probability(mode, good, bad, n)
    while True:
        u, v = 1 - draw.random(), draw.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if least <= k <= most and 2 * math.log(u) <= log_probability(k, good, bad, n) - top:
            return k


def log_probability(k: int, good: int, bad: int, n: int) -> float:
    """Of a hypergeometric k, but for a term of good, bad and n alone: two binomial terms of the same rate."""
    rate = n / (good + bad)
    return _log_binomial(k, good, rate) + _log_binomial(n - k, bad, rate)


def _log_binomial(k: int, n: int, p: float) -> float:
    """Logarithm of a binomial probability by its saddle-point form, whose terms are small where the probability isn't."""
    if k == 0:
        return n * math.log1p(-p)
    if k == n:
        return n * math.log(p)
    far = _deviance(k, n * p) + _deviance(n - k, n * (1 - p))
    return _stirling(n) - _stirling(k) - _stirling(n - k) - far + 0.5 * (math.log(n) - math.log(k) - math.log(n - k) - math.log(2 * math.pi))


def _stirling(n: int) -> float:
    """What Stirling's formula leaves of log n!."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, by a series where that would cancel."""
    v = (x - mean) / (x + mean)
    if abs(v) > 0.1:
        return x * math.log(x / mean) + mean - x
    out, term, k = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        k += 2
        new = out + term / k
        if new == out:
            return out
        out = new


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 20240229) -> DataFrame:
    """``docs`` with shard int and slot long (gapless from 0 in each shard), dealt and sorted by both."""
    spark = docs.sparkSession
    kept = docs.drop("shard", "slot")
    part, row, to = (unused(kept, c) for c in ("_part", "_row", "_to"))
    number = F.monotonically_increasing_id()
    held = materialize(kept.withColumn(part, F.shiftright(number, 33).cast("int")).withColumn(row, number.bitwiseAND(F.lit((1 << 33) - 1))), "shard")
    counts = held.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).toArrow()  # 12 bytes a part
    names, sizes = (counts.column(k).to_numpy() for k in (0, 1))
    before = np.concatenate(([0], np.cumsum(sizes)))
    state = spark.sparkContext.broadcast((names, before))

    @F.pandas_udf("shard int, slot long")
    def deal(part: pd.Series, row: pd.Series) -> pd.DataFrame:
        names, before = state.value
        ends = shard_sizes(int(before[-1]), n_shards)
        p = np.searchsorted(names, part.to_numpy())
        place = permuted(row.to_numpy(), before[p + 1] - before[p], p + seed)
        to, arrival = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for k in np.unique(p):
            own = p == k
            counts, arrived = _row_of(before, int(k), n_shards, seed)
            upto = np.cumsum(counts)
            at = np.searchsorted(upto, place[own], "right")
            to[own], arrival[own] = at, arrived[at] + place[own] - (upto - counts)[at]
        return pd.DataFrame({"shard": to.astype(np.int32), "slot": permuted(arrival, ends[to], to + seed + 10**9)})

    return (
        held.withColumn(to, deal(part, row))
        .select(*kept.columns, F.col(to)["shard"].alias("shard"), F.col(to)["slot"].alias("slot"))
        .repartitionByRange(shuffle_partitions(spark), "shard", "slot")
        .sortWithinPartitions("shard", "slot")
    )


_rows: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _row_of(before: np.ndarray, part: int, n_shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`matrix_row`, the last one kept for the next batch of a part."""
    key = (len(before), int(before[-1]), int(before[part]), part, n_shards, seed)
    if key not in _rows:
        found = matrix_row(before, part, n_shards, seed)
        _rows.clear()
        _rows[key] = found
    return _rows[key]


def digest(sharded: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return sharded.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
