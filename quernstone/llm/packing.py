"""Best-fit packing planned over the histogram of lengths.

Documents become pieces of at most ``capacity`` ids. Only the number of pieces of
each length reaches the driver: at most ``capacity`` rows at any input size. The
plan runs best-fit decreasing on those counts: all pieces of a length go at once
into the fullest open sequences that still hold them. The plan is a list of slot
ranges; a piece takes the slot whose number is its rank within its length.

Cases: a null text is empty, its document is the end id alone. Repeated rows are
packed each. A null doc_id stays null. An empty table gives no rows. Other columns
of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize
from .tokens import END_ID, ChunkEncoder, default_vocabulary

CAPACITY = 1024
#: Ids are handed on once there are so many bytes of them.
OUT_BYTES = 2_000_000
#: The table of ranks before each part is broadcast up to so many rows (24 bytes each), and shuffled beyond.
BROADCAST_ROWS = 500_000


class Slots(NamedTuple):
    """Slots of one length: ranks from first_rank on lie in sequences from sequence on, at offset."""

    length: int
    first_rank: int
    count: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """Best-fit decreasing over counts. Work and result depend on ``capacity``, not on the counts."""
    groups: dict[int, list[tuple[tuple[int, ...], int, int]]] = defaultdict(list)  # room: (lengths, first sequence, sequences)
    out: list[Slots] = []
    sequences = 0
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit into {capacity}")
        left, rank = histogram[length], 0
        while left:
            room = next((r for r in range(length, capacity) if groups.get(r)), capacity)
            if room == capacity:
                per = capacity // length
                whole, rest = divmod(left, per)
                found = [((length,) * k, sequences + (whole if k == rest else 0), n) for k, n in ((per, whole), (rest, 1)) if k and n and (k == per or rest)]
                for lengths, first, n in found:
                    for k in range(len(lengths)):
                        out.append(Slots(length, rank, n, first, k * length))
                        rank += n
                    groups[capacity - length * len(lengths)].append((lengths, first, n))
                    sequences += n
                left = 0
                continue
            lengths, first, n = groups[room].pop()
            take = min(n, left)
            if take < n:
                groups[room].append((lengths, first + take, n - take))
            out.append(Slots(length, rank, take, first, capacity - room))
            groups[room - length].append(((*lengths, length), first, take))
            rank, left = rank + take, left - take
    return out


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian uint32), part, local_rank: written to the shared folder.

    A document longer than ``capacity`` is cut so that all its pieces but the first are full.
    """
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        encoder, part = ChunkEncoder.shared(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, starts = encoder.encode_all(batch.column("text"), [END_ID])
            n = np.diff(starts)
            parts = -(-n // capacity)
            first = (n - (parts - 1) * capacity).repeat(parts)
            doc = np.arange(len(n)).repeat(parts)
            piece = np.arange(len(doc)) - (np.cumsum(parts) - parts).repeat(parts)
            start = np.where(piece, first + (piece - 1) * capacity, 0)
            length = np.where(piece, capacity, first)

            order = np.argsort(length, kind="stable")
            counts = np.bincount(length, minlength=capacity + 1)
            rank = np.empty_like(length)
            rank[order] = np.arange(len(length)) - (np.cumsum(counts) - counts)[length[order]]
            rank += seen[length]
            seen += counts

            ends = np.cumsum(length)
            at = 0
            while at < len(doc):
                begin = starts[doc[at]] + start[at]
                to = max(int(np.searchsorted(ends, begin + OUT_BYTES // 4)), at + 1)
                offsets = np.concatenate(([0], ends[at:to] - begin)).astype(np.int32) * 4
                found = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids[begin : ends[to - 1]]))])
                own = slice(at, to)
                yield [
                    batch.column("doc_id").take(pa.array(doc[own])),
                    pa.array(piece[own], pa.int32()),
                    pa.array(start[own]),
                    pa.array(length[own]),
                    found,
                    pa.array(np.full(to - at, part, np.int32)),
                    pa.array(rank[own]),
                ]
                at = to

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(map_texts(read, cut, "doc_id long, piece int, start long, length long, ids binary, part int, local_rank long"), "pieces")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to what :func:`pieces` made; the ids stay beside them."""
    counts = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots: dict[int, tuple[np.ndarray, ...]] = {}
    by_length = defaultdict(list)
    for s in plan(histogram, capacity):
        by_length[s.length].append(s)
    for length, found in by_length.items():
        slots[length] = tuple(np.array([getattr(s, f) for s in found], np.int64) for f in ("first_rank", "sequence", "offset"))

    ranked = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(ranked), F.lit(0)).alias("before"))
    if counts.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(ranks), 2), np.int64)
        order = np.argsort(lengths, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            first, sequence, offset = slots[int(lengths[own[0]])]
            k = np.searchsorted(first, ranks[own], "right") - 1
            out[own, 0], out[own, 1] = sequence[k] + ranks[own] - first[k], offset[k]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return (
        cut.join(before, ["part", "length"])
        .withColumn("slot", slot("length", F.col("local_rank") + F.col("before")))
        .select("doc_id", "piece", "start", "length", "ids", F.col("slot.sequence_id").alias("sequence_id"), F.col("slot.offset").alias("offset"))
    )


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return place(pieces(docs, vocabulary, capacity), capacity)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
