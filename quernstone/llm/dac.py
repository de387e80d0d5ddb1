"""Token ids as directly addressable codes, written and read through Spark's writers.

A segment holds the ids of consecutive documents. Ids are cut into 8-bit chunks:
level 0 has the low chunk of every id, level k the k-th chunk of those ids that
have one. A continuation bitmap beside each level marks the ids that go on, and a
rank directory (set bits before each 512-bit block) leads from an id's place in
one level to its place in the next, so any id is read without decoding others.

Layout, little-endian: magic ``QDAC1``; uint8 levels; uint64 documents; uint64
ids; int64 doc_id each (a null id is the int64 minimum); uint64 ids before each
document, and the total; then for each level uint64 size, the chunks, the bitmap
(low bit first) and the directory's uint32 entries.

Cases: a null or empty text has the end id alone. A null doc_id comes first and is
null again when read. Repeated ids are ordered by a hash of the text; equal rows are
interchangeable. An empty table gives no segments and no rows. Other columns of the
input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_texts, materialize, shuffle_partitions
from .tokens import END_ID, ChunkEncoder, default_vocabulary

MAGIC = b"QDAC1"
NULL_ID = -(2**63)
BLOCK_BITS = 512
#: Ids of a segment, about; a document is never split over segments.
SEGMENT_IDS = 1 << 16


def encode_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    named = np.array([NULL_ID if x is None else x for x in doc_ids], "<i8")
    return _segment(named, np.array([len(x) for x in ids], np.int64), ids)


def _segment(named: np.ndarray, n_ids: np.ndarray, ids: list[np.ndarray]) -> bytes:
    """``named``: a null id is NULL_ID; ``n_ids``: ids of each document; ``ids``: those of all documents, in any parts."""
    values = np.concatenate(ids).astype("<u4") if ids else np.zeros(0, "<u4")
    total, levels, out = len(values), 0, []
    while len(values) or not levels:
        goes_on = values > 255
        bits = np.packbits(goes_on, bitorder="little")
        full = np.zeros(-(-len(bits) // 64) * 64, np.uint8)
        full[: len(bits)] = bits
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(full.reshape(-1, 64)).sum(1, dtype=np.int64))))[:-1].astype("<u4")
        out += [struct.pack("<Q", len(values)), (values & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        values, levels = values[goes_on] >> 8, levels + 1
    starts = np.concatenate(([0], np.cumsum(n_ids))).astype("<u8")
    return b"".join([MAGIC, struct.pack("<BQQ", levels, len(named), total), named.astype("<i8").tobytes(), starts.tobytes(), *out])


class Segment:
    """A segment as read back: ``at(i)`` is one id, ``ids()`` all of them."""

    def __init__(self, data: bytes):
        if data[:5] != MAGIC:
            raise ValueError("not a segment of this format")
        n_levels, n_docs, self.n_ids = struct.unpack_from("<BQQ", data, 5)
        p = 22
        take = lambda kind, n: np.frombuffer(data, kind, n, p)
        self.doc_ids = take("<i8", n_docs)
        p += 8 * n_docs
        self.starts = take("<u8", n_docs + 1).astype(np.int64)
        p += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, p)
            p += 8
            chunks = take(np.uint8, n)
            p += n
            bits = take(np.uint8, -(-n // 8))
            p += len(bits)
            ranks = take("<u4", -(-len(bits) // 64))
            p += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def at(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK_BITS
            within = np.bitwise_count(bits[block * 64 : i >> 3]).sum() + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            i, shift = int(ranks[block]) + int(within), shift + 8
        raise ValueError("the last level goes on")

    def ids(self) -> np.ndarray:
        out = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            goes_on = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            value = chunks.astype(np.uint32)
            value[goes_on] |= out << 8
            out = value
        return out


def write_segments(docs: DataFrame, vocabulary: str | None = None, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Segments of ``docs`` (doc_id, text) in ascending doc_id order, written to the shared folder.

    Rows: part int, local_start long (ids before it in the part), n_ids long, segment binary.
    Parts follow each other in doc_id order.
    """
    path = vocabulary or default_vocabulary()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        encoder, part = ChunkEncoder.shared(path), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, ...]] = []
        size = start = 0

        def columns(done: list[tuple[int, int, bytes]]) -> list[pa.Array]:
            starts, sizes, found = zip(*done, strict=True)
            return [pa.array([part] * len(done), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())]

        def segment() -> tuple[int, int, bytes]:
            names, counts, ids = zip(*held, strict=True)
            return start, size, _segment(np.concatenate(names), np.concatenate(counts), list(ids))

        for batch in batches:
            ids, starts = encoder.encode_all(batch.column("text"), [END_ID])
            names, counts = batch.column("doc_id").to_numpy(), np.diff(starts)
            done, at = [], 0
            while at < len(names):
                to = min(max(int(np.searchsorted(starts, starts[at] + segment_ids - size)), at + 1), len(names))
                held.append((names[at:to], counts[at:to], ids[starts[at] : starts[to]]))
                size += int(starts[to] - starts[at])
                if size >= segment_ids:
                    done.append(segment())
                    held, size, start = [], 0, start + size
                at = to
            if done:
                yield columns(done)
        if held:
            yield columns([segment()])

    dealt = (
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    return materialize(map_texts(dealt, segments, "part int, local_start long, n_ids long, segment binary"), "dac")


def read_documents(segments: DataFrame) -> DataFrame:
    """Documents of written segments: doc_id, start long, n_tokens long, ids binary (little-endian uint32).

    Only a total for each part comes to the driver: as many rows as the shuffle had partitions.
    """
    totals = sorted(segments.groupBy("part").agg(F.sum("n_ids")).collect())
    before, run = {}, 0
    for part, n in totals:
        before[part] = run
        run += n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, local, data in zip(*(batch.column(c).to_pylist() for c in ("part", "local_start", "segment")), strict=True):
                s = Segment(data)
                ids, starts, n = s.ids().astype("<u4", copy=False), s.starts, len(s.doc_ids)
                found = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(starts * 4), pa.py_buffer(ids)]).cast(pa.binary())
                columns = [pa.array(s.doc_ids, mask=s.doc_ids == NULL_ID), pa.array(starts[:-1] + (before[part] + local)), pa.array(np.diff(starts)), found]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        pa.default_memory_pool().release_unused()

    fields = "doc_id long, start long, n_tokens long, ids binary"
    schema = to_arrow_schema(StructType.fromDDL(fields))
    return segments.select("part", "local_start", "segment").mapInArrow(documents, fields)


def tokens_at(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """position, id: single ids of written segments by their place among all ids, without decoding any other.

    ``wanted`` has position long; places beyond the last id give no row, a place asked for
    twice is given once. Positions meet segments by an equi join on ranges of
    :data:`SEGMENT_IDS` ids; a segment's bytes are read in the task that holds them.
    """
    spark = segments.sparkSession
    before, run = [], 0
    for part, n in sorted(segments.groupBy("part").agg(F.sum("n_ids")).collect()):
        before.append((part, run))
        run += n
    first = spark.createDataFrame(before, "part int, before long")
    placed = segments.select("part", "local_start", "n_ids").join(F.broadcast(first), "part").select("part", "local_start", "n_ids", (F.col("before") + F.col("local_start")).alias("begin"))
    bin_of = lambda c: F.floor(c / SEGMENT_IDS)
    ranges = placed.withColumn("bin", F.explode(F.sequence(bin_of(F.col("begin")), bin_of(F.col("begin") + F.col("n_ids") - 1))))
    asked = wanted.select("position").where("position >= 0").distinct().withColumn("bin", bin_of(F.col("position")))
    hit = asked.join(ranges, "bin").where("position >= begin AND position < begin + n_ids").select("part", "local_start", "begin", "position")

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, last, s = [], None, None
            for local, begin, position, data in zip(batch["local_start"], batch["begin"], batch["position"], batch["segment"], strict=True):
                if s is None or (begin, local) != last:
                    s, last = Segment(data), (begin, local)
                rows.append((position, s.at(position - begin)))
            yield pd.DataFrame(rows, columns=["position", "id"])

    return hit.join(segments.select("part", "local_start", "segment"), ["part", "local_start"]).select("local_start", "begin", "position", "segment").mapInPandas(look_up, "position long, id long")


def digest(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
