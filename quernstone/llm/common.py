"""Shared storage, names and small guards used by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quernstone.plans.lineage import shared_dir


_held: dict[tuple[str, str], Any] = {}


def only_one(kind: str, key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` builds, kept for later tasks of a worker process until it builds something else.

    A process holds one such memo at a time, so that a job of many operators needs no
    more memory than the one with the largest.
    """
    if (kind, key) not in _held:
        _held.clear()
        _held[kind, key] = make()
    return _held[kind, key]


def release() -> None:
    """Called by a task that needs no memo: what an earlier operator kept in this worker goes."""
    _held.clear()


def table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and reread it: lineage ends here."""
    spark = df.sparkSession
    path = table_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quernstone_path = path
    return out


#: Rows of an Arrow batch at most where texts go to Python.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS: executors hold two batches of whole texts a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _frame(part: pa.RecordBatch | pa.Table) -> pd.DataFrame:
    """As pandas; integers stay exact where a column has nulls."""
    exact = any(c.null_count and pa.types.is_integer(c.type) for c in part.columns)
    return part.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get if exact else None)


def map_large(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 1 << 16) -> DataFrame:
    """Like ``mapInPandas`` for rows of a few numbers: Arrow batches of any size are put together to ``rows`` rows or more."""
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def large() -> Iterator[pd.DataFrame]:
            held: list[pa.RecordBatch] = []
            n = 0
            for b in batches:
                if b.num_rows:
                    held.append(b)
                    n += b.num_rows
                if n >= rows:
                    frame, held, n = _frame(pa.Table.from_batches(held)), [], 0
                    yield frame
            if held:
                yield _frame(pa.Table.from_batches(held))

        for frame in run(large()):
            if len(frame):
                yield pa.RecordBatch.from_pandas(frame, schema=out_schema, preserve_index=False)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(go, schema)


def map_small(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 512) -> DataFrame:
    """Like ``mapInPandas``, but texts become Python strings a few rows at a time, not a whole Arrow batch."""
    out_schema = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def small() -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    yield _frame(b.slice(at, rows))

        for frame in run(small()):
            if len(frame):
                yield pa.RecordBatch.from_pandas(frame, schema=out_schema, preserve_index=False)
        pa.default_memory_pool().release_unused()  # the worker may idle beside others

    return df.mapInArrow(go, schema)


#: Bytes of text that :func:`text_slices` puts together, about.
SLICE_BYTES = 8_000_000


def text_slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, each row counted with 16 more; a longer text ends its batch."""
    held: list[pa.RecordBatch] = []
    left = size
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False) + 16, dtype=np.int64)
        at = done = 0
        while at < b.num_rows:
            to = min(int(np.searchsorted(ends, done + left)) + 1, b.num_rows)
            held.append(b.slice(at, to - at))
            left -= int(ends[to - 1]) - done
            at, done = to, int(ends[to - 1])
            if left <= 0:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, left = [], size
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], schema: str) -> DataFrame:
    """Like ``mapInArrow`` on :func:`text_slices`; ``run`` gives the columns of ``schema``."""
    out_schema = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(text_slices(batches)):
            yield pa.RecordBatch.from_arrays(columns, schema=out_schema)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(go, schema)


def with_text_columns(df: DataFrame, compute: Callable[[], Callable[[list[str | None]], list[Sequence]]], schema: str, rows: int = 512) -> DataFrame:
    """``df`` with columns of ``schema`` computed from its text; other columns pass through as Arrow data.

    ``compute()`` is called once a task; what it gives takes some texts and returns the columns' values.
    """
    small_batches(df.sparkSession)
    new = StructType.fromDDL(schema)
    at_text, kinds = df.columns.index("text"), [f.type for f in to_arrow_schema(new)]
    out_schema = StructType([*df.schema.fields, *new.fields])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compute()
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                found = run(part.column(at_text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, k) for v, k in zip(found, kinds, strict=True))], names=out_schema.names)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(go, out_schema)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote, once nothing reads it any more."""
    path = getattr(df, "_quernstone_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (names don't differ by case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def doc_crc(column: str = "doc_id"):
    """crc32 of a document id written as text (null id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
