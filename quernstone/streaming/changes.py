"""File changes as a stream: debounced bursts, thrashing alerts, accumulated state, snapshots.

Input rows have file_path string and ts timestamp. State is kept by key and bounded:
what a watermark or a ring no longer needs is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.operators.versions import file_diff
from quernstone.plans.lineage import cut

DEBOUNCE_MS = 500
RING, KEPT_FILES = 200, 20


def bursts(changes: DataFrame, by: str = "repo", quiet_ms: int = DEBOUNCE_MS, late: str = "10 minutes") -> DataFrame:
    """SM02. The files of each burst of a key's changes, which ends after ``quiet_ms`` without one."""
    w = F.session_window("ts", f"{quiet_ms} milliseconds")
    found = changes.withWatermark("ts", late).groupBy(by, w.alias("w")).agg(F.array_sort(F.collect_set("file_path")).alias("files"), F.count("*").alias("n_changes"))
    return found.select(by, F.col("w.start").alias("started"), F.col("w.end").alias("flushed"), "files", "n_changes")


def thrashing_alerts(changes: DataFrame, least: int = 5, minutes: int = 10, late: str = "10 minutes") -> DataFrame:
    """SM05. An alert when a file has ``least`` changes from one of them on within ``minutes``.

    Windows start at events, so fixed slides can't find them: each file's times of the last
    window are state. An alert is given once for each tumbling bucket its first change is in.
    """
    width = minutes * 60_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, given = (list(x) for x in state.get) if state.exists else ([], [])
        new = sorted(int(t.value // 1_000_000) for b in batches for t in b["ts"])
        times = sorted(times + new)
        out = []
        for k, first in enumerate(times):
            n = sum(1 for t in times[k:] if t <= first + width)
            if n >= least and first // width not in given:
                given.append(first // width)
                out.append((key[0], first, n))
        horizon = (times[-1] if times else 0) - 2 * width  # a window may still begin there, given late rows
        state.update(([t for t in times if t >= horizon], [g for g in given if (g + 1) * width >= horizon]))
        yield pd.DataFrame(out, columns=["file_path", "first_ms", "change_count"])

    return changes.withWatermark("ts", late).groupBy("file_path").applyInPandasWithState(step, "file_path string, first_ms long, change_count long", "times array<long>, given array<long>", "append", GroupStateTimeout.NoTimeout)


def accumulated(changes: DataFrame, by: str = "repo") -> DataFrame:
    """SM03. For each key: first and last change, up to 20 files, how many more there were, and a ring of 200 events.

    Events that come late are sorted into the ring; what falls out of it is gone.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, files, omitted, ring_t, ring_f = state.get if state.exists else (None, None, [], 0, [], [])
        files, ring = list(files), list(zip(ring_t, ring_f, strict=True))
        for b in batches:
            for path, t in zip(b["file_path"], b["ts"], strict=True):
                at = int(t.value // 1_000_000)
                first, last = min(at, first if first is not None else at), max(at, last if last is not None else at)
                if path not in files:
                    if len(files) < KEPT_FILES:
                        files.append(path)
                    else:
                        omitted += 1
                ring.append((at, path))
        ring = sorted(ring)[-RING:]
        state.update((first, last, files, omitted, [t for t, _ in ring], [f for _, f in ring]))
        yield pd.DataFrame([(key[0], first, last, sorted(files), omitted, len(ring))], columns=["key", "first_ms", "last_ms", "files", "omitted", "ring"])

    return changes.groupBy(by).applyInPandasWithState(step, "key string, first_ms long, last_ms long, files array<string>, omitted long, ring long", "first long, last long, files array<string>, omitted long, ring_t array<long>, ring_f array<string>", "update", GroupStateTimeout.NoTimeout)


def watch(snapshots: DataFrame, previous: DataFrame, on_diff: Callable[[DataFrame, int], None], once: bool = True, checkpoint: str | None = None) -> StreamingQuery:
    """SM01/SM04. Compares each batch of (path, content_hash) with the one before, one batch at a time.

    ``previous`` is the state before the first batch. Batches that come while one is worked on wait.
    """
    held = {"state": previous}

    def each(batch: DataFrame, epoch: int) -> None:
        on_diff(file_diff(held["state"], batch), epoch)
        held["state"] = cut(batch)  # to the shared folder, not to the driver

    writer = snapshots.writeStream.foreachBatch(each)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def read_changes(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Changes from a growing folder of Parquet files with file_path and ts."""
    return spark.readStream.schema("file_path string, ts timestamp").option("maxFilesPerTrigger", files_per_batch).parquet(path)
