from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from quernstone.streaming import changes

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def folder(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame([(p, START + timedelta(seconds=s)) for p, s in rows], "file_path string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return changes.read_changes(spark, str(tmp_path / "in"))


def run(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_bursts_end_after_quiet(spark, tmp_path):
    df = folder(spark, tmp_path, [[("a", 0), ("b", 0.3), ("a", 0.6)], [("c", 5)], [("z", 10_000)], [("z", 20_000)]]).withColumn("repo", F.lit("r"))
    found = run(spark, changes.bursts(df), "bursts", "append", tmp_path)
    assert sorted((r.files, r.n_changes) for r in found)[:2] == [(["a", "b"], 3), (["c"], 1)]


def test_thrashing_across_batches_alerts_once(spark, tmp_path):
    df = folder(spark, tmp_path, [[("a", 60 * k) for k in range(3)], [("a", 60 * k) for k in range(3, 6)], [("b", 1)], [("a", 380)]])
    found = run(spark, changes.thrashing_alerts(df), "alerts", "append", tmp_path)
    assert [r.file_path for r in found] == ["a"]


def test_accumulated_state(spark, tmp_path):
    df = folder(spark, tmp_path, [[(f"f{k}", k) for k in range(30)], [("f1", 100), ("g", -5)]]).withColumn("repo", F.lit("r"))
    last = max(run(spark, changes.accumulated(df), "state", "update", tmp_path), key=lambda r: r.ring)
    assert (len(last.files), last.omitted, last.ring, last.last_ms - last.first_ms) == (20, 11, 32, 105_000)


def test_watch_compares_with_the_batch_before(spark, tmp_path):
    schema = "path string, content_hash string"
    for rows in ([("a", "1"), ("b", "1")],):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    seen = []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "s"))
    q = changes.watch(stream, spark.createDataFrame([("a", "0"), ("c", "1")], schema), lambda d, k: seen.append({r.path: r.change for r in d.collect()}), checkpoint=str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert seen == [{"a": "modified", "b": "added", "c": "removed"}]
