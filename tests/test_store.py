from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.sources import store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_persisting_again_changes_nothing_and_replaces_owners(spark, tmp_path):
    path = str(tmp_path / "symbols")
    schema = "file string, name string"
    first = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")], schema)
    store.persist(first, path, "file", 2)
    store.persist(first, path, "file", 2)
    assert rows(store.read(spark, path).select("file", "name")) == rows(first)
    store.persist(spark.createDataFrame([("a", "new")], schema), path, "file", 2)
    assert rows(store.read(spark, path).select("file", "name")) == [("a", "new"), ("b", "z"), ("c", "w")]


def test_reading_what_is_not_there(spark, tmp_path):
    assert store.read(spark, str(tmp_path / "none")) is None


def test_deletion_at_either_end(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    left = store.without_touching(e, spark.createDataFrame([("b",)], "node string"))
    assert rows(left.select("src", "dst")) == [("c", "d")]


def test_replacement_snapshot_and_cache(spark, tmp_path):
    old = spark.createDataFrame([("f", "a", 1), ("f", "b", 1), ("g", "a", 1)], "owner string, name string, v int")
    new = spark.createDataFrame([("f", "c", 2), ("f", "c", 2)], "owner string, name string, v int")
    assert rows(store.replaced(old, new, "owner", ["owner", "name"])) == [("f", "c", 2), ("g", "a", 1)]
    path = str(tmp_path / "runs")
    for k in (1, 2):
        store.append(store.recorded(old, k), path)
    assert store.read(spark, path).groupBy("run_id").count().count() == 2
    keyed = old.withColumn("key", store.cache_key(F.col("owner"), F.col("name")))
    assert rows(store.misses(keyed, keyed.where("name = 'a'")).select("name")) == [("b",)]


def test_incremental_equals_full(spark, tmp_path):
    """A store that got changed files one run at a time equals one written at once."""
    from quernstone.operators.relational import snapshot

    schema = "path string, content_hash string"
    full = spark.createDataFrame([(f"p{k}", str(k % 3)) for k in range(30)], schema)
    path = str(tmp_path / "inc")
    store.persist(spark.createDataFrame([(f"p{k}", "old") for k in range(30)], schema), path, "path", 4)
    for part in range(3):
        store.persist(full.where(F.col("content_hash") == str(part)), path, "path", 4)
    assert snapshot(store.read(spark, path).select("path", "content_hash")).collect() == snapshot(full).collect()
