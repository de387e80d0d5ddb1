"""A store of relations in Parquet: idempotent writes, replacement, deletion, run snapshots, caches.

A relation is a folder. Writes replace whole partitions or whole relations, so writing the
same rows again changes nothing, and readers see a relation before or after a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def persist(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """SNK01. Replaces the rows of the buckets that ``rows`` has keys in; ``rows`` holds all rows of those keys.

    Rows of other keys in those buckets are carried over.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = rows.withColumn("bucket", bucket)
    old = read(spark, path)
    if old is not None:
        hit = new.select("bucket").distinct()
        old = old.join(F.broadcast(hit), "bucket", "left_semi").join(rows.select(key).distinct(), key, "left_anti")  # hit has no more rows than buckets
        new = new.unionByName(old)
    staged = f"{path}.staged"
    new.write.mode("overwrite").parquet(staged)
    spark.read.schema(new.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return spark.read.parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """SNK02."""
    rows.write.mode("append").parquet(path)


def without_touching(edges: DataFrame, gone: DataFrame, ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """SNK03. Edges with neither end in ``gone`` (node): two anti joins, not one on OR."""
    for end in ends:
        edges = edges.join(gone.select(F.col("node").alias(end)), end, "left_anti")
    return edges


def replaced(rows: DataFrame, new: DataFrame, owner: str, key: list[str]) -> DataFrame:
    """SNK04. ``new`` in place of all rows of its owners; equal keys once."""
    kept = rows.join(new.select(owner).distinct(), owner, "left_anti")
    return kept.unionByName(new.dropDuplicates(key))


def recorded(rows: DataFrame, run_id: int) -> DataFrame:
    """SNK08. The state of a run, to be appended to the partitions by run."""
    return rows.withColumn("run_id", F.lit(run_id).cast("long"))


def cache_key(*parts: Column) -> Column:
    """SRC23."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def misses(rows: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """SRC22. Rows whose key the cache lacks."""
    return rows.join(cache.select(key), key, "left_anti")
