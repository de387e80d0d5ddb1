"""Cuts lineage between rounds of iterative operators, and deals rows out to tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is used, in local mode only; on a cluster a
    machine-local folder would be wrong, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` below :func:`shared_dir` and rereads it, so a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out over the session's shuffle partitions, by columns or evenly.

    A small file is one task's, and so is what an adaptive plan puts together; before much
    work on each row the rows must be spread.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *by)
