"""The corpus pipeline: stages from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.common import materialize, read
from quernstone.llm.pipeline import STAGES

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: No stage can be stated in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
