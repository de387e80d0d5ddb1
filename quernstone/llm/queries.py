"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, dac, decontam, embedding, langid, packing, quality, sharding, simhash, suffix
from .common import materialize, read


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out())
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read(spark, sf_dir, "documents")))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(materialize(chat.format_records(chat.records_from_turns(turns)), "chat"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), ~quality.held_out())
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read(spark, sf_dir, "documents")))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.digest(dac.read_documents(dac.write_segments(read(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_embedding_near_dedup, op2_decontamination, op3_suffix_array, op4_language_id, op5_best_fit_packing, op6_chat_format, op7_quality, op8_sharding, op9_simhash, op10_token_ids)
}
#: DuckDB SQL where it can state the operator.
ORACLES: dict[str, str] = {"op1_embedding_near_dedup": embedding.ORACLE, "op6_chat_format": chat.ORACLE}
