"""Stages of the corpus pipeline; each takes (spark, docs, sf_dir) and returns a DataFrame.

Stages work on all their predecessor kept. Columns of documents pass through unchanged,
whatever else a table has; a stage that changes texts changes n_chars with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, langid, packing, suffix
from .common import materialize, read, unused

#: Ids that leave are broadcast up to so many (8 bytes each).
BROADCAST_IDS = 2_000_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for those whose doc_id is in ``ids``; null ids stay."""
    gone = materialize(ids.select("doc_id").where("doc_id IS NOT NULL").distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and texts without a letter. Where no language can be learned the letters alone decide."""
    model = langid.fit(docs, ~langid.held_out())
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    return langid.identify(docs, model, lang, score).where(F.col(lang) != "und").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that share 4 of 5 of their 5-word shingles: that of the least doc_id.

    Rows are told apart by doc_id and text, so a used id loses no other text of it, and rows
    without an id are members like others: they come last, by their texts' hashes.
    """
    found = materialize(jaccard.near_duplicates(docs, "th", "root"), "found")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    kept = materialize(found.groupBy("root").agg(F.min(row).alias("k"), F.count("*").alias("n")).select("k.doc_id", "k.th", "n"), "kept")
    # of the rows that are one in both, one stays; they are few, so they alone are gathered
    named = found.groupBy("doc_id", "th").agg(F.count("*").alias("rows"))
    marks = materialize(named.join(kept, named["doc_id"].eqNullSafe(kept["doc_id"]) & (named["th"] == kept["th"]), "left").select(named["doc_id"], named["th"], F.col("n").isNotNull().alias("stays"), "rows"), "marks")
    own = unused(docs, "_th")
    marked = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))

    def of(ids: DataFrame, how: str) -> DataFrame:
        a, b = unused(marked, "_id"), unused(marked, "_hash")
        ids = materialize(ids.select(F.col("doc_id").alias(a), F.col("th").alias(b)), "gone")
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        return marked.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.col(own) == F.col(b)), how)

    several = of(marks.where("stays AND rows > 1"), "left_semi").dropDuplicates(["doc_id", own])
    out = of(marks.where("NOT stays OR rows > 1"), "left_anti").unionByName(several)
    return out.select(*docs.columns)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that a document with a lesser id has too."""
    return suffix.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    return _without(docs, decontam.find_leaks(docs, read(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids: a row for each piece, with its ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", repeated_passage_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]
