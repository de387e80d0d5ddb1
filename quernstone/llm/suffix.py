"""Passages repeated across documents, by a sparse suffix array.

Words are runs without ASCII white space. Of each :data:`WINDOW` successive places the
one whose :data:`GRAM` words have the least hash keeps its suffix; so every passage of
:data:`PASSAGE` words keeps the same suffixes wherever it occurs, about 2 in 27 of all.
Suffixes are sorted over the cluster by their first words' hash, then text and document,
and neighbours are compared: one whose first words no other text shares goes, and of
equal texts only the first document's suffixes stay. From these matches are extended left
and right: each passage of PASSAGE words around a kept suffix is hashed, and is a match if
another document has it. All passages are looked up, not those of the sorted neighbours
alone: of many suffixes with the same first words, the one that goes on furthest to the
left need not be next to the one that goes on furthest to the right, and one between them
may have both. Runs of matching passages make up spans, as long as the match goes on.

A document is a row's doc_id and text; rows with the same doc_id and different texts are
kept apart. The least doc_id that has a passage holds it; in others it is a repeat. A span
ends where the document stops or starts to be the holder. A text whose words several
documents have is a span as well, held by the least of them.

Sorting is by range, so a suffix of any frequency is spread over partitions; where a
run of equal suffixes meets the edge of a batch it's kept unseen, which costs work alone.

Passages are told apart by 96 bits of two hashes, whole texts by 128 bits and their length.

Cases: texts that are null or have fewer than PASSAGE words have no spans; repeats
within a document don't count, nor between rows with the same doc_id. Equal rows are one
document. Rows with a null doc_id take no part. Empty tables give no rows. Other columns
are ignored, or kept by :func:`without_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import discard, map_large, map_small, materialize, release, shuffle_partitions, unused
from .words import VISIBLE, hashed_words, mix, raw_bytes, run_hashes

PASSAGE = 50
GRAM = 25
WINDOW = PASSAGE - GRAM + 1
#: Spans to cut (16 bytes each) that are broadcast to the documents at most; more are joined by a shuffle.
BROADCAST_SPANS = 1_000_000


def minimisers(grams: np.ndarray) -> np.ndarray:
    """Places whose hash is the least, the first of equals, in some WINDOW successive places."""
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = []
    for at in range(0, n, 1 << 14):
        view = np.lib.stride_tricks.sliding_window_view(grams[at : min(n, at + (1 << 14)) + WINDOW - 1], WINDOW)
        place = view.argmin(1) + np.arange(at, at + len(view))
        out.append(place[np.concatenate(([True], place[1:] != place[:-1]))])
    return np.unique(np.concatenate(out))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text as it is), text: the first two are the key of a document."""
    text = F.col("text").cast("string")
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash("text").alias("th"), text.alias("text"))


def _text_hash(column: str) -> Column:
    return F.xxhash64(F.col(column).cast("string"))


def suffixes(docs: DataFrame) -> DataFrame:
    """h long (hash of the first GRAM words), doc_id, th, place int, and t1, t2, n_words of its text's words; written to the shared folder."""

    def rows(h: list, named: list) -> pd.DataFrame:
        n = [len(x) for x in h]
        ids, th, t1, t2, words, place = zip(*named, strict=True)
        rep = lambda x, kind: np.repeat(np.array(x, kind), n)
        return pd.DataFrame({"h": np.concatenate(h), "doc_id": rep(ids, np.int64), "th": rep(th, np.int64), "place": np.concatenate(place), "t1": rep(t1, np.int64), "t2": rep(t2, np.int64), "n_words": rep(words, np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            h, named, held = [], [], 0
            for doc_id, th, text in zip(batch["doc_id"], batch["th"], batch["text"], strict=True):
                words = hashed_words(raw_bytes(text), VISIBLE)[0]
                grams = run_hashes(words, GRAM)
                place = minimisers(grams)
                if not len(place):
                    continue
                whole = np.array([xxh64_intdigest(words.tobytes(), seed) for seed in (1, 2)], np.uint64).view(np.int64)
                h.append(grams[place].view(np.int64))
                named.append((doc_id, th, whole[0], whole[1], len(words), place.astype(np.int32)))
                held += len(place)
                if held > 200_000:
                    yield rows(h, named)
                    h, named, held = [], [], 0
            if held:
                yield rows(h, named)

    return materialize(map_small(_named(docs), run, "h long, doc_id long, th long, place int, t1 long, t2 long, n_words int"), "suffixes")


def _copies(kept: DataFrame) -> DataFrame:
    """doc_id, th, n_words, first, same: documents whose words another document has too; first is the least of these, same the least with the text as it is."""
    texts = kept.select("doc_id", "th", "t1", "t2", "n_words").distinct()
    key = ["t1", "t2", "n_words"]
    several = texts.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    own = texts.join(materialize(several, "texts"), key)
    same = own.groupBy("th").agg(F.min("doc_id").alias("same"))
    return materialize(own.join(materialize(same, "same"), "th").select("doc_id", "th", "n_words", "first", "same"), "copies")


def _shared(kept: DataFrame) -> DataFrame:
    """Suffixes next to an equal one of another text: doc_id, th, place; of equal texts those of the first document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h, text, place = (batch[c].to_numpy() for c in ("h", "th", "place"))
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            ends = np.append(starts[1:], len(h))
            near = text[starts] != text[ends - 1]
            near[[0, -1]] = True  # may go on in the next batch
            first = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1])))
            yield batch[np.repeat(near, ends - starts) & first][["doc_id", "th", "place"]]

    n, order = shuffle_partitions(kept.sparkSession), ["h", "th", "place", "doc_id"]
    return map_large(kept.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order), run, "doc_id long, th long, place int")


def _passages(docs: DataFrame, places: DataFrame) -> DataFrame:
    """h long, doc_id, th, at long (32 more bits of hash, then the start): all passages around places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ("h", "doc_id", "th", "at")
        for batch in batches:
            found, held = [], 0
            for doc_id, th, text, place in zip(batch["doc_id"], batch["th"], batch["text"], batch["places"], strict=True):
                words = hashed_words(raw_bytes(text), VISIBLE)[0]
                h = run_hashes(words, PASSAGE)
                near = np.zeros(len(h) + 1, np.int32)
                p = np.asarray(place, np.int64)
                np.add.at(near, np.clip(p - (PASSAGE - GRAM), 0, len(h)), 1)
                np.add.at(near, np.clip(p + 1, 0, len(h)), -1)
                start = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                more = run_hashes(mix(words), PASSAGE)[start] >> np.uint64(32) << np.uint64(32)
                found.append((h[start].view(np.int64), np.full(len(start), doc_id), np.full(len(start), th), (more | start.astype(np.uint64)).view(np.int64)))
                held += len(start)
                if held > 200_000:
                    yield pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*found, strict=True)), strict=True)))
                    found, held = [], 0
            if held:
                yield pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*found, strict=True)), strict=True)))

    # as many places as a text has words at most; by a shuffle at any size, as places grow with the corpus
    by_doc = places.groupBy("doc_id", "th").agg(F.collect_set("place").alias("places")).hint("shuffle_hash")
    return map_small(_named(docs).join(by_doc, ["doc_id", "th"]).select("doc_id", "th", "text", "places"), run, "h long, doc_id long, th long, at long")


def matches(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, th, start, holder: passages that other documents have too, and the least id that has them; of equal texts the first document's."""
    places = materialize(_shared(kept), "places")
    passages = materialize(_passages(docs, places), "passages")
    more = F.shiftright("at", 32)
    # written, so that both sides of the join are plain exchanges, which AQE can split where a passage is very frequent
    ends = materialize(passages.groupBy("h", more.alias("more")).agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last")).where("holder < last").select("h", "more", "holder"), "holders")
    found = passages.withColumn("more", more).join(ends, ["h", "more"]).select("doc_id", "th", F.col("at").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("start"), "holder")
    out = materialize(found, "matches")
    for done in (places, passages, ends):
        discard(done)
    return out


def spans(found: DataFrame) -> DataFrame:
    """doc_id, th, start, n_words, holder: runs of overlapping passages that the document holds, or doesn't; holder is the least of theirs."""
    own = Window.partitionBy("doc_id", "th").orderBy("start")  # a document's own passages
    first = F.col("holder") == F.col("doc_id")
    new = F.coalesce(((F.col("start") > F.lag("start").over(own) + PASSAGE) | (F.col("first") != F.lag("first").over(own))).cast("int"), F.lit(1))
    return (
        found.withColumn("first", first)
        .withColumn("_new", new)
        .withColumn("_span", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "th", "_span")
        .agg(F.min("start").alias("start"), (F.max("start") + PASSAGE - F.min("start")).alias("n_words"), F.min("holder").alias("holder"))
        .drop("_span")
    )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, n_words, first_doc_id, is_first for each span that another document repeats.

    Of documents with equal texts each has the spans it shares with other texts, and one for the whole text.
    """
    kept = suffixes(docs)
    found, copies = materialize(spans(matches(docs, kept)), "spans"), _copies(kept)
    discard(kept)
    others = copies.where("same < doc_id").select("doc_id", "th", "same")
    theirs = found.join(others, (found["doc_id"] == others["same"]) & (found["th"] == others["th"])).select(others["doc_id"], "start", "n_words", "holder")
    whole = copies.select("doc_id", F.lit(0).alias("start"), "n_words", F.col("first").alias("holder"))
    every = found.select("doc_id", "start", "n_words", "holder").unionByName(theirs).unionByName(whole).distinct()
    return every.select("doc_id", F.col("start").alias("start_word"), "n_words", F.col("holder").alias("first_doc_id"), (F.col("holder") == F.col("doc_id")).alias("is_first"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of spans (first word, words) and the white space after them."""
    raw = raw_bytes(text)
    _, starts, ends = hashed_words(raw, VISIBLE)
    out, at = [], 0
    for first, n in sorted(spans):
        out.append(raw[at : starts[first]])
        at = starts[first + n] if first + n < len(starts) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without spans that an earlier document has; a text of which nothing is left goes. n_chars follows."""
    kept = suffixes(docs)
    copies = _copies(kept).where("first < doc_id").select("doc_id", "th", F.lit(0).alias("start"), "n_words")
    part = spans(matches(docs, kept).where("holder < doc_id")).select("doc_id", "th", "start", "n_words")
    repeats = part.join(copies.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_anti").unionByName(copies)
    doc, text_hash, found = unused(docs, "_doc"), unused(docs, "_th"), unused(docs, "_spans")
    by_doc = materialize(repeats.groupBy(F.col("doc_id").alias(doc), F.col("th").alias(text_hash)).agg(F.collect_list(F.struct("start", "n_words")).alias(found)), "spans")
    discard(kept)
    if (by_doc.agg(F.sum(F.size(found))).first()[0] or 0) <= BROADCAST_SPANS:
        by_doc = F.broadcast(by_doc)

    @F.pandas_udf("string")
    def run(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut(t, [(x["start"], x["n_words"]) for x in s]) for t, s in zip(text, spans, strict=True)], dtype=object)

    run = run.asNondeterministic()  # else the filter on its result runs it again, in a second Python worker beside each first
    names = docs.columns
    joined = docs.join(by_doc, (F.col("doc_id") == F.col(doc)) & (_text_hash("text") == F.col(text_hash)), "left")
    whole = joined.where(F.col(found).isNull()).select(*names)
    less = joined.where(F.col(found).isNotNull()).withColumn("text", run("text", found)).where(F.trim("text") != "")
    if "n_chars" in names:
        less = less.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(less.select(*names))
