from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null in any column, empty and white texts, ties, repeated rows, a very long text.
ODD = [
    (None, None, None, None, None),
    (None, "no id here", "en", "s", 10),
    (1, "", "en", "s", 0),
    (1, "", "en", "s", 0),
    (2, None, "en", None, None),
    (3, " \t\n　 ", None, "s", 5),
    (4, "12345 !!!", "en", "s", 9),
    (5, "word " * 60_000, "en", "s", 300_000),
    (6, "x" * 200_000, "en", "s", 200_000),
    (7, "the same text of a few words", "en", "s", 28),
    (8, "the same text of a few words", "en", "s", 28),
    (8, "another text under a used id", "en", "s", 28),
    (9, "naïve café 漢字 \U0001f600 it's don't\r\nend ", "fr", "s", 30),
]
#: Names that the operators use for columns of their own.
CLASHING = ["_part", "_row", "shard", "slot", "score", "lang_pred", "h", "start", "piece", "fp", "_spans", "_doc_id", "_gone", "holder"]


def docs(spark, rows):
    return spark.createDataFrame([(r + (None,) * 5)[:5] if len(r) < 5 else r for r in rows], DOCS)


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("kept").alias(c) for c in CLASHING])
