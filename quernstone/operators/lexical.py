"""Full-text search and lexical scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.plans.catalog import query
from quernstone.plans.lineage import cut
from quernstone.sources.tables import FILES_SQL, Tables

K1, B = 1.5, 0.75


def _equals(word: str) -> Callable[[Column], Column]:
    return lambda x: x == word


def _stems(word: str) -> Callable[[Column], Column]:
    return lambda x: T.shared_stem(x, F.lit(word))


def term_counts(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """(id, len, tf array): each text is cut into words once, and its words walked once.

    A text becomes words by one generator whose input no later projection repeats; only
    the number of words and the counts of the terms leave the task that read the text,
    as the sum over a row number, which is not a key any other row has.
    """
    rows = docs.select(F.col(id_col).alias("id"), T.tokenize(F.col(text_col)).alias("t"), F.monotonically_increasing_id().alias("row"))
    words = rows.select("id", "row", F.explode_outer("t").alias("w"))
    tf = [F.count_if(F.col("w") == w).alias(f"tf{k}") for k, w in enumerate(terms)]
    return words.groupBy("row", "id").agg(F.count("w").alias("len"), *tf).drop("row")


def bm25(docs: DataFrame, id_col: str, text_col: str, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """TX09. (id, score) of documents with any of the query's different terms; the statistics are over all documents.

    Texts are read and cut into words once; their counts, a few numbers a document, are
    written and read twice, for the statistics (one row) and for the scores.
    """
    terms = sorted(set(terms))
    rows = cut(term_counts(docs, id_col, text_col, terms))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        f = F.col(f"tf{k}").cast("double")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    hit = " OR ".join(f"tf{k} > 0" for k in range(len(terms))) or "false"
    return rows.crossJoin(F.broadcast(stats)).where(hit).select("id", score.alias("score"))  # stats has one row


def first_terms(tables: Tables, n: int = 5) -> list[str]:
    """The query that the registered lexical queries use: different terms of the first benchmark item."""
    row = tables.benchmark.select(T.tokenize(F.col("text")).alias("t"), "item_id").orderBy("item_id").limit(1).collect()
    return sorted(set(row[0]["t"]))[:n] if row else []


_Q = f"q AS (SELECT DISTINCT unnest(t) AS term FROM (SELECT {T.TOKENIZE_SQL.format(c='text')} AS t FROM benchmark ORDER BY item_id LIMIT 1) ORDER BY 1 LIMIT 5)"
_TOK = f"tok AS (SELECT doc_id, {T.TOKENIZE_SQL.format(c='text')} AS t FROM documents)"


@query(
    f"""WITH {_Q}, {_TOK}, st AS (SELECT count(*) AS n, avg(len(t)) AS av FROM tok),
    tf AS (SELECT doc_id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS f FROM tok, q),
    df AS (SELECT term, count(*) AS d FROM tf WHERE f > 0 GROUP BY term)
    SELECT doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / av))), 6) AS score
    FROM tf JOIN df USING (term), st WHERE f > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""",
    covers=("TX09", "TK01"),
)
def op_tx09_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over all documents, the 50 best."""
    t = Tables(spark, sf_dir)
    found = bm25(t.documents, "doc_id", "text", first_terms(t))
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query(f"WITH {_TOK} SELECT doc_id, array_to_string(t, ' ') AS tokens, len(t)::BIGINT AS n_tokens FROM tok", covers=("TX01",))
def op_tx01_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokenize(F.col("text"))
    return Tables(spark, sf_dir).documents.select("doc_id", t.alias("t")).select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"))


@query(
    f"""WITH w AS (SELECT p_partkey, {T.TOKENIZE_SQL.format(c='p_name')} AS t FROM part),
    s AS (SELECT DISTINCT p_partkey, array_to_string(t[i:i + n - 1], '') AS term FROM w, range(1, 5) AS a(n), range(1, 200) AS b(i) WHERE i + n - 1 <= len(t))
    SELECT p_partkey, string_agg(term, ' ' ORDER BY term) AS fts_text, count(*) AS n_terms FROM s GROUP BY p_partkey""",
    covers=("TX02", "TX03"),
)
def op_tx02_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.search_terms(F.col("p_name"))
    return Tables(spark, sf_dir).part.select("p_partkey", t.alias("t")).select("p_partkey", F.array_join("t", " ").alias("fts_text"), F.size("t").cast("long").alias("n_terms"))


@query(
    f"""WITH {_Q}, {_TOK} SELECT doc_id FROM tok WHERE (SELECT count(*) FROM q WHERE list_contains(t, term)) = (SELECT count(*) FROM q)
    OR (NOT EXISTS (SELECT 1 FROM tok x WHERE (SELECT count(*) FROM q WHERE list_contains(x.t, term)) = (SELECT count(*) FROM q)) AND (SELECT count(*) FROM q WHERE list_contains(t, term)) > 0)""",
    covers=("TX04", "TX05", "TX06", "FLT10"),
)
def op_tx04_match_with_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all terms of the query; if there are none, those with any."""
    t = Tables(spark, sf_dir)
    terms = first_terms(t)
    held = t.documents.select("doc_id", F.array_intersect(T.tokenize(F.col("text")), F.array(*map(F.lit, terms))).alias("hit"))
    every = held.where(F.size("hit") == len(terms))
    return (every if not every.isEmpty() else held.where(F.size("hit") > 0)).select("doc_id")


@query(
    f"""WITH {_Q}, {_TOK}, tf AS (SELECT doc_id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS f FROM tok, q), st AS (SELECT count(*) AS n, avg(len(t)) AS av FROM tok),
    df AS (SELECT term, count(*) AS d FROM tf WHERE f > 0 GROUP BY term)
    SELECT doc_id, round(-sum(ln((n - d + 0.5) / (d + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS rank
    FROM tf JOIN df USING (term), st WHERE f > 0 GROUP BY doc_id ORDER BY rank, doc_id LIMIT 48""",
    covers=("TX07", "AN10"),
)
def op_tx07_document_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's own rank: k1 1.2, less is better, 48 rows."""
    t = Tables(spark, sf_dir)
    found = bm25(t.documents, "doc_id", "text", first_terms(t), k1=1.2)
    return found.select(F.col("id").alias("doc_id"), F.round(-F.col("score"), 6).alias("rank")).orderBy("rank", "doc_id").limit(48)


FIELD_WEIGHTS = {"name": (100, 60, 40), "qualified": (30, 25, 20), "signature": (0, 0, 10), "path": (0, 0, 4)}


def field_match(value: Column, q: Column, weights: tuple[int, int, int]) -> Column:
    """TX21. Equal, prefix or substring, without case; the best counts."""
    v, exact, prefix, inside = F.lower(value), *weights
    return F.when(v == q, max(weights) if exact == 0 else exact).when(v.startswith(q), prefix or inside).when(v.contains(q), inside).otherwise(0)


@query(
    """WITH s AS (SELECT p_partkey, p_name, p_brand, p_type, lower(split_part(p_name, ' ', 1)) AS local_name FROM part), q AS (SELECT min(local_name) AS q FROM s),
    m AS (SELECT p_partkey, p_name,
      CASE WHEN local_name = q THEN 100 WHEN starts_with(local_name, q) THEN 60 WHEN contains(local_name, q) THEN 40 ELSE 0 END
      + CASE WHEN lower(p_name) = q THEN 30 WHEN starts_with(lower(p_name), q) THEN 25 WHEN contains(lower(p_name), q) THEN 20 ELSE 0 END
      + CASE WHEN contains(lower(p_type), q) THEN 10 ELSE 0 END + CASE WHEN contains(lower(p_brand), q) THEN 4 ELSE 0 END AS score FROM s, q)
    SELECT p_partkey, score::BIGINT AS score FROM m WHERE score > 0 ORDER BY score DESC, p_name, p_partkey LIMIT 20""",
    covers=("TX20", "TX21", "TK01", "TK02"),
)
def op_tx20_weighted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir).part.withColumn("local_name", F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))))
    q = F.col("q")
    score = field_match(F.col("local_name"), q, FIELD_WEIGHTS["name"]) + field_match(F.col("p_name"), q, FIELD_WEIGHTS["qualified"]) + field_match(F.col("p_type"), q, FIELD_WEIGHTS["signature"]) + field_match(F.col("p_brand"), q, FIELD_WEIGHTS["path"])
    found = s.crossJoin(F.broadcast(s.agg(F.min("local_name").alias("q")))).withColumn("score", score.cast("long"))
    return found.where("score > 0").orderBy(F.desc("score"), "p_name", "p_partkey").limit(20).select("p_partkey", "score")


@query(
    f"""WITH {_TOK}, u AS (SELECT DISTINCT unnest(t) AS term FROM tok) SELECT term, {T.STEM_SQL.format(t='term')} AS stem FROM u""",
    covers=("TX31",),
)
def op_tx31_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = Tables(spark, sf_dir).documents.select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term")).distinct()
    return terms.select("term", T.stem(F.col("term")).alias("stem"))


@query(
    """SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS normalized FROM documents""",
    covers=("TX33", "TX36"),
)
def op_tx36_normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.normalize_query(F.col("text")).alias("normalized"))


@query(
    """SELECT page_id, regexp_replace(replace(replace(url, 'https://', './'), '\\', '/'), '^(\\./)+', '') AS path,
    regexp_extract(url, '^(.*)/[^/]*$', 1) AS directory, string_split(url, '/')[-1] AS basename FROM pages""",
    covers=("TX35",),
)
def op_tx35_normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return Tables(spark, sf_dir).pages.select("page_id", T.normalize_path(F.replace(u, F.lit("https://"), F.lit("./"))).alias("path"), T.directory(u).alias("directory"), T.basename(u).alias("basename"))


@query(
    f"""WITH {FILES_SQL}, a AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM files ORDER BY path LIMIT 1), f AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM files)
    SELECT f.path, CASE WHEN a.d = f.d THEN 2 WHEN a.d <> '' AND f.d <> '' AND (starts_with(a.d, f.d || '/') OR starts_with(f.d, a.d || '/')) THEN 1
    WHEN regexp_extract(a.d, '^(.*)/[^/]*$', 1) <> '' AND regexp_extract(a.d, '^(.*)/[^/]*$', 1) = regexp_extract(f.d, '^(.*)/[^/]*$', 1) THEN 1 END AS proximity FROM f, a""",
    covers=("TX39",),
)
def op_tx39_package_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Tables(spark, sf_dir).files().select("path")
    anchor = F.broadcast(f.agg(F.min("path").alias("anchor")))
    return f.crossJoin(anchor).select("path", T.proximity(F.col("anchor"), F.col("path")).alias("proximity"))


@query(
    """SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE list_reduce(list_prepend({'c': '', 'n': 0}, list_transform(string_split(left(text, 200), ''), lambda c: {'c': c, 'n': strlen(c)})),
    lambda a, x: {'c': CASE WHEN a.n + x.n <= 200 AND a.n >= 0 THEN a.c || x.c ELSE a.c END, 'n': CASE WHEN a.n + x.n <= 200 THEN a.n + x.n ELSE 1000 END}).c END AS clipped, strlen(text) > 200 AS truncated FROM documents""",
    covers=("TX41",),
)
def op_tx41_clip_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", T.clip_bytes(F.col("text"), 200).alias("clipped"), (F.octet_length("text") > 200).alias("truncated"))


@query(
    f"""WITH {_Q}, {_TOK}, u AS (SELECT doc_id, list_distinct(t) AS t FROM tok)
    SELECT doc_id, (SELECT count(*) FROM q WHERE length(term) >= 3 AND len(list_filter(t, lambda x: x = term OR (least(length(x), length(term)) >= 5
      AND left(x, greatest(5, least(length(x), length(term)) - 3)::INT) = left(term, greatest(5, least(length(x), length(term)) - 3)::INT)))) > 0) AS domain_raw FROM u""",
    covers=("TX16", "TX32"),
)
def op_tx16_domain_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query terms that a document's words equal or share a stem with."""
    t = Tables(spark, sf_dir)
    terms = [w for w in first_terms(t) if len(w) >= 3]
    held = t.documents.select("doc_id", F.array_distinct(T.tokenize(F.col("text"))).alias("t"))
    raw = sum((F.exists("t", _stems(w)).cast("long") for w in terms), F.lit(0).cast("long"))
    return held.select("doc_id", raw.alias("domain_raw"))
