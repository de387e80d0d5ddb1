"""Classification and matching of symbols, relations and requests; operators of the store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import extract
from quernstone.plans.catalog import query
from quernstone.plans.lineage import cut, spread
from quernstone.sources import store
from quernstone.sources.codebase import SYMBOLS_SQL, Codebase
from quernstone.sources.tables import EDGES_SQL, Tables

#: Relation kinds and strengths by edge type; strengths, the best first.
STRENGTHS = ["exact", "resolved", "conservative", "lexical", "unresolved"]
RELATIONS = {"contains": "containment", "calls": "direct_call", "imports": "import", "references": "reference"}


def relation_strength(edge_type: Column, same_file: Column, same_class: Column) -> Column:
    """TX55. Containment is exact, imports resolved; calls are exact in a file, resolved across files, conservative across classes."""
    return F.when(edge_type == "contains", "exact").when(edge_type == "imports", "resolved").when(~same_class, "conservative").when(~same_file, "resolved").otherwise("exact")


@query(
    f"""WITH {EDGES_SQL}, k AS (SELECT src, dst, edge_type, substr(src, 3)::BIGINT % 7 = substr(dst, 3)::BIGINT % 7 AS same_file, substr(src, 3)::BIGINT % 2 = substr(dst, 3)::BIGINT % 2 AS same_class FROM edges),
    s AS (SELECT src, dst, CASE edge_type WHEN 'contains' THEN 'containment' WHEN 'calls' THEN 'direct_call' WHEN 'imports' THEN 'import' END AS relation, CASE WHEN edge_type = 'contains' THEN 'exact' WHEN edge_type = 'imports' THEN 'resolved' WHEN NOT same_class THEN 'conservative' WHEN NOT same_file THEN 'resolved' ELSE 'exact' END AS strength FROM k)
    SELECT src, dst, relation, strength FROM s WHERE relation IN ('direct_call', 'import') AND strength <> 'conservative'""",
    covers=("TX54", "TX55", "FLT18"),
)
def op_tx55_classify_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).edges()
    n = lambda c: F.substring(c, 3, 20).cast("long")
    kinds = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    strength = relation_strength(F.col("edge_type"), n("src") % 7 == n("dst") % 7, n("src") % 2 == n("dst") % 2)
    s = e.select("src", "dst", kinds[F.col("edge_type")].alias("relation"), strength.alias("strength"))
    return s.where(F.col("relation").isin("direct_call", "import") & (F.col("strength") != "conservative"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_linestatus, l_partkey, l_suppkey, l_orderkey, l_linenumber LIMIT 64""",
    covers=("TK06",),
)
def op_tk06_relation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total order of six keys, the best 64."""
    flag = F.col("l_returnflag")
    rank = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    return Tables(spark, sf_dir).lineitem.orderBy(rank, "l_linestatus", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber").limit(64).select("l_orderkey", "l_linenumber", "l_partkey")


#: Endings of compiled modules, the words that fit each, and what a hint adds.
BOUNDARY_WORDS = {
    ".pyx": ("compiled", "core", "cython", "extension", "fast", "helper", "kernel", "low", "parser", "performance", "utility"),
    ".pxd": ("cimport", "core", "cython", "helper", "low", "utility"),
    ".pxi": ("core", "cython", "helper", "utility"),
}
BOUNDARY = {"base": 18, "per_word": 4, "most_words": 8, "preferred": 8, "top_level": 4, "private": 2}


def boundary_ending(path: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(path).endswith(e), F.lit(e)) for e in BOUNDARY_WORDS])


def boundary_hint(path: Column, kind: Column, name: Column, words: list[str], preferred: list[str]) -> Column:
    """TX26. What a question about compiled code adds to a symbol at that boundary; 0 elsewhere or if none of its words fits."""
    ending, b = boundary_ending(path), BOUNDARY
    hits = F.coalesce(*[F.when(ending == e, len(set(words) & set(own))) for e, own in BOUNDARY_WORDS.items()], F.lit(0))
    score = b["base"] + F.least(hits * b["per_word"], F.lit(b["most_words"])) + F.when(ending.isin(*preferred), b["preferred"]).otherwise(0) + F.when(kind.isin("class", "function"), b["top_level"]).otherwise(0)
    return F.when(hits > 0, F.when(name.startswith("_"), F.greatest(F.lit(0), score - b["private"])).otherwise(score)).otherwise(0)


@query(
    f"""WITH {SYMBOLS_SQL}, p AS (SELECT symbol_id, kind, CASE WHEN symbol_id % 6 = 1 THEN '_' ELSE '' END || local_name AS name, CASE module_id % 4 WHEN 0 THEN replace(path, '.py', '.pyx') WHEN 1 THEN replace(path, '.py', '.PXD') WHEN 2 THEN replace(path, '.py', '.pxi') ELSE path END AS path FROM symbols),
    e AS (SELECT *, CASE WHEN ends_with(lower(path), '.pyx') THEN 2 WHEN ends_with(lower(path), '.pxd') THEN 1 WHEN ends_with(lower(path), '.pxi') THEN 0 END AS hits FROM p)
    SELECT symbol_id, CASE WHEN hits > 0 THEN 18 + least(hits * 4, 8) + CASE WHEN ends_with(path, '.pyx') THEN 8 ELSE 0 END + CASE WHEN kind IN ('class', 'function') THEN 4 ELSE 0 END - CASE WHEN starts_with(name, '_') THEN 2 ELSE 0 END ELSE 0 END AS hint
    FROM e WHERE hits IS NOT NULL AND kind <> 'constant'""",
    covers=("FLT11", "FLT13", "TX26"),
)
def op_flt11_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of compiled modules but structural ones, with their hint for "fast low kernels"; three of four modules are compiled."""
    k = F.col("module_id") % 4
    path = F.when(k == 0, F.replace("path", F.lit(".py"), F.lit(".pyx"))).when(k == 1, F.replace("path", F.lit(".py"), F.lit(".PXD"))).when(k == 2, F.replace("path", F.lit(".py"), F.lit(".pxi"))).otherwise(F.col("path"))
    s = Codebase(Tables(spark, sf_dir)).symbols().where("kind <> 'constant'").withColumn("file", path).withColumn("name", F.concat(F.when(F.col("symbol_id") % 6 == 1, "_").otherwise(""), "local_name"))
    return s.where(boundary_ending(F.col("file")).isNotNull()).select("symbol_id", boundary_hint(F.col("file"), F.col("kind"), F.col("name"), ["fast", "low"], [".pyx"]).alias("hint"))


@query("SELECT DISTINCT o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = 1", covers=("JN04",))
def op_jn04_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    own = t.lineitem.where("l_suppkey = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(own, "o_orderkey", "left_semi").select("o_custkey").distinct()


@query(
    """WITH failing AS (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'), impl AS (SELECT l_partkey, l_orderkey FROM lineitem SEMI JOIN failing ON l_orderkey = o_orderkey WHERE l_partkey % 3 <> 0)
    SELECT l_partkey, count(DISTINCT l_orderkey) AS tests, round(2.0 + 0.8 + 0.4 * least(count(DISTINCT l_orderkey), 3), 4) AS raw FROM impl GROUP BY 1""",
    covers=("JN15", "GR32"),
)
def op_jn15_tests_to_implementation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failing tests reach, without tests, and how many reach it."""
    t = Tables(spark, sf_dir)
    failing = t.orders.where(F.startswith("o_orderpriority", F.lit("1"))).select(F.col("o_orderkey").alias("l_orderkey"))
    impl = t.lineitem.where("l_partkey % 3 <> 0").select("l_partkey", "l_orderkey").join(failing, "l_orderkey", "left_semi").distinct()
    n = impl.groupBy("l_partkey").agg(F.count("*").alias("tests"))
    return n.withColumn("raw", F.round(2.8 + 0.4 * F.least(F.col("tests"), F.lit(3)), 4))


#: A clue's class and its weight, the best first.
CLUE_WEIGHTS = {"exact_path": 1.0, "exact_filename": 0.95, "directory_prefix": 0.9, "component_sequence": 0.75, "weak_basename": 0.25}


def clue_class(path: Column, clue: str) -> Column:
    """JN21. How a path matches a clue: all of it, its file name, a directory above it, a run of its parts, or its stem."""
    stem = clue.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
    return (
        F.when(path == clue, "exact_path")
        .when(T.basename(path) == clue, "exact_filename")
        .when(path.startswith(clue.rstrip("/") + "/"), "directory_prefix")
        .when(F.concat(F.lit("/"), path, F.lit("/")).contains("/" + clue.strip("/") + "/"), "component_sequence")
        .when(F.split(T.basename(path), "\\.")[0] == stem, "weak_basename")
    )


CLUES = ["src1/en/doc1.txt", "doc7.txt", "src3", "en/doc10.txt", "lib/doc2.py"]


def _clue_sql(c: str) -> str:
    stem = c.rsplit("/", 1)[-1].split(".")[0]
    return f"CASE WHEN p = '{c}' THEN 'exact_path' WHEN string_split(p, '/')[-1] = '{c}' THEN 'exact_filename' WHEN starts_with(p, '{c}/') THEN 'directory_prefix' WHEN contains('/' || p || '/', '/{c}/') THEN 'component_sequence' WHEN string_split(string_split(p, '/')[-1], '.')[1] = '{stem}' THEN 'weak_basename' END"


@query(
    "WITH f AS (SELECT source || '/' || lang || '/doc' || doc_id || '.txt' AS p FROM documents) SELECT * FROM (" + " UNION ALL ".join(f"SELECT p AS path, '{c}' AS clue, {_clue_sql(c)} AS match FROM f" for c in CLUES) + ") WHERE match IS NOT NULL",
    covers=("JN21", "TX24"),
)
def op_jn21_path_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handful of clues as expressions over one scan: no join."""
    f = Tables(spark, sf_dir).files().select("path")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("clue"), clue_class(F.col("path"), c).alias("match")) for c in CLUES]))
    return f.select("path", each.alias("m")).select("path", "m.clue", "m.match").where("match IS NOT NULL")


@query(
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_orderkey FROM r WHERE k > 100 AND k <= 150""",
    covers=("WN11",),
)
def op_wn11_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page after a cursor: rows beyond the cursor's keys in order, not an offset over all rows.

    The cursor is the 100th row, resolved to its keys once; its row must still be there.
    """
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice")
    order = (F.desc("o_totalprice"), "o_orderkey")
    cursor = o.orderBy(*order).limit(100).orderBy(F.asc("o_totalprice"), F.desc("o_orderkey")).limit(1).select(F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("k"))
    after = o.crossJoin(F.broadcast(cursor)).where("o_totalprice < p OR (o_totalprice = p AND o_orderkey > k)")  # one row
    return after.orderBy(*order).limit(50).select("o_orderkey")


#: Words that share a meaning.
SYNONYMS = {"delete": ["remove", "drop"], "create": ["add", "new"], "config": ["settings", "options"]}


def variants(term: Column) -> Column:
    """TX27. A term, its synonyms and its forms: -y and -ies, -ing, -ed, -ation, plurals; sorted, of two letters or more."""
    synonyms = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    n, cut = F.length(term), lambda k: F.substring(term, F.lit(1), F.length(term) - k)
    forms = [
        term,
        F.when(term.endswith("y"), F.concat(cut(1), F.lit("ies"))).otherwise(F.concat(term, F.lit("s"))),
        F.when(term.rlike("(s|x|z|ch|sh)$"), F.concat(term, F.lit("es"))),
        F.when(term.endswith("ies"), F.concat(cut(3), F.lit("y"))),
        F.when(term.endswith("ation"), F.concat(cut(5), F.lit("ate"))),
        F.when(term.endswith("ing") & (n > 4), cut(3)),
        F.when(term.endswith("ed") & (n > 3), cut(2)),
    ]
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(*forms), F.coalesce(synonyms[term], F.array().cast("array<string>"))), lambda x: x.isNotNull() & (F.length(x) > 1))))


#: The same in DuckDB SQL; ``{t}`` is the term.
VARIANTS_SQL = """list_sort(list_distinct(list_filter([{t}, CASE WHEN {t} LIKE '%y' THEN left({t}, length({t}) - 1) || 'ies' ELSE {t} || 's' END, CASE WHEN regexp_matches({t}, '(s|x|z|ch|sh)$') THEN {t} || 'es' END,
    CASE WHEN {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y' END, CASE WHEN {t} LIKE '%ation' THEN left({t}, length({t}) - 5) || 'ate' END, CASE WHEN {t} LIKE '%ing' AND length({t}) > 4 THEN left({t}, length({t}) - 3) END, CASE WHEN {t} LIKE '%ed' AND length({t}) > 3 THEN left({t}, length({t}) - 2) END]
    || CASE {t} WHEN 'delete' THEN ['remove', 'drop'] WHEN 'create' THEN ['add', 'new'] WHEN 'config' THEN ['settings', 'options'] ELSE [] END, lambda x: x IS NOT NULL AND length(x) > 1)))"""


@query(
    f"""WITH u AS (SELECT DISTINCT unnest({T.TOKENIZE_SQL.format(c="text || ' delete create config stories creation'")}) AS t FROM documents)
    SELECT t AS term, array_to_string({VARIANTS_SQL.format(t="t")}, ' ') AS forms FROM u""",
    covers=("TX27",),
)
def op_tx27_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.explode(F.array_distinct(T.tokenize(F.concat("text", F.lit(" delete create config stories creation")))))
    return Tables(spark, sf_dir).documents.select(t.alias("term")).distinct().select("term", F.array_join(variants(F.col("term")), " ").alias("forms"))


GENERIC = ("part", "test", "data", "with")


@query(
    f"""WITH m AS (SELECT doc_id, list_distinct(list_filter({T.TOKENIZE_SQL.format(c='text')}, lambda t: length(t) >= 4 AND t NOT IN ('part', 'test', 'data', 'with'))) AS t FROM documents), a AS (SELECT t AS q FROM m ORDER BY doc_id LIMIT 1)
    SELECT doc_id, len(t) AS terms, round(least(0.5, 0.15 * len(list_intersect(t, q))), 4) AS affinity FROM m, a""",
    covers=("TX40", "RT07"),
)
def op_rt07_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.15 for each telling word shared with a request, 0.5 at most."""
    d = Tables(spark, sf_dir).documents
    own = F.array_distinct(F.filter(T.tokenize(F.col("text")), lambda t: (F.length(t) >= 4) & ~t.isin(*GENERIC)))
    m = d.select("doc_id", own.alias("t"))
    q = F.broadcast(m.orderBy("doc_id").limit(1).select(F.col("t").alias("q")))
    return m.crossJoin(q).select("doc_id", F.size("t").cast("long").alias("terms"), F.round(F.least(F.lit(0.5), 0.15 * F.size(F.array_intersect("t", "q"))), 4).alias("affinity"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'explicit' WHEN length(split_part(p_name, ' ', 1)) < 4 THEN 'weak_short' ELSE 'ordinary' END AS confidence, CASE WHEN p_size % 4 = 0 THEN 1.0 WHEN length(split_part(p_name, ' ', 1)) < 4 THEN 0.5 ELSE 0.1 END::DOUBLE AS factor,
    CASE WHEN p_type LIKE '%1' AND p_size < 20 THEN 0.3 ELSE 0.0 END::DOUBLE AS penalty FROM part""",
    covers=("RT06",),
)
def op_rt06_identifier_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a name in prose counts, and what a symbol without use as an answer loses."""
    short = F.length(F.split_part("p_name", F.lit(" "), F.lit(1))) < 4
    kind = F.when(F.col("p_size") % 4 == 0, "explicit").when(short, "weak_short").otherwise("ordinary")
    factor = F.create_map(*map(F.lit, ("explicit", 1.0, "weak_short", 0.5, "ordinary", 0.1)))
    p = Tables(spark, sf_dir).part.select("p_partkey", kind.alias("confidence"), F.when(F.endswith("p_type", F.lit("1")) & (F.col("p_size") < 20), 0.3).otherwise(0.0).alias("penalty"))
    return p.withColumn("factor", factor[F.col("confidence")])


@query(
    """WITH c AS (SELECT l_partkey, l_suppkey, l_returnflag = 'A' AS producer, l_returnflag = 'R' AS consumer, round(l_extendedprice / 100000, 4) AS score FROM lineitem),
    p AS (SELECT l_suppkey, max(score) AS best FROM c WHERE producer GROUP BY 1), k AS (SELECT l_suppkey, max(score) AS best FROM c WHERE consumer GROUP BY 1)
    SELECT p.l_suppkey, round(greatest(p.best, k.best + 0.0001), 4) AS promoted FROM p JOIN k USING (l_suppkey)""",
    covers=("GR19",),
)
def op_gr19_promote_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A producer with a consumer comes out at least a step before it."""
    flag, s = F.col("l_returnflag"), F.round(F.col("l_extendedprice") / 100000, 4)
    g = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey").agg(F.max(F.when(flag == "A", s)).alias("p"), F.max(F.when(flag == "R", s)).alias("k"))
    return g.where("p IS NOT NULL AND k IS NOT NULL").select("l_suppkey", F.round(F.greatest(F.col("p"), F.col("k") + 0.0001), 4).alias("promoted"))


def ladder(stages: list[Column], budget: int) -> tuple[Column, Column]:
    """BU04. The first stage whose size fits the budget, else -1, and its size: each stage is smaller than the one before."""
    stage, size = F.lit(-1), F.lit(None).cast("long")
    for k in reversed(range(len(stages))):
        stage = F.when(stages[k] <= budget, k).otherwise(stage)
        size = F.when(stages[k] <= budget, stages[k]).otherwise(size)
    return stage, size


@query(
    """WITH s AS (SELECT doc_id, [ceil(n_chars / 4.0)::BIGINT, ceil(n_chars / 8.0)::BIGINT, ceil(n_chars / 16.0)::BIGINT, ceil(least(n_chars, 600) / 4.0)::BIGINT] AS x FROM documents)
    SELECT doc_id, CASE WHEN x[1] <= 120 THEN 0 WHEN x[2] <= 120 THEN 1 WHEN x[3] <= 120 THEN 2 WHEN x[4] <= 120 THEN 3 ELSE -1 END AS stage, CASE WHEN x[1] <= 120 THEN x[1] WHEN x[2] <= 120 THEN x[2] WHEN x[3] <= 120 THEN x[3] WHEN x[4] <= 120 THEN x[4] END AS size FROM s""",
    covers=("BU07",),
)
def op_bu04_progressive_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    stages = [F.ceil(n / 4).cast("long"), F.ceil(n / 8).cast("long"), F.ceil(n / 16).cast("long"), F.ceil(F.least(n, F.lit(600)) / 4).cast("long")]
    stage, size = ladder(stages, 120)
    return Tables(spark, sf_dir).documents.select("doc_id", stage.alias("stage"), size.alias("size"))


#: Symbols that a title names exactly: three a term, six a request.
PER_TERM, PER_REQUEST = 3, 6


def title_symbols(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """AN02. request_id, symbol_id, place: symbols whose name is a word of a request's title, in the order of the words, then by name and id."""
    words = spread(requests, "request_id").select("request_id", F.posexplode(F.filter(F.split("title", "[^A-Za-z0-9_]+"), lambda w: F.length(w) >= 3)).alias("at", "local_name"))
    words = words.groupBy("request_id", "local_name").agg(F.min("at").alias("at"))
    # a name's first symbols are the same for every request, so no request meets all symbols of a common name
    first = Window.partitionBy("local_name").orderBy("fq_name", "symbol_id")
    named = symbols.select("symbol_id", "local_name", "fq_name").withColumn("k", F.row_number().over(first)).where(F.col("k") <= PER_TERM).drop("k")
    # those that are asked for are written, so that few of them are broadcast and the words of all requests stay where they are
    named = cut(named.join(words.select("local_name").distinct(), "local_name", "left_semi"))
    held = words.join(named, "local_name")
    term = Window.partitionBy("request_id", "at").orderBy("fq_name", "symbol_id")
    few = held.withColumn("k", F.row_number().over(term)).where(F.col("k") <= PER_TERM)
    own = Window.partitionBy("request_id").orderBy("at", "fq_name", "symbol_id")
    return few.withColumn("place", F.row_number().over(own)).where(F.col("place") <= PER_REQUEST).select("request_id", "symbol_id", "place")


@query(
    f"""WITH {SYMBOLS_SQL}, r AS (SELECT c_custkey AS request_id, 'In SmallRing' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '_' || (c_custkey * 3) END || ': red_widget, test_small or RED_WIDGET fail; SmallRing of ' || c_mktsegment AS title FROM customer),
    w AS (SELECT request_id, list_filter(string_split_regex(title, '[^A-Za-z0-9_]+'), lambda x: length(x) >= 3) AS ws FROM r), e AS (SELECT request_id, unnest(ws) AS local_name, generate_subscripts(ws, 1) AS pos FROM w), d AS (SELECT request_id, local_name, min(pos) AS pos FROM e GROUP BY ALL),
    j AS (SELECT request_id, pos, symbol_id, fq_name, row_number() OVER (PARTITION BY request_id, pos ORDER BY fq_name, symbol_id) AS k FROM d JOIN symbols USING (local_name)),
    p AS (SELECT request_id, symbol_id, row_number() OVER (PARTITION BY request_id ORDER BY pos, fq_name, symbol_id) AS place FROM j WHERE k <= 3) SELECT * FROM p WHERE place <= 6""",
    covers=("AN02",),
)
def op_an02_title_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    k = F.col("c_custkey")
    title = F.concat(F.lit("In SmallRing"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("_"), (k * 3).cast("string"))), F.lit(": red_widget, test_small or RED_WIDGET fail; SmallRing of "), "c_mktsegment")
    return title_symbols(t.customer.select(k.alias("request_id"), title.alias("title")), Codebase(t).symbols())


@query(
    """SELECT source, sha256(string_agg(DISTINCT lang, chr(10) ORDER BY lang)) AS digest FROM documents GROUP BY source""",
    covers=("RE05", "RE07"),
)
def op_re07_surface_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.groupBy("source").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_set("lang"))), 256).alias("digest"))


@query(
    """WITH m AS (SELECT source, count(*) FILTER (lang = 'en') AS ready, count(*) AS n FROM documents GROUP BY 1) SELECT source, CASE WHEN ready = n THEN 'ready' WHEN ready = 0 THEN 'missing' ELSE 'degraded' END AS state FROM m""",
    covers=("RE01",),
)
def op_re08_workspace_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Tables(spark, sf_dir).documents.groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("r"), F.count("*").alias("n"))
    return m.select("source", F.when(F.col("r") == F.col("n"), "ready").when(F.col("r") == 0, "missing").otherwise("degraded").alias("state"))


@query(
    """WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k, p_size > 25 AS hidden FROM part), lead AS (SELECT p_partkey, 0 AS o FROM r WHERE k = 1), hid AS (SELECT p_partkey, 1 AS o FROM r WHERE k > 1 AND hidden ORDER BY k LIMIT 1), imp AS (SELECT p_partkey, 2 AS o FROM r WHERE k > 1 AND NOT hidden ORDER BY k LIMIT 2)
    SELECT p_partkey, o FROM lead UNION ALL SELECT * FROM hid UNION ALL SELECT * FROM imp""",
    covers=("PK10", "PK08", "PK04"),
)
def op_pk10_digest_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead, the first hidden one beside it, and two more."""
    p = Tables(spark, sf_dir).part
    order = (F.desc("p_retailprice"), "p_partkey")
    lead = p.orderBy(*order).limit(1)
    rest = p.join(F.broadcast(lead.select("p_partkey")), "p_partkey", "left_anti")
    take = lambda df, o: df.select("p_partkey", F.lit(o).alias("o"))
    return take(lead, 0).unionByName(take(rest.where("p_size > 25").orderBy(*order).limit(1), 1)).unionByName(take(rest.where("p_size <= 25").orderBy(*order).limit(2), 2))


#: Profiles by intent.
PROFILES = {"debug": (2, 2), "refactor": (3, 5), "feature": (2, 3), "explain": (3, 4)}


@query(
    "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS pivots, CASE p_size % 5 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 4 END AS support FROM part",
    covers=("EX04", "RO06"),
)
def op_ex04_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, [*PROFILES, "other"]))
    pick = lambda k: F.create_map(*[F.lit(x) for name, v in PROFILES.items() for x in (name, v[k])])
    p = Tables(spark, sf_dir).part.select("p_partkey", F.element_at(names, F.col("p_size") % 5 + 1).alias("i"))
    return p.select("p_partkey", pick(0)[F.col("i")].alias("pivots"), pick(1)[F.col("i")].alias("support"))


# ---- the store


@query(f"WITH {EDGES_SQL} SELECT src, dst FROM edges WHERE src NOT IN ('s:1', 'p:7') AND dst NOT IN ('s:1', 'p:7')", covers=("SNK03",))
def op_snk03_delete_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.range(2).select(F.when(F.col("id") == 0, "s:1").otherwise("p:7").alias("node"))
    return store.without_touching(Tables(spark, sf_dir).edges(), gone).select("src", "dst")


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 1, 0.0 FROM orders WHERE o_orderstatus = 'P'""",
    covers=("SNK04",),
)
def op_snk04_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    new = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return store.replaced(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), new.unionByName(new), "l_orderkey", ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey AS path, r AS run_id FROM orders, (VALUES (1::BIGINT), (2)) v(r) WHERE r = 1 AND o_orderkey % 7 <> 0 OR r = 2 AND o_orderkey % 11 <> 0", covers=("SNK08", "SNK02"))
def op_snk08_record_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = Tables(spark, sf_dir).run_states()
    return store.recorded(prev, 1).unionByName(store.recorded(cur, 2)).select("path", "run_id")


@query("SELECT doc_id FROM documents WHERE sha256(text || chr(0) || 'v1') NOT IN (SELECT sha256(text || chr(0) || 'v1') FROM documents WHERE doc_id % 3 = 0)", covers=("SRC22", "SRC23"))
def op_src22_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents.select("doc_id", store.cache_key(F.col("text"), F.lit("v1")).alias("key"))
    return store.misses(d, d.where("doc_id % 3 = 0")).select("doc_id")


# ---- code by rules


#: Definitions by language family: (kind, pattern), the name in the first group.
FAMILIES = {
    "typescript": [("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("type", r"^\s*(?:export\s+)?(?:interface|type)\s+(\w+)")],
    "cython": [("class", r"^\s*(?:cdef\s+)?class\s+(\w+)"), ("function", r"^\s*(?:def|cpdef|cdef)\s+(?:[\w*]+\s+)?(\w+)\s*\(")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("type", r"^type\s+(\w+)")],
    "rust": [("function", r"^\s*(?:pub\s+)?fn\s+(\w+)"), ("type", r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)")],
}


def structural_symbols(sources: DataFrame) -> DataFrame:
    """SRC09/SRC11/SRC12. (path, kind, name, line) of definitions in sources (path, language, code), by rules for each family."""
    lines = sources.select("path", "language", F.posexplode(F.split("code", "\n")).alias("line", "text"))
    found = None
    for language, rules in FAMILIES.items():
        kind = F.lit(None).cast("string")
        name = F.lit("")
        for k, pattern in reversed(rules):
            hit = F.regexp_extract("text", pattern, 1)
            kind, name = F.when(hit != "", k).otherwise(kind), F.when(hit != "", hit).otherwise(name)
        own = lines.where(F.col("language") == language).select("path", kind.alias("kind"), name.alias("name"), (F.col("line") + 1).alias("line")).where("kind IS NOT NULL")
        found = own if found is None else found.unionByName(own)
    return found


@query(
    """WITH s AS (SELECT p_partkey, (p_partkey % 4)::INT AS k, p_size FROM part) SELECT 'f' || p_partkey AS path, CASE k WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'function' ELSE 'type' END AS kind, CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'b' WHEN 2 THEN 'C' ELSE 'D' END || p_size AS name, 2 AS line FROM s""",
    covers=("SRC09", "SRC11"),
)
def op_src12_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    code = F.when(k == 0, F.concat(F.lit("// x\nexport class A"), size, F.lit(" {}"))).when(k == 1, F.concat(F.lit("#\ncpdef int b"), size, F.lit("(x):"))).when(k == 2, F.concat(F.lit("\nfunc (r T) C"), size, F.lit("() {}"))).otherwise(F.concat(F.lit("\npub struct D"), size))
    language = F.element_at(F.array(*map(F.lit, ["typescript", "cython", "go", "rust"])), (k + 1).cast("int"))
    return structural_symbols(Tables(spark, sf_dir).part.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), language.alias("language"), code.alias("code")))


def fact_rows(sources: DataFrame) -> DataFrame:
    """SRC18 over (path, code): path, kind, line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *f) for p, c in zip(b["path"], b["code"], strict=True) for f in extract.mechanism_facts(c or "")], columns=["path", "kind", "line"])

    return sources.select("path", "code").mapInPandas(run, "path string, kind string, line int")


@query(
    """SELECT 'f' || p_partkey AS path, k.kind, k.line FROM part, (VALUES ('ordering', 0), ('first_item', 1)) k(kind, line) WHERE p_partkey % 2 = 0 UNION ALL SELECT 'f' || p_partkey, 'max', 0 FROM part WHERE p_partkey % 2 = 1""",
    covers=("SRC18", "SRC19"),
)
def op_src18_mechanism_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("p_partkey") % 2 == 0, "x = sorted(xs)  # min(a)\nreturn x[0]").otherwise("y = max(xs)\ns = 'sorted(a)'")
    return fact_rows(Tables(spark, sf_dir).part.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), code.alias("code")))
