"""Fusion of candidate lanes, gates and penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.plans.catalog import query
from quernstone.sources.tables import Tables

#: Fixed values of the fusion.
WEIGHTS = {"lexical": 1.0, "symbol": 1.2, "path": 0.8, "domain": 0.9, "test": 1.3, "graph": 1.0, "centrality": 0.5, "literal": 1.4}
INTENT_WEIGHTS = {
    "test_failure": {"test": 1.6, "symbol": 1.3},
    "debug": {"lexical": 1.1, "test": 1.4},
    "refactor": {"symbol": 1.4, "path": 1.0},
    "modify": {"symbol": 1.2, "domain": 1.2, "path": 1.0},
    "explain": {"graph": 1.2, "symbol": 1.1},
    "impact": {"graph": 1.3, "centrality": 0.6},
}
HUB_IN_DEGREE, WEAK_LEXICAL = 5, 0.1
FTS_SHARE, TFIDF_SHARE = 0.65, 0.35


def normalized(value: Column, top: Column) -> Column:
    """TX11. A share of the pool's greatest value, within 0 and 1; 0 if that isn't positive."""
    return F.when(top > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / top))).otherwise(0.0)


def fused(pool: DataFrame, lanes: list[str], weights: dict[str, float]) -> DataFrame:
    """TX12. Adds final: lanes over their pool maxima, weighed and summed. One aggregate to one row, one broadcast."""
    tops = pool.agg(*[F.max(c).alias(f"top_{c}") for c in lanes])
    held = pool.crossJoin(F.broadcast(tops))
    total = F.lit(0.0)
    for c in lanes:
        held = held.withColumn(f"n_{c}", F.round(normalized(F.col(c), F.col(f"top_{c}")), 4))
        total = total + F.col(f"n_{c}") * weights[c]
    return held.withColumn("final", total)


def hub_penalty(lexical: Column, local: Column, in_degree: Column, graph: Column, centrality: Column) -> Column:
    """TX13. What a hub without evidence of its own gets from its neighbourhood."""
    return F.when((in_degree >= HUB_IN_DEGREE) & (lexical < WEAK_LEXICAL) & (local <= 0), graph + centrality).otherwise(0.0)


def gated_centrality(share_of: Column, centrality: Column, contribution: Column) -> Column:
    """TX14. Centrality counts in proportion to the evidence that identifies the candidate."""
    return F.when((contribution > 0) & (centrality > 0), contribution * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share_of / centrality))).otherwise(0.0)


_POOL = """deg AS (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS sup FROM lineitem GROUP BY 1),
pool AS (SELECT p_partkey, p_size::DOUBLE AS lexical, CASE WHEN p_size > 45 THEN 1.0 ELSE 0.0 END AS symbol, coalesce(sup, 0)::DOUBLE AS graph, coalesce(n, 0)::DOUBLE AS centrality, coalesce(n, 0) AS in_degree FROM part LEFT JOIN deg ON l_partkey = p_partkey)"""


def _pool(t: Tables) -> DataFrame:
    deg = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("sup"))
    return t.part.select("p_partkey", "p_size").join(deg, "p_partkey", "left").select(
        "p_partkey", F.col("p_size").cast("double").alias("lexical"), F.when(F.col("p_size") > 45, 1.0).otherwise(0.0).alias("symbol"),
        F.coalesce("sup", F.lit(0)).cast("double").alias("graph"), F.coalesce("n", F.lit(0)).cast("double").alias("centrality"), F.coalesce("n", F.lit(0)).alias("in_degree"),
    )


@query(
    f"""WITH {_POOL}, t AS (SELECT max(lexical) AS l, max(symbol) AS s, max(graph) AS g, max(centrality) AS c FROM pool),
    n AS (SELECT p_partkey, in_degree, round(lexical / l, 4) AS nl, round(CASE WHEN s > 0 THEN symbol / s ELSE 0 END, 4) AS ns, round(CASE WHEN g > 0 THEN graph / g ELSE 0 END, 4) AS ng, round(CASE WHEN c > 0 THEN centrality / c ELSE 0 END, 4) AS nc FROM pool, t),
    f AS (SELECT *, CASE WHEN in_degree >= 5 AND nl < 0.1 AND ns <= 0 THEN ng + 0.5 * nc ELSE 0 END AS penalty, CASE WHEN nc > 0 THEN 0.5 * nc * greatest(0, least(1, (CASE WHEN nl >= 0.1 THEN nl ELSE 0 END + ns) / nc)) ELSE 0 END AS support FROM n)
    SELECT p_partkey, round(greatest(0, nl + 1.2 * ns + ng - penalty) + support, 4) AS final FROM f ORDER BY final DESC, p_partkey LIMIT 25""",
    covers=("TX10", "TX11", "TX12", "TX13", "TX14", "ST02", "TK03", "AG22", "RO06"),
)
def op_tx12_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fused(_pool(Tables(spark, sf_dir)), ["lexical", "symbol", "graph"], WEIGHTS)
    top = F.broadcast(f.agg(F.max("centrality").alias("top_centrality")))
    f = f.crossJoin(top).withColumn("nc", F.round(normalized(F.col("centrality"), F.col("top_centrality")), 4))
    penalty = hub_penalty(F.col("n_lexical"), F.col("n_symbol"), F.col("in_degree"), F.col("n_graph"), 0.5 * F.col("nc"))
    own = F.when(F.col("n_lexical") >= WEAK_LEXICAL, F.col("n_lexical")).otherwise(0.0) + F.col("n_symbol")
    final = F.greatest(F.lit(0.0), F.col("final") - penalty) + gated_centrality(own, F.col("nc"), 0.5 * F.col("nc"))
    return f.select("p_partkey", F.round(final, 4).alias("final")).orderBy(F.desc("final"), "p_partkey").limit(25)


@query(
    """SELECT p_partkey, round(0.65 * (p_size / 50.0) + 0.35 * (floor(p_retailprice) / 2000), 6) AS blended, CASE WHEN p_size < 10 THEN round(0.25 * p_size / 50.0, 6) ELSE round(p_size / 50.0, 6) END AS weakened FROM part""",
    covers=("TX10",),
)
def op_tx10_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") / 50.0
    blended = FTS_SHARE * size + TFIDF_SHARE * (F.floor("p_retailprice") / 2000)
    return Tables(spark, sf_dir).part.select("p_partkey", F.round(blended, 6).alias("blended"), F.round(F.when(F.col("p_size") < 10, 0.25 * size).otherwise(size), 6).alias("weakened"))


def symbol_match(name: Column, symbols: list[str]) -> Column:
    """TX29. 3 for the name itself, 1.8 for a prefix either way, 1 if all of a symbol's words occur."""
    n, words, best = F.lower(name), T.tokenize(name), F.lit(0.0)
    for s in symbols:
        low = s.lower()
        every = F.size(F.array_except(T.tokenize(F.lit(s)), words)) == 0
        best = F.greatest(best, F.when(n == low, 3.0).when(n.startswith(low) | F.lit(low).startswith(n), 1.8).when(every, 1.0).otherwise(0.0))
    return best


@query(
    """WITH x AS (SELECT p_partkey, lower(p_name) AS n, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM part)
    SELECT p_partkey, greatest(CASE WHEN n = 'part 7' THEN 3.0 WHEN starts_with(n, 'part 7') OR starts_with('part 7', n) THEN 1.8 WHEN list_has_all(w, ['part', '7']) THEN 1.0 ELSE 0 END,
    CASE WHEN n = '12 part' THEN 3.0 WHEN starts_with(n, '12 part') OR starts_with('12 part', n) THEN 1.8 WHEN list_has_all(w, ['12', 'part']) THEN 1.0 ELSE 0 END)::DOUBLE AS raw FROM x""",
    covers=("TX29",),
)
def op_tx29_symbol_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).part.select("p_partkey", symbol_match(F.col("p_name"), ["part 7", "12 part"]).alias("raw"))


def path_match(path: Column, files: list[str]) -> Column:
    """TX30. 3 for the path, 2.6 for a suffix either way, 2 for the file name, 1 for the directory."""
    best = F.lit(0.0)
    for f in files:
        base, folder = f.rsplit("/", 1)[-1], f.rsplit("/", 1)[0] if "/" in f else ""
        same_dir = (T.directory(path) != "") & (T.directory(path) == folder)
        m = F.when(path == f, 3.0).when(path.endswith("/" + f) | F.lit(f).endswith(F.concat(F.lit("/"), path)), 2.6).when(T.basename(path) == base, 2.0).when(same_dir, 1.0).otherwise(0.0)
        best = F.greatest(best, m)
    return best


@query(
    """WITH f AS (SELECT doc_id, source || '/' || lang || '/doc' || doc_id || '.txt' AS p FROM documents)
    SELECT doc_id, greatest(CASE WHEN p = 'src1/en/doc1.txt' THEN 3.0 WHEN ends_with(p, '/src1/en/doc1.txt') THEN 2.6 WHEN string_split(p, '/')[-1] = 'doc1.txt' THEN 2 WHEN regexp_extract(p, '^(.*)/[^/]*$', 1) = 'src1/en' THEN 1 ELSE 0 END,
    CASE WHEN p = 'en/doc7.txt' THEN 3.0 WHEN ends_with(p, '/en/doc7.txt') THEN 2.6 WHEN string_split(p, '/')[-1] = 'doc7.txt' THEN 2 WHEN regexp_extract(p, '^(.*)/[^/]*$', 1) = 'en' THEN 1 ELSE 0 END)::DOUBLE AS raw FROM f""",
    covers=("TX30", "TX24"),
)
def op_tx30_path_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Tables(spark, sf_dir).files()
    return f.select(F.col("id").cast("long").alias("doc_id"), path_match(F.col("path"), ["src1/en/doc1.txt", "en/doc7.txt"]).alias("raw"))


@query(
    """SELECT p_partkey, least(12 * (p_size > 40)::INT + 8 * (p_retailprice > 1500)::INT, 18) AS test_penalty, least(14 + 6 * (p_size % 5), 30) AS path_signal, least(8 + 4 * (p_size % 4), 20) AS technical, CASE WHEN p_size % 7 >= 2 THEN least(6 * (p_size % 7), 18) ELSE 0 END AS coverage FROM part""",
    covers=("TX23", "TX24"),
)
def op_tx23_bounded_bonuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped bonuses and penalties of the field score."""
    s = F.col("p_size")
    flag = lambda c: c.cast("int")
    return Tables(spark, sf_dir).part.select(
        "p_partkey", F.least(12 * flag(s > 40) + 8 * flag(F.col("p_retailprice") > 1500), F.lit(18)).alias("test_penalty"), F.least(14 + 6 * (s % 5), F.lit(30)).alias("path_signal"),
        F.least(8 + 4 * (s % 4), F.lit(20)).alias("technical"), F.when(s % 7 >= 2, F.least(6 * (s % 7), F.lit(18))).otherwise(0).alias("coverage"),
    )


@query(
    """SELECT p_partkey, round(0.3 + least(0.1 * (p_size % 6), 0.3) + CASE WHEN p_size > 40 THEN 0.1 ELSE 0 END - CASE WHEN p_retailprice > 1500 THEN 0.15 ELSE 0 END - CASE WHEN p_size % 3 = 0 THEN 0.04 ELSE 0 END, 4) AS rank_score FROM part""",
    covers=("TK09",),
)
def op_tk09_pivot_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    score = 0.3 + F.least(0.1 * (s % 6), F.lit(0.3)) + F.when(s > 40, 0.1).otherwise(0.0) - F.when(F.col("p_retailprice") > 1500, 0.15).otherwise(0.0) - F.when(s % 3 == 0, 0.04).otherwise(0.0)
    return Tables(spark, sf_dir).part.select("p_partkey", F.round(score, 4).alias("rank_score"))
