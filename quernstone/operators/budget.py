"""Budgets, packing, roles and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.plans.catalog import query
from quernstone.sources.tables import Tables


def prefix_within(df: DataFrame, partition: list[str], order: list, cost: Column, budget: float, most: int | None = None) -> DataFrame:
    """WN07. Rows of each group, in order, while their running cost stays within the budget."""
    own = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = df.withColumn("_used", F.sum(cost).over(own)).where(F.col("_used") <= budget)
    if most is not None:
        kept = kept.withColumn("_k", F.count("*").over(own)).where(F.col("_k") <= most).drop("_k")
    return kept.withColumnRenamed("_used", "used")


@query(
    """SELECT source, doc_id, used FROM (SELECT *, sum(ceil(length(text) / 4.0)) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS k FROM documents) WHERE used <= 1200 AND k <= 16""",
    covers=("WN07", "BU02"),
)
def op_wn07_prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents.select("source", "doc_id", "n_chars", T.estimate_tokens(F.col("text")).alias("cost"))
    return prefix_within(d, ["source"], ["n_chars", "doc_id"], F.col("cost"), 1200, 16).select("source", "doc_id", "used")


def greedy_skip(rows: Column, budget: int, most: int) -> Column:
    """WN09/PK01. Folds an ordered array of structs (id, cost): a row that doesn't fit is skipped, not an end. Ids taken."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["cost"] <= budget) & (F.size(acc["ids"]) < most)
        return F.struct(F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"))

    return F.aggregate(rows, start, step)


@query(
    """WITH RECURSIVE c AS (SELECT source, doc_id, ceil(length(text) / 4.0)::BIGINT AS cost, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS k FROM documents),
    o AS (SELECT doc_id, cost, row_number() OVER (ORDER BY k, source) AS i FROM c WHERE k <= 8),
    g(i, used, ids, n) AS (SELECT 0::BIGINT, 0::BIGINT, []::BIGINT[], 0 UNION ALL SELECT o.i, CASE WHEN used + cost <= 4000 AND n < 24 THEN used + cost ELSE used END, CASE WHEN used + cost <= 4000 AND n < 24 THEN list_append(ids, doc_id) ELSE ids END, CASE WHEN used + cost <= 4000 AND n < 24 THEN n + 1 ELSE n END FROM g JOIN o ON o.i = g.i + 1)
    SELECT unnest(ids) AS doc_id FROM (SELECT ids FROM g ORDER BY i DESC LIMIT 1)""",
    covers=("WN09", "WS06", "AG24", "PK01"),
)
def op_wn09_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources take turns by their rows' rank; 8 candidates a source, a budget of 4000 tokens, 24 rows."""
    own = Window.partitionBy("source").orderBy("n_chars", "doc_id")
    c = Tables(spark, sf_dir).documents.select("source", "doc_id", "n_chars", T.estimate_tokens(F.col("text")).alias("cost")).withColumn("k", F.row_number().over(own)).where("k <= 8")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "source", F.col("doc_id").alias("id"), "cost"))), lambda x: F.struct(x["id"].alias("id"), x["cost"].alias("cost")))
    return c.agg(greedy_skip(ordered, 4000, 24).alias("g")).select(F.explode("g.ids").alias("doc_id"))  # 8 rows a source


@query(
    """SELECT o_orderkey, CASE WHEN t < 1500 THEN 'micro' WHEN t < 12000 THEN 'standard' ELSE 'full' END AS tier, CASE WHEN t < 1500 THEN 1 WHEN t < 12000 THEN 2 ELSE 5 END AS pivots, least(400, greatest(25, ceil(t / 120.0)))::BIGINT AS pool FROM (SELECT o_orderkey, floor(o_totalprice / 10)::BIGINT AS t FROM orders)""",
    covers=("BU01", "BU07"),
)
def op_bu01_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    tier = F.when(t < 1500, "micro").when(t < 12000, "standard").otherwise("full")
    o = Tables(spark, sf_dir).orders.select("o_orderkey", F.floor(F.col("o_totalprice") / 10).alias("t"))
    return o.select("o_orderkey", tier.alias("tier"), F.when(t < 1500, 1).when(t < 12000, 2).otherwise(5).alias("pivots"), F.least(F.lit(400), F.greatest(F.lit(25), F.ceil(t / 120))).cast("long").alias("pool"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
    SELECT doc_id, k::BIGINT AS section, length(line) AS chars, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS upto FROM l""",
    covers=("BU06", "AN09"),
)
def op_bu06_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("doc_id").orderBy("k")
    lines = Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    lines = lines.select("doc_id", "k", F.length("line").cast("long").alias("chars"))
    return lines.select("doc_id", (F.col("k") + 1).cast("long").alias("section"), "chars", F.sum(F.col("chars") + 1).over(own).alias("upto"))


def chunk_lines(lines: Column, most: int, limit: int) -> Column:
    """SRC15. Packs lines, in order, into chunks of at most ``most`` characters, ``limit`` chunks: (first, last, chars)."""
    empty = F.array().cast("array<struct<first:int,last:int,chars:bigint>>")
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("i"), (F.length(x) + 1).cast("long").alias("n")))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["chars"] + x["n"] <= most)
        new = F.struct(x["i"].alias("first"), x["i"].alias("last"), x["n"].alias("chars"))
        grown = F.struct(last["first"].alias("first"), x["i"].alias("last"), (last["chars"] + x["n"]).alias("chars"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    return F.slice(F.aggregate(numbered, empty, step), 1, limit)


@query(
    """WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), c(doc_id, k, first, last, chars, i) AS (
      SELECT doc_id, 1, 1, 1, length(x[1]) + 1, 1 FROM l UNION ALL
      SELECT c.doc_id, CASE WHEN chars + length(x[i + 1]) + 1 <= 4096 THEN k ELSE k + 1 END, CASE WHEN chars + length(x[i + 1]) + 1 <= 4096 THEN first ELSE i + 1 END, i + 1, CASE WHEN chars + length(x[i + 1]) + 1 <= 4096 THEN chars + length(x[i + 1]) + 1 ELSE length(x[i + 1]) + 1 END, i + 1 FROM c JOIN l USING (doc_id) WHERE i < len(x))
    SELECT doc_id, k::BIGINT AS chunk, min(first)::BIGINT AS first_line, max(last)::BIGINT AS last_line, max(chars)::BIGINT AS chars FROM c WHERE k <= 32 GROUP BY doc_id, k""",
    covers=("SRC15",),
)
def op_src15_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(chunk_lines(F.split("text", "\n"), 4096, 32)).alias("k", "c"))
    return d.select("doc_id", (F.col("k") + 1).cast("long").alias("chunk"), F.col("c.first").cast("long").alias("first_line"), F.col("c.last").cast("long").alias("last_line"), F.col("c.chars").alias("chars"))


@query(
    """WITH r AS (SELECT p_partkey, p_size / 50.0 AS local, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM part), p AS (SELECT p_partkey FROM r WHERE local >= 0.3 ORDER BY k LIMIT 5), s AS (SELECT p_partkey FROM r WHERE k <= 40)
    SELECT p_partkey, CASE WHEN p_partkey IN (SELECT p_partkey FROM p) THEN 'pivot' WHEN p_partkey IN (SELECT p_partkey FROM s) THEN 'support' ELSE 'discard' END AS role FROM part""",
    covers=("RO01",),
)
def op_ro01_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pivots with evidence of their own, the rest of the best 40 support. Both sets are top-k, then broadcast."""
    p = Tables(spark, sf_dir).part
    order = (F.desc("p_retailprice"), "p_partkey")
    pivots = p.where(F.col("p_size") / 50.0 >= 0.3).orderBy(*order).limit(5).select("p_partkey", F.lit(True).alias("pivot"))
    support = p.orderBy(*order).limit(40).select("p_partkey", F.lit(True).alias("support"))
    return p.select("p_partkey").join(F.broadcast(pivots), "p_partkey", "left").join(F.broadcast(support), "p_partkey", "left").select("p_partkey", F.when(F.col("pivot"), "pivot").when(F.col("support"), "support").otherwise("discard").alias("role"))


@query(
    """SELECT item_id, CASE WHEN length(text) < 200 THEN 'micro' WHEN length(text) > 1200 THEN 'full' WHEN length(text) > 600 THEN 'standard' ELSE 'compact' END AS mode FROM benchmark""",
    covers=("RO03", "RT09"),
)
def op_ro03_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return Tables(spark, sf_dir).benchmark.select("item_id", F.when(n < 200, "micro").when(n > 1200, "full").when(n > 600, "standard").otherwise("compact").alias("mode"))


#: Fixed values: (intent, matcher, terms, priority, strength).
INTENT_RULES = [
    ("debug", "any", ["bug", "fail", "failing", "error", "crash", "broken", "incorrect", "exception", "traceback"], 100, 4),
    ("debug", "any", ["fix"], 90, 3),
    ("refactor", "any", ["refactor", "split", "move", "cleanup", "reorganize", "restructure"], 80, 3),
    ("refactor", "any", ["rename"], 85, 3),
    ("feature", "any", ["add", "implement", "create", "build"], 70, 3),
    ("feature", "any", ["support", "enable"], 75, 3),
    ("explain", "part", ["how does", "where is", "what is", "why does"], 60, 2),
    ("explain", "any", ["explain", "trace", "understand"], 65, 3),
]


def classify_intent(q: Column, rules: list | None = None, fallback: str = "explain") -> Column:
    """RO04/TX37. Strengths of matching rules add up by intent; the best wins, a tie or none falls back."""
    n = T.normalize_query(q)
    words = F.split(n, " ")
    totals: dict[str, Column] = {}
    for intent, kind, terms, _, strength in rules or INTENT_RULES:
        hit = F.arrays_overlap(words, F.array(*map(F.lit, terms))) if kind == "any" else F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(n, t))
        totals[intent] = totals.get(intent, F.lit(0)) + F.when(hit, strength).otherwise(0)
    ranked = F.sort_array(F.array(*[F.struct(v.alias("s"), F.lit(k).alias("intent")) for k, v in totals.items()]), asc=False)
    return F.when((ranked[0]["s"] >= 1) & (ranked[0]["s"] > ranked[1]["s"]), ranked[0]["intent"]).otherwise(fallback)


QUESTIONS = ["fix the crash in {}", "rename {}", "add support for {}", "how does {} work", "refactor and fix {}", "{}"]

_RULES_SQL = " UNION ALL ".join(f"SELECT '{i}' AS intent, '{k}' AS kind, {t} AS terms, {s} AS strength" for i, k, t, _, s in INTENT_RULES)


@query(
    f"""WITH q AS (SELECT p_partkey, replace({QUESTIONS}[(p_partkey % 6)::INT + 1], '{{}}', p_name) AS q FROM part), w AS (SELECT p_partkey, trim(regexp_replace(lower(q), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS n FROM q), r AS ({_RULES_SQL}),
    t AS (SELECT p_partkey, intent, sum(CASE WHEN kind = 'any' AND list_has_any(string_split(n, ' '), terms) OR kind = 'part' AND len(list_filter(terms, lambda x: contains(n, x))) > 0 THEN strength ELSE 0 END) AS s FROM w, r GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, intent DESC) AS k, lead(s) OVER (PARTITION BY p_partkey ORDER BY s DESC, intent DESC) AS second FROM t)
    SELECT p_partkey, CASE WHEN s >= 1 AND s > second THEN intent ELSE 'explain' END AS intent FROM k WHERE k = 1""",
    covers=("RO04", "TX37", "TK13"),
)
def op_ro04_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).part
    asked = F.replace(F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("p_partkey") % 6 + 1).cast("int")), F.lit("{}"), F.col("p_name"))
    return p.select("p_partkey", classify_intent(asked).alias("intent"))


def rule_score(files: Column, linked: list[str], names: Column, linked_names: list[str], terms: Column, query_terms: list[str], same_intent: Column) -> Column:
    """RU03. 30 and 4 a file, 12 and 2 a path prefix, 40 and 5 a symbol, 5 a term up to 20, 8 for the intent."""
    some = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    n = lambda a, xs: F.size(F.array_intersect(a, some(xs)))
    near = F.size(F.filter(files, lambda f: F.exists(some(linked), lambda x: x.startswith(F.concat(f, F.lit("/"))) | f.startswith(F.concat(x, F.lit("/"))))))
    step = lambda k, base, per: F.when(k > 0, base + per * k).otherwise(0)
    return step(n(files, linked), 30, 4) + step(near, 12, 2) + step(n(names, linked_names), 40, 5) + F.least(n(terms, query_terms) * 5, F.lit(20)) + F.when(same_intent, 8).otherwise(0)


@query(
    """WITH r AS (SELECT c_custkey, ['src' || (c_nationkey % 5), 'src1/en'] AS files, [c_mktsegment] AS names, string_split(lower(c_name), '#') AS terms FROM customer),
    s AS (SELECT c_custkey, CASE WHEN list_contains(files, 'src1') THEN 34 ELSE 0 END
      + CASE WHEN len(list_filter(files, lambda f: starts_with('src1', f || '/') OR starts_with(f, 'src1/'))) > 0 THEN 12 + 2 * len(list_filter(files, lambda f: starts_with('src1', f || '/') OR starts_with(f, 'src1/'))) ELSE 0 END
      + CASE WHEN list_contains(names, 'BUILDING') THEN 45 ELSE 0 END + least(5 * list_contains(terms, 'customer')::INT, 20) + CASE WHEN c_custkey % 2 = 0 THEN 8 ELSE 0 END AS score FROM r)
    SELECT c_custkey, score::BIGINT AS score FROM s ORDER BY score DESC, c_custkey LIMIT 3""",
    covers=("RU02", "RU03"),
)
def op_ru03_rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).customer
    files = F.array(F.concat(F.lit("src"), (F.col("c_nationkey") % 5).cast("string")), F.lit("src1/en"))
    score = rule_score(files, ["src1"], F.array("c_mktsegment"), ["BUILDING"], F.split(F.lower("c_name"), "#"), ["customer"], F.col("c_custkey") % 2 == 0)
    return c.select("c_custkey", score.cast("long").alias("score")).orderBy(F.desc("score"), "c_custkey").limit(3)


#: Evidence tiers, the strongest first.
TIERS = ["explicit_route", "path_containment", "indexed_path", "exact_symbol", "behavioral_mechanism"]


@query(
    """WITH e AS (SELECT l_orderkey AS request, l_suppkey AS repo, min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 3 ELSE 4 END) AS tier FROM lineitem GROUP BY 1, 2), b AS (SELECT request, min(tier) AS tier FROM e GROUP BY 1)
    SELECT request, CASE b.tier WHEN 1 THEN 'path_containment' WHEN 3 THEN 'exact_symbol' ELSE 'behavioral_mechanism' END AS tier, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(repo) END AS chosen FROM e JOIN b USING (request, tier) GROUP BY request, b.tier""",
    covers=("WS01", "WS02", "WS03"),
)
def op_ws01_nominate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest tier that has evidence decides; more than one candidate in it is ambiguous."""
    flag = F.col("l_returnflag")
    tier = F.when(flag == "A", 1).when(flag == "R", 3).otherwise(4)
    e = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_orderkey").alias("request"), F.col("l_suppkey").alias("repo")).agg(F.min(tier).alias("tier"))
    n = e.groupBy("request", "tier").agg(F.count("*").alias("candidates"), F.min("repo").alias("repo"))
    best = n.groupBy("request").agg(F.min(F.struct("tier", "candidates", "repo")).alias("b"))
    return best.select("request", F.element_at(F.array(*map(F.lit, TIERS)), F.col("b.tier") + 1).alias("tier"), F.col("b.candidates").alias("candidates"), F.when(F.col("b.candidates") == 1, F.col("b.repo")).alias("chosen"))


@query(
    """SELECT l_partkey AS subject, CASE WHEN count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') > 1 THEN 'ambiguous' WHEN count(*) FILTER (l_returnflag = 'N' AND l_quantity > 45) > 0 THEN 'unproven' WHEN count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') = 1 THEN 'unique' ELSE 'absent' END AS uniqueness FROM lineitem GROUP BY 1""",
    covers=("WS07",),
)
def op_ws07_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued: two present are ambiguous, an unknown one leaves it unproven, else unique or absent."""
    flag = F.col("l_returnflag")
    n, unknown = F.countDistinct(F.when(flag == "R", F.col("l_suppkey"))), F.count_if((flag == "N") & (F.col("l_quantity") > 45))
    g = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_partkey").alias("subject")).agg(n.alias("n"), unknown.alias("u"))
    return g.select("subject", F.when(F.col("n") > 1, "ambiguous").when(F.col("u") > 0, "unproven").when(F.col("n") == 1, "unique").otherwise("absent").alias("uniqueness"))


@query(
    """SELECT avg((event_type IN ('view', 'click'))::INT) >= 0.8 OR coalesce(max((event_type = 'purchase')::INT), 0) = 0 AS dominated, user_id FROM events GROUP BY user_id""",
    covers=("AN05",),
)
def op_an05_dominated_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, own = F.col("event_type").isin("view", "click").cast("int"), (F.col("event_type") == "purchase").cast("int")
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(((F.avg(test) >= 0.8) | (F.max(own) == 0)).alias("dominated"))


@query(
    """SELECT doc_id, CASE WHEN n_chars < 100 THEN 'not_covered' WHEN lang <> 'en' THEN 'unsupported_language' WHEN n_chars > 20000 THEN 'over_budget' ELSE 'answer' END AS state FROM documents""",
    covers=("PK05", "RE01"),
)
def op_pk05_decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return Tables(spark, sf_dir).documents.select("doc_id", F.when(n < 100, "not_covered").when(F.col("lang") != "en", "unsupported_language").when(n > 20000, "over_budget").otherwise("answer").alias("state"))
