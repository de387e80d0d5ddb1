"""Technical hints, roles refined within a pool, pools of tests filled up with production symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.plans.catalog import query
from quernstone.sources.codebase import CALLS_SQL, SYMBOLS_SQL, Codebase
from quernstone.sources.tables import Tables

#: Words that place a symbol in each dimension of a technical question, and what a hint adds.
DIMENSIONS = {
    "entrypoint": ("main", "cli", "run"),
    "io": ("input", "output", "read", "write", "load", "dump", "parse", "parser", "io", "ess"),
    "lowlevel": ("compiled", "extension", "internal", "core", "lowlevel"),
    "parser": ("parse", "parser", "parsing", "adapter", "ess"),
    "serialization": ("dict", "dictionary", "json", "yaml", "serialize", "dump", "load"),
    "utility": ("utility", "utilities", "util", "utils", "helper", "helpers", "common", "core", "internal"),
}
HINT = {"base": 8, "per_dimension": 4, "compiled": 8, "serialization": 6, "entrypoint": 6, "most": 20}
STARTERS = r"^(run|execute|launch|start)_"
SERIAL_NAMES = ("dict", "json", "yaml", "serialize")


def technical_hint(dimensions: list[str], name: Column, path: Column) -> Column:
    """TX25. What a question of these dimensions adds to a symbol: more for each that fits, all within the most."""
    words = F.concat(T.tokenize(name), T.tokenize(path))
    compiled = F.lower(path).rlike(r"\.(pyx|pxd|pxi)$")
    fits = {d: F.arrays_overlap(words, F.array(*map(F.lit, own))) for d, own in DIMENSIONS.items()}
    fits["entrypoint"] = fits["entrypoint"] | name.rlike(STARTERS) | T.basename(F.lower(path)).isin("main.py", "cli.py", "__main__.py")
    fits["lowlevel"] = fits["lowlevel"] | compiled
    asked = {d: fits[d] for d in dimensions}
    n = sum((c.cast("int") for c in asked.values()), F.lit(0))
    score = HINT["base"] + F.least((n - 1) * HINT["per_dimension"], F.lit(HINT["most"] - HINT["base"]))
    bonus = {"lowlevel": (compiled, HINT["compiled"]), "serialization": (F.arrays_overlap(T.tokenize(name), F.array(*map(F.lit, SERIAL_NAMES))), HINT["serialization"]), "entrypoint": (name.rlike(STARTERS), HINT["entrypoint"])}
    for d, (also, more) in bonus.items():
        if d in asked:
            score = score + F.when(asked[d] & also, more).otherwise(0)
    return F.when(n > 0, F.least(score, F.lit(HINT["most"]))).otherwise(0)


_PREFIXES = ["parse_", "run_", "util_", "json_", "core_", "", "load_", "dump_dict_"]


@query(
    f"""WITH {SYMBOLS_SQL}, s AS (SELECT symbol_id, ({_PREFIXES!r})[(symbol_id % 8)::INT + 1] || lower(local_name) AS name, CASE WHEN module_id % 4 = 0 THEN replace(path, '.py', '.pyx') ELSE path END AS path FROM symbols),
    w AS (SELECT *, list_concat({T.TOKENIZE_SQL.format(c="name")}, {T.TOKENIZE_SQL.format(c="path")}) AS ws, {T.TOKENIZE_SQL.format(c="name")} AS nw, ends_with(path, '.pyx') AS compiled FROM s),
    f AS (SELECT *, (list_has_any(ws, ['main', 'cli', 'run']) OR regexp_matches(name, '^(run|execute|launch|start)_'))::INT AS e, (compiled OR list_has_any(ws, ['compiled', 'extension', 'internal', 'core', 'lowlevel']))::INT AS l, list_has_any(ws, ['parse', 'parser', 'parsing', 'adapter', 'ess'])::INT AS p, list_has_any(ws, ['dict', 'dictionary', 'json', 'yaml', 'serialize', 'dump', 'load'])::INT AS z FROM w)
    SELECT symbol_id, CASE WHEN e + l + p + z > 0 THEN least(20, 8 + least(12, 4 * (e + l + p + z - 1)) + CASE WHEN l = 1 AND compiled THEN 8 ELSE 0 END + CASE WHEN z = 1 AND list_has_any(nw, ['dict', 'json', 'yaml', 'serialize']) THEN 6 ELSE 0 END + CASE WHEN e = 1 AND regexp_matches(name, '^(run|execute|launch|start)_') THEN 6 ELSE 0 END) ELSE 0 END AS hint FROM f""",
    covers=("TX25",),
)
def op_tx25_technical_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with prefixes of several dimensions; a quarter of the modules is compiled."""
    prefix = F.get(F.array(*map(F.lit, _PREFIXES)), (F.col("symbol_id") % 8).cast("int"))
    path = F.when(F.col("module_id") % 4 == 0, F.replace("path", F.lit(".py"), F.lit(".pyx"))).otherwise(F.col("path"))
    s = Codebase(Tables(spark, sf_dir)).symbols().select("symbol_id", F.concat(prefix, F.lower("local_name")).alias("name"), path.alias("path"))
    return s.select("symbol_id", technical_hint(["entrypoint", "lowlevel", "parser", "serialization"], F.col("name"), F.col("path")).alias("hint"))


NAME_OVERLAP, FANOUT = 2, 2


def refined_roles(pool: DataFrame, calls: DataFrame) -> DataFrame:
    """RO02. symbol_id, role: the base role of each candidate, then overrides in order, the last that fits stands.

    ``pool`` has symbol_id, role, kind, local (in the question's package), overlap (words its
    name shares with the question), evidence, generic, is_test, named, expansion, holds_expansion, literal, anchored.
    Calls within the pool are one self join; a dispatcher calls two or more qualifying helpers.
    """
    c = F.col
    able = c("kind").isin("function", "method") & ~c("is_test")
    held = pool.withColumn("qualifies", able & c("local") & c("evidence") & (c("overlap") >= 1))
    edges = calls.select("src", "dst").distinct()
    fan = edges.join(held.where("qualifies").select(c("symbol_id").alias("dst")), "dst", "left_semi").groupBy(c("src").alias("symbol_id")).agg(F.count("*").alias("fan"))
    held = held.join(fan, "symbol_id", "left").withColumn("dispatcher", able & (F.coalesce("fan", F.lit(0)) >= FANOUT))
    called = edges.join(held.where("dispatcher").select(c("symbol_id").alias("src")), "src", "left_semi").select(c("dst").alias("symbol_id"), F.lit(True).alias("by_dispatcher")).distinct()
    held = held.join(called, "symbol_id", "left")
    helper = ~c("dispatcher") & c("qualifies") & ((c("overlap") >= NAME_OVERLAP) | F.coalesce("by_dispatcher", F.lit(False)))
    role = F.when(c("generic") & ~c("local") & (c("overlap") == 0), "support").when(helper, "pivot").otherwise(c("role"))
    held = held.withColumn("r", role)
    role = F.when(c("dispatcher") & ~((c("r") == "pivot") & c("named") & able), "support").otherwise(c("r"))
    role = F.when(c("expansion"), "pivot").when(c("holds_expansion"), "support").otherwise(role)
    role = F.when(c("literal") & able, "pivot").otherwise(role)
    return held.select("symbol_id", F.when(c("anchored"), "pivot").otherwise(role).alias("role"))


@query(
    f"""WITH {SYMBOLS_SQL}, {CALLS_SQL}, e AS (SELECT DISTINCT src, dst FROM calls WHERE edge_type = 'calls' AND src % 3 = 0),
    p AS (SELECT symbol_id, kind, CASE WHEN symbol_id % 3 = 0 THEN 'pivot' ELSE 'support' END AS role, (path LIKE 'src/pkg1/%' OR path LIKE 'src/pkg2/%') AS local, len(list_intersect(list_distinct({T.TOKENIZE_SQL.format(c="local_name")}), ['small', 'ring', 'red', 'error'])) AS overlap, symbol_id % 5 <> 2 AS evidence,
      local_name LIKE 'base\\_error%' ESCAPE '\\' AS generic, starts_with(path, 'tests/') OR starts_with(local_name, 'test_') AS is_test, symbol_id % 8 = 0 AS named, symbol_id % 41 = 1 AS expansion, symbol_id % 41 = 2 AS holds, symbol_id % 37 = 5 AS literal, symbol_id % 53 = 4 AS anchored FROM symbols),
    q AS (SELECT *, kind IN ('function', 'method') AND NOT is_test AS able, kind IN ('function', 'method') AND NOT is_test AND local AND evidence AND overlap >= 1 AS qualifies FROM p),
    f AS (SELECT src, count(*) AS fan FROM e WHERE dst IN (SELECT symbol_id FROM q WHERE qualifies) GROUP BY src),
    d AS (SELECT q.*, able AND coalesce(fan, 0) >= 2 AS dispatcher FROM q LEFT JOIN f ON f.src = symbol_id), b AS (SELECT DISTINCT dst FROM e WHERE src IN (SELECT symbol_id FROM d WHERE dispatcher)),
    r AS (SELECT *, CASE WHEN generic AND NOT local AND overlap = 0 THEN 'support' WHEN NOT dispatcher AND qualifies AND (overlap >= 2 OR symbol_id IN (SELECT dst FROM b)) THEN 'pivot' ELSE role END AS r1 FROM d)
    SELECT symbol_id, CASE WHEN anchored THEN 'pivot' WHEN literal AND able THEN 'pivot' WHEN expansion THEN 'pivot' WHEN holds THEN 'support' WHEN dispatcher AND NOT (r1 = 'pivot' AND named AND able) THEN 'support' ELSE r1 END AS role FROM r""",
    covers=("RO02",),
)
def op_ro02_refined_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols as one pool; the question is about small red rings that err, in two packages."""
    code, k = Codebase(Tables(spark, sf_dir)), F.col("symbol_id")
    words = F.array(*map(F.lit, ("small", "ring", "red", "error")))
    pool = code.symbols().select(
        "symbol_id", "kind", F.when(k % 3 == 0, "pivot").otherwise("support").alias("role"), (F.col("path").startswith("src/pkg1/") | F.col("path").startswith("src/pkg2/")).alias("local"),
        F.size(F.array_intersect(T.tokenize(F.col("local_name")), words)).alias("overlap"), (k % 5 != 2).alias("evidence"), F.col("local_name").startswith("base_error").alias("generic"),
        (F.col("path").startswith("tests/") | F.col("local_name").startswith("test_")).alias("is_test"), (k % 8 == 0).alias("named"), (k % 41 == 1).alias("expansion"), (k % 41 == 2).alias("holds_expansion"), (k % 37 == 5).alias("literal"), (k % 53 == 4).alias("anchored"),
    )
    return refined_roles(pool, code.calls().where("edge_type = 'calls' AND src % 3 = 0"))


DOMINANCE, POOL = 0.8, 12


def production_backfill(pools: DataFrame, production: DataFrame) -> DataFrame:
    """AN04. pool, symbol_id, added: pools that tests dominate get production symbols of their topic, up to a pool's size.

    Tests dominate where they are four of five, or where nothing else can be edited. ``pools``
    has pool, topic, symbol_id, is_test, able; ``production`` topic, symbol_id, score.
    """
    g = pools.groupBy("pool", "topic").agg(F.avg(F.col("is_test").cast("int")).alias("share"), F.count_if(~F.col("is_test") & F.col("able")).alias("others"))
    dominated = g.where((F.col("others") == 0) | (F.col("share") >= DOMINANCE)).select("pool", "topic")
    top = Window.partitionBy("topic").orderBy(F.desc("score"), "symbol_id")
    best = production.withColumn("k", F.row_number().over(top)).where(F.col("k") <= POOL).select("topic", "symbol_id")
    new = dominated.join(best, "topic").select("pool", "symbol_id").join(pools.select("pool", "symbol_id"), ["pool", "symbol_id"], "left_anti")
    return pools.select("pool", "symbol_id", F.lit(False).alias("added")).unionByName(new.select("pool", "symbol_id", F.lit(True).alias("added")))


@query(
    f"""WITH {SYMBOLS_SQL}, c AS (SELECT symbol_id, module_id % 20 AS pool, module_id % 5 AS topic, starts_with(path, 'tests/') OR starts_with(local_name, 'test_') OR module_id % 20 IN (3, 8) AND symbol_id % 6 > 0 AS is_test, kind <> 'constant' AS able, length(coalesce(docstring, '')) AS score FROM symbols),
    d AS (SELECT pool, topic FROM c GROUP BY pool, topic HAVING count(*) FILTER (WHERE NOT is_test AND able) = 0 OR avg(is_test::INT) >= 0.8),
    b AS (SELECT topic, symbol_id FROM c WHERE NOT is_test AND able QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, symbol_id) <= 12)
    SELECT pool, symbol_id, false AS added FROM c UNION ALL SELECT d.pool, b.symbol_id, true FROM d JOIN b USING (topic) WHERE (d.pool, b.symbol_id) NOT IN (SELECT (pool, symbol_id) FROM c)""",
    covers=("AN04",),
)
def op_an04_production_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules in twenty pools and five topics; two pools are made of tests."""
    m, k = F.col("module_id"), F.col("symbol_id")
    is_test = F.col("path").startswith("tests/") | F.col("local_name").startswith("test_") | ((m % 20).isin(3, 8) & (k % 6 > 0))
    c = Codebase(Tables(spark, sf_dir)).symbols().select("symbol_id", (m % 20).alias("pool"), (m % 5).alias("topic"), is_test.alias("is_test"), (F.col("kind") != "constant").alias("able"), F.length(F.coalesce("docstring", F.lit(""))).alias("score"))
    return production_backfill(c, c.where("NOT is_test AND able").select("topic", "symbol_id", "score"))


PREFIX = 4


def subject_match(name: Column, terms: list[str]) -> Column:
    """TX32. exact if a word of the name is one of the subject's, stem if it shares a prefix of four letters and all but three, else none."""
    words = T.tokenize(name)
    exact = F.arrays_overlap(words, F.array(*map(F.lit, terms)))
    stem = F.lit(False)
    for t in terms:
        stem = stem | _shares(words, t)
    return F.when(F.coalesce(name, F.lit("")) == "", "none").when(exact, "exact").when(stem, "stem").otherwise("none")


def _shares(words: Column, term: str) -> Column:
    return F.exists(words, lambda w: T.shared_stem(w, F.lit(term), PREFIX))


@query(
    f"""WITH {SYMBOLS_SQL}, w AS (SELECT symbol_id, {T.TOKENIZE_SQL.format(c="local_name")} AS ws FROM symbols), t AS (SELECT unnest(['rings', 'error', 'smalls']) AS t)
    SELECT symbol_id, CASE WHEN list_has_any(ws, ['rings', 'error', 'smalls']) THEN 'exact' WHEN EXISTS (SELECT 1 FROM t WHERE len(list_filter(ws, lambda w: least(length(w), length(t)) >= 4 AND left(w, greatest(4, least(length(w), length(t)) - 3)::INT) = left(t, greatest(4, least(length(w), length(t)) - 3)::INT))) > 0) THEN 'stem' ELSE 'none' END AS match FROM w""",
    covers=("TX32",),
)
def op_tx32_subject_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Codebase(Tables(spark, sf_dir)).symbols().select("symbol_id", subject_match(F.col("local_name"), ["rings", "error", "smalls"]).alias("match"))
