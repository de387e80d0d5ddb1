"""Neighbourhoods of seeds and pivots, paths worth completing, run chains, callers in source lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.operators.extract import all_of
from quernstone.plans.catalog import query
from quernstone.plans.lineage import cut
from quernstone.sources.codebase import CALLS_SQL, SYMBOLS_SQL, Codebase
from quernstone.sources.tables import Tables

#: Strengths of evidence from the best down.
STRENGTHS = ("exact", "resolved", "conservative", "lexical", "unresolved")


def path_order(strengths: Column, files: Column, key: Column) -> list[Column]:
    """TK07. Sort keys of static paths: weakest strength, length, changes of file, key. Strengths are of edges, files of nodes."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, STRENGTHS)), s)
    weakest = F.array_max(F.transform(strengths, rank))
    changes = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(files) - 1, F.lit(1))), lambda i: F.get(files, i) != F.get(files, i - 1)))
    return [weakest, F.size(strengths), changes, key]


@query(
    """WITH e AS (SELECT l_orderkey, l_linenumber, CASE l_suppkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'resolved' WHEN 2 THEN 'conservative' WHEN 3 THEN 'lexical' ELSE 'unresolved' END AS s, l_suppkey % 5 AS r, 'f' || (l_partkey % 3) AS f, l_partkey FROM lineitem WHERE l_orderkey % 9 = 0),
    p AS (SELECT l_orderkey, list(r ORDER BY l_linenumber, l_partkey) AS rs, list(f ORDER BY l_linenumber, l_partkey) AS fs FROM e GROUP BY l_orderkey),
    k AS (SELECT l_orderkey, list_max(rs) AS weakest, len(rs) AS n, len(list_filter(range(2, len(fs) + 1), lambda i: fs[i] <> fs[i - 1])) AS changes, array_to_string(fs, '>') AS key FROM p)
    SELECT l_orderkey, ['exact', 'resolved', 'conservative', 'lexical', 'unresolved'][weakest + 1] AS weakest, row_number() OVER (ORDER BY k.weakest, n, changes, key, l_orderkey) AS place FROM k QUALIFY place <= 500""",
    covers=("TK07", "AG25", "TX53"),
)
def op_tk07_static_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as paths: lines are edges, their parts' files the nodes. The 500 first."""
    edge = F.struct("l_linenumber", "l_partkey", F.get(F.array(*map(F.lit, STRENGTHS)), (F.col("l_suppkey") % 5).cast("int")).alias("s"), F.concat(F.lit("f"), (F.col("l_partkey") % 3).cast("string")).alias("f"))
    p = Tables(spark, sf_dir).lineitem.where("l_orderkey % 9 = 0").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(edge)).alias("e"))
    held = p.select("l_orderkey", F.col("e.s").alias("s"), F.col("e.f").alias("f"))
    keys = path_order(F.col("s"), F.col("f"), F.array_join("f", ">"))
    best = held.orderBy(*keys, "l_orderkey").limit(500)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*keys, "l_orderkey")).cast("long")).select("l_orderkey", F.get(F.array(*map(F.lit, STRENGTHS)), (keys[0] - 1).cast("int")).alias("weakest"), "place")


MOST_SEEDS, PER_SEED, MOST_NEIGHBOURS, EXPANDED = 12, 4, 8, 40


def neighbour_anchors(seeds: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """GR25. seed, neighbour, relation: production symbols one step from the first seeds.

    At most :data:`MOST_SEEDS` seeds, of :data:`EXPANDED` neighbours by id; a neighbour that is a
    seed itself, a test or module-level is none. Each goes to its first seed that has
    fewer than :data:`PER_SEED`, until there are :data:`MOST_NEIGHBOURS`: a fold over the few rows left.
    """
    first = seeds.orderBy("seed").limit(MOST_SEEDS)
    out = edges.join(F.broadcast(first), edges["src"] == first["seed"]).select("seed", F.col("dst").alias("neighbour"), F.concat(F.col("edge_type"), F.lit(" by")).alias("relation"))
    back = edges.join(F.broadcast(first), edges["dst"] == first["seed"]).select("seed", F.col("src").alias("neighbour"), F.concat(F.col("edge_type"), F.lit(" of")).alias("relation"))
    ways = out.unionByName(back).groupBy("seed", "neighbour").agg(F.min("relation").alias("relation")).join(seeds.select(F.col("seed").alias("neighbour")), "neighbour", "left_anti")
    fit = symbols.where("kind IN ('function', 'method', 'class') AND NOT startswith(path, 'tests/') AND NOT startswith(local_name, 'test_')").select(F.col("symbol_id").alias("neighbour"))
    near = ways.join(fit, "neighbour").groupBy("neighbour").agg(F.array_sort(F.collect_list(F.struct("seed", "relation"))).alias("ways")).orderBy("neighbour").limit(EXPANDED)
    picked = F.aggregate(
        F.array_sort(F.collect_list(F.struct("neighbour", "ways"))),
        F.array().cast("array<struct<seed:bigint,neighbour:bigint,relation:string>>"),
        lambda done, n: F.when(F.size(done) >= MOST_NEIGHBOURS, done).otherwise(F.concat(done, F.slice(F.transform(F.filter(n["ways"], lambda w: F.size(F.filter(done, lambda d: d["seed"] == w["seed"])) < PER_SEED), lambda w: F.struct(w["seed"].alias("seed"), n["neighbour"].alias("neighbour"), w["relation"].alias("relation"))), 1, 1))),
    )
    return near.agg(picked.alias("p")).select(F.explode("p").alias("p")).select("p.*")


def _anchor_oracle(n: int = EXPANDED) -> str:
    """The fold as a recursive query: one neighbour a step, with the seeds' counts in a list."""
    return f"""WITH RECURSIVE {SYMBOLS_SQL}, {CALLS_SQL}, seeds AS (SELECT symbol_id AS seed FROM symbols WHERE symbol_id % 17 = 3), f AS (SELECT seed FROM seeds ORDER BY seed LIMIT 12),
    ways AS (SELECT seed, nb, min(relation) AS relation FROM (SELECT seed, dst AS nb, edge_type || ' by' AS relation FROM calls JOIN f ON src = seed UNION ALL SELECT seed, src, edge_type || ' of' FROM calls JOIN f ON dst = seed) x WHERE nb NOT IN (SELECT seed FROM seeds) GROUP BY seed, nb),
    fit AS (SELECT symbol_id FROM symbols WHERE kind IN ('function', 'method', 'class') AND NOT starts_with(path, 'tests/') AND NOT starts_with(local_name, 'test_')),
    near AS (SELECT nb, list({{'seed': seed, 'relation': relation}} ORDER BY seed) AS ways, row_number() OVER (ORDER BY nb) AS k FROM ways WHERE nb IN (SELECT symbol_id FROM fit) GROUP BY nb),
    walk AS (SELECT 0::BIGINT AS k, []::STRUCT(seed BIGINT, neighbour BIGINT, relation VARCHAR)[] AS done
      UNION ALL SELECT n.k, CASE WHEN len(done) >= 8 THEN done ELSE list_concat(done, list_transform(list_filter(n.ways, lambda w: len(list_filter(done, lambda d: d.seed = w.seed)) < 4)[1:1], lambda w: {{'seed': w.seed, 'neighbour': n.nb, 'relation': w.relation}})) END
      FROM walk JOIN near n ON n.k = walk.k + 1 WHERE n.k <= {n})
    SELECT p.seed, p.neighbour, p.relation FROM (SELECT unnest(done) AS p FROM (SELECT done FROM walk ORDER BY k DESC LIMIT 1) x) y"""


@query(_anchor_oracle(), covers=("GR25",))
def op_gr25_neighbour_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = Codebase(Tables(spark, sf_dir))
    symbols = code.symbols()
    return neighbour_anchors(symbols.where("symbol_id % 17 = 3").select(F.col("symbol_id").alias("seed")), code.calls(), symbols)


#: Relations of a neighbour to its pivot from the closest on; a pivot shows so many.
RELATIONS = {"caller": 1, "callee": 2, "importer": 3, "imported": 4, "reference": 5, "sibling": 6}
PER_PIVOT = 4


def pivot_neighbourhoods(pivots: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """GR28. pivot_id, neighbour, reason, place: what is closest to each pivot, each neighbour by its best relation."""
    reason = lambda call, take: F.when(F.col("edge_type") == "calls", call).when(F.col("edge_type") == "imports", take).when(F.col("edge_type") == "references", "reference")
    out = edges.join(pivots, edges["src"] == pivots["pivot_id"]).select("pivot_id", F.col("dst").alias("neighbour"), reason("callee", "imported").alias("reason"))
    back = edges.join(pivots, edges["dst"] == pivots["pivot_id"]).select("pivot_id", F.col("src").alias("neighbour"), reason("caller", "importer").alias("reason"))
    own = symbols.join(pivots, symbols["symbol_id"] == pivots["pivot_id"]).select("pivot_id", "module_id")
    side = symbols.join(own, "module_id").select("pivot_id", F.col("symbol_id").alias("neighbour"), F.lit("sibling").alias("reason"))
    order = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    near = out.unionByName(back).unionByName(side).where("reason IS NOT NULL AND pivot_id <> neighbour").join(symbols.select(F.col("symbol_id").alias("neighbour"), "fq_name"), "neighbour")
    best = near.groupBy("pivot_id", "neighbour", "fq_name").agg(F.min_by("reason", order[F.col("reason")]).alias("reason"))
    place = F.row_number().over(Window.partitionBy("pivot_id").orderBy(order[F.col("reason")], "fq_name", "neighbour"))
    return best.withColumn("place", place).where(F.col("place") <= PER_PIVOT).select("pivot_id", "neighbour", "reason", "place")


@query(
    f"""WITH {SYMBOLS_SQL}, {CALLS_SQL}, pv AS (SELECT symbol_id AS pivot_id, module_id FROM symbols WHERE symbol_id % 13 = 5), r AS (
      SELECT pivot_id, dst AS neighbour, CASE edge_type WHEN 'calls' THEN 2 WHEN 'imports' THEN 4 WHEN 'references' THEN 5 END AS r FROM calls JOIN pv ON src = pivot_id
      UNION ALL SELECT pivot_id, src, CASE edge_type WHEN 'calls' THEN 1 WHEN 'imports' THEN 3 WHEN 'references' THEN 5 END FROM calls JOIN pv ON dst = pivot_id
      UNION ALL SELECT pivot_id, symbol_id, 6 FROM symbols JOIN pv USING (module_id)),
    b AS (SELECT pivot_id, neighbour, fq_name, min(r) AS r FROM r JOIN symbols ON symbol_id = neighbour WHERE r IS NOT NULL AND pivot_id <> neighbour GROUP BY ALL)
    SELECT pivot_id, neighbour, ['caller', 'callee', 'importer', 'imported', 'reference', 'sibling'][r] AS reason, row_number() OVER (PARTITION BY pivot_id ORDER BY r, fq_name, neighbour) AS place FROM b QUALIFY place <= 4""",
    covers=("GR28",),
)
def op_gr28_pivot_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = Codebase(Tables(spark, sf_dir))
    symbols = code.symbols()
    return pivot_neighbourhoods(symbols.where("symbol_id % 13 = 5").select(F.col("symbol_id").alias("pivot_id")), code.calls(), symbols)


#: Fixed values of path completion.
LEAST_RELEVANCE, LEAST_TERMS, LEAST_SLOTS, MOST_DEPTH, MOST_PATHS = 0.3, 2, 2, 2, 1


def path_rejection(selected: Column, structural: Column, depth: Column, downstream: Column, delivered: Column, branch: Column, seeds_called: Column, relevance: Column, terms: Column) -> Column:
    """GR27. Why a rescued path isn't completed, by the first gate it fails; null if it may be."""
    chain, controls = depth >= 2, (depth == 1) & branch & (seeds_called >= 2)
    return (
        F.when(selected, "already_selected").when(structural, "structural").when((depth > MOST_DEPTH) | (downstream < 1), "depth").when(delivered != downstream, "no_coherent_path")
        .when(~chain & ~controls, "no_coherent_path").when((relevance < LEAST_RELEVANCE) | (terms < LEAST_TERMS), "weak_relevance")
    )


@query(
    f"""WITH {SYMBOLS_SQL}, {CALLS_SQL}, c AS (SELECT DISTINCT src, dst FROM calls WHERE edge_type = 'calls' AND src <> dst AND dst IN (SELECT symbol_id FROM symbols)), sel AS (SELECT symbol_id FROM symbols WHERE symbol_id % 5 IN (0, 1, 4)), seed AS (SELECT symbol_id FROM symbols WHERE symbol_id % 25 = 10),
    paths AS (SELECT a.src AS cand, a.dst AS mid, NULL::BIGINT AS last, 1 AS depth FROM c a WHERE a.dst IN (SELECT symbol_id FROM seed) UNION ALL SELECT a.src, a.dst, b.dst, 2 FROM c a JOIN c b ON b.src = a.dst WHERE b.dst IN (SELECT symbol_id FROM seed) AND a.src <> b.dst),
    calledseeds AS (SELECT src, count(DISTINCT dst) AS n FROM c WHERE dst IN (SELECT symbol_id FROM seed) AND dst IN (SELECT symbol_id FROM sel) GROUP BY src),
    j AS (SELECT p.*, s.fq_name, s.kind, length(s.local_name) % 5 AS terms, round(length(s.signature) / 60.0, 4) AS relevance, coalesce(n, 0) AS n, (mid IN (SELECT symbol_id FROM sel))::INT + coalesce((last IN (SELECT symbol_id FROM sel))::INT, 0) AS delivered FROM paths p JOIN symbols s ON s.symbol_id = cand LEFT JOIN calledseeds x ON x.src = cand),
    r AS (SELECT *, CASE WHEN cand IN (SELECT symbol_id FROM sel) THEN 'already_selected' WHEN kind = 'constant' THEN 'structural' WHEN delivered <> depth THEN 'no_coherent_path' WHEN depth < 2 AND n < 2 THEN 'no_coherent_path' WHEN relevance < 0.3 OR terms < 2 THEN 'weak_relevance' END AS why FROM j)
    SELECT coalesce(why, 'eligible') AS outcome, count(*) AS n, CASE WHEN why IS NULL THEN (SELECT fq_name FROM r WHERE why IS NULL ORDER BY depth DESC, relevance DESC, fq_name, cand LIMIT 1) END AS completed FROM r GROUP BY why""",
    covers=("GR27",),
)
def op_gr27_path_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers one or two steps above seeds: how many each gate turns away, and the one path that is completed."""
    code = Codebase(Tables(spark, sf_dir))
    symbols = code.symbols()
    ids = symbols.select("symbol_id")
    selected, seeds = ids.where("symbol_id % 5 IN (0, 1, 4)").withColumn("is_selected", F.lit(True)), ids.where("symbol_id % 25 = 10")
    c = code.calls().where("edge_type = 'calls' AND src <> dst").select("src", "dst").distinct().join(ids.withColumnRenamed("symbol_id", "dst"), "dst", "left_semi")
    last = cut(c.join(seeds.withColumnRenamed("symbol_id", "dst"), "dst", "left_semi").select("src", "dst"))
    one = last.select(F.col("src").alias("cand"), F.col("dst").alias("mid"), F.lit(None).cast("long").alias("last"), F.lit(1).alias("depth"))
    two = c.select(F.col("src").alias("cand"), F.col("dst").alias("mid")).join(last.select(F.col("src").alias("mid"), F.col("dst").alias("last")), "mid").where("cand <> last").select("cand", "mid", "last", F.lit(2).alias("depth"))
    called = last.join(selected.withColumnRenamed("symbol_id", "dst"), "dst").groupBy(F.col("src").alias("cand")).agg(F.countDistinct("dst").alias("n_seeds"))
    is_in = lambda name: selected.select(F.col("symbol_id").alias(name), F.col("is_selected").alias(f"{name}_in"))
    held = one.unionByName(two).join(symbols.select(F.col("symbol_id").alias("cand"), "fq_name", "kind", "local_name", "signature"), "cand").join(called, "cand", "left")
    for name in ("cand", "mid", "last"):
        held = held.join(is_in(name), name, "left")
    flag = lambda name: F.coalesce(f"{name}_in", F.lit(False))
    relevance = F.round(F.length("signature") / 60.0, 4)
    why = path_rejection(flag("cand"), F.col("kind") == "constant", F.col("depth"), F.col("depth"), flag("mid").cast("int") + flag("last").cast("int"), F.lit(True), F.coalesce("n_seeds", F.lit(0)), relevance, F.length("local_name") % 5)
    held = held.select("fq_name", "cand", "depth", relevance.alias("relevance"), F.coalesce(why, F.lit("eligible")).alias("outcome"))
    # the longest chain first, then relevance, then the name; the least of a struct is taken before the shuffle
    first = F.min(F.when(F.col("outcome") == "eligible", F.struct((-F.col("depth")).alias("d"), (-F.col("relevance")).alias("r"), "fq_name", "cand")))
    return held.groupBy("outcome").agg(F.count("*").alias("n"), first.alias("f")).select("outcome", "n", F.col("f.fq_name").alias("completed"))


MOST_STEPS = 64


def run_steps(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """ME04. source, comparison, run_id, step: the runs after source up to comparison, by previous_run_id.

    One join a step for all spans at once. Spans whose chain doesn't reach their source give no rows.
    """
    links = runs.select(F.col("run_id"), "previous_run_id")
    at = spans.where("source <> comparison").select("source", "comparison", F.col("comparison").alias("run_id"))
    found, done = None, None
    for back in range(MOST_STEPS):
        at = cut(at.join(links, "run_id"))
        if at.isEmpty():
            break
        own = at.select("source", "comparison", "run_id", F.lit(back).alias("back"))
        found = own if found is None else found.unionByName(own)
        reached = at.where("previous_run_id = source").select("source", "comparison", F.lit(back).alias("steps"))
        done = reached if done is None else done.unionByName(reached)
        at = at.where("previous_run_id IS NOT NULL AND previous_run_id <> source").select("source", "comparison", F.col("previous_run_id").alias("run_id"))
    if found is None:
        return spans.where("false").select("source", "comparison", F.col("source").alias("run_id"), F.lit(0).alias("step"))
    return found.join(done, ["source", "comparison"]).select("source", "comparison", "run_id", (F.col("steps") - F.col("back") + 1).alias("step"))


#: Reasons for staleness, the worst first.
STALE_REASONS = {"file_removed": 0, "symbol_removed": 1, "symbol_modified": 2, "file_modified": 3}


def observation_staleness(observations: DataFrame, links: DataFrame, runs: DataFrame, diffs: DataFrame, comparison: int) -> DataFrame:
    """JN16. observation_id, status, reason, detected_in: what became of what an observation links to since its run.

    Links and diffs share a target: a path, or the identity of a symbol. A run that is
    no longer there, or later than the comparison, makes an observation stale by itself;
    one without a run is fresh.
    """
    obs = observations.join(runs.select(F.col("run_id").alias("source"), F.lit(True).alias("known")), "source", "left")
    unavailable = F.col("source").isNotNull() & (F.col("known").isNull() | (F.col("source") > comparison))
    walked = obs.where(~unavailable & F.col("source").isNotNull())
    steps = run_steps(runs, walked.select("source", F.lit(comparison).cast("long").alias("comparison")).distinct())
    hit = walked.join(links, "observation_id").join(diffs, "target").join(steps.select("source", "run_id"), ["source", "run_id"])
    rank = F.create_map(*[F.lit(x) for kv in STALE_REASONS.items() for x in kv])
    worst = hit.groupBy("observation_id").agg(F.min(F.struct(rank[F.col("change")].alias("rank"), F.col("run_id"), F.col("change"))).alias("w"))
    gone = F.struct(F.lit("source_run_unavailable").alias("reason"), F.lit(comparison).cast("long").alias("run"))
    found = F.when(unavailable, gone).when(F.col("w").isNotNull(), F.struct(F.col("w.change").alias("reason"), F.col("w.run_id").alias("run")))
    return obs.join(worst, "observation_id", "left").select("observation_id", F.when(found.isNull(), "fresh").otherwise("stale").alias("status"), found["reason"].alias("reason"), found["run"].alias("detected_in"))


@query(
    """WITH RECURSIVE runs AS (SELECT n_nationkey + 1 AS run_id, CASE WHEN n_nationkey = 0 THEN NULL WHEN n_nationkey % 4 = 3 THEN n_nationkey - 1 ELSE n_nationkey END AS prev FROM nation WHERE n_nationkey <> 7),
    obs AS (SELECT c_custkey AS observation_id, CASE WHEN c_custkey % 6 > 0 THEN c_nationkey + 1 END AS source FROM customer),
    links AS (SELECT DISTINCT o_custkey AS observation_id, 't' || (o_orderkey % 400) AS target FROM orders),
    diffs AS (SELECT DISTINCT 't' || (l_partkey % 400) AS target, l_suppkey % 25 + 1 AS run_id, CASE (l_partkey + l_suppkey) % 4 WHEN 0 THEN 'file_removed' WHEN 1 THEN 'symbol_removed' WHEN 2 THEN 'symbol_modified' ELSE 'file_modified' END AS change FROM lineitem WHERE l_orderkey % 23 = 0),
    walk AS (SELECT 25::BIGINT AS run_id, 0 AS back UNION ALL SELECT r.prev, w.back + 1 FROM walk w JOIN runs r ON r.run_id = w.run_id WHERE r.prev IS NOT NULL),
    st AS (SELECT s.source, w.run_id FROM (SELECT DISTINCT source FROM obs) s JOIN walk x ON x.run_id = s.source JOIN walk w ON w.back < x.back),
    h AS (SELECT o.observation_id, d.run_id, d.change, CASE d.change WHEN 'file_removed' THEN 0 WHEN 'symbol_removed' THEN 1 WHEN 'symbol_modified' THEN 2 ELSE 3 END AS r FROM obs o JOIN links USING (observation_id) JOIN diffs d USING (target) JOIN st ON st.source = o.source AND st.run_id = d.run_id),
    w AS (SELECT observation_id, min({'r': r, 'run_id': run_id, 'change': change}) AS w FROM h GROUP BY observation_id)
    SELECT observation_id, CASE WHEN (source IS NOT NULL AND source NOT IN (SELECT run_id FROM runs)) OR w IS NOT NULL THEN 'stale' ELSE 'fresh' END AS status,
      CASE WHEN source IS NOT NULL AND source NOT IN (SELECT run_id FROM runs) THEN 'source_run_unavailable' ELSE w.change END AS reason, CASE WHEN source IS NOT NULL AND source NOT IN (SELECT run_id FROM runs) THEN 25 ELSE w.run_id END AS detected_in FROM obs LEFT JOIN w USING (observation_id)""",
    covers=("JN16", "ME04"),
)
def op_jn16_observation_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are runs, some off the chain and one deleted; customers are observations, their orders what these link to."""
    t = Tables(spark, sf_dir)
    n = F.col("n_nationkey").cast("long")
    runs = t.nation.where("n_nationkey <> 7").select((n + 1).alias("run_id"), F.when(n == 0, None).when(n % 4 == 3, n - 1).otherwise(n).alias("previous_run_id"))
    obs = t.customer.select(F.col("c_custkey").alias("observation_id"), F.when(F.col("c_custkey") % 6 > 0, F.col("c_nationkey").cast("long") + 1).alias("source"))
    target = lambda c: F.concat(F.lit("t"), (F.col(c) % 400).cast("string")).alias("target")
    links = t.orders.select(F.col("o_custkey").alias("observation_id"), target("o_orderkey")).distinct()
    kind = (F.col("l_partkey") + F.col("l_suppkey")) % 4
    change = F.when(kind == 0, "file_removed").when(kind == 1, "symbol_removed").when(kind == 2, "symbol_modified").otherwise("file_modified")
    diffs = t.lineitem.where("l_orderkey % 23 = 0").select(target("l_partkey"), (F.col("l_suppkey").cast("long") % 25 + 1).alias("run_id"), change.alias("change")).distinct()
    return observation_staleness(obs, links, runs, diffs, 25)


#: Fixed pattern: the names, attributes and subscripts before a dot.
RECEIVER = r"([A-Za-z_][A-Za-z0-9_]*(?:\s*\[[^\[\]]*\]|\s*\.\s*[A-Za-z_][A-Za-z0-9_]*)*)"


def without_strings(line: Column) -> Column:
    """A source line with what is in quotes as spaces of the same length, and without its comment."""
    blank = lambda m: F.regexp_replace(m, "[^'\"]", " ")
    parts = all_of(line, r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"]+|['"]""")
    return F.regexp_replace(F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^['\"]") & (F.length(p) > 1), blank(p)).otherwise(p)), ""), "#.*$", "")


def method_calls(line: Column, method: str) -> Column:
    """TX52. Receivers of calls of a method in a line of source; not those in strings and comments, nor of what a call returns."""
    return all_of(without_strings(line), rf"(?<![\w\])]){RECEIVER}\s*\.\s*{method}\s*\(", 1)


#: Fixed pattern: names that an import binds to a module.
MODULE_IMPORT = r"^\s*import\s+([A-Za-z_][A-Za-z0-9_]*)(?:\.[A-Za-z0-9_.]*)?(?:\s+as\s+([A-Za-z_][A-Za-z0-9_]*))?"


def possible_callers(lines: DataFrame, method: str, owners: DataFrame) -> DataFrame:
    """JN18. path, line, receiver: calls by name in files that refer to the owner; calls on imported modules are none."""
    candidates = lines.join(owners, "path", "left_semi")
    bound = F.when(F.regexp_extract("text", MODULE_IMPORT, 2) != "", F.regexp_extract("text", MODULE_IMPORT, 2)).otherwise(F.regexp_extract("text", MODULE_IMPORT, 1))
    modules = candidates.select("path", bound.alias("receiver")).where("receiver <> ''").distinct()
    return candidates.select("path", "line", F.explode(method_calls(F.col("text"), method)).alias("receiver")).join(modules, ["path", "receiver"], "left_anti")


_LINES = (
    ("import shutil as sh", ()), ("x = ring.copy(1)", ("ring",)), ("a.b[0].copy() # c.copy()", ("a.b[0]",)), ("say('d.copy()') or e . copy ( )", ("e",)), ("sh.copy(f)", ()), ("f().copy()", ()), ("import numpy", ()), ("numpy.copy(x); self.parts['k'].copy()", ("self.parts['k']",)), ("recopy(1)", ()), ('m["q.copy()"].copy()', ('m["q.copy()"]',)),
)


@query(
    f"""WITH {SYMBOLS_SQL}, {CALLS_SQL}, owners AS (SELECT DISTINCT s.path FROM calls c JOIN symbols s ON s.symbol_id = c.src WHERE c.dst % 50 = 2 AND c.edge_type = 'references'),
    l AS (SELECT path, symbol_id AS line, symbol_id % 10 AS k FROM symbols), r AS (SELECT unnest([1, 2, 3, 4, 7, 7, 9]) AS k, unnest(['ring', 'a.b[0]', 'e', 'sh', 'numpy', 'self.parts[   ]', 'm[          ]']) AS receiver),
    m AS (SELECT DISTINCT path, CASE k WHEN 0 THEN 'sh' ELSE 'numpy' END AS receiver FROM l WHERE k IN (0, 6))
    SELECT path, line, receiver FROM l JOIN r USING (k) WHERE path IN (SELECT path FROM owners) AND NOT EXISTS (SELECT 1 FROM m WHERE m.path = l.path AND m.receiver = r.receiver)""".replace("'self.parts[   ]'", "'self.parts[''' || ' ' || ''']'").replace("'m[          ]'", "'m[\"        \"]'").replace("unnest([1, 2, 3, 4, 7, 7, 9])", "unnest([1, 2, 3, 4, 7, 7, 9])"),
    covers=("JN18", "TX52"),
)
def op_jn18_possible_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of source a symbol, ten kinds of lines; the method is ``copy``."""
    code = Codebase(Tables(spark, sf_dir))
    symbols = code.symbols()
    text = F.get(F.array(*[F.lit(x) for x, _ in _LINES]), (F.col("symbol_id") % 10).cast("int"))
    owners = code.calls().where("dst % 50 = 2 AND edge_type = 'references'").join(symbols, F.col("src") == F.col("symbol_id")).select("path").distinct()
    return possible_callers(symbols.select("path", F.col("symbol_id").alias("line"), text.alias("text")), "copy", owners)


MOST_MENTIONS = 10


def documentation_mentions(pages: DataFrame, names: list[str]) -> DataFrame:
    """DX12. path, line, name, source: the first lines of documentation, by path, that say one of a symbol's names."""
    lines = pages.where(F.lower("path").rlike(r"\.(md|mdx|rst|txt)$")).select("path", F.posexplode(F.split("text", "\n")).alias("at", "source"))
    name = F.coalesce(*[F.when(F.contains(F.col("source"), F.lit(n)), F.lit(n)) for n in names if len(n) > 2])
    return lines.select("path", (F.col("at") + 1).alias("line"), name.alias("name"), F.substring(F.trim("source"), 1, 240).alias("source")).where("name IS NOT NULL").orderBy("path", "line").limit(MOST_MENTIONS)


@query(
    """WITH f AS (SELECT source || '/' || lang || '/doc' || doc_id || '.txt' AS path, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT path, unnest(ls) AS s, generate_subscripts(ls, 1) AS line FROM f)
    SELECT path, line, CASE WHEN contains(s, 'heonha') THEN 'heonha' ELSE 'theon' END AS name, left(trim(s, ' '), 240) AS source FROM l WHERE contains(s, 'heonha') OR contains(s, 'theon') ORDER BY path, line LIMIT 10""",
    covers=("DX12",),
)
def op_dx12_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    files = t.files().select(F.col("id").cast("long").alias("doc_id"), "path")
    return documentation_mentions(t.documents.select("doc_id", "text").join(files, "doc_id").select("path", "text"), ["heonha", "theon"])


def ordered_union(groups: list[Column]) -> Column:
    """ST04. Different paths of several groups, each where it comes first; null groups and paths don't count."""
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(g, F.array().cast("array<string>")) for g in groups])))


@query(
    """WITH l AS (SELECT l_orderkey, list('p' || (l_partkey % 9) ORDER BY l_linenumber, l_partkey) AS a, list(CASE WHEN l_suppkey % 3 > 0 THEN 'p' || (l_suppkey % 7) END ORDER BY l_linenumber, l_partkey) AS b FROM lineitem GROUP BY 1),
    u AS (SELECT l_orderkey, list_filter(list_concat(CASE WHEN l_orderkey % 4 > 0 THEN b ELSE [] END, a), lambda x: x IS NOT NULL) AS u FROM l)
    SELECT l_orderkey, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ' ') AS paths FROM u""",
    covers=("ST04",),
)
def op_st04_ordered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("l_linenumber", "l_partkey", F.concat(F.lit("p"), (F.col("l_partkey") % 9).cast("string")).alias("a"), F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("p"), (F.col("l_suppkey") % 7).cast("string"))).alias("b"))
    held = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return held.select("l_orderkey", F.array_join(ordered_union([F.when(F.col("l_orderkey") % 4 > 0, F.col("r.b")), F.col("r.a")]), " ").alias("paths"))
