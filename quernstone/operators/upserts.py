"""Merges into stores: sessions, observations and references by key; idempotent migration; what of a store still applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.plans.catalog import query
from quernstone.sources.codebase import SYMBOLS_SQL, Codebase
from quernstone.sources.tables import Tables


def upsert_sessions(sessions: DataFrame, activity: DataFrame) -> DataFrame:
    """SNK10. Sessions after a batch of activity (session_id, agent_kind, at, status), one aggregate over both.

    The first known agent stays, the start is the least and the last activity the greatest
    time; the status is the latest one given, and one that is active again is no longer compressed.
    """
    old = sessions.select("session_id", "agent_kind", F.col("started").alias("lo"), F.col("last").alias("hi"), "status", "compressed_at", F.lit(-1).cast("long").alias("seq"))
    new = activity.select("session_id", "agent_kind", F.col("at").alias("lo"), F.col("at").alias("hi"), "status", F.lit(None).cast("long").alias("compressed_at"), "seq")
    both = old.unionByName(new)
    known = F.when(F.col("agent_kind").isNotNull(), F.col("seq"))
    g = both.groupBy("session_id").agg(
        F.min_by("agent_kind", known).alias("agent_kind"), F.min("lo").alias("started"), F.max("hi").alias("last"), F.max_by("status", "seq").alias("status"),
        F.max("compressed_at").alias("c"), F.max(F.when(F.col("seq") >= 0, F.col("status") == "active")).alias("woken"),
    )
    return g.select("session_id", "agent_kind", "started", "last", "status", F.when(~F.coalesce("woken", F.lit(False)), F.col("c")).alias("compressed_at"))


@query(
    """WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN 'a' || (c_custkey % 4) END AS kind, 5000 + c_custkey AS lo, 6000 + c_custkey AS hi, CASE WHEN c_custkey % 5 = 0 THEN 'compressed' ELSE 'inactive' END AS status, CASE WHEN c_custkey % 5 = 0 THEN 7000 END AS c, -1 AS seq FROM customer WHERE c_custkey % 2 = 0),
    a AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 4 = 1 THEN 'b' || (o_orderkey % 3) END AS kind, o_orderkey AS lo, o_orderkey AS hi, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'inactive' END AS status, NULL::INT AS c, o_orderkey AS seq FROM orders),
    b AS (SELECT * FROM s UNION ALL SELECT * FROM a)
    SELECT id AS session_id, arg_min(kind, seq) FILTER (WHERE kind IS NOT NULL) AS agent_kind, min(lo) AS started, max(hi) AS last, arg_max(status, seq) AS status, CASE WHEN coalesce(bool_or(status = 'active') FILTER (WHERE seq >= 0), false) THEN NULL ELSE max(c) END AS compressed_at FROM b GROUP BY id""",
    covers=("SNK10",),
)
def op_snk10_session_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the customers have a session; orders are activity."""
    t = Tables(spark, sf_dir)
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    s = lambda x: x.cast("string")
    sessions = t.customer.where(c % 2 == 0).select(
        c.alias("session_id"), F.when(c % 3 > 0, F.concat(F.lit("a"), s(c % 4))).alias("agent_kind"), (c + 5000).alias("started"), (c + 6000).alias("last"),
        F.when(c % 5 == 0, "compressed").otherwise("inactive").alias("status"), F.when(c % 5 == 0, F.lit(7000).cast("long")).alias("compressed_at"),
    )
    activity = t.orders.select(F.col("o_custkey").alias("session_id"), F.when(o % 4 == 1, F.concat(F.lit("b"), s(o % 3))).alias("agent_kind"), o.alias("at"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("inactive").alias("status"), o.alias("seq"))
    return upsert_sessions(sessions, activity)


def observation_id(*parts: Column) -> Column:
    """Content-stable: the time of an observation is no part of it."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def insert_observations(stored: DataFrame, new: DataFrame) -> DataFrame:
    """SNK09. What of a batch is added: no empty summary, no key that is stored or came earlier in the batch, then no id that is or did; each once.

    ``new`` has observation_id, dedupe_key (may be null), seq and others; two windows and two anti joins, both on keys.
    """
    fit = new.where(F.trim("summary") != "")
    keyed = fit.where("dedupe_key IS NOT NULL").join(stored.select("dedupe_key"), "dedupe_key", "left_anti")
    by_key = keyed.withColumn("k", F.row_number().over(Window.partitionBy("dedupe_key").orderBy("seq"))).where("k = 1").drop("k")
    left = by_key.unionByName(fit.where("dedupe_key IS NULL").select(by_key.columns)).join(stored.select("observation_id"), "observation_id", "left_anti")
    return left.withColumn("k", F.row_number().over(Window.partitionBy("observation_id").orderBy("seq"))).where("k = 1").drop("k")


@query(
    """WITH n AS (SELECT event_id AS seq, CASE WHEN event_id % 9 = 4 THEN ' ' ELSE event_type || ' ' || (user_id % 40) END AS summary, CASE WHEN event_id % 3 > 0 THEN 'k' || user_id || event_type END AS dedupe_key FROM events),
    i AS (SELECT *, substr(sha256(summary || chr(31) || seq % 4), 1, 24) AS observation_id FROM n), st AS (SELECT 'k' || (n_nationkey * 3) || 'view' AS dedupe_key, substr(sha256('click ' || n_nationkey || chr(31) || '1'), 1, 24) AS observation_id FROM nation),
    f AS (SELECT * FROM i WHERE trim(summary) <> '' AND (dedupe_key IS NULL OR dedupe_key NOT IN (SELECT dedupe_key FROM st))), k AS (SELECT * FROM f QUALIFY dedupe_key IS NULL OR row_number() OVER (PARTITION BY dedupe_key ORDER BY seq) = 1)
    SELECT seq, observation_id FROM k WHERE observation_id NOT IN (SELECT observation_id FROM st) QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY seq) = 1""",
    covers=("SNK09",),
)
def op_snk09_observation_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    e, s = F.col("event_id"), lambda x: x.cast("string")
    new = t.events.select(e.alias("seq"), F.when(e % 9 == 4, " ").otherwise(F.concat("event_type", F.lit(" "), s(F.col("user_id") % 40))).alias("summary"), F.when(e % 3 > 0, F.concat(F.lit("k"), s(F.col("user_id")), "event_type")).alias("dedupe_key"))
    new = new.withColumn("observation_id", observation_id(F.col("summary"), F.col("seq") % 4))
    k = F.col("n_nationkey")
    stored = t.nation.select(F.concat(F.lit("k"), s(k * 3), F.lit("view")).alias("dedupe_key"), observation_id(F.concat(F.lit("click "), s(k)), F.lit(1)).alias("observation_id"))
    return insert_observations(stored, new).select("seq", "observation_id")


def put_references(stored: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """SNK11. References by hash after a batch: the latest write of a hash stands, and beyond ``most`` those read least lately go."""
    both = stored.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    kept = both.groupBy("hash").agg(F.max(F.struct("seq", "body", "accessed")).alias("r")).select("hash", F.col("r.body").alias("body"), F.col("r.accessed").alias("accessed"))
    return kept.orderBy(F.desc("accessed"), "hash").limit(most)


@query(
    """WITH b AS (SELECT 'h' || (p_partkey % 70) AS hash, p_name AS body, p_partkey % 900 AS accessed, -1 AS seq FROM part WHERE p_partkey < 70 UNION ALL SELECT 'h' || (l_partkey % 300), l_returnflag || l_orderkey, l_orderkey % 1000, l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_suppkey % 9 = 2),
    k AS (SELECT hash, max({'seq': seq, 'body': body, 'accessed': accessed}) AS r FROM b GROUP BY hash) SELECT hash, r.body AS body, r.accessed AS accessed FROM k ORDER BY accessed DESC, hash LIMIT 100""",
    covers=("SNK11",),
)
def op_snk11_put_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    name = lambda c, n: F.concat(F.lit("h"), (F.col(c) % n).cast("string")).alias("hash")
    stored = t.part.where("p_partkey < 70").select(name("p_partkey", 70), F.col("p_name").alias("body"), (F.col("p_partkey") % 900).alias("accessed"))
    new = t.lineitem.where("l_suppkey % 9 = 2").select(name("l_partkey", 300), F.concat("l_returnflag", F.col("l_orderkey").cast("string")).alias("body"), (F.col("l_orderkey") % 1000).alias("accessed"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq"))
    return put_references(stored, new, 100)


def migrated(legacy: DataFrame, store: DataFrame, key: list[str]) -> DataFrame:
    """SNK12. The store after a migration that ignores what it has: rows of legacy with a new key, the first of each; a second run adds none."""
    new = legacy.join(store.select(*key), key, "left_anti")
    first = new.groupBy(*key).agg(F.min(F.struct(*[c for c in legacy.columns if c not in key])).alias("r"))
    return store.unionByName(first.select(*key, "r.*").select(store.columns))


@query(
    """WITH l AS (SELECT l_partkey AS a, l_suppkey AS b, l_orderkey AS v FROM lineitem WHERE l_orderkey % 5 = 1), s AS (SELECT p_partkey AS a, s_suppkey AS b, -1 AS v FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) WHERE p_partkey % 2 = 0)
    SELECT a, b, v FROM s UNION ALL SELECT a, b, min(v) FROM l WHERE (a, b) NOT IN (SELECT (a, b) FROM s) GROUP BY a, b""",
    covers=("SNK12",),
)
def op_snk12_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run twice; the second run finds nothing to add."""
    t = Tables(spark, sf_dir)
    legacy = t.lineitem.where("l_orderkey % 5 = 1").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_orderkey").alias("v"))
    n = t.supplier.agg(F.count("*").alias("n"))
    store = t.part.where("p_partkey % 2 = 0").crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("a"), (F.col("p_partkey") % F.col("n")).alias("b"), F.lit(-1).cast("long").alias("v"))  # one row
    return migrated(legacy, migrated(legacy, store, ["a", "b"]), ["a", "b"])


def compatibility(scope: Column, schema_ok: Column, repo: Column, worktree: Column, head: Column, source: Column, index: Column, implementation: Column) -> Column:
    """ME03. Whether a memory still applies, by the first thing that doesn't match; null flags are evidence that is missing.

    A repository's memory asks no more than the repository, a worktree's no more than the worktree.
    """
    own = F.when(implementation, "applicable").when(implementation.isNull(), "provenance_incomplete").otherwise("stale_implementation")
    return (
        F.when(scope == "global", "applicable").when(scope.isNull() | ~F.coalesce(schema_ok, F.lit(False)), "provenance_incomplete").when(~repo, "foreign_repository").when(scope == "repository", own)
        .when(~worktree, "stale_worktree").when(scope == "worktree", own).when(~head, "stale_repo_state").when(source.isNull(), "provenance_incomplete").when(~source, "stale_source_state").when(~index, "stale_index").otherwise(own)
    )


@query(
    """WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'global' WHEN 1 THEN 'repository' WHEN 2 THEN 'worktree' WHEN 5 THEN NULL ELSE 'index_state' END AS scope, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 13 > 0 END AS ok, o_custkey % 7 > 0 AS repo, o_custkey % 5 > 0 AS wt, o_orderstatus <> 'P' AS head,
      CASE WHEN o_orderkey % 17 > 1 THEN o_orderpriority < '5' END AS src, o_totalprice > 20000 AS idx, CASE WHEN o_custkey % 19 > 2 THEN o_orderkey % 4 > 0 END AS impl FROM orders)
    SELECT k AS o_orderkey, CASE WHEN scope = 'global' THEN 'applicable' WHEN scope IS NULL OR NOT coalesce(ok, false) THEN 'provenance_incomplete' WHEN NOT repo THEN 'foreign_repository' WHEN scope = 'repository' THEN CASE WHEN impl THEN 'applicable' WHEN impl IS NULL THEN 'provenance_incomplete' ELSE 'stale_implementation' END
      WHEN NOT wt THEN 'stale_worktree' WHEN scope <> 'worktree' AND NOT head THEN 'stale_repo_state' WHEN scope <> 'worktree' AND src IS NULL THEN 'provenance_incomplete' WHEN scope <> 'worktree' AND NOT src THEN 'stale_source_state' WHEN scope <> 'worktree' AND NOT idx THEN 'stale_index'
      WHEN impl THEN 'applicable' WHEN impl IS NULL THEN 'provenance_incomplete' ELSE 'stale_implementation' END AS state FROM o""",
    covers=("ME03",),
)
def op_me03_compatibility_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as memories, their columns as what of the recorded state still agrees."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    scope = F.when(k % 6 == 0, "global").when(k % 6 == 1, "repository").when(k % 6 == 2, "worktree").when(k % 6 != 5, "index_state")
    state = compatibility(scope, F.when(k % 11 > 0, k % 13 > 0), c % 7 > 0, c % 5 > 0, F.col("o_orderstatus") != "P", F.when(k % 17 > 1, F.col("o_orderpriority") < "5"), F.col("o_totalprice") > 20000, F.when(c % 19 > 2, k % 4 > 0))
    return Tables(spark, sf_dir).orders.select("o_orderkey", state.alias("state"))


RULES_SHOWN = 3


def relevant_rules(scored: DataFrame) -> DataFrame:
    """RU02. status, rule_id, score, place, total: the best rules by status, those with a score that can be shown; all statuses are counted."""
    totals = scored.groupBy("status").agg(F.count("*").alias("total"))
    own = Window.partitionBy("status").orderBy(F.desc("score"), "rule_id")
    best = scored.where("status IN ('active', 'candidate') AND score > 0").withColumn("place", F.row_number().over(own)).where(F.col("place") <= RULES_SHOWN)
    return totals.join(best, "status", "left").select("status", "rule_id", "score", "place", "total")


@query(
    f"""WITH {SYMBOLS_SQL}, r AS (SELECT symbol_id AS rule_id, CASE symbol_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'candidate' WHEN 2 THEN 'stale' WHEN 3 THEN 'disabled' ELSE 'dismissed' END AS status, len(list_intersect(list_distinct({T.TOKENIZE_SQL.format(c="fq_name || ' ' || coalesce(docstring, '')")}), ['small', 'ring', 'economy', 'fails', 'gives'])) * 6 AS score FROM symbols),
    b AS (SELECT status, rule_id, score, row_number() OVER (PARTITION BY status ORDER BY score DESC, rule_id) AS place FROM r WHERE status IN ('active', 'candidate') AND score > 0 QUALIFY place <= 3), n AS (SELECT status, count(*) AS total FROM r GROUP BY status)
    SELECT status, rule_id, score, place, total FROM n LEFT JOIN b USING (status)""",
    covers=("RU02",),
)
def op_ru02_relevant_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("symbol_id") % 5
    status = F.when(k == 0, "active").when(k == 1, "candidate").when(k == 2, "stale").when(k == 3, "disabled").otherwise("dismissed")
    words = F.array_distinct(T.tokenize(F.concat_ws(" ", "fq_name", F.coalesce("docstring", F.lit("")))))
    score = F.size(F.array_intersect(words, F.array(*map(F.lit, ("small", "ring", "economy", "fails", "gives"))))) * 6
    rules = Codebase(Tables(spark, sf_dir)).symbols().select(F.col("symbol_id").alias("rule_id"), status.alias("status"), score.cast("long").alias("score"))
    return relevant_rules(rules)


PER_SEED = 3


def same_module_neighbours(seeds: DataFrame, symbols: DataFrame) -> DataFrame:
    """WN06. seed, neighbour, place: symbols of the seed's directory in other files that are no seeds, by path, line and id, a few a seed.

    A seed passes over one file of its directory. So the first few of each file are enough,
    and of these the first of the directory, a few more than that file can hold: a seed
    never meets all symbols of its directory.
    """
    held = symbols.withColumn("directory", T.directory(F.col("path")))
    ids = seeds.select(F.col("seed").alias("symbol_id")).distinct()
    own = held.join(ids, "symbol_id", "left_semi").select(F.col("symbol_id").alias("seed"), "directory", F.col("path").alias("seed_path"))
    order = ("path", "line", "symbol_id")
    first = lambda df, by, most: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("k") <= most).drop("k")
    rest = held.join(ids, "symbol_id", "left_anti").select("directory", *order)
    few = first(first(rest, ("directory", "path"), PER_SEED), ("directory",), 2 * PER_SEED)
    # the few rows of a directory are one row of it, so a directory of any number of seeds is no more than its seeds
    lists = few.groupBy("directory").agg(F.collect_list(F.struct(*order)).alias("few"))
    side = own.join(lists, "directory").select("seed", "seed_path", F.explode("few").alias("x")).select("seed", "seed_path", "x.*").where("path <> seed_path")
    place = F.row_number().over(Window.partitionBy("seed").orderBy(*order))
    return side.withColumn("place", place).where(F.col("place") <= PER_SEED).select("seed", F.col("symbol_id").alias("neighbour"), "place")


@query(
    f"""WITH {SYMBOLS_SQL}, h AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM symbols), sd AS (SELECT symbol_id AS seed, path AS sp, dir FROM h WHERE symbol_id % 40 = 7)
    SELECT seed, symbol_id AS neighbour, row_number() OVER (PARTITION BY seed ORDER BY path, line, symbol_id) AS place FROM sd JOIN h USING (dir) WHERE symbol_id % 40 <> 7 AND path <> sp QUALIFY place <= 3""",
    covers=("WN06",),
)
def op_wn06_module_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Codebase(Tables(spark, sf_dir)).symbols()
    return same_module_neighbours(s.where("symbol_id % 40 = 7").select(F.col("symbol_id").alias("seed")), s)
