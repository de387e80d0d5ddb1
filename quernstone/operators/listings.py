"""Ordered listings of symbols, edges with both ends' files, summaries of diffs and failures, sets that keep one of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.operators.versions import file_diff
from quernstone.plans.catalog import query
from quernstone.sources.codebase import CALLS_SQL, MODULES_SQL, SYMBOLS_SQL, Codebase
from quernstone.sources.tables import RUNS_SQL, Tables


@query(
    f"""WITH {SYMBOLS_SQL} SELECT symbol_id, row_number() OVER (ORDER BY line, fq_name, symbol_id) AS place FROM symbols WHERE path = (SELECT min(path) FROM symbols WHERE path LIKE 'src/%')""",
    covers=("FLT01",),
)
def op_flt01_symbols_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file's symbols in the order of the source."""
    s = Codebase(Tables(spark, sf_dir)).symbols()
    first = s.where("path LIKE 'src/%'").agg(F.min("path").alias("path"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("line", "fq_name", "symbol_id")).cast("long")  # one file is the feature
    return s.join(F.broadcast(first), "path", "left_semi").select("symbol_id", place.alias("place"))


@query(
    f"""WITH {SYMBOLS_SQL} SELECT symbol_id, path, line FROM symbols ORDER BY path, line, kind, fq_name, signature, symbol_id LIMIT 400""",
    covers=("FLT06",),
)
def op_flt06_all_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 400 of all symbols in their order of six keys."""
    return Codebase(Tables(spark, sf_dir)).symbols().orderBy("path", "line", "kind", "fq_name", "signature", "symbol_id").limit(400).select("symbol_id", "path", "line")


@query(
    f"""WITH {SYMBOLS_SQL} SELECT local_name, count(*) AS n, min(fq_name) AS first FROM symbols WHERE local_name IN ('SmallRing', 'red_widget', 'RED_WIDGET', 'test_small') GROUP BY local_name""",
    covers=("FLT03",),
)
def op_flt03_by_local_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Codebase(Tables(spark, sf_dir)).symbols()
    return s.where(F.col("local_name").isin("SmallRing", "red_widget", "RED_WIDGET", "test_small")).groupBy("local_name").agg(F.count("*").alias("n"), F.min("fq_name").alias("first"))


@query(
    f"""WITH {MODULES_SQL} SELECT path, module_id, package FROM modules WHERE path IN (SELECT 'src/pkg' || (n_nationkey % 5) || '/mod' || n_nationkey || '.py' FROM nation)""",
    covers=("FLT07",),
)
def op_flt07_file_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by exact path, for a list of paths of which some exist."""
    t = Tables(spark, sf_dir)
    n = F.col("n_nationkey")
    wanted = t.nation.select(F.concat(F.lit("src/pkg"), (n % 5).cast("string"), F.lit("/mod"), n.cast("string"), F.lit(".py")).alias("path"))
    return Codebase(t).modules().join(wanted, "path", "left_semi").select("path", "module_id", "package")


@query(
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (3, 5, 8) ORDER BY o_custkey, o_orderdate, o_orderkey""",
    covers=("FLT20",),
)
def op_flt20_session_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations (orders) of given sessions (customers), by session and time."""
    return Tables(spark, sf_dir).orders.where(F.col("o_custkey").isin(3, 5, 8)).orderBy("o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


FACTS_PER_SYMBOL, IDS_AT_ONCE = 8, 400


def facts_of(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """FLT22. Facts of the wanted symbols, by ordinal, eight of each at most; a semi join takes any number of ids at once."""
    own = Window.partitionBy("symbol_id").orderBy("ordinal", "kind")
    return facts.join(ids, "symbol_id", "left_semi").withColumn("k", F.row_number().over(own)).where(F.col("k") <= FACTS_PER_SYMBOL).drop("k")


@query(
    """WITH f AS (SELECT l_partkey AS symbol_id, l_orderkey * 10 + l_linenumber AS ordinal, CASE l_returnflag WHEN 'A' THEN 'ordering' WHEN 'N' THEN 'conditional' ELSE 'fallback' END AS kind FROM lineitem WHERE l_partkey % 3 = 1)
    SELECT symbol_id, ordinal, kind FROM f QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY ordinal, kind) <= 8""",
    covers=("FLT22",),
)
def op_flt22_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    kind = F.when(F.col("l_returnflag") == "A", "ordering").when(F.col("l_returnflag") == "N", "conditional").otherwise("fallback")
    facts = t.lineitem.select(F.col("l_partkey").alias("symbol_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), kind.alias("kind"))
    return facts_of(facts, t.part.where("p_partkey % 3 = 1").select(F.col("p_partkey").alias("symbol_id")))


def edges_of_files(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """JN02. Edges either end of which lies in one of the files (path), with both ends' names and files.

    Two branches instead of an OR, so both stay equi joins; an edge within a file comes once.
    """
    end = lambda side: symbols.select(F.col("symbol_id").alias(side), F.col("fq_name").alias(f"{side}_name"), F.col("path").alias(f"{side}_path"))
    held = edges.join(end("src"), "src").join(end("dst"), "dst")
    near = held.join(files, held["src_path"] == files["path"], "left_semi")
    far = held.join(files, held["dst_path"] == files["path"], "left_semi").join(files, F.col("src_path") == files["path"], "left_anti")
    return near.unionByName(far)


@query(
    f"""WITH {SYMBOLS_SQL}, {CALLS_SQL}, e AS (SELECT DISTINCT edge_id, src, dst, edge_type FROM calls), f AS (SELECT path FROM modules WHERE module_id % 25 = 9)
    SELECT edge_id, a.fq_name AS src_name, a.path AS src_path, b.fq_name AS dst_name, b.path AS dst_path FROM e JOIN symbols a ON a.symbol_id = src JOIN symbols b ON b.symbol_id = dst WHERE a.path IN (SELECT path FROM f) OR b.path IN (SELECT path FROM f)""",
    covers=("JN02",),
)
def op_jn02_edges_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = Codebase(Tables(spark, sf_dir))
    edges = code.calls().select("edge_id", "src", "dst", "edge_type").distinct()
    return edges_of_files(edges, code.symbols(), code.modules().where("module_id % 25 = 9").select("path")).select("edge_id", "src_name", "src_path", "dst_name", "dst_path")


@query(
    f"""WITH {SYMBOLS_SQL}, {CALLS_SQL}, u AS (SELECT local_name, min(symbol_id) AS symbol_id FROM symbols GROUP BY local_name HAVING count(*) = 1)
    SELECT DISTINCT u.local_name AS name, b.fq_name AS callee FROM u JOIN calls c ON c.src = u.symbol_id AND c.edge_type = 'calls' JOIN symbols b ON b.symbol_id = c.dst WHERE u.local_name LIKE '%\\_error%' ESCAPE '\\'""",
    covers=("JN10",),
)
def op_jn10_exact_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a name calls, for names that only one symbol has: an ambiguous name is never guessed at."""
    code = Codebase(Tables(spark, sf_dir))
    s = code.symbols()
    exact = s.groupBy(F.col("local_name").alias("name")).agg(F.min("symbol_id").alias("src"), F.count("*").alias("n")).where(F.contains(F.col("name"), F.lit("_error"))).where("n = 1").drop("n")
    return code.calls().where("edge_type = 'calls'").join(exact, "src").join(s.select(F.col("symbol_id").alias("dst"), F.col("fq_name").alias("callee")), "dst").select("name", "callee").distinct()


@query(
    f"""WITH {RUNS_SQL}, s AS (SELECT coalesce(p.kind, c.kind) AS kind, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN p.content_hash <> c.content_hash THEN 'modified' ELSE 'unchanged' END AS change FROM prev p FULL JOIN cur c ON p.path = c.path)
    SELECT kind, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'modified') AS modified, count(*) FILTER (WHERE change = 'unchanged') AS unchanged,
      (SELECT count(*) FROM prev) AS files_before, (SELECT count(*) FROM cur) AS files_after FROM s GROUP BY kind""",
    covers=("AG06", "AG07"),
)
def op_ag06_symbol_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by kind of symbol, beside the sizes of both runs."""
    prev, cur = Tables(spark, sf_dir).run_states()
    kinds = prev.select("path", "kind").unionByName(cur.select("path", "kind")).dropDuplicates(["path"])
    count = lambda c: F.count_if(F.col("change") == c).alias(c)
    by_kind = file_diff(prev, cur).join(kinds, "path").groupBy("kind").agg(*map(count, ("added", "removed", "modified", "unchanged")))
    sizes = prev.agg(F.count("*").alias("files_before")).crossJoin(cur.agg(F.count("*").alias("files_after")))  # one row each
    return by_kind.crossJoin(F.broadcast(sizes))


DETAILS = 20


@query(
    """WITH o AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'parse_failed' WHEN 'click' THEN 'read_failed' WHEN 'view' THEN 'unsupported_language' ELSE 'indexed' END AS status, ['py', 'ts', 'rs', 'go', NULL][(user_id % 5)::INT + 1] AS language FROM events),
    d AS (SELECT status, event_id, row_number() OVER (PARTITION BY status ORDER BY event_id) AS k FROM o WHERE status <> 'indexed')
    SELECT status, count(*) AS n, CASE WHEN status <> 'indexed' THEN (SELECT string_agg(event_id, ' ' ORDER BY event_id) FROM d WHERE d.status = o.status AND k <= 20) END AS details,
      CASE WHEN status IN ('parse_failed', 'read_failed') THEN string_agg(DISTINCT language, ' ' ORDER BY language) END AS languages FROM o GROUP BY status""",
    covers=("AG20", "AG21"),
)
def op_ag20_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of indexing by status, the first 20 of those not indexed, and the languages of those that failed."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "parse_failed").when(kind == "click", "read_failed").when(kind == "view", "unsupported_language").otherwise("indexed")
    o = Tables(spark, sf_dir).events.select("event_id", status.alias("status"), F.get(F.array(*[F.lit(x) for x in ("py", "ts", "rs", "go")]), (F.col("user_id") % 5).cast("int")).alias("language"))
    own = Window.partitionBy("status").orderBy("event_id")
    first = o.where("status <> 'indexed'").withColumn("k", F.row_number().over(own)).where(F.col("k") <= DETAILS).groupBy("status").agg(F.array_sort(F.collect_list("event_id")).alias("d"))
    counts = o.groupBy("status").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("language")).alias("l"))
    failed = F.col("status").isin("parse_failed", "read_failed")
    return counts.join(first, "status", "left").select("status", "n", F.array_join(F.col("d").cast("array<string>"), " ").alias("details"), F.when(failed, F.array_join("l", " ")).alias("languages"))


def composed_coverage(considered: Column, answered: Column, unknown: Column) -> Column:
    """AG23. Counts that add up, and whether each member answered; what isn't accounted for is unknown for other reasons."""
    rest = F.greatest(considered - answered - unknown, F.lit(0))
    return F.struct(considered.alias("considered"), answered.alias("answered"), (unknown + rest).alias("unknown"), (answered == considered).alias("complete"))


@query(
    """WITH c AS (SELECT user_id, count(*) AS considered, count(*) FILTER (WHERE value < 20 + user_id % 100) AS answered, count(*) FILTER (WHERE value >= 90 AND event_type = 'error') AS timed_out FROM events GROUP BY user_id)
    SELECT user_id, considered, answered, timed_out + greatest(considered - answered - timed_out, 0) AS unknown, answered = considered AS complete FROM c""",
    covers=("AG23",),
)
def op_ag23_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    c = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(v < 20 + F.col("user_id") % 100).alias("a"), F.count_if((v >= 90) & (F.col("event_type") == "error")).alias("u"))
    return c.select("user_id", composed_coverage(F.col("n"), F.col("a"), F.col("u")).alias("c")).select("user_id", "c.*")


def last_of_each(relations: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """ST08. One relation a key, the last; the greatest of a struct is taken before the shuffle."""
    rest = [c for c in relations.columns if c not in key]
    kept = relations.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r"))
    return kept.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


@query(
    """SELECT l_partkey, l_suppkey, max({'l_shipdate': l_shipdate, 'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_returnflag': l_returnflag}).l_orderkey AS l_orderkey, max({'l_shipdate': l_shipdate, 'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_returnflag': l_returnflag}).l_returnflag AS l_returnflag FROM lineitem GROUP BY ALL""",
    covers=("ST08",),
)
def op_st08_last_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).lineitem.select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag")
    return last_of_each(rows, ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_suppkey", "l_orderkey", "l_returnflag")


def equivalent_once(results: DataFrame) -> DataFrame:
    """ST06. Results with the same name, kind and signature in different files are one: the best score stays, then the least path and id, with how many it stands for."""
    own = Window.partitionBy("local_name", "kind", "signature").orderBy(F.desc("score"), "path", "symbol_id")
    n = F.count("*").over(Window.partitionBy("local_name", "kind", "signature"))
    return results.withColumn("k", F.row_number().over(own)).withColumn("stands_for", n).where("k = 1").drop("k")


@query(
    f"""WITH {SYMBOLS_SQL}, r AS (SELECT *, length(coalesce(docstring, '')) % 7 AS score FROM symbols)
    SELECT symbol_id, count(*) OVER (PARTITION BY local_name, kind, signature) AS stands_for FROM r QUALIFY row_number() OVER (PARTITION BY local_name, kind, signature ORDER BY score DESC, path, symbol_id) = 1""",
    covers=("ST06",),
)
def op_st06_equivalent_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Codebase(Tables(spark, sf_dir)).symbols().withColumn("score", F.length(F.coalesce("docstring", F.lit(""))) % 7)
    return equivalent_once(s).select("symbol_id", "stands_for")
