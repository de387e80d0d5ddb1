"""Snapshots of runs: differences, renames, staleness, chains of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.plans.catalog import query
from quernstone.sources.tables import RUNS_SQL, Tables


def file_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """JN11. (path, change) of two states (path, content_hash): added, removed, modified or unchanged."""
    joined = prev.select("path", F.col("content_hash").alias("a")).join(cur.select("path", F.col("content_hash").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").otherwise("unchanged")
    return joined.select("path", change.alias("change"))


_DIFF = """d AS (SELECT coalesce(p.path, c.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN p.content_hash <> c.content_hash THEN 'modified' ELSE 'unchanged' END AS change
FROM prev p FULL JOIN cur c ON p.path = c.path)"""


@query(f"WITH {RUNS_SQL}, {_DIFF} SELECT path, change FROM d", covers=("JN11",))
def op_jn11_file_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_diff(*Tables(spark, sf_dir).run_states())


@query(f"WITH {RUNS_SQL}, {_DIFF} SELECT path, CASE change WHEN 'added' THEN 'created' WHEN 'removed' THEN 'deleted' ELSE change END AS change FROM d WHERE change <> 'unchanged'", covers=("JN13",))
def op_jn13_source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("change") == "added", "created").when(F.col("change") == "removed", "deleted").otherwise(F.col("change"))
    return file_diff(*Tables(spark, sf_dir).run_states()).where("change <> 'unchanged'").select("path", named.alias("change"))


@query(
    f"WITH {RUNS_SQL}, {_DIFF} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'unchanged') AS unchanged FROM d",
    covers=("AG05", "AG06", "AG07"),
)
def op_ag05_summarize_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = file_diff(*Tables(spark, sf_dir).run_states())
    return d.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified", "unchanged")])


def symbol_diff(prev: DataFrame, cur: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """JN12. Pairs equal keys by their ordinal: key, ordinal, change."""
    own = Window.partitionBy(*key).orderBy(*order)
    a, b = (df.withColumn("ordinal", F.row_number().over(own)).select(*key, "ordinal", F.col("content_hash").alias(n)) for df, n in ((prev, "a"), (cur, "b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").otherwise("unchanged")
    return a.join(b, [*key, "ordinal"], "full_outer").select(*key, "ordinal", change.alias("change"))


@query(
    f"""WITH {RUNS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY owner, kind ORDER BY path) AS ordinal FROM prev), b AS (SELECT *, row_number() OVER (PARTITION BY owner, kind ORDER BY path) AS ordinal FROM cur)
    SELECT coalesce(a.owner, b.owner) AS owner, coalesce(a.kind, b.kind) AS kind, coalesce(a.ordinal, b.ordinal) AS ordinal,
    CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.content_hash <> b.content_hash THEN 'modified' ELSE 'unchanged' END AS change
    FROM a FULL JOIN b ON a.owner = b.owner AND a.kind = b.kind AND a.ordinal = b.ordinal""",
    covers=("JN12", "WN05"),
)
def op_jn12_symbol_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_diff(*Tables(spark, sf_dir).run_states(), ["owner", "kind"], ["path"])


def rename_plan(prev: DataFrame, cur: DataFrame, key: list[str]) -> DataFrame:
    """JN14. Removed and added paths with equal ``key`` (content and kind) pair up one to one, in order of path."""
    d = file_diff(prev, cur)
    own = Window.partitionBy(*key).orderBy("path")
    gone = prev.join(d.where("change = 'removed'"), "path").withColumn("k", F.row_number().over(own)).select(*key, "k", F.col("path").alias("old_path"))
    new = cur.join(d.where("change = 'added'"), "path").withColumn("k", F.row_number().over(own)).select(*key, "k", F.col("path").alias("new_path"))
    return gone.join(new, [*key, "k"]).select("old_path", "new_path")


@query(
    f"""WITH {RUNS_SQL}, moved AS (SELECT CASE WHEN path % 13 = 0 THEN path + 1000000000 ELSE path END AS path, content_hash FROM cur),
    g AS (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS k FROM prev WHERE path NOT IN (SELECT path FROM moved)),
    n AS (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS k FROM moved WHERE path NOT IN (SELECT path FROM prev))
    SELECT g.path AS old_path, n.path AS new_path FROM g JOIN n USING (content_hash, k)""",
    covers=("JN14", "WN10"),
)
def op_jn14_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thirteenth of the files has moved between the runs; a rename keeps its content, equal contents pair in order."""
    prev, cur = Tables(spark, sf_dir).run_states()
    moved = cur.withColumn("path", F.when(F.col("path") % 13 == 0, F.col("path") + 1_000_000_000).otherwise(F.col("path")))
    return rename_plan(prev, moved, ["content_hash"])


STALE_PRIORITY = {"file_removed": 0, "symbol_modified": 2, "file_modified_source_backed": 3}


@query(
    f"""WITH {RUNS_SQL}, {_DIFF}, items AS (SELECT l_orderkey AS path, l_linenumber AS item, l_quantity > 25 AS source_backed FROM lineitem)
    SELECT path, item, CASE WHEN change = 'removed' THEN 'file_removed' WHEN change = 'modified' AND source_backed THEN 'file_modified_source_backed' ELSE 'fresh' END AS state,
    CASE WHEN change = 'removed' THEN 0 WHEN change = 'modified' AND source_backed THEN 3 END AS priority FROM items JOIN d USING (path)""",
    covers=("JN17",),
)
def op_jn17_capsule_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    items = t.lineitem.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("item"), (F.col("l_quantity") > 25).alias("backed"))
    state = F.when(F.col("change") == "removed", "file_removed").when((F.col("change") == "modified") & F.col("backed"), "file_modified_source_backed").otherwise("fresh")
    rank = F.create_map(*[F.lit(x) for kv in STALE_PRIORITY.items() for x in kv])
    return items.join(file_diff(*t.run_states()), "path").select("path", "item", state.alias("state")).withColumn("priority", rank[F.col("state")])


@query(
    f"""WITH {RUNS_SQL}, {_DIFF}, last AS (SELECT path FROM base WHERE path % 13 <> 0) SELECT d.path FROM d WHERE change = 'added' AND path NOT IN (SELECT path FROM last)""",
    covers=("JN20",),
)
def op_jn20_added_then_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    prev, cur = t.run_states()
    last = t.orders.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("path"))
    return file_diff(prev, cur).where("change = 'added'").select("path").join(last, "path", "left_anti")


@query(
    f"""WITH {RUNS_SQL}, r AS (SELECT owner, array_agg(path ORDER BY path) AS files FROM base GROUP BY owner), {_DIFF}, x AS (SELECT owner, unnest(files) AS path FROM r)
    SELECT owner, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change IN ('removed', 'modified')) > 0 AS stale FROM x JOIN d USING (path) GROUP BY owner""",
    covers=("RU04",),
)
def op_ru04_stale_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules go stale when a file of their scope is removed or modified."""
    t = Tables(spark, sf_dir)
    scope = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("path"))
    n = lambda *c: F.count_if(F.col("change").isin(*c))
    return scope.join(file_diff(*t.run_states()), "path").groupBy("owner").agg(n("removed").alias("removed"), n("modified").alias("modified"), (n("removed", "modified") > 0).alias("stale"))


@query(
    f"""WITH {RUNS_SQL} SELECT count(*) FILTER (p.path IS NULL OR c.path IS NULL OR p.content_hash <> c.content_hash) AS mismatches, count(*) FILTER (p.path IS NULL OR c.path IS NULL OR p.content_hash <> c.content_hash) = 0 AS materialized FROM prev p FULL JOIN cur c ON p.path = c.path""",
    covers=("RE03",),
)
def op_re03_materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = file_diff(*Tables(spark, sf_dir).run_states())
    n = F.count_if(F.col("change") != "unchanged")
    return d.agg(n.alias("mismatches"), (n == 0).alias("materialized"))


@query(
    f"""WITH {RUNS_SQL}, s AS (SELECT o.path % 4 AS snapshot_id, p.path, p.content_hash FROM base o JOIN prev p USING (path)), m AS (SELECT snapshot_id, count(*) AS shared FROM s JOIN cur c ON s.path = c.path AND s.content_hash = c.content_hash GROUP BY 1)
    SELECT snapshot_id, shared FROM m ORDER BY shared DESC, snapshot_id LIMIT 1""",
    covers=("SRC24",),
)
def op_src24_reusable_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = Tables(spark, sf_dir).run_states()
    shared = prev.withColumn("snapshot_id", F.col("path") % 4).join(cur.select("path", "content_hash"), ["path", "content_hash"])
    return shared.groupBy("snapshot_id").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "snapshot_id").limit(1)


@query(
    f"""WITH {RUNS_SQL}, k AS (SELECT owner, kind, min(path) AS old_path FROM prev GROUP BY 1, 2 HAVING count(*) = 1), n AS (SELECT owner, kind, min(path) AS new_path FROM cur GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT l_orderkey, l_linenumber, coalesce(new_path, l_orderkey) AS target FROM lineitem LEFT JOIN (SELECT old_path, new_path FROM k JOIN n USING (owner, kind)) ON old_path = l_orderkey""",
    covers=("JN23",),
)
def op_jn23_rebind_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    only = lambda s, c: s.groupBy("owner", "kind").agg(F.count("*").alias("n"), F.min("path").alias(c)).where("n = 1").drop("n")
    prev, cur = t.run_states()
    moved = only(prev, "old_path").join(only(cur, "new_path"), ["owner", "kind"]).select(F.col("old_path").alias("l_orderkey"), "new_path")
    return t.lineitem.join(moved, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("new_path", "l_orderkey").alias("target"))
