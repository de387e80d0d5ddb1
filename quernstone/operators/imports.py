"""Edges between files: resolvable ends, merged sites, removed files, importers and re-exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.plans.catalog import query
from quernstone.plans.lineage import cut
from quernstone.sources.codebase import CALLS_SQL, IMPORTS_SQL, MODULES_SQL, SYMBOLS_SQL, Codebase
from quernstone.sources.tables import Tables


def resolvable(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """SNK05. Edges both ends of which are symbols, one of each id: two semi joins on keys."""
    ids = symbols.select("symbol_id")
    kept = edges.join(ids, edges["src"] == ids["symbol_id"], "left_semi")
    return kept.join(ids, kept["dst"] == ids["symbol_id"], "left_semi").dropDuplicates(["edge_id"])


@query(
    f"""WITH {SYMBOLS_SQL}, {CALLS_SQL} SELECT DISTINCT edge_id, src, dst, edge_type FROM calls
    WHERE src IN (SELECT symbol_id FROM symbols) AND dst IN (SELECT symbol_id FROM symbols)""",
    covers=("SNK05",),
)
def op_snk05_resolvable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = Codebase(Tables(spark, sf_dir))
    return resolvable(code.calls(), code.symbols()).select("edge_id", "src", "dst", "edge_type")


def merged(edges: DataFrame) -> DataFrame:
    """SNK07. One edge an id with all its sites, each once, in order; a site is counted before the shuffle."""
    sites = edges.select("edge_id", "src", "dst", "edge_type", "line").distinct()
    return sites.groupBy("edge_id", "src", "dst", "edge_type").agg(F.array_sort(F.collect_set("line")).alias("lines"))


@query(
    f"""WITH {CALLS_SQL} SELECT edge_id, src, dst, edge_type, string_agg(DISTINCT line, ',' ORDER BY line) AS lines, count(DISTINCT line) AS n_sites
    FROM calls GROUP BY ALL""",
    covers=("SNK07",),
)
def op_snk07_merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merged(Codebase(Tables(spark, sf_dir)).calls())
    return found.select("edge_id", "src", "dst", "edge_type", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), F.size("lines").cast("long").alias("n_sites"))


def pruned(modules: DataFrame, scanned: DataFrame, symbols: DataFrame, edges: DataFrame, imports: DataFrame) -> dict[str, DataFrame]:
    """SNK06. What is left of each table once files that a scan no longer finds are gone, and all that hangs on them."""
    gone = modules.join(scanned, "path", "left_anti").select("path")
    left = symbols.join(gone, "path", "left_anti")
    ids = symbols.join(gone, "path", "left_semi").select("symbol_id")
    no_src = edges.join(ids, edges["src"] == ids["symbol_id"], "left_anti")
    return {
        "modules": modules.join(gone, "path", "left_anti"),
        "symbols": left,
        "edges": no_src.join(ids, no_src["dst"] == ids["symbol_id"], "left_anti"),
        "imports": imports.join(gone, imports["importer"] == gone["path"], "left_anti"),
    }


@query(
    f"""WITH {SYMBOLS_SQL}, {CALLS_SQL}, {IMPORTS_SQL}, gone AS (SELECT path FROM modules WHERE module_id % 6 = 5),
    ids AS (SELECT symbol_id FROM symbols WHERE path IN (SELECT path FROM gone))
    SELECT 'modules' AS relation, path AS key, count(*) AS n FROM modules WHERE path NOT IN (SELECT path FROM gone) GROUP BY path
    UNION ALL SELECT 'symbols', path, count(*) FROM symbols WHERE path NOT IN (SELECT path FROM gone) GROUP BY path
    UNION ALL SELECT 'edges', edge_type, count(*) FROM calls WHERE src NOT IN (SELECT symbol_id FROM ids) AND dst NOT IN (SELECT symbol_id FROM ids) GROUP BY edge_type
    UNION ALL SELECT 'imports', importer, count(*) FROM imports WHERE importer NOT IN (SELECT path FROM gone) GROUP BY importer""",
    covers=("SNK06",),
)
def op_snk06_prune_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan finds five of six modules; rows left of each relation by file, of edges by type."""
    code = Codebase(Tables(spark, sf_dir))
    modules = code.modules()
    left = pruned(modules, modules.where("module_id % 6 <> 5").select("path"), code.symbols(), code.calls(), code.imports())
    keys = {"modules": "path", "symbols": "path", "edges": "edge_type", "imports": "importer"}
    counts = [left[k].groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).select(F.lit(k).alias("relation"), "key", "n") for k, c in keys.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def importers(imports: DataFrame, targets: DataFrame, wildcard: bool) -> DataFrame:
    """GR22, GR23. target, importer: files that import a target by name or module, or all of it by a wildcard."""
    form = F.col("form") == "wildcard"
    return imports.where(form if wildcard else ~form).join(targets, "target", "left_semi").select("target", "importer").distinct()


def re_exporters(imports: DataFrame) -> DataFrame:
    """GR24. file, target: files that hand a target's names on."""
    return imports.where("form = 're_export'").select(F.col("importer").alias("file"), "target").distinct()


@query(
    f"""WITH {MODULES_SQL}, {IMPORTS_SQL}, t AS (SELECT path AS target FROM modules WHERE module_id % 3 = 1)
    SELECT target, importer, bool_or(form <> 'wildcard') AS by_name, bool_or(form = 'wildcard') AS by_wildcard, bool_or(form = 're_export') AS re_exports
    FROM imports JOIN t USING (target) GROUP BY target, importer""",
    covers=("GR22", "GR23", "GR24"),
)
def op_gr22_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = Codebase(Tables(spark, sf_dir))
    targets, imports = code.modules().where("module_id % 3 = 1").select(F.col("path").alias("target")), code.imports()
    lanes = [
        importers(imports, targets, wildcard=False).withColumn("lane", F.lit("by_name")),
        importers(imports, targets, wildcard=True).withColumn("lane", F.lit("by_wildcard")),
        re_exporters(imports).join(targets, "target", "left_semi").select("target", F.col("file").alias("importer"), F.lit("re_exports").alias("lane")),
    ]
    both = lanes[0].unionByName(lanes[1]).unionByName(lanes[2])
    has = [F.max(F.col("lane") == c).alias(c) for c in ("by_name", "by_wildcard", "re_exports")]
    return both.groupBy("target", "importer").agg(*has)


def binding_closure(changed: DataFrame, imports: DataFrame, most: int = 16) -> DataFrame:
    """GR21 over kinds of imports. path, hands_on: files to bind again.

    A change goes on through files that re-export a changed one or import all of it, level
    by level until no file is new; whoever imports one of these in any way is bound again.
    """
    onward = imports.where(F.col("form").isin("re_export", "wildcard")).select("importer", "target").distinct()
    seen = cut(changed.select("path").distinct())
    frontier = seen
    for _ in range(most):
        reached = onward.join(frontier.select(F.col("path").alias("target")), "target", "left_semi").select(F.col("importer").alias("path")).distinct()
        frontier = cut(reached.join(seen, "path", "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    rest = imports.join(seen.select(F.col("path").alias("target")), "target", "left_semi").select(F.col("importer").alias("path")).distinct().join(seen, "path", "left_anti")
    return seen.select("path", F.lit(True).alias("hands_on")).unionByName(rest.select("path", F.lit(False).alias("hands_on")))


@query(
    f"""WITH RECURSIVE {MODULES_SQL}, {IMPORTS_SQL}, handing(path) AS (
      SELECT path FROM modules WHERE module_id % 29 = 2
      UNION SELECT i.importer FROM handing h JOIN imports i ON i.target = h.path AND i.form IN ('re_export', 'wildcard'))
    SELECT path, bool_or(h) AS hands_on FROM (SELECT path, true AS h FROM handing UNION ALL SELECT i.importer, false FROM imports i JOIN handing h ON i.target = h.path) x GROUP BY path""",
    covers=("GR21",),
)
def op_gr21_import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = Codebase(Tables(spark, sf_dir))
    return binding_closure(code.modules().where("module_id % 29 = 2").select("path"), code.imports())
