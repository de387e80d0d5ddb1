"""A code base over the driver's tables: modules, symbols and the relations between them.

Suppliers are modules, parts symbols, line items what symbols do to each other. Names
are made of the words of part names, so that operators on names, signatures and paths
read text. The SQL is the same for Spark and DuckDB; ``{part}`` and so on are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quernstone.sources.tables import Tables

#: modules: module_id, path, package, dotted. Some are tests, some package surfaces, some generated.
MODULES = """modules AS (
  SELECT s_suppkey AS module_id, s_nationkey % 5 AS package,
    CASE WHEN s_suppkey % 7 = 3 THEN 'tests/pkg' || (s_nationkey % 5) || '/test_mod' || s_suppkey || '.py'
         WHEN s_suppkey % 9 = 4 THEN 'src/pkg' || (s_nationkey % 5) || '/sub' || s_suppkey || '/__init__.py'
         WHEN s_suppkey % 13 = 6 THEN 'dist/pkg' || (s_nationkey % 5) || '/mod' || s_suppkey || '.py'
         ELSE 'src/pkg' || (s_nationkey % 5) || '/mod' || s_suppkey || '.py' END AS path,
    'pkg' || (s_nationkey % 5) || '.mod' || s_suppkey AS dotted
  FROM {supplier})"""

#: symbols: symbol_id, module_id, path, kind, local_name, fq_name, signature, docstring, exported, line.
SYMBOLS = """named AS (
  SELECT p_partkey, p_type, p_size, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b,
    CAST(floor(p_partkey / 7) AS BIGINT) % (SELECT count(*) FROM {supplier}) AS module_id FROM {part}),
symbols AS (
  SELECT p_partkey AS symbol_id, m.module_id, m.path, kind, local_name, m.dotted || '.' || local_name AS fq_name,
    CASE kind WHEN 'function' THEN 'def ' || local_name || '(' || lower(p_type) || ', ' || b || '=None)' WHEN 'method' THEN 'def ' || local_name || '(self, ' || b || ')'
      WHEN 'class' THEN 'class ' || local_name || '(Base)' ELSE local_name || ' = ' || p_size END AS signature,
    CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE 'Gives the ' || b || ' of a ' || a || ' ' || lower(p_type) || ' when it fails.' END AS docstring,
    p_partkey % 4 <> 2 AS exported, CAST(p_partkey % 7 AS INT) * 20 + 1 AS line
  FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' WHEN 3 THEN 'constant' ELSE 'function' END AS kind,
      CASE p_partkey % 5 WHEN 0 THEN a || '_' || b WHEN 1 THEN a || upper(substr(b, 1, 1)) || substr(b, 2) WHEN 2 THEN upper(substr(a, 1, 1)) || substr(a, 2) || upper(substr(b, 1, 1)) || substr(b, 2)
        WHEN 3 THEN upper(a || '_' || b) ELSE CASE WHEN p_partkey % 2 = 0 THEN 'test_' || a WHEN p_partkey % 11 < 3 THEN 'base_error' ELSE b || '_error' END END || CASE WHEN p_partkey % 3 = 0 THEN '_' || p_partkey ELSE '' END AS local_name FROM named) x
  JOIN modules m ON m.module_id = x.module_id)"""

#: calls: edge_id, src, dst, edge_type, line; ends of some are no symbol, some ids occur more than once.
CALLS = """calls AS (
  SELECT concat(l_partkey, '>', dst, ':', edge_type) AS edge_id, l_partkey AS src, dst, edge_type, line FROM (
    SELECT l_partkey, CAST(l_linenumber AS BIGINT) * 3 + l_suppkey % 5 AS line,
      (l_partkey * 31 + l_suppkey * 7 + l_linenumber) % (SELECT count(*) + 20 FROM {part}) AS dst,
      CASE l_linenumber % 4 WHEN 0 THEN 'contains' WHEN 1 THEN 'calls' WHEN 2 THEN 'imports' ELSE 'references' END AS edge_type FROM {lineitem}) x)"""

#: imports: importer, target, form, name; form is module, name, wildcard or re_export.
IMPORTS = """imports AS (
  SELECT DISTINCT a.path AS importer, b.path AS target, CASE (x.l_partkey + x.l_linenumber) % 6 WHEN 0 THEN 'wildcard' WHEN 1 THEN 're_export' WHEN 2 THEN 'module' ELSE 'name' END AS form
  FROM {lineitem} x JOIN modules a ON a.module_id = x.l_suppkey JOIN modules b ON b.module_id = x.l_partkey % (SELECT count(*) FROM {supplier})
  WHERE a.module_id <> b.module_id AND x.l_orderkey % 41 = 0)"""

_TABLES = ("part", "supplier", "lineitem")


def oracle_sql(sql: str) -> str:
    """``sql`` with the tables' names, for DuckDB."""
    return sql.format(**{t: t for t in _TABLES})


MODULES_SQL = oracle_sql(MODULES)
SYMBOLS_SQL = f"{MODULES_SQL}, {oracle_sql(SYMBOLS)}"
CALLS_SQL = oracle_sql(CALLS)
IMPORTS_SQL = oracle_sql(IMPORTS)


class Codebase:
    """The relations as DataFrames; nothing runs until they're used."""

    def __init__(self, tables: Tables):
        self._tables = tables

    def _select(self, ctes: str, name: str) -> DataFrame:
        used = {t: getattr(self._tables, t) for t in _TABLES if f"{{{t}}}" in ctes}
        return self._tables.spark.sql(f"WITH {ctes} SELECT * FROM {name}", **used)

    def modules(self) -> DataFrame:
        return self._select(MODULES, "modules")

    def symbols(self) -> DataFrame:
        return self._select(f"{MODULES}, {SYMBOLS}", "symbols")

    def calls(self) -> DataFrame:
        return self._select(CALLS, "calls")

    def imports(self) -> DataFrame:
        return self._select(f"{MODULES}, {IMPORTS}", "imports")
