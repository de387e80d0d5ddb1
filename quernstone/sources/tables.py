"""The driver's tables, and the relations of the data model derived from them.

A repository's relations have stand-ins: ``files`` are documents, ``symbols`` parts,
suppliers, customers and orders with typed ids, ``edges`` the references between them,
``runs`` two deterministic states of orders, ``changes`` the event log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """``Tables(spark, dir).orders`` reads a table; nothing runs until it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def files(self) -> DataFrame:
        d = self.documents
        return d.select(
            F.col("doc_id").cast("string").alias("id"),
            F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
            F.col("lang").alias("language"),
            F.sha2("text", 256).alias("content_hash"),
            F.octet_length("text").cast("long").alias("size_bytes"),
        )

    def edges(self) -> DataFrame:
        """src, dst, edge_type: customers contain orders, orders call parts, parts import suppliers.

        Edges of different types differ, so each type has its own distinct pairs, of keys and not of names.
        """
        return self._edges(lambda pairs: pairs.distinct())

    def repeated_edges(self) -> DataFrame:
        """The rows behind :meth:`edges`, of which some repeat; for those who want few of them."""
        return self._edges(lambda pairs: pairs)

    def _edges(self, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        def typed(table: DataFrame, a: str, src: str, b: str, dst: str, edge_type: str) -> DataFrame:
            name = lambda tag, c: F.concat(F.lit(f"{tag}:"), F.col(c).cast("string"))
            return of(table.select(src, dst)).select(name(a, src).alias("src"), name(b, dst).alias("dst"), F.lit(edge_type).alias("edge_type"))

        own = typed(self.orders, "c", "o_custkey", "o", "o_orderkey", "contains")
        call = typed(self.lineitem, "o", "l_orderkey", "p", "l_partkey", "calls")
        return own.unionByName(call).unionByName(typed(self.lineitem, "p", "l_partkey", "s", "l_suppkey", "imports"))

    def run_states(self) -> tuple[DataFrame, DataFrame]:
        """Orders as two runs saw them: path, kind, content_hash, size."""
        o = self.orders.select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("owner"))
        state = lambda df: df.select("path", "kind", "owner", F.sha2(F.concat_ws("|", "kind", F.format_string("%d", F.floor("price").cast("long"))), 256).alias("content_hash"))
        before = o.where("path % 7 <> 0")
        after = o.where("path % 11 <> 0").withColumn("price", F.expr("CASE WHEN path % 5 = 0 THEN price + 1000 ELSE price END"))
        return state(before), state(after)

    def changes(self) -> DataFrame:
        """File change events: file_path, ts, event_id."""
        return self.events.select(F.concat_ws("/", F.col("event_type"), F.col("user_id").cast("string")).alias("file_path"), "ts", "event_id", "user_id", "event_type", "value")


#: The same relations for the oracle.
FILES_SQL = """files AS (SELECT doc_id::VARCHAR AS id, source || '/' || lang || '/doc' || doc_id || '.txt' AS path, lang AS language,
  sha256(text) AS content_hash, strlen(text)::BIGINT AS size_bytes FROM documents)"""
EDGES_SQL = """edges AS (SELECT DISTINCT * FROM (
  SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst, 'contains' AS edge_type FROM orders
  UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'calls' FROM lineitem
  UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'imports' FROM lineitem))"""
RUNS_SQL = """base AS (SELECT o_orderkey AS path, o_orderstatus AS kind, o_totalprice AS price, o_custkey AS owner FROM orders),
prev AS (SELECT path, kind, owner, sha256(kind || '|' || floor(price)::BIGINT) AS content_hash FROM base WHERE path % 7 <> 0),
cur AS (SELECT path, kind, owner, sha256(kind || '|' || floor(CASE WHEN path % 5 = 0 THEN price + 1000 ELSE price END)::BIGINT) AS content_hash FROM base WHERE path % 11 <> 0)"""
CHANGES_SQL = """changes AS (SELECT event_type || '/' || user_id AS file_path, ts, event_id, user_id, event_type, value FROM events)"""
