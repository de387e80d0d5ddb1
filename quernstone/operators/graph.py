"""Traversals of an edge relation (src, dst, edge_type): a join for each level, never a node at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.plans.catalog import query
from quernstone.plans.lineage import cut
from quernstone.sources.tables import EDGES_SQL, Tables


def traverse(edges: DataFrame, starts: DataFrame, max_depth: int, reverse: bool = False, edge_budget: int | None = None) -> DataFrame:
    """GR01/GR07. (node, distance) of what ``starts`` (node) reach in at most ``max_depth`` steps, themselves included.

    Each level joins the frontier to the edges and drops visited nodes; a level is written
    before the next. With a budget the edges of a level, in order of their ends, count
    against it, and the traversal ends inside the level where it is spent.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    seen = cut(starts.select("node").distinct().withColumn("distance", F.lit(0)))
    frontier, left = seen.select("node"), edge_budget
    for depth in range(1, max_depth + 1):
        out = step.join(frontier, "node", "left_semi")
        if left is not None:
            out = out.orderBy("node", "next").limit(left)
            out = cut(out)
            left -= out.count()
        new = cut(out.select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("distance", F.lit(depth)))
        if new.isEmpty():
            break
        seen, frontier = cut(seen.unionByName(new)), new.select("node")
        if left is not None and left <= 0:
            break
    return seen


def closure(edges: DataFrame, starts: DataFrame, most: int | None = None, rounds: int = 100) -> DataFrame | None:
    """GR21. Everything that reaches ``starts``; None (a refusal) once it holds more than ``most`` nodes."""
    seen = cut(starts.select("node").distinct())
    frontier = seen
    for _ in range(rounds):
        new = cut(edges.join(frontier.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(seen, "node", "left_anti"))
        if new.isEmpty():
            return seen
        seen, frontier = cut(seen.unionByName(new)), new
        if most is not None and seen.count() > most:
            return None
    raise RuntimeError("the closure didn't end")


def shortest_paths(edges: DataFrame, start: str, end: str, max_depth: int, max_paths: int = 16) -> DataFrame:
    """GR02/GR03. All shortest paths from start to end as arrays of nodes, in order, at most ``max_paths``.

    Distances from both ends keep just the edges that lie on a shortest path; paths then
    grow along those, a join for each step.
    """
    spark = edges.sparkSession
    one = lambda x: spark.range(1).select(F.lit(x).alias("node"))
    ahead = traverse(edges, one(start), max_depth).select("node", F.col("distance").alias("ds"))
    length = ahead.where(F.col("node") == end).select("ds").first()
    if length is None:
        return spark.createDataFrame([], "path array<string>")
    back = traverse(edges, one(end), length[0], reverse=True).select("node", F.col("distance").alias("dt"))
    on = ahead.join(back, "node").where(F.col("ds") + F.col("dt") == length[0])
    a, b = (on.select(F.col("node").alias(n), F.col("ds").alias(f"d_{n}")) for n in ("src", "dst"))
    dag = cut(edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("d_dst = d_src + 1").select("src", "dst"))
    paths = one(start).select(F.array("node").alias("path"), F.col("node").alias("src"))
    for _ in range(length[0]):
        # every kept prefix ends in the same node, so the first max_paths of them suffice
        paths = paths.join(dag, "src").select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src")).orderBy("path").limit(max_paths)
    return paths.select("path")


def _first_customer(t: Tables) -> str:
    return t.orders.orderBy("o_orderkey").limit(1).select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string"))).collect()[0][0]


_START = "st AS (SELECT 'c:' || o_custkey AS node FROM orders ORDER BY o_orderkey LIMIT 1)"
_WALK = f"r(node, d) AS (SELECT node, 0 FROM st UNION SELECT e.dst, d + 1 FROM r JOIN edges e ON e.src = r.node WHERE d < 3), dist AS (SELECT node, min(d) AS distance FROM r GROUP BY node)"  # noqa: F541


@query(f"WITH RECURSIVE {EDGES_SQL}, {_START}, {_WALK} SELECT node, distance FROM dist", covers=("GR01",))
def op_gr01_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return traverse(t.edges(), spark.range(1).select(F.lit(_first_customer(t)).alias("node")), 3)


_BACK = "b(node, d) AS (SELECT 's:1', 0 UNION SELECT e.src, d + 1 FROM b JOIN edges e ON e.dst = b.node WHERE d < 3), bd AS (SELECT node, min(d) AS distance FROM b GROUP BY node)"


@query(f"WITH RECURSIVE {EDGES_SQL}, {_BACK} SELECT node, distance FROM bd", covers=("GR06", "GR07"))
def op_gr07_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return traverse(t.edges(), spark.range(1).select(F.lit("s:1").alias("node")), 3, reverse=True)


def first_visits(edges: DataFrame, distances: DataFrame) -> DataFrame:
    """GR08/GR09. One parent for each reached node: the least one a step nearer."""
    near = distances.select(F.col("node").alias("dst"), (F.col("distance") + 1).alias("d"))
    node = distances.select(F.col("node").alias("src"), F.col("distance").alias("d"))
    return edges.join(node, "src").join(near, ["dst", "d"]).groupBy(F.col("src").alias("node"), F.col("d").alias("distance")).agg(F.min("dst").alias("parent"))


@query(f"WITH RECURSIVE {EDGES_SQL}, {_BACK} SELECT c.node, c.distance, min(p.node) AS parent FROM bd c JOIN edges e ON e.src = c.node JOIN bd p ON p.node = e.dst AND p.distance = c.distance - 1 GROUP BY 1, 2", covers=("GR08", "GR09"))
def op_gr09_primary_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).edges()
    return first_visits(e, traverse(e, spark.range(1).select(F.lit("s:1").alias("node")), 3, reverse=True))


@query(f"WITH RECURSIVE {EDGES_SQL}, {_START}, {_WALK} SELECT e.src, e.dst FROM edges e JOIN dist a ON a.node = e.src JOIN dist b ON b.node = e.dst WHERE b.distance = a.distance + 1", covers=("GR10", "GR04"))
def op_gr10_layer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    e = t.edges()
    d = traverse(e, spark.range(1).select(F.lit(_first_customer(t)).alias("node")), 3)
    a, b = (d.select(F.col("node").alias(n), F.col("distance").alias(f"d_{n}")) for n in ("src", "dst"))
    return e.join(a, "src").join(b, "dst").where("d_dst = d_src + 1").select("src", "dst")


@query(
    f"""WITH {EDGES_SQL}, {_START}, e2 AS (SELECT DISTINCT src, dst FROM edges)
    SELECT a.src || '>' || a.dst || '>' || b.dst || '>' || c.dst AS path FROM st JOIN e2 a ON a.src = st.node JOIN e2 b ON b.src = a.dst JOIN e2 c ON c.src = b.dst WHERE c.dst = 's:1' ORDER BY [a.src, a.dst, b.dst, c.dst] LIMIT 16""",
    covers=("GR02", "GR03", "GR04"),
)
def op_gr03_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return shortest_paths(t.edges(), _first_customer(t), "s:1", 12).select(F.array_join("path", ">").alias("path"))


@query(
    f"""WITH {EDGES_SQL}, sd AS (SELECT 'p:' || p_partkey AS seed FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3), u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    h1 AS (SELECT DISTINCT seed, b AS node, 1 AS d FROM sd JOIN u ON a = seed), h2 AS (SELECT DISTINCT h.seed, u.b AS node, 2 AS d FROM h1 h JOIN u ON u.a = h.node), x AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2)
    SELECT node, min(d) AS depth, count(DISTINCT seed) AS seeds FROM x WHERE node NOT IN (SELECT seed FROM sd) GROUP BY node ORDER BY depth, node LIMIT 24""",
    covers=("GR11", "TK04"),
)
def op_gr11_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected expansion of seeds by two hops with the seeds behind each node, at most 24.

    Edges meet the few nodes before repeats leave, and the first hop is written, so neither hop shuffles all edges.
    """
    t = Tables(spark, sf_dir)
    e = t.repeated_edges()
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    seeds = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(3).select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("seed"))
    seeds = cut(seeds)
    hop1 = cut(both.join(F.broadcast(seeds), F.col("seed") == F.col("a")).select("seed", F.col("b").alias("node")).distinct())
    hop2 = hop1.join(both, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
    every = hop1.withColumn("d", F.lit(1)).unionByName(hop2.withColumn("d", F.lit(2))).join(F.broadcast(seeds.select(F.col("seed").alias("node"))), "node", "left_anti")
    return every.groupBy("node").agg(F.min("d").alias("depth"), F.countDistinct("seed").alias("seeds")).orderBy("depth", "node").limit(24)


RERANK = {"in": (2, 6), "out": (1, 4), "contains": (8, 16), "imports": (6, 12)}


@query(
    f"""WITH {EDGES_SQL}, n AS (SELECT node, count(*) FILTER (k = 'in') AS i, count(*) FILTER (k = 'out') AS o, count(*) FILTER (t = 'contains') AS c, count(*) FILTER (t = 'imports') AS m FROM (SELECT dst AS node, 'in' AS k, edge_type AS t FROM edges UNION ALL SELECT src, 'out', edge_type FROM edges) GROUP BY node)
    SELECT node, (least(2 * i, 6) + least(o, 4) + least(8 * c, 16) + least(6 * m, 12))::BIGINT AS bonus FROM n""",
    covers=("GR12", "GR13", "TK03"),
)
def op_gr12_graph_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).edges()
    ends = e.select(F.col("dst").alias("node"), F.lit("in").alias("k"), "edge_type").unionByName(e.select(F.col("src").alias("node"), F.lit("out").alias("k"), "edge_type"))
    n = ends.groupBy("node").agg(*[F.count_if(c == v).alias(v) for c, v in ((F.col("k"), "in"), (F.col("k"), "out"), (F.col("edge_type"), "contains"), (F.col("edge_type"), "imports"))])
    return n.select("node", sum((F.least(F.col(k) * w, F.lit(top)) for k, (w, top) in RERANK.items()), F.lit(0)).cast("long").alias("bonus"))


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, k(node) AS (SELECT 's:1' UNION SELECT src FROM k JOIN edges ON dst = node WHERE edge_type <> 'contains') SELECT node FROM k""",
    covers=("GR21",),
)
def op_gr21_binding_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    e = t.edges().where("edge_type <> 'contains'")
    return closure(e, spark.range(1).select(F.lit("s:1").alias("node")))


@query(
    """WITH a AS (SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) ORDER BY 1 LIMIT 4), p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), fan AS (SELECT l_suppkey, count(*) AS n FROM p GROUP BY 1)
    SELECT x.l_orderkey AS anchor, y.l_orderkey AS neighbour, count(*) AS score FROM p x JOIN p y ON x.l_suppkey = y.l_suppkey AND x.l_orderkey <> y.l_orderkey WHERE x.l_orderkey IN (SELECT l_orderkey FROM a) GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY score DESC, anchor, neighbour LIMIT 6""",
    covers=("GR26", "AN11", "TK11"),
)
def op_gr26_coedit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share most suppliers with one of four anchors."""
    p = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_suppkey").distinct()
    anchors = p.select("l_orderkey").distinct().orderBy("l_orderkey").limit(4)
    own = p.join(F.broadcast(anchors), "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("anchor"), "l_suppkey")
    shared = p.join(F.broadcast(own), "l_suppkey").where("l_orderkey <> anchor")  # own is four files' neighbours
    return shared.groupBy("anchor", F.col("l_orderkey").alias("neighbour")).agg(F.count("*").alias("score")).where("score >= 2").orderBy(F.desc("score"), "anchor", "neighbour").limit(6)


@query(
    """SELECT r_name, n_name, string_agg(s_name, ',' ORDER BY s_name) AS members, count(s_name) AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    covers=("GR29", "JN10"),
)
def op_gr29_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    tree = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return tree.groupBy("r_name", "n_name").agg(F.nullif(F.array_join(F.array_sort(F.collect_list("s_name")), ","), F.lit("")).alias("members"), F.count("s_name").alias("n"))


def synthetic(spark: SparkSession, edges: int, fan_out: int, planted: int, seed: int) -> DataFrame:
    """GR30. A layered random graph of ``edges`` edges and a planted path p0 > p1 > ... > p<planted>."""
    i = F.col("id")
    layer = F.floor(i / fan_out)
    noise = spark.range(edges - planted).select(F.concat(F.lit("n"), layer.cast("string")).alias("src"), F.concat(F.lit("n"), (layer + 1 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(fan_out * 4))).cast("string")).alias("dst"), F.lit("calls").alias("edge_type"))
    path = spark.range(planted).select(F.concat(F.lit("p"), i.cast("string")).alias("src"), F.concat(F.lit("p"), (i + 1).cast("string")).alias("dst"), F.lit("calls").alias("edge_type"))
    return noise.unionByName(path)


@query("SELECT 'p0>p1>p2>p3>p4>p5' AS path", covers=("GR30", "GR02"))
def op_gr30_planted_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortest_paths(synthetic(spark, 12_000, 8, 5, 7), "p0", "p5", 12).select(F.array_join("path", ">").alias("path"))


@query(
    f"""WITH {EDGES_SQL}, x AS (SELECT dst AS node, count(DISTINCT edge_type) AS relations, least(count(DISTINCT src), 3) AS seeds, bool_and(edge_type = 'imports') AS same FROM edges GROUP BY dst)
    SELECT node, round(CASE WHEN same THEN 0.5 ELSE 1.0 END + 0.6 * relations + 0.3 * seeds, 4) AS graph_raw, round(2.0 + 0.8 * relations + 0.4 * seeds + CASE WHEN same THEN 0.8 ELSE 0 END, 4) AS test_raw FROM x""",
    covers=("GR31", "GR32"),
)
def op_gr31_lane_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Tables(spark, sf_dir).edges().groupBy(F.col("dst").alias("node")).agg(F.countDistinct("edge_type").alias("relations"), F.least(F.countDistinct("src"), F.lit(3)).alias("seeds"), F.bool_and(F.col("edge_type") == "imports").alias("same"))
    graph = F.when(F.col("same"), 0.5).otherwise(1.0) + 0.6 * F.col("relations") + 0.3 * F.col("seeds")
    test = 2.0 + 0.8 * F.col("relations") + 0.4 * F.col("seeds") + F.when(F.col("same"), 0.8).otherwise(0.0)
    return x.select("node", F.round(graph, 4).alias("graph_raw"), F.round(test, 4).alias("test_raw"))


@query(
    f"""WITH {EDGES_SQL}, s AS (SELECT 'p:' || p_partkey AS seed FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3), c AS (SELECT seed, e.src AS node, row_number() OVER (PARTITION BY seed ORDER BY e.src) AS k FROM s JOIN edges e ON e.dst = seed AND e.edge_type = 'calls')
    SELECT node, count(*) AS n_seeds, round(0.95 * 0.8 + least(0.05 * (count(*) - 1), 0.1), 4) AS score FROM c WHERE k <= 3 GROUP BY node ORDER BY n_seeds DESC, node LIMIT 8""",
    covers=("GR14", "GR15"),
)
def op_gr14_upstream_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of three seeds, three a seed, eight in all, with a bonus for several seeds."""
    t = Tables(spark, sf_dir)
    seeds = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(3).select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("dst"))
    own = Window.partitionBy("dst").orderBy("src")
    callers = t.edges().where("edge_type = 'calls'").join(F.broadcast(seeds), "dst", "left_semi").withColumn("k", F.row_number().over(own)).where("k <= 3")
    n = callers.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_seeds"))
    return n.withColumn("score", F.round(0.95 * 0.8 + F.least(0.05 * (F.col("n_seeds") - 1), F.lit(0.1)), 4)).orderBy(F.desc("n_seeds"), "node").limit(8)
