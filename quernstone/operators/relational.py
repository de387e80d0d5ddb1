"""Lookups, joins, aggregates, per-group limits and set operations over relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.plans.catalog import query
from quernstone.sources.tables import EDGES_SQL, FILES_SQL, Tables

STRUCTURAL = ("n", "r")
LANGUAGES = {"en": "english", "de": "german", "fr": "french", "es": "spanish"}


# ---- sources, predicates


@query(f"WITH {FILES_SQL} SELECT path, language, content_hash, size_bytes FROM files", covers=("SRC01", "FLT06"))
def op_src01_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).files().select("path", "language", "content_hash", "size_bytes")


def snapshot(files: DataFrame, parts: int = 4096) -> DataFrame:
    """SRC02. (n_files, fingerprint) of a set of (path, content_hash), in two levels so that no task gathers all rows.

    Rows are dealt to ``parts`` groups by the first hex digits of their path's hash; a group's
    digest is over its sorted rows, the whole digest over the sorted groups.
    """
    row = F.concat_ws(":", "path", "content_hash")
    group = F.substring(F.sha2("path", 256), 1, 3)
    groups = files.groupBy(group.alias("g")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(row))), 256).alias("h"))
    return groups.agg(F.sum("n").alias("n_files"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", "g", "h")))), 256).alias("fingerprint"))


@query(
    f"""WITH {FILES_SQL}, g AS (SELECT left(sha256(path), 3) AS g, count(*) AS n, sha256(string_agg(path || ':' || content_hash, chr(10) ORDER BY path || ':' || content_hash)) AS h FROM files GROUP BY 1)
    SELECT sum(n)::BIGINT AS n_files, sha256(string_agg(g || ':' || h, chr(10) ORDER BY g || ':' || h)) AS fingerprint FROM g""",
    covers=("SRC02", "RE04", "RE06", "SRC23"),
)
def op_src02_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(Tables(spark, sf_dir).files())


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' END AS language FROM documents", covers=("SRC05",))
def op_src05_detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return Tables(spark, sf_dir).documents.select("doc_id", known[F.col("lang")].alias("language"))


@query(
    f"WITH {FILES_SQL} SELECT path, NOT (regexp_matches(path, 'src(1|3|5)/') AND language IN ('de', 'fr')) AND size_bytes <= 262144 AND NOT contains(text, chr(0)) AS safe FROM files JOIN documents ON id = doc_id::VARCHAR",
    covers=("SRC06", "SRC07"),
)
def op_src06_safe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    d = t.documents
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")))
    safe = ~(path.rlike("src(1|3|5)/") & F.col("lang").isin("de", "fr")) & (F.octet_length("text") <= 262144) & ~F.contains("text", F.lit("\0"))
    return d.select(path.alias("path"), safe.alias("safe"))


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """SRC04. The last rule whose pattern matches decides; rules are (regex, negated) in order."""
    out = F.lit(False)
    for pattern, negated in rules:
        out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def compile_ignore(content: str, base: str = "") -> list[tuple[str, bool]]:
    """SRC03. Rules of an ignore file as anchored regexes: negation, directories, anchors, ``*``, ``?``, ``**`` and classes."""
    import re

    out = []
    for line in content.splitlines():
        line = line.rstrip() if not line.endswith("\\ ") else line
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        only_dir, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.removeprefix("/")
        body, k = "", 0
        while k < len(line):
            rest = line[k:]
            if rest.startswith("**/"):
                body, k = body + "(?:.*/)?", k + 3
            elif rest.startswith("/**/"):
                body, k = body + "/(?:.*/)?", k + 4
            elif rest.startswith("/**"):
                body, k = body + "/.*", k + 3
            elif rest[0] == "*":
                body, k = body + "[^/]*", k + 1
            elif rest[0] == "?":
                body, k = body + "[^/]", k + 1
            elif m := re.match(r"\[!?[^\]]+\]", rest):
                body, k = body + m[0].replace("[!", "[^"), k + len(m[0])
            else:
                step = 2 if rest[0] == "\\" and len(rest) > 1 else 1
                body, k = body + re.escape(rest[step - 1]), k + step
        prefix = f"^{re.escape(base)}" + ("" if anchored else "(?:.*/)?")
        out.append((f"{prefix}{body}{'/' if only_dir else '(?:/|$)'}", negated))
    return out


IGNORE = "*.txt\n!doc1*.txt\n/src2/\n**/fr/**\n"


@query(
    f"""WITH {FILES_SQL} SELECT path, CASE WHEN regexp_matches(path, '(^|/)fr/') THEN true WHEN regexp_matches(path, '^src2/') THEN true
    WHEN regexp_matches(path, '(^|/)doc1[^/]*\\.txt(/|$)') THEN false WHEN regexp_matches(path, '\\.txt(/|$)') THEN true ELSE false END AS ignored FROM files""",
    covers=("SRC03", "SRC04"),
)
def op_src04_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).files().select("path", ignored(F.col("path"), compile_ignore(IGNORE)).alias("ignored"))


@query(f"WITH {FILES_SQL} SELECT * EXCLUDE (content_hash) FROM files WHERE starts_with(path, 'src3/en/') AND NOT contains(substr(path, 9), '/')", covers=("FLT04", "FLT01"))
def op_flt04_under_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = "src3/en/"
    f = Tables(spark, sf_dir).files().drop("content_hash")
    return f.where(F.startswith("path", F.lit(prefix)) & ~F.contains(F.substring("path", len(prefix) + 1, 1_000_000), F.lit("/")))


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)", covers=("FLT02", "FLT03", "FLT07"))
def op_flt02_exact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).part
    return p.join(F.broadcast(p.agg(F.min("p_brand").alias("p_brand"))), "p_brand", "left_semi").select("p_partkey", "p_name", "p_brand", "p_type")


@query("SELECT o.* FROM orders o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)", covers=("FLT05", "JN05"))
def op_flt05_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return t.orders.join(t.customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(*t.orders.columns)


@query("SELECT count(*) > 0 AS has_rows FROM documents", covers=("FLT08",))
def op_flt08_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("has_rows"))


@query("SELECT event_id, event_type, (SELECT count(*) FROM events WHERE event_type = 'error') - 20 AS omitted FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 20", covers=("FLT09", "AG20"))
def op_flt09_bounded_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = Tables(spark, sf_dir).events.where("event_type = 'error'")
    total = F.broadcast(failed.agg((F.count("*") - 20).alias("omitted")))
    return failed.orderBy("ts", "event_id").limit(20).crossJoin(total).select("event_id", "event_type", "omitted")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a') OR contains(lower(coalesce(p_type, '')), 'a')", covers=("FLT10",))
def op_flt10_contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("a"))
    return Tables(spark, sf_dir).part.where(has(F.col("p_name")) | has(F.col("p_brand")) | has(F.col("p_type"))).select("p_partkey")


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE list_has_any(string_split(path, '/'), ['src1', 'src4', 'es']) ORDER BY path LIMIT 96", covers=("FLT12",))
def op_flt12_path_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Tables(spark, sf_dir).files()
    return f.where(F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ("src1", "src4", "es"))))).orderBy("path").limit(96).select("path")


TEST_PATH = r"(^|/)(tests?|__tests__|spec)/|(^|/)test[._-]|\.(test|spec)\.[a-z]+$"


@query(
    f"""WITH {FILES_SQL}, p AS (SELECT CASE WHEN id::BIGINT % 3 = 0 THEN 'tests/' || path WHEN id::BIGINT % 5 = 0 THEN replace(path, '.txt', '.spec.ts') ELSE path END AS path FROM files)
    SELECT path, regexp_matches(path, '(^|/)(tests?|__tests__|spec)/|(^|/)test[._-]|\\.(test|spec)\\.[a-z]+$') AS is_test,
    CASE WHEN regexp_matches(path, '(^|/)(docs?|examples?|samples?)/') THEN 'example' WHEN regexp_matches(path, '(^|/)(vendor|node_modules|generated)/') THEN 'vendored' WHEN regexp_matches(path, '\\.(json|txt|csv)$') THEN 'data' ELSE 'source' END AS kind FROM p""",
    covers=("FLT14", "FLT15", "FLT16", "FLT17"),
)
def op_flt14_path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Tables(spark, sf_dir).files()
    k, p = F.col("id").cast("long"), F.col("path")
    path = F.when(k % 3 == 0, F.concat(F.lit("tests/"), p)).when(k % 5 == 0, F.replace(p, F.lit(".txt"), F.lit(".spec.ts"))).otherwise(p)
    kind = F.when(F.col("path").rlike("(^|/)(docs?|examples?|samples?)/"), "example").when(F.col("path").rlike("(^|/)(vendor|node_modules|generated)/"), "vendored").when(F.col("path").rlike(r"\.(json|txt|csv)$"), "data").otherwise("source")
    return f.select(path.alias("path")).select("path", F.col("path").rlike(TEST_PATH).alias("is_test"), kind.alias("kind"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 3 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') ORDER BY c_acctbal DESC, c_custkey", covers=("FLT19", "FLT20"))
def op_flt19_dynamic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).customer
    return c.where((F.col("c_nationkey") == 3) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE")).orderBy(F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_acctbal")


def enclosing(anchors: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """FLT21. (anchor_id, span_id, exact): the shortest span of the file around a line, else the nearest.

    Anchors are (anchor_id, file, line), spans (span_id, file, first, last) no longer than
    ``width`` lines. A line meets spans through bins of ``width`` lines, an equi join; only
    lines in no span go on to their file's nearest span, by the last one before and the
    first one after, which two window scans find.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    s = spans.withColumn("bin", bins(F.col("first"), F.col("last")))
    inside = anchors.withColumn("bin", F.floor(F.col("line") / width)).join(s, ["file", "bin"]).where("line BETWEEN first AND last")
    best = inside.groupBy("anchor_id").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("n"), "span_id")).alias("b")).select("anchor_id", F.col("b.span_id").alias("span_id"), F.lit(True).alias("exact"))
    rest = anchors.join(best, "anchor_id", "left_anti")
    own = Window.partitionBy("file")
    marks = rest.select("file", F.col("line").alias("at"), "anchor_id", F.lit(None).cast("struct<at:bigint,span_id:bigint>").alias("up"), F.lit(None).cast("struct<at:bigint,span_id:bigint>").alias("down"))
    none = F.lit(None).cast("struct<at:bigint,span_id:bigint>")
    point = lambda c: F.struct(F.col(c).cast("long").alias("at"), F.col("span_id").cast("long").alias("span_id"))
    ends = spans.select("file", F.col("last").alias("at"), F.lit(None).cast("long").alias("anchor_id"), point("last").alias("up"), none.alias("down")).unionByName(spans.select("file", F.col("first").alias("at"), F.lit(None).cast("long").alias("anchor_id"), none.alias("up"), point("first").alias("down")))
    seen = marks.unionByName(ends).withColumn("before", F.last("up", ignorenulls=True).over(own.orderBy("at", F.col("anchor_id").isNotNull()))).withColumn("after", F.last("down", ignorenulls=True).over(own.orderBy(F.desc("at"), F.col("anchor_id").isNotNull())))
    near = seen.where("anchor_id IS NOT NULL").withColumn("near", F.when(F.col("after").isNull() | (F.col("at") - F.col("before.at") <= F.col("after.at") - F.col("at")), F.col("before.span_id")).otherwise(F.col("after.span_id")))
    return best.unionByName(near.where("near IS NOT NULL").select("anchor_id", F.col("near").alias("span_id"), F.lit(False).alias("exact")))


# ---- joins


@query(
    "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    covers=("JN01", "JN10"),
)
def op_jn01_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query(f"WITH {EDGES_SQL} SELECT * FROM edges WHERE src LIKE 'p:1%' OR dst LIKE 'p:1%'", covers=("JN02",))
def op_jn02_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at either end of a set; a filter on rows, so both ends are looked at in one pass."""
    return Tables(spark, sf_dir).edges().where(F.startswith("src", F.lit("p:1")) | F.startswith("dst", F.lit("p:1")))


@query(
    """WITH own AS (SELECT DISTINCT c_nationkey, s_nationkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)
    SELECT c_nationkey AS anchor, s_nationkey AS other, 'out' AS direction FROM own WHERE c_nationkey <> s_nationkey
    UNION ALL SELECT s_nationkey, c_nationkey, 'in' FROM own WHERE c_nationkey <> s_nationkey""",
    covers=("JN03", "ST03"),
)
def op_jn03_cross_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    pairs = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").join(c, "o_custkey").join(s, "l_suppkey").select("c_nationkey", "s_nationkey").distinct().where("c_nationkey <> s_nationkey")
    row = lambda a, b, d: pairs.select(F.col(a).alias("anchor"), F.col(b).alias("other"), F.lit(d).alias("direction"))
    return row("c_nationkey", "s_nationkey", "out").unionByName(row("s_nationkey", "c_nationkey", "in"))


@query("SELECT l_partkey, string_agg(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR, ',' ORDER BY l_orderkey, l_linenumber) AS sites FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) GROUP BY l_partkey", covers=("JN06", "FLT22"))
def op_jn06_call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    own = t.lineitem.join(t.part.where("p_size > 40").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    sites = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber")))
    named = F.transform(sites, lambda x: F.concat_ws("-", x["l_orderkey"].cast("string"), x["l_linenumber"].cast("string")))
    return own.groupBy("l_partkey").agg(F.array_join(named, ",").alias("sites"))


@query(
    """SELECT (SELECT count(*) FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_partkey IS NULL)::BIGINT AS dangling_parts,
    (SELECT count(*) FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_custkey IS NULL)::BIGINT AS dangling_customers,
    (SELECT count(*) > 0 FROM lineitem l SEMI JOIN orders o ON l.l_orderkey = o.o_orderkey SEMI JOIN part p ON l.l_partkey = p.p_partkey) AS resolvable""",
    covers=("JN07", "JN08"),
)
def op_jn08_validate_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    line, part = t.lineitem, t.part.select(F.col("p_partkey").alias("l_partkey"))
    parts = line.join(part, "l_partkey", "left_anti").agg(F.count("*").alias("dangling_parts"))
    custs = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").agg(F.count("*").alias("dangling_customers"))
    some = line.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").join(part, "l_partkey", "left_semi").limit(1).agg((F.count("*") > 0).alias("resolvable"))
    return parts.crossJoin(custs).crossJoin(some)  # one row each


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey ORDER BY n DESC, c_custkey LIMIT 10", covers=("JN09", "ME06"))
def op_jn09_left_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))  # before the join: one row a key
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy(F.desc("n"), "c_custkey").limit(10)


@query(
    f"""WITH {FILES_SQL}, h AS (SELECT 'doc' || (item_id * 7) || '.txt' AS hint FROM benchmark UNION ALL SELECT 'en/doc' || (item_id * 3) || '.txt' FROM benchmark)
    SELECT hint, path FROM h JOIN files ON path = hint OR ends_with(path, '/' || hint)""",
    covers=("JN19", "RT04", "TX38"),
)
def op_jn19_suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints meet paths by their last segment, an equi join; the boundary suffix is verified."""
    t = Tables(spark, sf_dir)
    hints = t.benchmark.select(F.concat(F.lit("doc"), (F.col("item_id") * 7).cast("string"), F.lit(".txt")).alias("hint")).unionByName(t.benchmark.select(F.concat(F.lit("en/doc"), (F.col("item_id") * 3).cast("string"), F.lit(".txt")).alias("hint")))
    paths = t.files().select("path", T.basename(F.col("path")).alias("last"))
    return hints.withColumn("last", T.basename(F.col("hint"))).join(paths, "last").where((F.col("path") == F.col("hint")) | F.endswith("path", F.concat(F.lit("/"), "hint"))).select("hint", "path")


# ---- aggregates


@query("SELECT p_partkey, count(l_orderkey) AS in_degree FROM part LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_partkey = p_partkey GROUP BY p_partkey", covers=("AG01", "AG04"))
def op_ag01_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    n = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).distinct().groupBy("p_partkey").agg(F.count("*").alias("n"))
    return t.part.select("p_partkey").join(n, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).cast("long").alias("in_degree"))


@query(f"WITH {EDGES_SQL} SELECT node, count(DISTINCT other) AS neighbours FROM (SELECT src AS node, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges) GROUP BY node", covers=("AG02",))
def op_ag02_distinct_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).edges()
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    return both.distinct().groupBy("node").agg(F.count("*").alias("neighbours"))


@query(f"WITH {EDGES_SQL} SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type", covers=("AG03", "AG10", "AG15", "AG21"))
def op_ag10_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).edges().groupBy("edge_type").agg(F.count("*").alias("n"))


@query(
    """SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders, count(*) AS n FROM lineitem GROUP BY l_suppkey""",
    covers=("AG08", "AG11", "AG23"),
)
def op_ag11_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if
    return Tables(spark, sf_dir).lineitem.groupBy("l_suppkey").agg(n(F.col("l_returnflag") == "R").alias("returned"), n(F.col("l_linestatus") == "O").alias("open"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"), F.count("*").alias("n"))


@query(
    """SELECT l_suppkey, bool_or(l_returnflag = 'R') AS direct, min(l_linenumber) AS distance, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds,
    min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS strongest, max(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS weakest FROM lineitem GROUP BY l_suppkey""",
    covers=("AG09", "AG25", "TX53"),
)
def op_ag09_affected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rank = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    return Tables(spark, sf_dir).lineitem.groupBy("l_suppkey").agg(F.bool_or(flag == "R").alias("direct"), F.min("l_linenumber").alias("distance"), F.array_join(F.sort_array(F.collect_set(flag)), ",").alias("kinds"), F.min(rank).alias("strongest"), F.max(rank).alias("weakest"))


@query("SELECT source, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, sum(ceil(n_chars / 4.0))::BIGINT AS declared, round(100 - 100.0 * sum(ceil(least(length(text), 600) / 4.0)) / nullif(sum(ceil(length(text) / 4.0)), 0), 4) AS saved FROM documents GROUP BY source", covers=("AG18", "TX34", "BU03"))
def op_ag18_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    full, short = F.sum(T.estimate_tokens(F.col("text"))), F.sum(F.ceil(F.least(F.length("text"), F.lit(600)) / 4))
    return Tables(spark, sf_dir).documents.groupBy("source").agg(full.alias("tokens"), F.sum(F.ceil(F.col("n_chars") / 4)).cast("long").alias("declared"), F.round(100 - 100.0 * short / F.nullif(full, F.lit(0)), 4).alias("saved"))


@query("SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS english, string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (lang <> 'en') AS others FROM documents GROUP BY source", covers=("AG19",))
def op_ag19_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.col("lang")
    return Tables(spark, sf_dir).documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(lang == "en").alias("english"), F.nullif(F.array_join(F.sort_array(F.collect_set(F.when(lang != "en", lang))), ","), F.lit("")).alias("others"))


@query("SELECT user_id, event_id, round(value / max(value) OVER (), 6) AS norm FROM events", covers=("AG22", "TX11"))
def op_ag22_pool_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events
    return e.crossJoin(F.broadcast(e.agg(F.max("value").alias("top")))).select("user_id", "event_id", F.round(F.col("value") / F.col("top"), 6).alias("norm"))


# ---- per-group limits, orders


@query(
    f"WITH {EDGES_SQL} SELECT dst, src FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM edges WHERE edge_type = 'calls') WHERE k <= 5",
    covers=("WN01", "WN06"),
)
def op_wn01_top_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("dst").orderBy("src")
    return Tables(spark, sf_dir).edges().where("edge_type = 'calls'").withColumn("k", F.row_number().over(w)).where("k <= 5").select("dst", "src")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200", covers=("WN03", "WN08"))
def op_wn03_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 200 by time: a top-k, with no window over all rows."""
    return Tables(spark, sf_dir).events.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id")


@query(
    """WITH r AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_name, p_partkey) AS k FROM part)
    SELECT p_partkey, p_retailprice FROM r WHERE k <= 20 OR (p_brand = (SELECT min(p_brand) FROM part) AND p_partkey % 50 = 0)""",
    covers=("TK05",),
)
def op_tk05_top_beside_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20, and members of a lane beyond them."""
    p = Tables(spark, sf_dir).part
    best = p.orderBy(F.desc("p_retailprice"), "p_name", "p_partkey").limit(20)
    lane = p.where("p_partkey % 50 = 0").join(F.broadcast(p.agg(F.min("p_brand").alias("p_brand"))), "p_brand", "left_semi").select(*p.columns)
    return best.unionByName(lane).distinct().select("p_partkey", "p_retailprice")


@query(
    """WITH r AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM part),
    kept AS (SELECT * FROM r WHERE k <= 10), more AS (SELECT * FROM r WHERE k > 10 AND p_size > 25 AND p_brand NOT IN (SELECT p_brand FROM kept) ORDER BY k LIMIT 1)
    SELECT p_partkey FROM kept UNION ALL SELECT p_partkey FROM more""",
    covers=("TK08",),
)
def op_tk08_cap_with_exemption(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).part
    order = (F.desc("p_retailprice"), "p_partkey")
    kept = p.orderBy(*order).limit(10)
    more = p.where("p_size > 25").join(F.broadcast(kept.select("p_brand")), "p_brand", "left_anti").orderBy(*order).limit(1)
    return kept.select("p_partkey").unionByName(more.select("p_partkey"))


@query(
    """WITH r AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS b FROM part)
    SELECT p_partkey, p_brand FROM r ORDER BY b > 1, p_retailprice DESC, p_partkey LIMIT 30""",
    covers=("TK10",),
)
def op_tk10_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot for each brand's best, then by rank."""
    own = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    ranked = Tables(spark, sf_dir).part.withColumn("b", F.row_number().over(own))
    return ranked.orderBy(F.col("b") > 1, F.desc("p_retailprice"), "p_partkey").limit(30).select("p_partkey", "p_brand")


@query("SELECT max(o_orderkey) AS latest, arg_max(o_custkey, o_orderkey) AS owner FROM orders", covers=("TK14",))
def op_tk14_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).orders.agg(F.max("o_orderkey").alias("latest"), F.max_by("o_custkey", "o_orderkey").alias("owner"))


# ---- set operations


@query(
    """WITH u AS (SELECT p_partkey, 0 AS lane, p_size AS score FROM part WHERE p_size > 30 UNION ALL SELECT p_partkey, 1, p_size * 2 FROM part WHERE p_retailprice > 1000)
    SELECT p_partkey, lane, score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY lane) AS k FROM u) WHERE k = 1""",
    covers=("ST01", "ST06", "ST08"),
)
def op_st01_first_lane_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).part
    lane = lambda df, k, s: df.select("p_partkey", F.lit(k).alias("lane"), s.alias("score"))
    both = lane(p.where("p_size > 30"), 0, F.col("p_size")).unionByName(lane(p.where("p_retailprice > 1000"), 1, F.col("p_size") * 2))
    return both.groupBy("p_partkey").agg(F.min(F.struct("lane", "score")).alias("b")).select("p_partkey", "b.lane", "b.score")


@query("SELECT p_brand, p_type, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, p_type, p_size HAVING count(*) = 1", covers=("ST07", "GR05"))
def op_st07_unambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).part.groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n"), F.min("p_partkey").alias("p_partkey")).where("n = 1").drop("n")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_partkey IN (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 400)", covers=("ST05",))
def op_st05_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    pool = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(400).select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.where("l_quantity > 45").select("l_partkey").join(F.broadcast(pool), "l_partkey", "left_semi").distinct()
