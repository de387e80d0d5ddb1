"""Extraction from text: literals, anchors, commands, test outcomes, patches, code."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.plans.catalog import query
from quernstone.plans.lineage import spread
from quernstone.sources.tables import Tables

#: Fixed patterns of code-like words.
SCREAMING = r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"
ACRONYM = r"^[A-Z]{3,}$"
LINE_ANCHOR = r"([A-Za-z0-9_./-]+\.[A-Za-z][A-Za-z0-9]*)(?:#L|:)(\d+)(?:-L?(\d+))?"


def all_of(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


@query(
    r"""WITH d AS (SELECT doc_id, text || ' see src/app.py#L10-L20 and lib/x.ts:42, not A_B_C or HTTP_ERR' AS t FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(t, '\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b'), lambda x: x <> ''))), ' ') AS constants,
    len(list_distinct(list_filter(string_split_regex(t, '[^A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Z]{3,}$')))) AS acronyms FROM d""",
    covers=("SRC16", "TX47", "AN03"),
)
def op_src16_body_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.lit(" see src/app.py#L10-L20 and lib/x.ts:42, not A_B_C or HTTP_ERR"))
    return Tables(spark, sf_dir).documents.select("doc_id", F.array_join(F.array_sort(F.array_distinct(all_of(t, SCREAMING))), " ").alias("constants"), F.size(F.array_distinct(F.filter(F.split(t, "[^A-Za-z0-9_]+"), lambda x: x.rlike(ACRONYM)))).cast("long").alias("acronyms"))


@query(
    r"""WITH d AS (SELECT p_partkey, p_name || ' in src/m' || p_partkey || '.py#L' || p_size || '-L' || (p_size + 5) || ' or lib/x.ts:42' AS t FROM part), m AS (SELECT p_partkey, unnest(regexp_extract_all(t, '([A-Za-z0-9_./-]+\.[A-Za-z][A-Za-z0-9]*)(?:#L|:)(\d+)(?:-L?(\d+))?')) AS a FROM d)
    SELECT p_partkey, a AS anchor, regexp_extract(a, '^(.*?)(?:#L|:)', 1) AS path, regexp_extract(a, '(?:#L|:)(\d+)', 1)::BIGINT AS first, greatest(regexp_extract(a, '(?:#L|:)(\d+)', 1)::BIGINT, coalesce(try_cast(regexp_extract(a, '-L?(\d+)$', 1) AS BIGINT), 0)) AS last FROM m""",
    covers=("TX46",),
)
def op_tx46_line_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file#L10-L20 and file:42; a reversed range is one line."""
    size = F.col("p_size")
    t = F.concat(F.col("p_name"), F.lit(" in src/m"), F.col("p_partkey").cast("string"), F.lit(".py#L"), size.cast("string"), F.lit("-L"), (size + 5).cast("string"), F.lit(" or lib/x.ts:42"))
    m = Tables(spark, sf_dir).part.select("p_partkey", F.explode(all_of(t, LINE_ANCHOR)).alias("anchor"))
    part = lambda k: F.regexp_extract("anchor", LINE_ANCHOR, k)
    first = part(2).cast("long")
    return m.select("p_partkey", "anchor", part(1).alias("path"), first.alias("first"), F.greatest(first, F.coalesce(part(3).try_cast("long"), F.lit(0).cast("long"))).alias("last"))


@query(
    r"""SELECT page_id, len(regexp_extract_all(html, '<(a|p|div|h[1-6])\b')) AS tags, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS links, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages""",
    covers=("GR29",),
)
def op_tx44_page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return Tables(spark, sf_dir).pages.select("page_id", F.size(all_of(h, r"<(a|p|div|h[1-6])\b")).cast("long").alias("tags"), F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.size(F.array_distinct(all_of(h, 'href="([^"]*)"', 1))).cast("long").alias("links"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


COMMANDS = ["python -m pytest tests/{}", "pytest -q", "python3 -m unittest", "tox -e py3", "npm run test", "cargo test", "go test ./...", "make {}", "rm -rf {}", "pytest | tee log"]
#: Fixed patterns, in order: the first that matches names the framework.
FRAMEWORKS = [
    ("pytest", r"\bpython[0-9.]*\s+-m\s+pytest\b|(^|[\s;&|(])pytest\b"),
    ("unittest", r"\bpython[0-9.]*\s+-m\s+unittest\b|(^|[\s;&|(])unittest\b"),
    ("tox", r"(^|[\s;&|(])tox\b"),
    ("bun", r"(^|[\s;&|(])bun\s+test\b"),
    ("npm", r"(^|[\s;&|(])npm\s+(run\s+)?test\b"),
    ("cargo", r"(^|[\s;&|(])cargo\s+test\b"),
    ("go", r"(^|[\s;&|(])go\s+test\b"),
]


def test_framework(command: Column) -> Column:
    """TX42."""
    c, out = F.lower(command), F.lit("unknown")
    for name, pattern in reversed(FRAMEWORKS):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def command_safety(command: Column) -> Column:
    """DX09. Rejected words first, then shell operators, then whether it is a known test command."""
    return (
        F.when(command.rlike(r"\b(rm|sudo|curl|wget|chmod|git\s+push)\b"), "rejected")
        .when(command.rlike(r"[|;&><`]|\$\("), "shell")
        .when(test_framework(command) == "unknown", "unrecognized")
        .otherwise("allowed")
    )


_FRAMEWORK_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(c), '{p}') THEN '{n}'" for n, p in FRAMEWORKS) + " ELSE 'unknown' END"


@query(
    f"""WITH x AS (SELECT p_partkey, replace({COMMANDS}[(p_partkey % 10)::INT + 1], '{{}}', p_size::VARCHAR) AS c FROM part), f AS (SELECT *, {_FRAMEWORK_SQL} AS framework FROM x)
    SELECT p_partkey, framework, CASE WHEN regexp_matches(c, '\\b(rm|sudo|curl|wget|chmod|git\\s+push)\\b') THEN 'rejected' WHEN regexp_matches(c, '[|;&><`]|\\$\\(') THEN 'shell' WHEN framework = 'unknown' THEN 'unrecognized' ELSE 'allowed' END AS safety FROM f""",
    covers=("TX42", "DX09"),
)
def op_tx42_test_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.replace(F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("p_partkey") % 10 + 1).cast("int")), F.lit("{}"), F.col("p_size").cast("string"))
    return Tables(spark, sf_dir).part.select("p_partkey", c.alias("c")).select("p_partkey", test_framework(F.col("c")).alias("framework"), command_safety(F.col("c")).alias("safety"))


#: Fixed patterns of a test runner's output: signs of each outcome, and its counts.
ERROR_SIGNS = r"={3,}\s*ERRORS\s*={3,}|Traceback \(most recent call last\)|ImportError|ModuleNotFoundError"
ERROR_COUNT = r"(\d+)\s+errors?\b"
FAILURE_SIGNS = r"={3,}\s*FAILURES\s*={3,}|(^|\n)FAILED\s+\S"
FAILURE_COUNT = r"(\d+)\s+failed"
PASS_COUNT = r"(\d+)\s+passed"
NOTHING_SIGNS = "no tests ran|collected 0 items"


def pytest_outcome(output: Column) -> Column:
    """TX43. error, failed, passed, no_tests or unknown: each outcome by its signs and its count, the worst first."""
    counted = lambda p: F.coalesce(F.regexp_extract(output, p, 1).try_cast("long") > 0, F.lit(False))
    signs = {
        "error": output.rlike(ERROR_SIGNS) | counted(ERROR_COUNT),
        "failed": output.rlike(FAILURE_SIGNS) | counted(FAILURE_COUNT),
        "passed": counted(PASS_COUNT),
        "no_tests": output.rlike(NOTHING_SIGNS),
    }
    return F.coalesce(*[F.when(found, name) for name, found in signs.items()], F.lit("unknown"))


_OUT = "CASE (p_partkey % 5)::INT WHEN 0 THEN p_size || ' passed in 2s' WHEN 1 THEN p_size || ' failed, 3 passed' WHEN 2 THEN 'collected 0 items' WHEN 3 THEN (p_size % 2) || ' error' ELSE '' END"


@query(
    f"""WITH x AS (SELECT p_partkey, p_size, {_OUT} AS o FROM part) SELECT p_partkey, CASE WHEN trim(o) = '' THEN 'unknown' WHEN coalesce(try_cast(regexp_extract(o, '(\\d+)\\s+errors?\\b', 1) AS BIGINT), 0) > 0 THEN 'error' WHEN coalesce(try_cast(regexp_extract(o, '(\\d+)\\s+failed', 1) AS BIGINT), 0) > 0 THEN 'failed'
    WHEN coalesce(try_cast(regexp_extract(o, '(\\d+)\\s+passed', 1) AS BIGINT), 0) > 0 THEN 'passed' WHEN contains(o, 'collected 0 items') THEN 'no_tests' ELSE 'unknown' END AS status FROM x""",
    covers=("TX43",),
)
def op_tx43_pytest_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    o = F.when(k == 0, F.concat(size, F.lit(" passed in 2s"))).when(k == 1, F.concat(size, F.lit(" failed, 3 passed"))).when(k == 2, "collected 0 items").when(k == 3, F.concat((F.col("p_size") % 2).cast("string"), F.lit(" error"))).otherwise("")
    return Tables(spark, sf_dir).part.select("p_partkey", o.alias("o")).select("p_partkey", pytest_outcome(F.col("o")).alias("status"))


def test_node(node: Column) -> tuple[Column, Column]:
    """TX45. (file, symbols) of a::B::c, or of a.b.C.d from its first capitalised segment on."""
    trimmed = F.trim(node)
    colon = F.split(trimmed, "::")
    dots = F.filter(F.split(trimmed, "\\."), lambda s: s != "")
    cls = F.array_position(F.transform(dots, lambda s: s.rlike("^[A-Z]")), True).cast("int")
    tail = F.when(cls > 0, F.slice(dots, cls, F.size(dots))).otherwise(F.filter(F.slice(dots, -1, 1), lambda s: s.startswith("test_")))
    is_colon = F.contains(trimmed, F.lit("::"))
    return F.when(is_colon & (colon[0] != ""), colon[0]), F.array_distinct(F.filter(F.when(is_colon, F.slice(colon, F.lit(2), F.size(colon))).otherwise(tail), lambda s: s != ""))


@query(
    """WITH x AS (SELECT p_partkey, CASE (p_partkey % 3)::INT WHEN 0 THEN 'tests/test_' || p_size || '.py::TestA::test_b' WHEN 1 THEN 'app.tests.TestCase' || p_size || '.test_x' ELSE 'app.tests.test_y' END AS n FROM part)
    SELECT p_partkey, CASE WHEN contains(n, '::') THEN string_split(n, '::')[1] END AS file, CASE WHEN contains(n, '::') THEN array_to_string(string_split(n, '::')[2:], ' ') WHEN p_partkey % 3 = 1 THEN array_to_string(string_split(n, '.')[3:], ' ') ELSE string_split(n, '.')[-1] END AS symbols FROM x""",
    covers=("TX45", "RT08"),
)
def op_tx45_test_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    n = F.when(k == 0, F.concat(F.lit("tests/test_"), size, F.lit(".py::TestA::test_b"))).when(k == 1, F.concat(F.lit("app.tests.TestCase"), size, F.lit(".test_x"))).otherwise("app.tests.test_y")
    file, symbols = test_node(F.col("n"))
    return Tables(spark, sf_dir).part.select("p_partkey", n.alias("n")).select("p_partkey", file.alias("file"), F.array_join(symbols, " ").alias("symbols"))


def edited_files(patch: Column) -> Column:
    """DX01. Different files of a unified diff's +++ lines, without a/ or b/ and deletions."""
    raw = F.transform(all_of(patch, r"(?m)^\+\+\+ ([^\t\r\n]*)", 1), lambda x: F.regexp_replace(F.trim(x), "^[ab]/", ""))
    return F.array_distinct(F.filter(raw, lambda x: (x != "") & (x != "/dev/null")))


@query(
    r"""WITH x AS (SELECT o_orderkey, '--- a/f' || o_custkey || '.py' || chr(10) || '+++ b/f' || o_custkey || '.py' || chr(10) || '@@ -1 +1 @@ def g' || chr(10) || '+def h' || (o_orderkey % 7) || '():' || chr(10) || '-x' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '+++ /dev/null' ELSE '+++ b/z.py' END AS p FROM orders)
    SELECT o_orderkey, array_to_string(list_filter(list_transform(regexp_extract_all(p, '(?m)^\+\+\+ ([^\t\r\n]*)', 1), lambda f: regexp_replace(trim(f), '^[ab]/', '')), lambda f: f <> '/dev/null'), ' ') AS files,
    regexp_extract(p, '(?m)^\+\s*def ([A-Za-z0-9_]+)', 1) AS symbol, len(regexp_extract_all(p, '(?m)^\+[^+]')) AS added, len(regexp_extract_all(p, '(?m)^-[^-]')) AS removed FROM x""",
    covers=("DX01", "DX02", "DX05"),
)
def op_dx01_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    p = F.concat_ws("\n", F.concat(F.lit("--- a/f"), cust, F.lit(".py")), F.concat(F.lit("+++ b/f"), cust, F.lit(".py")), F.lit("@@ -1 +1 @@ def g"), F.concat(F.lit("+def h"), (key % 7).cast("string"), F.lit("():")), F.lit("-x"), F.when(key % 3 == 0, "+++ /dev/null").otherwise("+++ b/z.py"))
    x = Tables(spark, sf_dir).orders.select("o_orderkey", p.alias("p"))
    n = lambda r: F.size(all_of(F.col("p"), r)).cast("long")
    return x.select("o_orderkey", F.array_join(edited_files(F.col("p")), " ").alias("files"), F.regexp_extract("p", r"(?m)^\+\s*def ([A-Za-z0-9_]+)", 1).alias("symbol"), n(r"(?m)^\+[^+]").alias("added"), n(r"(?m)^-[^-]").alias("removed"))


@query(
    """WITH piv AS (SELECT DISTINCT l_orderkey AS run, l_partkey AS path FROM lineitem WHERE l_linenumber <= 3), c AS (SELECT l_orderkey AS run, l_partkey AS path, bool_or(l_returnflag = 'A') AS inspected, bool_or(l_returnflag = 'R') AS edited, bool_or(l_quantity > 45) AS ruled FROM lineitem GROUP BY 1, 2)
    SELECT run, path, CASE WHEN edited AND NOT inspected THEN 'edited_without_inspection' WHEN edited THEN 'edited' WHEN inspected AND ruled THEN 'ruled_out' WHEN inspected THEN 'inspected' ELSE 'ignored' END AS status FROM piv JOIN c USING (run, path)""",
    covers=("DX03", "DX04", "DX10"),
)
def op_dx04_pivot_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass by (run, file): what the calls did, then the first status that holds."""
    line, flag = Tables(spark, sf_dir).lineitem, F.col("l_returnflag")
    c = line.groupBy(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("path")).agg(F.bool_or(flag == "A").alias("inspected"), F.bool_or(flag == "R").alias("edited"), F.bool_or(F.col("l_quantity") > 45).alias("ruled"), F.bool_or(F.col("l_linenumber") <= 3).alias("pivot")).where("pivot")
    i, e = F.col("inspected"), F.col("edited")
    return c.select("run", "path", F.when(e & ~i, "edited_without_inspection").when(e, "edited").when(i & F.col("ruled"), "ruled_out").when(i, "inspected").otherwise("ignored").alias("status"))


@query(
    """WITH t AS (SELECT conv_id, turn, lower(split_part(text, ' ', 2)) AS leaf FROM conversations WHERE role = 'assistant'), p AS (SELECT conv_id, turn, lower(text) AS q FROM conversations)
    SELECT t.conv_id, t.turn, count(p.turn) AS mentions FROM t LEFT JOIN p ON p.conv_id = t.conv_id AND p.turn < t.turn AND contains(p.q, t.leaf) GROUP BY 1, 2""",
    covers=("DX06",),
)
def op_dx06_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier calls of the conversation that mention what a turn selects."""
    c = Tables(spark, sf_dir).conversations
    t = c.where("role = 'assistant'").select("conv_id", "turn", F.lower(F.split_part("text", F.lit(" "), F.lit(2))).alias("leaf"))
    p = c.select("conv_id", F.col("turn").alias("at"), F.lower("text").alias("q"))
    return t.join(p, (t["conv_id"] == p["conv_id"]) & (F.col("at") < F.col("turn")) & F.contains("q", F.col("leaf")), "left").groupBy(t["conv_id"], "turn").agg(F.count("at").alias("mentions"))


@query(
    """SELECT doc_id, left(sha256(doc_id::VARCHAR), 12) AS ref, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}' AS payload FROM documents""",
    covers=("TX56", "TX57", "SNK13"),
)
def op_tx56_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 hex digits name a payload; its JSON has sorted keys."""
    return Tables(spark, sf_dir).documents.select("doc_id", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 12).alias("ref"), F.to_json(F.struct("doc_id", "lang", "source")).alias("payload"))


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) SELECT doc_id, array_to_string(x[greatest(1, len(x) // 2 - 5):greatest(1, len(x) // 2 - 5) + 11], chr(10)) AS excerpt FROM l""",
    covers=("JN22", "PK09"),
)
def op_jn22_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 12 lines around an anchor line, here the middle one."""
    n = F.greatest(F.lit(1), F.floor(F.size("x") / 2).cast("int") - 5)
    return Tables(spark, sf_dir).documents.select("doc_id", F.split("text", "\n").alias("x")).select("doc_id", F.array_join(F.slice("x", n, F.lit(12)), "\n").alias("excerpt"))


@query(
    r"""WITH x AS (SELECT p_partkey, 'use ' || p_name || CASE (p_partkey % 3)::INT WHEN 0 THEN ' rather than ' WHEN 1 THEN ' instead of ' ELSE ' and ' END || p_brand || ', please' AS t FROM part)
    SELECT p_partkey, regexp_extract(t, '^(?:use )?(.*?) (?:rather than|instead of|other than) ', 1) AS positive, regexp_extract(t, '(?:rather than|instead of|other than) ([^,.;!?]*)', 1) AS excluded FROM x""",
    covers=("TX48", "TX49"),
)
def op_tx48_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred side and what it excludes, up to the next punctuation."""
    k = F.col("p_partkey") % 3
    cue = F.when(k == 0, " rather than ").when(k == 1, " instead of ").otherwise(" and ")
    t = F.concat(F.lit("use "), F.col("p_name"), cue, F.col("p_brand"), F.lit(", please"))
    return Tables(spark, sf_dir).part.select("p_partkey", F.regexp_extract(t, "^(?:use )?(.*?) (?:rather than|instead of|other than) ", 1).alias("positive"), F.regexp_extract(t, "(?:rather than|instead of|other than) ([^,.;!?]*)", 1).alias("excluded"))


# ---- concept owners and mechanism facts


@query(
    rf"""WITH q AS (SELECT DISTINCT CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS term FROM (SELECT unnest({T.TOKENIZE_SQL.format(c='text')}) AS w FROM benchmark WHERE item_id = 0) WHERE length(w) > 5),
    d AS (SELECT source, doc_id, list_distinct({T.TOKENIZE_SQL.format(c='text')}) AS t FROM documents), m AS (SELECT source, doc_id, term FROM d, q WHERE list_contains(t, term)),
    c AS (SELECT source, term FROM m GROUP BY 1, 2), n AS (SELECT count(DISTINCT source) AS n FROM documents), df AS (SELECT term, ln((n + 1) / (coalesce(k, 0) + 1)) AS idf FROM q LEFT JOIN (SELECT term, count(*) AS k FROM c GROUP BY 1) USING (term), n),
    tot AS (SELECT sum(idf) AS total FROM df), s AS (SELECT source, sum(idf) AS w FROM c JOIN df USING (term) GROUP BY 1), e AS (SELECT source, count(DISTINCT doc_id) AS defs FROM m GROUP BY 1), a AS (SELECT source, count(*) AS every FROM documents GROUP BY 1)
    SELECT source, round(0.6 * CASE WHEN total = 0 THEN 0 ELSE least(1, w / total) END + 0.2 * least(1, defs / 3) + 0.2 * least(1, defs / every), 4) AS score FROM s JOIN e USING (source) JOIN a USING (source), tot ORDER BY score DESC, source LIMIT 3""",
    covers=("GR16",),
)
def op_gr16_concept_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by how much of a question's weighed terms they cover, how often and how densely; idf is over sources."""
    t = Tables(spark, sf_dir)
    words = {w for r in t.benchmark.where("item_id = 0").select(T.tokenize(F.col("text")).alias("t")).limit(1).collect() for w in r[0] if len(w) > 5}
    terms = sorted({w[:-1] if w.endswith("s") and not w.endswith("ss") else w for w in words})
    wanted = F.array(*map(F.lit, terms))
    d = t.documents.select("source", F.array_intersect(T.tokenize(F.col("text")), wanted).alias("hit"))
    per = d.groupBy("source").agg(F.array_distinct(F.flatten(F.collect_set("hit"))).alias("covered"), F.count_if(F.size("hit") > 0).alias("defs"), F.count("*").alias("every"))
    stats = per.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("covered", w)).alias(f"d{k}") for k, w in enumerate(terms)])
    idf = [F.log((F.col("n") + 1) / (F.col(f"d{k}") + 1)) for k in range(len(terms))]
    weight = sum((F.when(F.array_contains("covered", w), x).otherwise(0.0) for w, x in zip(terms, idf, strict=True)), F.lit(0.0))
    total = sum(idf, F.lit(0.0))
    score = 0.6 * F.when(total == 0, 0.0).otherwise(F.least(F.lit(1.0), weight / total)) + 0.2 * F.least(F.lit(1.0), F.col("defs") / 3) + 0.2 * F.least(F.lit(1.0), F.col("defs") / F.col("every"))
    return per.where("defs > 0").crossJoin(F.broadcast(stats)).select("source", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "source").limit(3)


#: Fact kinds that a line of code shows, by pattern.
FACT_PATTERNS = [
    ("ordering", r"\bsorted\s*\(|\.sort\s*\("),
    ("min", r"\bmin\s*\("),
    ("max", r"\bmax\s*\("),
    ("first_item", r"\[\s*0\s*\]"),
    ("fallback", r"\bor\s+[A-Za-z_]|\bexcept\b"),
    ("cache_lookup", r"\bcache\b|\bmemo\b"),
    ("conditional", r"^\s*(?:el)?if\b"),
    ("attribute_return", r"^\s*return\s+self\.[A-Za-z_]"),
]


def blank_literals(code: str) -> str:
    """SRC19. Strings and comments as blanks of equal length; line ends stay."""
    out, k, n = list(code), 0, len(code)
    while k < n:
        if code[k] == "#":
            stop = code.find("\n", k)
            stop = n if stop < 0 else stop
        elif code[k] in "\"'":
            quote = code[k] * 3 if code.startswith(code[k] * 3, k) else code[k]
            stop = k + len(quote)
            while stop < n and not code.startswith(quote, stop) and not (len(quote) == 1 and code[stop] == "\n"):
                stop += 2 if code[stop] == "\\" else 1
            stop = min(n, stop + len(quote))
        else:
            k += 1
            continue
        out[k:stop] = [c if c == "\n" else " " for c in code[k:stop]]
        k = stop
    return "".join(out)


def mechanism_facts(body: str, most: int = 8) -> list[tuple[str, int]]:
    """SRC18. (kind, line) of the first lines that show each kind, at most ``most``."""
    import re

    found: dict[str, int] = {}
    for k, line in enumerate(blank_literals(body).split("\n")):
        for kind, pattern in FACT_PATTERNS:
            if kind not in found and re.search(pattern, line):
                found[kind] = k
    return sorted(found.items(), key=lambda x: (x[1], x[0]))[:most]


def parse_python(sources: DataFrame) -> DataFrame:
    """SRC08/SRC10/SRC13. Symbols, edges and errors of Python sources (path, code), a batch of files at a time.

    Rows: path, kind (function, class, method, import, call or error), name, parent, line. A
    file that doesn't parse gives one error row and none else.
    """

    def visit(node: ast.AST, parent: str, inside: bool) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside else "function"
                yield kind, child.name, parent, child.lineno
                yield from visit(child, f"{parent}.{child.name}" if parent else child.name, kind == "class")
                continue
            if isinstance(child, ast.Import):
                yield from (("import", a.name, parent, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                yield from (("import", f"{'.' * child.level}{child.module or ''}.{a.name}", parent, child.lineno) for a in child.names)
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    yield "call", name, parent, child.lineno
            yield from visit(child, parent, inside)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, code in zip(batch["path"], batch["code"], strict=True):
                try:
                    rows += [(path, *x) for x in visit(ast.parse(code or ""), "", False)]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, "error", type(e).__name__, "", getattr(e, "lineno", None) or 0))
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "parent", "line"])

    return sources.select("path", "code").mapInPandas(run, "path string, kind string, name string, parent string, line int")


@query(
    """SELECT 'm' || p_partkey || '.py' AS path, k.kind, CASE k.kind WHEN 'import' THEN 'os' WHEN 'class' THEN 'C' || p_size WHEN 'method' THEN 'run' ELSE 'helper' END AS name, CASE k.kind WHEN 'method' THEN 'C' || p_size WHEN 'call' THEN 'C' || p_size || '.run' ELSE '' END AS parent
    FROM part, (VALUES ('import'), ('class'), ('method'), ('call')) k(kind) WHERE p_partkey % 10 <> 0 UNION ALL SELECT 'm' || p_partkey || '.py', 'error', 'SyntaxError', '' FROM part WHERE p_partkey % 10 = 0""",
    covers=("SRC08", "SRC10", "SRC13", "EX01"),
)
def op_src10_parse_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("p_partkey") % 10 == 0, "def broken(:").otherwise(F.concat(F.lit("import os\nclass C"), F.col("p_size").cast("string"), F.lit(":\n    def run(self):\n        return helper(self)\n")))
    sources = Tables(spark, sf_dir).part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), code.alias("code"))
    return parse_python(spread(sources)).select("path", "kind", "name", "parent")


@query(
    """WITH p AS (SELECT p_partkey, string_split(regexp_replace('pkg/' || lower(p_brand) || '/m' || p_size || '.py', '[#\\s]', '', 'g'), '.')[1] AS m FROM part) SELECT replace(m, '/', '.') AS module, count(*) AS files, min(p_partkey) AS first_file, count(*) > 1 AS ambiguous FROM p GROUP BY 1""",
    covers=("SRC14",),
)
def op_src14_module_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.concat(F.lit("pkg/"), F.lower("p_brand"), F.lit("/m"), F.col("p_size").cast("string"), F.lit(".py")), r"[#\s]", "")
    module = F.replace(F.split(path, "\\.")[0], F.lit("/"), F.lit("."))
    return Tables(spark, sf_dir).part.groupBy(module.alias("module")).agg(F.count("*").alias("files"), F.min("p_partkey").alias("first_file"), (F.count("*") > 1).alias("ambiguous"))


@query(
    """WITH f AS (SELECT l_partkey AS owner, l_orderkey AS ord, CASE l_returnflag WHEN 'A' THEN 'ordering' WHEN 'R' THEN 'first_item' ELSE 'fallback' END AS kind, l_linestatus = 'F' AS bearing FROM lineitem), c AS (SELECT * FROM f WHERE kind IN ('ordering', 'first_item') AND bearing ORDER BY owner, ord, kind LIMIT 400),
    o AS (SELECT owner, kind, row_number() OVER (PARTITION BY owner ORDER BY ord, kind) AS k FROM c) SELECT owner, kind, CASE kind WHEN 'first_item' THEN 0.55 ELSE 0.2 END::DOUBLE AS strength FROM o WHERE k = 1 ORDER BY strength DESC, owner LIMIT 3""",
    covers=("GR17", "GR18"),
)
def op_gr17_operation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 facts that bear on a selection, the first of each owner, direct before partial, three."""
    flag = F.col("l_returnflag")
    f = Tables(spark, sf_dir).lineitem.select(F.col("l_partkey").alias("owner"), F.col("l_orderkey").alias("ord"), F.when(flag == "A", "ordering").when(flag == "R", "first_item").otherwise("fallback").alias("kind"), (F.col("l_linestatus") == "F").alias("bearing"))
    c = f.where(F.col("kind").isin("ordering", "first_item") & F.col("bearing")).orderBy("owner", "ord", "kind").limit(400)
    first = c.groupBy("owner").agg(F.min(F.struct("ord", "kind")).alias("f"))
    return first.select("owner", F.col("f.kind").alias("kind"), F.when(F.col("f.kind") == "first_item", 0.55).otherwise(0.2).alias("strength")).orderBy(F.desc("strength"), "owner").limit(3)


@query(
    """WITH a AS (SELECT o_orderkey AS id, o_custkey AS file, (o_orderkey % 40)::BIGINT AS line FROM orders), s AS (SELECT o_orderkey AS span_id, o_custkey AS file, (o_orderkey % 31)::BIGINT AS first, (o_orderkey % 31 + o_orderkey % 6)::BIGINT AS last FROM orders),
    i AS (SELECT id, arg_min(span_id, (last - first, span_id)) AS span_id FROM a JOIN s USING (file) WHERE line BETWEEN first AND last GROUP BY id) SELECT id AS anchor_id, span_id FROM i""",
    covers=("FLT21", "AN01"),
)
def op_flt21_enclosing_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's shortest enclosing span, by an equi join on bins."""
    from quernstone.operators.relational import enclosing

    o, k = Tables(spark, sf_dir).orders, F.col("o_orderkey")
    anchors = o.select(k.alias("anchor_id"), F.col("o_custkey").alias("file"), (k % 40).alias("line"))
    spans = o.select(k.alias("span_id"), F.col("o_custkey").alias("file"), (k % 31).alias("first"), (k % 31 + k % 6).alias("last"))
    return enclosing(anchors, spans, 8).where("exact").select("anchor_id", "span_id")
