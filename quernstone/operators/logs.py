"""Tool-call streams, test provenance, references by hash, sections under a budget, routes, literals in byte spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators.extract import all_of
from quernstone.plans.catalog import query
from quernstone.sources.tables import Tables

_EVENT = "type string, name string, content string, message struct<content: array<struct<type: string, name: string, id: string>>>"


def tool_calls(lines: DataFrame) -> DataFrame:
    """SRC20. stream, ordinal, name, output: tool calls of streams of JSON lines (stream, line_no, line), in order.

    Lines that aren't objects are skipped. A result goes to the last call before it, and
    only the first result of a call counts: a running maximum within the stream.
    """
    held = lines.where(F.trim("line").startswith("{")).select("stream", "line_no", F.from_json("line", _EVENT, {"mode": "PERMISSIVE"}).alias("e"))
    nested = F.when(F.col("e.type") == "assistant", F.filter(F.col("e.message.content"), lambda b: b["type"] == "tool_use"))
    names = F.when(F.col("e.type") == "tool_use", F.array("e.name")).otherwise(F.transform(nested, lambda b: b["name"]))
    calls = held.select("stream", "line_no", F.posexplode(names).alias("at", "name"), F.lit(None).cast("string").alias("output"), F.lit(True).alias("call"))
    results = held.where(F.col("e.type") == "tool_result").select("stream", "line_no", F.lit(0).alias("at"), F.lit(None).cast("string").alias("name"), F.coalesce("e.content", F.lit("")).alias("output"), F.lit(False).alias("call"))
    so_far = Window.partitionBy("stream").orderBy("line_no", "at").rowsBetween(Window.unboundedPreceding, 0)
    both = calls.unionByName(results).withColumn("ordinal", F.count_if("call").over(so_far))
    place = F.struct("line_no", "at")
    grouped = both.where("ordinal > 0").groupBy("stream", "ordinal")
    return grouped.agg(F.max("name").alias("name"), F.min_by("output", F.when(~F.col("call"), place)).alias("output"))


_STREAM = "CASE event_type WHEN 'click' THEN '{\"type\":\"assistant\",\"message\":{\"content\":[{\"type\":\"text\"},{\"type\":\"tool_use\",\"name\":\"read' || (event_id % 5) || '\"},{\"type\":\"tool_use\",\"name\":\"grep\"}]}}' WHEN 'view' THEN '{\"type\":\"tool_use\",\"name\":\"bash\"}' WHEN 'error' THEN '{\"type\":\"tool_result\",\"content\":\"out' || event_id || '\"}' WHEN 'signup' THEN 'not json {' ELSE '[1, 2]' END"


@query(
    f"""WITH l AS (SELECT user_id AS stream, event_id AS line_no, event_type, event_id FROM events),
    c AS (SELECT stream, line_no, 0 AS pos, 'bash' AS name FROM l WHERE event_type = 'view' UNION ALL SELECT stream, line_no, 0, 'read' || (event_id % 5) FROM l WHERE event_type = 'click' UNION ALL SELECT stream, line_no, 1, 'grep' FROM l WHERE event_type = 'click'),
    o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY line_no, pos) AS ordinal, lead(line_no) OVER (PARTITION BY stream ORDER BY line_no, pos) AS next, lead(pos) OVER (PARTITION BY stream ORDER BY line_no, pos) AS next_pos FROM c)
    SELECT o.stream, o.ordinal, o.name, (SELECT 'out' || min(r.event_id) FROM l r WHERE r.event_type = 'error' AND r.stream = o.stream AND r.line_no > o.line_no AND (o.next IS NULL OR r.line_no < o.next)) AS output FROM o""",
    covers=("SRC20",),
)
def op_src20_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the lines of a stream, with lines that are no JSON or no object."""
    e = Tables(spark, sf_dir).events
    return tool_calls(e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("line_no"), F.expr(_STREAM).alias("line")))


def test_provenance(injected: Column, exposed: Column, searched: Column, read: Column, shown: Column, explored: Column, selected: Column) -> Column:
    """DX07. Where the name of a selected test came from.

    ``exposed`` is null where it isn't known what the prompt showed. Found by itself only
    with a search and then a read or an output that shows it.
    """
    strong = searched & (read | shown)
    hidden = F.when(strong & exposed.isNotNull(), "agent_discovered_hidden_match").when(strong | exposed.isNotNull(), "ambiguous").otherwise("injected_metadata")
    own = F.when(strong, "agent_discovered").when(searched | read | shown | explored, "ambiguous").otherwise("unknown")
    return F.when(~selected, "unknown").when(F.coalesce(exposed, F.lit(False)), "injected_metadata").when(injected, hidden).otherwise(own)


def outcome_mismatch(success: Column, status: Column) -> Column:
    """DX08. The tool said it went well and the output says it didn't."""
    return F.coalesce(success, F.lit(False)) & status.isin("failed", "error", "failed_or_error")


@query(
    """WITH u AS (SELECT user_id, bool_or(event_type = 'click' AND value > 40) AS searched, bool_or(event_type = 'view' AND value > 45) AS read, bool_or(event_type = 'purchase' AND value > 48) AS shown, count(*) > 20 AS explored,
      user_id % 3 = 0 AS injected, CASE WHEN user_id % 4 > 0 THEN user_id % 8 = 3 END AS exposed, user_id % 11 > 0 AS selected, CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS ok, ['passed', 'failed', 'error', 'failed_or_error', 'unknown'][(user_id % 7) % 5 + 1] AS status FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN NOT selected THEN 'unknown' WHEN exposed THEN 'injected_metadata' WHEN injected THEN CASE WHEN searched AND (read OR shown) AND exposed IS NOT NULL THEN 'agent_discovered_hidden_match' WHEN (searched AND (read OR shown)) OR exposed IS NOT NULL THEN 'ambiguous' ELSE 'injected_metadata' END
      WHEN searched AND (read OR shown) THEN 'agent_discovered' WHEN searched OR read OR shown OR explored THEN 'ambiguous' ELSE 'unknown' END AS provenance, coalesce(ok, false) AND status IN ('failed', 'error', 'failed_or_error') AS mismatch FROM u""",
    covers=("DX07", "DX08"),
)
def op_dx07_test_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as what was done before a test ran."""
    k, v = F.col("user_id"), F.col("value")
    saw = lambda kind, least: F.max((F.col("event_type") == kind) & (v > least))
    u = Tables(spark, sf_dir).events.groupBy("user_id").agg(saw("click", 40).alias("searched"), saw("view", 45).alias("read"), saw("purchase", 48).alias("shown"), (F.count("*") > 20).alias("explored"))
    found = test_provenance(k % 3 == 0, F.when(k % 4 > 0, k % 8 == 3), F.col("searched"), F.col("read"), F.col("shown"), F.col("explored"), k % 11 > 0)
    status = F.get(F.array(*map(F.lit, ("passed", "failed", "error", "failed_or_error", "unknown"))), ((k % 7) % 5).cast("int"))
    ok = F.when(k % 5 == 1, False).when(k % 5 > 1, True)
    return u.select("user_id", found.alias("provenance"), outcome_mismatch(ok, status).alias("mismatch"))


def resolve_references(wanted: DataFrame, memory: DataFrame, stored: DataFrame, gone: DataFrame) -> DataFrame:
    """PK06. hash, source, body, reason: exact lookups in two tiers.

    The stored entry wins where both have one and they differ; of what neither has, a
    tombstone tells expired from unknown. All joins are on the hash.
    """
    m = memory.select("hash", F.col("body").alias("m"))
    s = stored.select("hash", F.col("body").alias("s"))
    held = wanted.join(m, "hash", "left").join(s, "hash", "left").join(gone.select("hash", F.lit(True).alias("gone")).distinct(), "hash", "left")
    stored_wins = F.col("s").isNotNull() & (F.col("m").isNull() | (F.col("m") != F.col("s")))
    source = F.when(stored_wins, "persistent").when(F.col("m").isNotNull(), "process")
    reason = F.when(source.isNull(), F.when(F.col("gone"), "expired").otherwise("unknown_hash"))
    return held.select("hash", source.alias("source"), F.when(stored_wins, F.col("s")).otherwise(F.col("m")).alias("body"), reason.alias("reason"))


@query(
    """WITH w AS (SELECT DISTINCT left(sha256(p_name || (p_partkey % 60)), 12) AS hash, p_name || (p_partkey % 60) AS body FROM part), h AS (SELECT hash, body, strlen(body) + ascii(hash) AS k FROM w)
    SELECT hash, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 AND k % 5 = 0 THEN 'persistent' ELSE 'process' END WHEN k % 2 = 0 THEN 'persistent' END AS source,
      CASE WHEN k % 2 = 0 AND (k % 3 > 0 OR k % 5 = 0) THEN body || CASE WHEN k % 5 = 0 THEN '!' ELSE '' END WHEN k % 3 = 0 THEN body END AS body, CASE WHEN k % 2 = 1 AND k % 3 > 0 THEN CASE WHEN k % 7 < 3 THEN 'expired' ELSE 'unknown_hash' END END AS reason FROM h""",
    covers=("PK06",),
)
def op_pk06_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat("p_name", (F.col("p_partkey") % 60).cast("string"))
    h = Tables(spark, sf_dir).part.select(F.substring(F.sha2(body, 256), 1, 12).alias("hash"), body.alias("body")).distinct().withColumn("k", F.octet_length("body") + F.ascii("hash"))
    stored = h.where("k % 2 = 0").select("hash", F.concat("body", F.when(F.col("k") % 5 == 0, "!").otherwise("")).alias("body"))
    return resolve_references(h.select("hash"), h.where("k % 3 = 0"), stored, h.where("k % 7 < 3"))


#: Which sections go first; the others stay.
DROPPED_FIRST = ("diagnostic", "optional", "important")


def sections_kept(sections: DataFrame, budget: int) -> DataFrame:
    """BU05. Adds kept, marker: whole sections go, the least class first and the largest first in it, until the text fits.

    ``sections`` has text_id, start, name, priority, chars. What a section saves is its
    length less that of the marker left for it; one goes if what went before it wasn't enough.
    """
    rank = F.array_position(F.array(*map(F.lit, DROPPED_FIRST)), F.col("priority"))
    marker = F.concat(F.lit("[omitted "), "priority", F.lit(" section: "), "name", F.lit(" ("), F.col("chars").cast("string"), F.lit(" chars)]\n"))
    whole = Window.partitionBy("text_id")
    order = whole.orderBy(F.when(rank > 0, rank).otherwise(9), F.desc("chars"), "start")
    held = sections.withColumn("marker", marker).withColumn("total", F.sum("chars").over(whole))
    saved = F.coalesce(F.sum(F.when(rank > 0, F.col("chars") - F.length("marker")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("kept", (rank == 0) | (F.col("total") - saved <= budget)).drop("total")


def heading_sections(texts: DataFrame) -> DataFrame:
    """text_id, start, name, priority, chars of texts (text_id, text): a section begins at the start and at each line; the last word of its first line names it."""
    lines = texts.select("text_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    before = Window.partitionBy("text_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    kinds = F.array(*map(F.lit, ("essential", "important", "optional", "diagnostic")))
    return lines.select("text_id", start.alias("start"), F.substring("line", 1, 12).alias("name"), F.get(kinds, F.length("line") % 4).alias("priority"), (F.length("line") + 1).alias("chars"))


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), s AS (SELECT doc_id AS text_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
    x AS (SELECT text_id, pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY text_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, left(line, 12) AS name, length(line) + 1 AS chars, length(line) % 4 AS p FROM s),
    m AS (SELECT *, ['essential', 'important', 'optional', 'diagnostic'][p + 1] AS priority, sum(chars) OVER (PARTITION BY text_id) AS total FROM x),
    k AS (SELECT *, chars - length('[omitted ' || priority || ' section: ' || name || ' (' || chars || ' chars)]' || chr(10)) AS gain FROM m),
    g AS (SELECT *, coalesce(sum(CASE WHEN p > 0 THEN gain ELSE 0 END) OVER (PARTITION BY text_id ORDER BY CASE WHEN p > 0 THEN 4 - p ELSE 9 END, chars DESC, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved FROM k)
    SELECT text_id, count(*) AS sections, count(*) FILTER (WHERE p > 0 AND total - saved > 1500) AS dropped, sum(CASE WHEN p > 0 AND total - saved > 1500 THEN chars - gain ELSE chars END)::BIGINT AS chars FROM g GROUP BY text_id""",
    covers=("BU05",),
)
def op_bu05_drop_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as sections, under a budget of 1500 characters."""
    docs = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("text_id"), "text")
    s = sections_kept(heading_sections(docs), 1500)
    left = F.when(F.col("kept"), F.col("chars")).otherwise(F.length("marker"))
    return s.groupBy("text_id").agg(F.count("*").alias("sections"), F.count_if(~F.col("kept")).alias("dropped"), F.sum(left).alias("chars"))


def routed(requests: DataFrame, members: DataFrame) -> DataFrame:
    """WS08. request_id, outcome, member, source: the one member that a request's selectors name.

    The first selector that is set decides: worktree, repository, path, alias or display
    name; a working directory only if a member holds it, else the default. A repository or
    a display name that several members have is ambiguous. Paths go to the deepest root
    that holds them: an equi join on each of the path's ancestors.
    """
    one = members.groupBy
    r = requests
    work = members.select(F.col("worktree_id").alias("wt"), F.col("alias").alias("by_wt"))
    repo = one("repository_id").agg(F.count("*").alias("n_repo"), F.min("alias").alias("by_repo")).withColumnRenamed("repository_id", "rp")
    name = one("display_name").agg(F.count("*").alias("n_name"), F.min("alias").alias("by_name")).withColumnRenamed("display_name", "dn")
    alias = members.select(F.col("alias").alias("al"))
    roots = members.select(F.col("root").alias("folder"), F.col("alias").alias("holder"))

    def deepest(column: str, out: str) -> DataFrame:
        parts = F.split(F.col(column), "/")
        folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        held = r.where(F.col(column).isNotNull()).select("request_id", F.explode(folders).alias("folder")).join(roots, "folder")
        return held.groupBy("request_id").agg(F.max_by("holder", F.length("folder")).alias(out))

    default = members.where("is_default").select(F.col("alias").alias("default_alias"))
    j = r.join(work, r["worktree_id"] == work["wt"], "left").join(repo, r["repository_id"] == repo["rp"], "left").join(name, r["alias"] == name["dn"], "left").join(alias, r["alias"] == alias["al"], "left")
    j = j.join(deepest("path", "by_path"), "request_id", "left").join(deepest("cwd", "by_cwd"), "request_id", "left").crossJoin(F.broadcast(default.agg(F.min("default_alias").alias("default_alias"))))  # one row
    c = F.col
    found = lambda member, source: F.when(member.isNotNull(), F.struct(F.lit("routed").alias("outcome"), member.alias("member"), F.lit(source).alias("source"))).otherwise(F.struct(F.lit("unknown").alias("outcome"), F.lit(None).cast("string").alias("member"), F.lit(source).alias("source")))
    many = lambda n, ok, source: F.when(n > 1, F.struct(F.lit("ambiguous").alias("outcome"), F.lit(None).cast("string").alias("member"), F.lit(source).alias("source"))).otherwise(ok)
    route = (
        F.when(c("worktree_id").isNotNull(), found(c("by_wt"), "worktree"))
        .when(c("repository_id").isNotNull(), many(c("n_repo"), found(c("by_repo"), "repository"), "repository"))
        .when(c("path").isNotNull(), found(c("by_path"), "path"))
        .when(c("alias").isNotNull(), F.when(c("al").isNotNull(), found(c("al"), "alias")).otherwise(many(c("n_name"), found(c("by_name"), "display_name"), "display_name")))
        .when(c("by_cwd").isNotNull(), found(c("by_cwd"), "cwd")).otherwise(found(c("default_alias"), "default"))
    )
    return j.select("request_id", route.alias("r")).select("request_id", "r.*")


@query(
    """WITH m AS (SELECT s_suppkey AS k, 'm' || s_suppkey AS alias, 'w' || s_suppkey AS worktree_id, 'r' || (s_suppkey % 60) AS repository_id, 'name' || (s_suppkey % 40) AS display_name, '/ws/n' || (s_nationkey % 5) || CASE WHEN s_suppkey % 2 = 0 THEN '/s' || s_suppkey ELSE '/t/' || s_suppkey END AS root FROM supplier),
    q AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'w' || (c_custkey % 120) END AS wt, CASE WHEN c_custkey % 7 = 1 THEN 'r' || (c_custkey % 70) END AS rp, CASE WHEN c_custkey % 7 = 2 THEN '/ws/n' || (c_nationkey % 5) || '/s' || (c_custkey % 100) || '/src/a.py' END AS path,
      CASE c_custkey % 7 WHEN 3 THEN 'm' || (c_custkey % 130) WHEN 4 THEN 'name' || (c_custkey % 50) END AS al, CASE WHEN c_custkey % 7 = 5 THEN '/ws/n' || (c_nationkey % 5) || '/t/' || (c_custkey % 100) END AS cwd FROM customer),
    x AS (SELECT q.*, (SELECT alias FROM m WHERE m.worktree_id = q.wt) AS by_wt, (SELECT count(*) FROM m WHERE m.repository_id = q.rp) AS n_rp, (SELECT min(alias) FROM m WHERE m.repository_id = q.rp) AS by_rp, (SELECT arg_max(alias, length(root)) FROM m WHERE q.path = root OR starts_with(q.path, root || '/')) AS by_path,
      (SELECT alias FROM m WHERE m.alias = q.al) AS by_al, (SELECT count(*) FROM m WHERE m.display_name = q.al) AS n_dn, (SELECT min(alias) FROM m WHERE m.display_name = q.al) AS by_dn, (SELECT arg_max(alias, length(root)) FROM m WHERE q.cwd = root OR starts_with(q.cwd, root || '/')) AS by_cwd FROM q),
    r AS (SELECT id, CASE WHEN wt IS NOT NULL THEN 'worktree' WHEN rp IS NOT NULL THEN 'repository' WHEN path IS NOT NULL THEN 'path' WHEN al IS NOT NULL THEN CASE WHEN by_al IS NOT NULL THEN 'alias' ELSE 'display_name' END WHEN by_cwd IS NOT NULL THEN 'cwd' ELSE 'default' END AS source,
      CASE WHEN wt IS NOT NULL THEN by_wt WHEN rp IS NOT NULL THEN CASE WHEN n_rp > 1 THEN '?' ELSE by_rp END WHEN path IS NOT NULL THEN by_path WHEN al IS NOT NULL THEN CASE WHEN by_al IS NOT NULL THEN by_al WHEN n_dn > 1 THEN '?' ELSE by_dn END WHEN by_cwd IS NOT NULL THEN by_cwd ELSE 'm0' END AS member FROM x)
    SELECT id AS request_id, CASE WHEN member = '?' THEN 'ambiguous' WHEN member IS NULL THEN 'unknown' ELSE 'routed' END AS outcome, CASE WHEN member <> '?' THEN member END AS member, source FROM r""",
    covers=("WS08",),
)
def op_ws08_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are members, customers requests with one selector or none."""
    t = Tables(spark, sf_dir)
    k, s = F.col("s_suppkey"), lambda c: c.cast("string")
    named = lambda tag, c: F.concat(F.lit(tag), s(c))
    root = F.concat(named("/ws/n", F.col("s_nationkey") % 5), F.when(k % 2 == 0, named("/s", k)).otherwise(named("/t/", k)))
    members = t.supplier.select(named("m", k).alias("alias"), named("w", k).alias("worktree_id"), named("r", k % 60).alias("repository_id"), named("name", k % 40).alias("display_name"), root.alias("root"), (k == 0).alias("is_default"))
    c, nation = F.col("c_custkey"), named("/ws/n", F.col("c_nationkey") % 5)
    requests = t.customer.select(
        c.alias("request_id"), F.when(c % 7 == 0, named("w", c % 120)).alias("worktree_id"), F.when(c % 7 == 1, named("r", c % 70)).alias("repository_id"),
        F.when(c % 7 == 2, F.concat(nation, named("/s", c % 100), F.lit("/src/a.py"))).alias("path"), F.when(c % 7 == 3, named("m", c % 130)).when(c % 7 == 4, named("name", c % 50)).alias("alias"), F.when(c % 7 == 5, F.concat(nation, named("/t/", c % 100))).alias("cwd"),
    )
    return routed(requests, members)


#: Fixed pattern and values: quoted strings, and what makes one a message.
QUOTED = r"""'([^'\\\n]*)'|"([^"\\\n]*)\""""
MESSAGE_CHARS, MESSAGE_WORDS, MESSAGE_LETTERS = 12, 2, 0.6


def body_literals(body: Column) -> Column:
    """SRC17. Distinctive literals of a symbol's body, lower-case: constants of capitals, and quoted messages of several words."""
    from quernstone.operators.extract import SCREAMING

    quoted = F.transform(all_of(body, QUOTED), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    message = lambda m: (F.length(m) >= MESSAGE_CHARS) & (F.size(F.filter(F.split(m, r"\s+"), lambda w: w != "")) >= MESSAGE_WORDS) & (F.length(F.regexp_replace(m, "[^A-Za-z]", "")) >= MESSAGE_LETTERS * F.length(m))
    return F.transform(F.array_distinct(F.concat(all_of(body, SCREAMING), F.filter(quoted, message))), F.lower)


def symbol_literals(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """SRC17. symbol_id, fq_name, literals of symbols (path, start_byte, end_byte) in files (path, content): bodies are cut by bytes."""
    raw = F.encode("content", "UTF-8")
    body = F.decode(F.substring(raw, F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte")), "UTF-8")
    return symbols.join(files, "path").select("symbol_id", "fq_name", body_literals(body).alias("literals")).where(F.size("literals") > 0)


MOST_LITERAL_HITS = 10


def search_literals(literals: DataFrame, terms: list[str]) -> DataFrame:
    """TX08. The first symbols, by name and id, whose literals have all the terms as words."""
    words = T.tokenize(F.array_join("literals", " "))
    return literals.where(F.forall(F.array(*map(F.lit, terms)), lambda w: F.array_contains(words, w))).orderBy("fq_name", "symbol_id").limit(MOST_LITERAL_HITS)


_SOURCE = "'# é ü' || chr(10) || 'def f(): raise E(\"the ' || p_name || ' could not be opened\") # MAX_' || upper(split_part(p_name, ' ', 1)) || ' ''ab'' ''12 34 56 78 9'''"


@query(
    f"""WITH s AS (SELECT p_partkey AS symbol_id, p_name || p_partkey AS fq_name, p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'max_' || split_part(p_name, ' ', 1) END AS c, 'the ' || p_name || ' could not be opened' AS m FROM part)
    SELECT symbol_id, fq_name, CASE WHEN c = '' THEN m ELSE c || '|' || m END AS literals, row_number() OVER (ORDER BY fq_name, symbol_id) AS hit FROM s WHERE symbol_id IN (SELECT symbol_id FROM s WHERE contains(m, ' ring ') AND (contains(m, 'red ') OR c = 'max_red') ORDER BY fq_name, symbol_id LIMIT 10)""",
    covers=("SRC17", "TX08"),
)
def op_src17_symbol_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file a part with letters of two bytes before the body; a third of the spans end before the comment. Terms: red, ring."""
    part = Tables(spark, sf_dir).part
    source = F.expr(_SOURCE)
    files = part.select(F.col("p_partkey").cast("string").alias("path"), source.alias("content"))
    start = F.lit(8)  # the first line has 8 bytes, 6 characters
    stop = F.octet_length(source) - F.when(F.col("p_partkey") % 3 == 0, F.octet_length(F.element_at(F.split(source, " # "), -1))).otherwise(0)
    symbols = part.select("p_partkey", F.col("p_partkey").alias("symbol_id"), F.col("p_partkey").cast("string").alias("path"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("fq_name"), start.alias("start_byte"), stop.alias("end_byte"))
    found = search_literals(symbol_literals(symbols, files), ["red", "ring"])
    return found.select("symbol_id", "fq_name", F.array_join("literals", "|").alias("literals"), F.row_number().over(Window.orderBy("fq_name", "symbol_id")).cast("long").alias("hit"))
