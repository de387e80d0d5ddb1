"""Event logs, sessions, tool calls and memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.plans.catalog import query
from quernstone.sources.tables import CHANGES_SQL, Tables

THRASH_CHANGES, THRASH_MINUTES = 5, 10
NUDGE_FIRST, NUDGE_EVERY = 3, 5
BASH_LOOP, REPEATED_SEARCH = 8, 5


def thrashing(changes: DataFrame, least: int = THRASH_CHANGES, minutes: int = THRASH_MINUTES) -> DataFrame:
    """WN02/SM05. The first time at which a file has ``least`` changes within ``minutes``, both ends included.

    (file_path, first_ts, change_count, bucket): bucket is the tumbling window that repeats of
    the alert are deduplicated by.
    """
    span = F.unix_micros(F.col("ts").cast("timestamp"))
    own = Window.partitionBy("file_path").orderBy("at").rangeBetween(Window.currentRow, minutes * 60_000_000)
    seen = changes.select("file_path", "ts", span.alias("at")).withColumn("n", F.count("*").over(own))
    first = seen.where(F.col("n") >= least).groupBy("file_path").agg(F.min(F.struct("at", F.col("ts"), "n")).alias("w"))
    width = minutes * 60_000_000
    return first.select("file_path", F.col("w.ts").alias("first_ts"), F.col("w.n").alias("change_count"), (F.floor(F.col("w.at") / width)).alias("bucket"))


@query(
    f"""WITH {CHANGES_SQL.replace("event_type || '/' || user_id", "'u/' || user_id")}, n AS (SELECT file_path, ts, count(*) OVER (PARTITION BY file_path ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 600 MINUTE FOLLOWING) AS n FROM changes)
    SELECT file_path, min(ts) AS first_ts, arg_min(n, ts) AS change_count, (epoch_us(min(ts)) // 36000000000)::BIGINT AS bucket FROM n WHERE n >= 5 GROUP BY file_path""",
    covers=("WN02", "SM05"),
)
def op_wn02_thrashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for files, so keys grow with the log; five changes within ten hours."""
    return thrashing(Tables(spark, sf_dir).changes().withColumn("file_path", F.concat(F.lit("u/"), F.col("user_id").cast("string"))), minutes=600)


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """SM02. Bursts of a user's events with no pause over the gap: (user_id, started, ended, n_events, kinds)."""
    w = F.session_window("ts", f"{gap_minutes} minutes")
    g = events.groupBy("user_id", w.alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_events"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))
    return g.drop("w")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n_events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM s GROUP BY user_id, k""",
    covers=("SM02", "SM03"),
)
def op_sm02_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(Tables(spark, sf_dir).events)


@query(
    """WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
    SELECT user_id, last, now - last >= INTERVAL 2 HOUR AS eligible FROM l, n""",
    covers=("SM06",),
)
def op_sm06_inactive_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    return e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(now).select("user_id", "last", (F.col("now") - F.col("last") >= F.expr("INTERVAL 2 HOURS")).alias("eligible"))


@query(
    """WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts, sum(n)::BIGINT AS total FROM k GROUP BY user_id""",
    covers=("SM07", "AG12"),
)
def op_sm07_compress_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = Tables(spark, sf_dir).events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    pairs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat_ws("=", x["event_type"], x["n"].cast("string"))), ",")
    return k.groupBy("user_id").agg(pairs.alias("counts"), F.sum("n").alias("total"))


@query(
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('view', 'click')),
    d AS (SELECT user_id, count(*) AS durable FROM events WHERE event_type = 'purchase' AND event_id % 40 = 0 GROUP BY user_id)
    SELECT r.user_id, r.event_id, r.k AS calls FROM r LEFT JOIN d USING (user_id) WHERE coalesce(durable, 0) = 0 AND r.k >= 3 AND (r.k - 3) % 5 = 0""",
    covers=("SM09",),
)
def op_sm09_nudges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires at the third call of a session without a lasting observation, then at each fifth."""
    e = Tables(spark, sf_dir).events
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    calls = e.where(F.col("event_type").isin("view", "click")).withColumn("calls", F.row_number().over(own))
    lasting = e.where("event_type = 'purchase' AND event_id % 40 = 0").select("user_id").distinct()
    due = (F.col("calls") >= NUDGE_FIRST) & ((F.col("calls") - NUDGE_FIRST) % NUDGE_EVERY == 0)
    return calls.where(due).join(lasting, "user_id", "left_anti").select("user_id", "event_id", F.col("calls").cast("long").alias("calls"))


@query(
    """WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id, CASE WHEN now - ts > INTERVAL 1 DAY THEN 'expired' ELSE 'live' END AS state FROM events, n""",
    covers=("SM11", "WN08"),
)
def op_sm11_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("event_id", F.when(F.col("now") - F.col("ts") > F.expr("INTERVAL 1 DAY"), "expired").otherwise("live").alias("state"))


@query(
    """SELECT event_type, value > 50 AS large, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, sha256(event_type || '|' || CASE WHEN value > 50 THEN 'true' ELSE 'false' END) AS signature FROM events GROUP BY 1, 2 HAVING count(*) >= 3""",
    covers=("AG13", "ME07", "ME08", "TX58"),
)
def op_ag13_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = F.col("value") > 50
    signature = F.sha2(F.concat_ws("|", "event_type", F.col("large").cast("string")), 256)
    g = Tables(spark, sf_dir).events.groupBy("event_type", large.alias("large")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.where("n >= 3").withColumn("signature", signature)


@query(
    """SELECT event_type AS scope, count(DISTINCT user_id) AS evidence, count(DISTINCT user_id) >= 3 AS candidate, CASE WHEN count(DISTINCT user_id) >= 10 THEN 'high' WHEN count(DISTINCT user_id) >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM events GROUP BY 1""",
    covers=("AG14", "RU01"),
)
def op_ag14_rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Tables(spark, sf_dir).events.groupBy(F.col("event_type").alias("scope")).agg(F.countDistinct("user_id").alias("evidence"))
    n = F.col("evidence")
    return g.select("scope", "evidence", (n >= 3).alias("candidate"), F.when(n >= 10, "high").when(n >= 5, "medium").otherwise("low").alias("confidence"))


# ---- tool calls


def tool_calls(conversations: DataFrame) -> DataFrame:
    """SRC20 over turns: (conv_id, idx, tool, category, query); a turn's first word stands for its query."""
    category = F.when(F.col("role") == "user", "search").when(F.col("role") == "system", "read").otherwise("edit")
    return conversations.select("conv_id", F.col("turn").alias("idx"), F.col("role").alias("tool"), category.alias("category"), F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("query"))


_CALLS = "calls AS (SELECT conv_id, turn AS idx, role AS tool, CASE role WHEN 'user' THEN 'search' WHEN 'system' THEN 'read' ELSE 'edit' END AS category, lower(split_part(text, ' ', 1)) AS query FROM conversations)"


@query(
    f"""WITH {_CALLS}, r AS (SELECT conv_id, max(n) AS top FROM (SELECT conv_id, query, count(*) AS n FROM calls WHERE category = 'search' GROUP BY 1, 2) GROUP BY 1)
    SELECT conv_id, count(*) AS total, count(*) FILTER (category = 'search') AS searches, count(*) FILTER (category = 'edit') AS edits, count(DISTINCT query) AS queries,
    count(*) >= 8 AS long_loop, count(*) FILTER (category = 'search') >= 5 OR coalesce(max(top), 0) >= 2 AS repeated_search FROM calls LEFT JOIN r USING (conv_id) GROUP BY conv_id""",
    covers=("AG16",),
)
def op_ag16_tool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = tool_calls(Tables(spark, sf_dir).conversations)
    n = lambda c: F.count_if(F.col("category") == c)
    per = calls.groupBy("conv_id", "query").agg(F.count("*").alias("n"), n("search").alias("s"), n("edit").alias("e"))
    return per.groupBy("conv_id").agg(F.sum("n").alias("total"), F.sum("s").alias("searches"), F.sum("e").alias("edits"), F.count_if(F.col("query").isNotNull()).alias("queries"), (F.sum("n") >= BASH_LOOP).alias("long_loop"), ((F.sum("s") >= REPEATED_SEARCH) | (F.max("s") >= 2)).alias("repeated_search"))


@query(
    f"""WITH {_CALLS}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, query ORDER BY idx) AS occ FROM calls)
    SELECT conv_id, count(*) FILTER (occ >= 2) AS repeats, min(idx) FILTER (category = 'edit') AS first_edit, count(*) FILTER (category = 'search') AS searches,
    CASE WHEN count(*) >= 12 THEN 'high' WHEN count(*) >= 4 THEN 'medium' ELSE 'low' END AS risk FROM k GROUP BY conv_id""",
    covers=("AG17", "WN04"),
)
def op_ag17_turn_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("conv_id", "query").orderBy("idx")
    k = tool_calls(Tables(spark, sf_dir).conversations).withColumn("occ", F.row_number().over(own))
    risk = F.when(F.count("*") >= 12, "high").when(F.count("*") >= 4, "medium").otherwise("low")
    return k.groupBy("conv_id").agg(F.count_if(F.col("occ") >= 2).alias("repeats"), F.min(F.when(F.col("category") == "edit", F.col("idx"))).alias("first_edit"), F.count_if(F.col("category") == "search").alias("searches"), risk.alias("risk"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_valid(props)", covers=("SRC21",))
def op_src20_parse_json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).events.select("event_id", F.from_json("props", "k long").alias("p")).where("p IS NOT NULL").select("event_id", "p.k")


def attach_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """SRC21. Results attach by id, else to the latest call opened before them: an as-of join by one window scan."""
    own = Window.partitionBy("log").orderBy("idx", "is_result")
    rows = calls.select("log", "idx", "call_id", F.lit(0).alias("is_result"), F.lit(None).cast("string").alias("output")).unionByName(results.select("log", "idx", "call_id", F.lit(1).alias("is_result"), "output"))
    latest = F.last(F.when(F.col("is_result") == 0, F.col("call_id")), ignorenulls=True).over(own)
    known = calls.select("log", "call_id", F.lit(True).alias("known")).distinct()
    return rows.withColumn("latest", latest).where("is_result = 1").join(known, ["log", "call_id"], "left").select("log", "idx", F.when(F.col("known"), F.col("call_id")).otherwise(F.col("latest")).alias("call_id"), "output")


@query(
    """WITH c AS (SELECT conv_id AS log, turn AS idx, conv_id || '-' || turn AS call_id FROM conversations WHERE role = 'user'), r AS (SELECT conv_id AS log, turn AS idx, text AS output FROM conversations WHERE role = 'assistant')
    SELECT r.log, r.idx, (SELECT arg_max(c.call_id, c.idx) FROM c WHERE c.log = r.log AND c.idx < r.idx) AS call_id FROM r""",
    covers=("SRC21",),
)
def op_src21_as_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).conversations
    calls = c.where("role = 'user'").select(F.col("conv_id").alias("log"), F.col("turn").alias("idx"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("call_id"))
    results = c.where("role = 'assistant'").select(F.col("conv_id").alias("log"), F.col("turn").alias("idx"), F.lit(None).cast("string").alias("call_id"), F.col("text").alias("output"))
    return attach_results(calls, results).select("log", "idx", "call_id")


# ---- memories


MEMORY_WEIGHTS = {"summary_exact": 80, "summary_part": 32, "body_part": 16, "per_term": 6, "term_cap": 24, "stale": 30}


def memory_score(summary: Column, body: Column, q: str, stale: Column) -> Column:
    """ME02. Additive signals of one observation; stale ones lose 30."""
    w, terms = MEMORY_WEIGHTS, [t for t in q.split() if t]
    s, b = F.lower(summary), F.lower(body)
    hits = F.size(F.array_intersect(F.split(s, "[^a-z0-9]+"), F.array(*map(F.lit, terms))))
    return (
        F.when(s == q, w["summary_exact"]).when(s.contains(q), w["summary_part"]).otherwise(0)
        + F.when(b.contains(q), w["body_part"]).otherwise(0)
        + F.least(hits * w["per_term"], F.lit(w["term_cap"]))
        - F.when(stale, w["stale"]).otherwise(0)
    )


@query(
    """WITH o AS (SELECT p_partkey AS id, lower(p_name) AS s, lower(p_type) AS b, p_size < 5 AS stale FROM part),
    x AS (SELECT id, CASE WHEN s = 'a b' THEN 80 WHEN contains(s, 'a b') THEN 32 ELSE 0 END + CASE WHEN contains(b, 'a b') THEN 16 ELSE 0 END
    + least(len(list_intersect(string_split_regex(s, '[^a-z0-9]+'), ['small', 'ring'])) * 6, 24) - CASE WHEN stale THEN 30 ELSE 0 END AS score FROM o)
    SELECT id, score::BIGINT AS score FROM x WHERE score > 0 ORDER BY score DESC, id LIMIT 8""".replace("'a b'", "'small ring'"),
    covers=("ME01", "ME02", "TK12"),
)
def op_me01_search_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).part
    score = memory_score(F.col("p_name"), F.col("p_type"), "small ring", F.col("p_size") < 5)
    return p.select(F.col("p_partkey").alias("id"), score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(8)


@query(
    """SELECT event_type AS key, count(DISTINCT CASE WHEN value > 50 THEN 'high' ELSE 'low' END) AS variants FROM events GROUP BY 1 HAVING count(DISTINCT CASE WHEN value > 50 THEN 'high' ELSE 'low' END) >= 2""",
    covers=("ME09",),
)
def op_me09_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(F.col("value") > 50, "high").otherwise("low")
    return Tables(spark, sf_dir).events.groupBy(F.col("event_type").alias("key")).agg(F.countDistinct(found).alias("variants")).where("variants >= 2")


@query(
    """SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'session_unknown' WHEN event_type = 'error' THEN 'incompatible' WHEN value IS NULL THEN 'unverifiable' WHEN value > 90 THEN 'stale_scope' ELSE 'compatible' END AS state FROM events""",
    covers=("ME03",),
)
def op_me03_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("user_id") % 4 == 0, "session_unknown").when(F.col("event_type") == "error", "incompatible").when(F.col("value").isNull(), "unverifiable").when(F.col("value") > 90, "stale_scope").otherwise("compatible")
    return Tables(spark, sf_dir).events.select("event_id", state.alias("state"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT user_id, event_id, event_type FROM r WHERE k <= 4""",
    covers=("ME05",),
)
def op_me05_recent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return Tables(spark, sf_dir).events.withColumn("k", F.row_number().over(own)).where("k <= 4").select("user_id", "event_id", "event_type")


@query(
    """SELECT user_id, min(ts) AS started, max(ts) AS last_activity, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY user_id""",
    covers=("SNK10", "SNK11"),
)
def op_snk10_upsert_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of a session fold to its first start, last activity and latest status."""
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("last_activity"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n"))


@query(
    """SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1""",
    covers=("SNK09", "SNK12"),
)
def op_snk09_deduplicated_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first observation of each dedupe key stays."""
    e = Tables(spark, sf_dir).events
    first = e.groupBy("user_id", "event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return first.select(F.col("f.event_id").alias("event_id"))


