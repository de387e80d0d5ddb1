"""Claims of absence, recorded identities, freshness and guarded transitions of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.plans.catalog import query
from quernstone.sources.codebase import SYMBOLS_SQL, Codebase
from quernstone.sources.tables import Tables

#: Sources whose miss settles absence, and scopes from narrow to wide.
EXACT_SOURCES = ("path_membership", "symbol_exact_lookup")
SCOPES = ("member_local", "scanned_members", "enabled_members", "workspace")


def scope_width(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SCOPES)), c)


def negative_claim(capability: Column, considered: Column, answered: Column) -> Column:
    """WS04. What a miss proves: nothing, absence among those that answered, or absence."""
    return (
        F.when(~capability.isin(*EXACT_SOURCES) | (answered == 0), "not_observed")
        .when(answered == considered, "authoritative_absence")
        .otherwise("bounded_absence")
    )


def can_claim_absence(strength: Column, scope: Column, claimed: Column) -> Column:
    """WS05. A bounded absence reaches no further than the members that answered."""
    proven = F.when(strength == "authoritative_absence", scope_width(scope)).when(strength == "bounded_absence", scope_width(F.lit("scanned_members"))).otherwise(0)
    return scope_width(claimed) <= proven


@query(
    """WITH c AS (SELECT user_id, event_type, CASE event_type WHEN 'view' THEN 'path_membership' WHEN 'click' THEN 'symbol_exact_lookup' WHEN 'signup' THEN 'symbol_exact_lookup' ELSE 'ranked_retrieval' END AS capability,
      count(*) AS considered, count(*) FILTER (WHERE value < 18 + user_id % 70) AS answered FROM events GROUP BY user_id, event_type),
    s AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'enabled_members' WHEN user_id % 3 = 1 THEN 'workspace' ELSE 'member_local' END AS scope,
      CASE WHEN capability = 'ranked_retrieval' OR answered = 0 THEN 'not_observed' WHEN answered = considered THEN 'authoritative_absence' ELSE 'bounded_absence' END AS strength FROM c),
    w AS (SELECT unnest(['member_local', 'scanned_members', 'enabled_members', 'workspace']) AS claimed_scope, unnest([1, 2, 3, 4]) AS width)
    SELECT user_id, event_type, strength, claimed_scope, CASE strength WHEN 'not_observed' THEN false WHEN 'bounded_absence' THEN width <= 2 ELSE width <= (SELECT x.width FROM w x WHERE x.claimed_scope = s.scope) END AS can_claim
    FROM s, w""",
    covers=("WS04", "WS05"),
)
def op_ws04_negative_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups of a user by source: how many members answered, and what a miss lets one say at each scope."""
    e = Tables(spark, sf_dir).events
    capability = F.when(F.col("event_type") == "view", "path_membership").when(F.col("event_type").isin("click", "signup"), "symbol_exact_lookup").otherwise("ranked_retrieval")
    c = e.groupBy("user_id", "event_type").agg(F.count("*").alias("considered"), F.count_if(F.col("value") < 18 + F.col("user_id") % 70).alias("answered"))
    scope = F.when(F.col("user_id") % 3 == 0, "enabled_members").when(F.col("user_id") % 3 == 1, "workspace").otherwise("member_local")
    held = c.withColumn("strength", negative_claim(capability, F.col("considered"), F.col("answered"))).withColumn("scope", scope).withColumn("claimed_scope", F.explode(F.array(*map(F.lit, SCOPES))))
    return held.select("user_id", "event_type", "strength", "claimed_scope", can_claim_absence(F.col("strength"), F.col("scope"), F.col("claimed_scope")).alias("can_claim"))


def identity_mismatches(recorded: dict[str, Column], found: dict[str, Column], exact: tuple[str, ...]) -> Column:
    """RT03. Null if nothing is recorded, else the names that disagree.

    Ids are compared if they're recorded; instances only if both sides have one.
    """
    names = list(recorded)
    wrong = [F.when(recorded[c].isNotNull() & (~recorded[c].eqNullSafe(found[c]) if c in exact else (recorded[c] != found[c])), F.lit(c)) for c in names]
    declared = F.coalesce(*[recorded[c] for c in names]).isNotNull()
    return F.when(declared, F.array_compact(F.array(*wrong)))


@query(
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN 'r' || o_custkey END AS r_id, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS w_id, CASE WHEN o_orderkey % 5 = 2 THEN o_orderstatus END AS r_inst,
      CASE WHEN o_orderkey % 7 = 6 THEN 'r' || (o_custkey + 1) ELSE 'r' || o_custkey END AS f_id, CASE WHEN o_orderkey % 10 < 8 THEN o_orderpriority END AS f_w, CASE WHEN o_orderkey % 2 = 0 THEN 'O' END AS f_inst FROM orders)
    SELECT o_orderkey, CASE WHEN r_id IS NULL AND w_id IS NULL AND r_inst IS NULL THEN NULL ELSE concat_ws(',', CASE WHEN r_id <> f_id THEN 'repository_id' END, CASE WHEN w_id IS NOT NULL AND w_id IS DISTINCT FROM f_w THEN 'worktree_id' END, CASE WHEN r_inst <> f_inst THEN 'repository_instance' END) END AS mismatches,
      CASE WHEN r_id IS NULL AND w_id IS NULL AND r_inst IS NULL THEN 'unrecorded' WHEN r_id <> f_id OR (w_id IS NOT NULL AND w_id IS DISTINCT FROM f_w) OR coalesce(r_inst <> f_inst, false) THEN 'replaced' ELSE 'agrees' END AS verdict FROM r""",
    covers=("RT03",),
)
def op_rt03_recorded_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders recorded of their customer, priority and status against what is found now."""
    k = F.col("o_orderkey")
    own = F.concat(F.lit("r"), F.col("o_custkey").cast("string"))
    recorded = {"repository_id": F.when(k % 4 > 0, own), "worktree_id": F.when(k % 3 == 1, F.col("o_orderpriority")), "repository_instance": F.when(k % 5 == 2, F.col("o_orderstatus"))}
    found = {"repository_id": F.when(k % 7 == 6, F.concat(F.lit("r"), (F.col("o_custkey") + 1).cast("string"))).otherwise(own), "worktree_id": F.when(k % 10 < 8, F.col("o_orderpriority")), "repository_instance": F.when(k % 2 == 0, F.lit("O"))}
    held = Tables(spark, sf_dir).orders.select("o_orderkey", identity_mismatches(recorded, found, ("repository_id", "worktree_id")).alias("m"))
    verdict = F.when(F.col("m").isNull(), "unrecorded").when(F.size("m") > 0, "replaced").otherwise("agrees")
    return held.select("o_orderkey", F.array_join("m", ",").alias("mismatches"), verdict.alias("verdict"))


#: Fixed values, in the order in which a mismatch is reported.
FRESHNESS = ("index_format_version", "schema_version", "parser_fingerprint", "indexer_fingerprint", "config_hash", "repo_head")


def freshness(has_index: Column, stored: Column, expected: Column) -> tuple[Column, Column]:
    """RE02. (what disagrees, reason of the first) of two structs of FRESHNESS fields; a null struct is missing."""
    wrong = F.array_compact(F.array(*[F.when(~stored[c].eqNullSafe(expected[c]), F.lit(c)) for c in FRESHNESS]))
    mismatches = F.when(~has_index, F.array(F.lit("index"))).when(stored.isNull(), F.array(F.lit("metadata"))).otherwise(wrong)
    return mismatches, F.when(~has_index, "index missing").when(stored.isNull(), "metadata missing").when(F.size(wrong) == 0, "fresh").otherwise(F.concat(F.element_at(wrong, 1), F.lit(" changed")))


@query(
    """WITH s AS (SELECT o.o_orderkey AS k, o.o_custkey % 9 > 0 AS has_index, CASE WHEN o.o_orderkey % 8 > 0 THEN {'index_format_version': 5, 'schema_version': o.o_custkey % 3, 'parser_fingerprint': o.o_orderstatus, 'indexer_fingerprint': sha256(o.o_orderpriority),
        'config_hash': CASE WHEN o.o_orderkey % 6 = 5 THEN NULL ELSE 'c' END, 'repo_head': o.o_orderdate::DATE::VARCHAR} END AS stored,
      {'index_format_version': 5, 'schema_version': o.o_custkey % 2, 'parser_fingerprint': 'F', 'indexer_fingerprint': sha256(o.o_orderpriority), 'config_hash': 'c', 'repo_head': CASE WHEN o.o_orderkey % 5 = 0 THEN '' ELSE o.o_orderdate::DATE::VARCHAR END} AS expected FROM orders o),
    m AS (SELECT k, has_index, stored, list_filter([CASE WHEN stored.index_format_version IS DISTINCT FROM expected.index_format_version THEN 'index_format_version' END, CASE WHEN stored.schema_version IS DISTINCT FROM expected.schema_version THEN 'schema_version' END,
      CASE WHEN stored.parser_fingerprint IS DISTINCT FROM expected.parser_fingerprint THEN 'parser_fingerprint' END, CASE WHEN stored.indexer_fingerprint IS DISTINCT FROM expected.indexer_fingerprint THEN 'indexer_fingerprint' END,
      CASE WHEN stored.config_hash IS DISTINCT FROM expected.config_hash THEN 'config_hash' END, CASE WHEN stored.repo_head IS DISTINCT FROM expected.repo_head THEN 'repo_head' END], lambda x: x IS NOT NULL) AS wrong FROM s)
    SELECT k AS o_orderkey, CASE WHEN NOT has_index THEN 'index' WHEN stored IS NULL THEN 'metadata' ELSE array_to_string(wrong, ',') END AS mismatches,
      CASE WHEN NOT has_index THEN 'index missing' WHEN stored IS NULL THEN 'metadata missing' WHEN len(wrong) = 0 THEN 'fresh' ELSE wrong[1] || ' changed' END AS reason FROM m""",
    covers=("RE02",),
)
def op_re02_index_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, head = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    stored = F.when(k % 8 > 0, F.struct(F.lit(5).alias("index_format_version"), (F.col("o_custkey") % 3).alias("schema_version"), F.col("o_orderstatus").alias("parser_fingerprint"), F.sha2("o_orderpriority", 256).alias("indexer_fingerprint"), F.when(k % 6 != 5, "c").alias("config_hash"), head.alias("repo_head")))
    expected = F.struct(F.lit(5).alias("index_format_version"), (F.col("o_custkey") % 2).alias("schema_version"), F.lit("F").alias("parser_fingerprint"), F.sha2("o_orderpriority", 256).alias("indexer_fingerprint"), F.lit("c").alias("config_hash"), F.when(k % 5 == 0, "").otherwise(head).alias("repo_head"))
    held = Tables(spark, sf_dir).orders.select("o_orderkey", (F.col("o_custkey") % 9 > 0).alias("has"), stored.alias("s"), expected.alias("e"))
    wrong, reason = freshness(F.col("has"), F.col("s"), F.col("e"))
    return held.select("o_orderkey", F.array_join(wrong, ",").alias("mismatches"), reason.alias("reason"))


#: Which status a rule may leave for which.
RULE_MOVES = {"promote": ("candidate", "active"), "dismiss": ("candidate", "dismissed")}


def rule_transition(rules: DataFrame, requests: DataFrame) -> DataFrame:
    """RU05. rule_id, action, status, changed_at, error: requests applied to rules whose status allows it.

    A rule that isn't a candidate, or isn't there, keeps what it has and says why.
    """
    allowed = F.col("status") == "candidate"
    target = F.create_map(*[F.lit(x) for k, v in RULE_MOVES.items() for x in (k, v[1])])
    both = requests.join(rules, "rule_id", "left")
    error = F.when(F.col("status").isNull(), "no such rule").when(~allowed, F.concat(F.lit("only candidates can be changed: "), F.col("status")))
    return both.select("rule_id", "action", F.when(allowed, target[F.col("action")]).otherwise(F.col("status")).alias("status"), F.when(allowed, F.col("now")).otherwise(F.col("changed_at")).alias("changed_at"), error.alias("error"))


@query(
    """WITH rules AS (SELECT c_custkey AS rule_id, CASE c_custkey % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'active' WHEN 2 THEN 'candidate' ELSE 'dismissed' END AS status, c_nationkey::BIGINT AS changed_at FROM customer WHERE c_custkey % 10 > 0),
    q AS (SELECT c_custkey AS rule_id, CASE WHEN c_mktsegment < 'G' THEN 'promote' ELSE 'dismiss' END AS action, 1000 + c_custkey AS now FROM customer)
    SELECT rule_id, action, CASE WHEN status = 'candidate' THEN CASE action WHEN 'promote' THEN 'active' ELSE 'dismissed' END ELSE status END AS status,
      CASE WHEN status = 'candidate' THEN now ELSE changed_at END AS changed_at,
      CASE WHEN status IS NULL THEN 'no such rule' WHEN status <> 'candidate' THEN 'only candidates can be changed: ' || status END AS error FROM q LEFT JOIN rules USING (rule_id)""",
    covers=("RU05",),
)
def op_ru05_rule_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = Tables(spark, sf_dir).customer, F.col("c_custkey")
    rules = c.where(k % 10 > 0).select(k.alias("rule_id"), F.when(k % 2 == 0, "candidate").when(k % 4 == 1, "active").otherwise("dismissed").alias("status"), F.col("c_nationkey").cast("long").alias("changed_at"))
    requests = c.select(k.alias("rule_id"), F.when(F.col("c_mktsegment") < "G", "promote").otherwise("dismiss").alias("action"), (k + 1000).alias("now"))
    return rule_transition(rules, requests)


DAY_MS = 86_400_000
RETENTION_MS = 90 * DAY_MS


def cleanup_candidates(sessions: DataFrame, now_ms: Column, retention_ms: int = RETENTION_MS) -> DataFrame:
    """SM08. Compressed sessions with how long they've been so; those past retention come first, then the latest."""
    since = F.coalesce("compressed_at_ms", "last_activity_at_ms")
    held = sessions.where("status = 'compressed'").withColumn("compressed_for_ms", F.greatest(now_ms - since, F.lit(0)))
    return held.withColumn("eligible", F.col("compressed_for_ms") >= retention_ms).orderBy(F.desc("eligible"), F.desc(F.coalesce("compressed_at_ms", F.lit(0))), "session_id")


@query(
    """WITH s AS (SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'compressed' WHEN 'O' THEN 'inactive' ELSE 'active' END AS status, CASE WHEN o_orderkey % 5 > 0 THEN epoch_ms(o_orderdate) + o_custkey END AS compressed_at_ms, epoch_ms(o_orderdate) AS last_activity_at_ms FROM orders)
    SELECT session_id, greatest(904608000000 - coalesce(compressed_at_ms, last_activity_at_ms), 0) AS compressed_for_ms, greatest(904608000000 - coalesce(compressed_at_ms, last_activity_at_ms), 0) >= 7776000000 AS eligible
    FROM s WHERE status = 'compressed' ORDER BY eligible DESC, coalesce(compressed_at_ms, 0) DESC, session_id LIMIT 500""",
    covers=("SM08",),
)
def op_sm08_session_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 of the list as of 1998-09-01; orders are sessions."""
    k, at = F.col("o_orderkey"), F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    status = F.when(F.col("o_orderstatus") == "F", "compressed").when(F.col("o_orderstatus") == "O", "inactive").otherwise("active")
    sessions = Tables(spark, sf_dir).orders.select(k.alias("session_id"), status.alias("status"), F.when(k % 5 > 0, at + F.col("o_custkey")).alias("compressed_at_ms"), at.alias("last_activity_at_ms"))
    return cleanup_candidates(sessions, F.lit(904608000000)).limit(500).select("session_id", "compressed_for_ms", "eligible")


#: Fixed values, tried in this order.
CRASH_MARKS = r"(?i)internal error|Maximum call stack|(?-i:RangeError|TypeError)"
ENCODING_MARKS = r"(?i)unicode error|codec can't decode|invalid non-printable character|invalid character|encoding"
SYNTAX_MARKS = r"(?i)SyntaxError|IndentationError|TabError|unexpected|expected|invalid"


def failure_class(status: Column, message: Column, code: Column) -> Column:
    """TX59. A crash of the parser that speaks of encodings is a crash; a decoder's complaint is no syntax error."""
    m = F.coalesce(message, F.lit(""))
    return (
        F.when(status == "read_failed", "read_error").when(status != "parse_failed", "unknown")
        .when(m.rlike(CRASH_MARKS), "parser_exception").when(m.rlike(ENCODING_MARKS), "encoding_error").when(m.rlike(SYNTAX_MARKS), "syntax_error")
        .when(F.coalesce(code, F.lit("")) == "parser_failed", "syntax_error").otherwise("unknown")
    )


_MESSAGES = (
    "TypeError: x is not a function while encoding", "rangeerror is no class of ours", "SyntaxError: 'utf-8' codec can't decode byte 0xff", "Invalid character in identifier", "IndentationError: unindent",
    "unexpected token )", "the file went away", "INTERNAL ERROR at 4", "", "tab or space expected",
)


@query(
    f"""WITH m AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'read_failed' WHEN 'view' THEN 'indexed' ELSE 'parse_failed' END AS status, CASE WHEN event_id % 11 < 10 THEN ({[*_MESSAGES]!r})[(event_id % 11)::INT + 1] END AS message, CASE WHEN user_id % 2 = 0 THEN 'parser_failed' END AS code FROM events)
    SELECT event_id, CASE WHEN status = 'read_failed' THEN 'read_error' WHEN status <> 'parse_failed' THEN 'unknown'
      WHEN regexp_matches(coalesce(message, ''), 'internal error|maximum call stack', 'i') OR contains(message, 'RangeError') OR contains(message, 'TypeError') THEN 'parser_exception'
      WHEN regexp_matches(coalesce(message, ''), 'unicode error|codec can.t decode|invalid non-printable character|invalid character|encoding', 'i') THEN 'encoding_error'
      WHEN regexp_matches(coalesce(message, ''), 'syntaxerror|indentationerror|taberror|unexpected|expected|invalid', 'i') THEN 'syntax_error' WHEN code = 'parser_failed' THEN 'syntax_error' ELSE 'unknown' END AS failure_class FROM m""".replace('"SyntaxError: \'utf-8\' codec can\'t decode byte 0xff"', "'SyntaxError: ''utf-8'' codec can''t decode byte 0xff'"),
    covers=("TX59",),
)
def op_tx59_failure_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of failed files, each with any status and code."""
    k = F.col("event_id")
    status = F.when(F.col("event_type") == "error", "read_failed").when(F.col("event_type") == "view", "indexed").otherwise("parse_failed")
    message = F.get(F.array(*map(F.lit, _MESSAGES)), (k % 11).cast("int"))
    return Tables(spark, sf_dir).events.select("event_id", failure_class(status, message, F.when(F.col("user_id") % 2 == 0, "parser_failed")).alias("failure_class"))


def entrypoint(path: Column, name: Column, exported: Column) -> Column:
    """DX11. Tests by path or name, else what is exported, else null."""
    p = F.lower(path)
    is_test = p.rlike(r"(^|/)(tests?|__tests__)(/|$)") | p.rlike(r"(^|/)(test_[^/]+|[^/]+\.(test|spec)\.[cm]?[jt]sx?)$") | F.lower(name).rlike(r"^(test_|it$|test$|describe$)")
    return F.when(is_test, "test").when(exported, "exported_api")


@query(
    f"""WITH {SYMBOLS_SQL} SELECT symbol_id, CASE WHEN regexp_matches(lower(path), '(^|/)(tests?|__tests__)(/|$)') OR regexp_matches(lower(path), '(^|/)(test_[^/]+|[^/]+\\.(test|spec)\\.[cm]?[jt]sx?)$')
      OR regexp_matches(lower(local_name), '^(test_|it$|test$|describe$)') THEN 'test' WHEN exported THEN 'exported_api' END AS entrypoint FROM symbols""",
    covers=("DX11",),
)
def op_dx11_entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Codebase(Tables(spark, sf_dir)).symbols().select("symbol_id", entrypoint(F.col("path"), F.col("local_name"), F.col("exported")).alias("entrypoint"))
