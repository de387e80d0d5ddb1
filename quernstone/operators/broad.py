"""Questions of many words against symbols: admission, scores by word group, direct answers, contrast, places named in prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators.extract import all_of
from quernstone.operators.objectives import path_clues, route_hints
from quernstone.operators.symbols import VARIANTS_SQL, variants
from quernstone.plans.catalog import query
from quernstone.plans.lineage import spread
from quernstone.sources.codebase import MODULES_SQL, SYMBOLS_SQL, Codebase
from quernstone.sources.tables import Tables

FIELDS = ("local_name", "fq_name", "signature", "docstring", "path")
#: What an equal, prefix or contained variant adds by field; coverage of a group and its most.
FIELD_SCORES = {"local_name": (28, 20, 14), "fq_name": (22, 18, 14), "signature": (12, 12, 12), "docstring": (10, 10, 10), "path": (12, 12, 12)}
COVERAGE, MOST_COVERAGE = 6, 18


def _field(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def word_groups(spark: SparkSession, terms: list[str]) -> list[list[str]]:
    """The forms of each word of a question: one row, taken to the driver once, so that scans compare plain literals."""
    return [list(forms) for forms in spark.range(1).select(F.array(*[variants(F.lit(t)) for t in terms])).first()[0]]


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def admitted(symbols: DataFrame, question: str, terms: list[str], groups: list[list[str]]) -> DataFrame:
    """FLT23. Symbols a field of which has the whole question, two neighbouring words as they stand, or forms of any two words (of one, if it's all)."""
    has = lambda s: _any([F.contains(_field(f), F.lit(s)) for f in FIELDS])
    said = sum((_any([has(v) for v in forms]).cast("int") for forms in groups), F.lit(0))
    return symbols.where((said >= min(2, len(terms))) | _any([has(question.lower()), *[has(f"{a} {b}") for a, b in zip(terms, terms[1:], strict=False)]]))


def group_score(forms: list[str]) -> Column:
    """The best of all fields and forms of a word; null if none has it."""
    best = []
    for name, (equal, prefix, inside) in FIELD_SCORES.items():
        f = _field(name)
        tests = ((_any([f == F.lit(v) for v in forms]), equal), (_any([f.startswith(v) for v in forms]), prefix), (_any([F.contains(f, F.lit(v)) for v in forms]), inside))
        best.append(F.when(tests[0][0], tests[0][1]).when(tests[1][0], tests[1][1]).when(tests[2][0], tests[2][1]))
    return F.greatest(*best)


def broad_score(groups: list[list[str]]) -> tuple[Column, Column]:
    """TX22. (score, groups matched): the best match of each word, and more for each of two or more words that match."""
    scores = [group_score(forms) for forms in groups]
    n = sum((s.isNotNull().cast("int") for s in scores), F.lit(0))
    total = sum((F.coalesce(s, F.lit(0)) for s in scores), F.lit(0))
    return total + F.when(n >= 2, F.least(n * COVERAGE, F.lit(MOST_COVERAGE))).otherwise(0), n


_TERMS = ["creating", "rings", "small", "economy"]
_BROAD_SQL = f"""g AS (SELECT k, {VARIANTS_SQL.format(t="t")} AS forms FROM (SELECT unnest({_TERMS!r}) AS t, unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT symbol_id, fq_name AS name, lower(local_name) AS local_name, lower(fq_name) AS fq_name, lower(signature) AS signature, lower(coalesce(docstring, '')) AS docstring, lower(path) AS path FROM symbols),
b AS (SELECT symbol_id, k, max(greatest(CASE WHEN local_name = v THEN 28 WHEN starts_with(local_name, v) THEN 20 WHEN contains(local_name, v) THEN 14 ELSE 0 END, CASE WHEN fq_name = v THEN 22 WHEN starts_with(fq_name, v) THEN 18 WHEN contains(fq_name, v) THEN 14 ELSE 0 END,
  CASE WHEN contains(signature, v) THEN 12 ELSE 0 END, CASE WHEN contains(docstring, v) THEN 10 ELSE 0 END, CASE WHEN contains(path, v) THEN 12 ELSE 0 END)) AS s FROM f, (SELECT k, unnest(forms) AS v FROM g) GROUP BY symbol_id, k),
n AS (SELECT symbol_id, count(*) FILTER (WHERE s > 0) AS n, sum(s)::BIGINT AS s FROM b GROUP BY symbol_id)"""


@query(
    f"""WITH {SYMBOLS_SQL}, {_BROAD_SQL} SELECT symbol_id, s + CASE WHEN n >= 2 THEN least(6 * n, 18) ELSE 0 END AS score, n AS groups FROM n JOIN f USING (symbol_id)
    WHERE n >= 2 OR contains(local_name || chr(1) || fq_name || chr(1) || signature || chr(1) || docstring || chr(1) || path, 'creating rings') OR contains(local_name || chr(1) || fq_name || chr(1) || signature || chr(1) || docstring || chr(1) || path, 'rings small') OR contains(local_name || chr(1) || fq_name || chr(1) || signature || chr(1) || docstring || chr(1) || path, 'small economy')
    ORDER BY score DESC, name, symbol_id LIMIT 200""",
    covers=("FLT23", "TX22", "TK02"),
)
def op_flt23_broad_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 best symbols for "creating rings small economy"."""
    groups = word_groups(spark, _TERMS)
    score, n = broad_score(groups)
    found = admitted(Codebase(Tables(spark, sf_dir)).symbols(), " ".join(_TERMS), _TERMS, groups)
    return found.select("symbol_id", "fq_name", score.cast("long").alias("score"), n.cast("long").alias("groups")).orderBy(F.desc("score"), "fq_name", "symbol_id").limit(200).drop("fq_name")


#: Words of a request for a capability that name none, and numbers of parameters.
CAPABILITY_WORDS = ("already", "directly", "exist", "exists", "helper", "method", "please", "project")
COUNTS = {"single": 1, "one": 1, "two": 2, "three": 3, "four": 4}


def concept(w: Column) -> Column:
    n, cut = F.length(w), lambda k: F.substring(w, F.lit(1), F.length(w) - k)
    return F.when((n > 4) & w.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((n > 4) & w.endswith("ing"), cut(3)).when((n > 3) & w.endswith("s"), cut(1)).otherwise(w)


def parameters_fit(q: Column, signature: Column) -> Column:
    """Whether a signature has as many parameters named after a thing as the request counts ("two rings")."""
    asked = r"\b(single|one|two|three|four)\s+([a-z][a-z0-9_]*)"
    number = F.create_map(*[F.lit(x) for kv in COUNTS.items() for x in kv])[F.regexp_extract(F.lower(q), asked, 1)]
    params = F.filter(F.transform(F.split(F.regexp_extract(signature, r"\(([^)]*)\)", 1), ","), lambda p: F.trim(F.regexp_replace(F.trim(p), "[:=].*$", ""))), lambda p: p != "")

    def fit(thing: Column) -> Column:
        fits = F.filter(params, lambda p: F.exists(T.tokenize(p), lambda w: concept(w) == thing) | F.rlike(F.lower(p), F.concat(F.lit("^"), F.substring(thing, 1, 1), F.lit(r"\d+$"))))
        return F.coalesce(F.size(fits) >= number, F.lit(False)) & (thing != "")

    return T.once(concept(F.regexp_extract(F.lower(q), asked, 2)), fit)


def direct_answer(q: Column, name: Column, kind: Column, signature: Column, docstring: Column) -> Column:
    """TX50. How far a definition answers a request for a capability; only functions and methods, from name, signature and docstring alone."""
    concepts = lambda ws: F.transform(ws, concept)
    terms = concepts(F.slice(F.filter(F.array_distinct(T.tokenize(q)), lambda w: ~w.isin(*CAPABILITY_WORDS)), 1, 12))
    words = lambda c: concepts(T.tokenize(F.coalesce(c, F.lit(""))))
    lists = F.struct(terms.alias("terms"), words(name).alias("name"), words(signature).alias("signature"), words(docstring).alias("docstring"))

    def counts(x: Column) -> Column:
        terms = x["terms"]
        of = lambda pool: F.size(F.filter(terms, lambda w: F.array_contains(pool, w)))
        pairs = F.array_distinct(F.array_compact(F.transform(F.sequence(F.lit(1), F.greatest(F.size(terms) - 1, F.lit(1))), lambda i: F.concat(F.get(terms, i - 1), F.lit(" "), F.get(terms, i)))))
        phrases = T.once(F.array_join(x["own"], " "), lambda text: F.least(F.size(F.filter(pairs, lambda p: F.contains(text, p))), F.lit(3)))
        return F.struct(F.size(terms).alias("terms"), of(x["own"]).alias("own"), of(x["name"]).alias("name"), of(x["docstring"]).alias("docstring"), phrases.alias("phrases"))

    def answer(x: Column) -> Column:
        named = x["name"] > 0
        explained = (x["docstring"] >= 2) | (x["phrases"] > 0)
        coverage = F.when(x["terms"] > 0, x["own"] / x["terms"]).otherwise(0.0)
        score = coverage * 0.62 + F.least(F.lit(0.16), x["phrases"] * 0.08) + F.when(named & explained, 0.12).otherwise(0.0) + F.when(parameters_fit(q, signature), 0.1).otherwise(0.0)
        score = T.once(score, lambda s: F.when(named, s).otherwise(F.least(s, F.lit(0.28))))
        return F.when(~kind.isin("function", "method") | (x["own"] < 2), 0.0).otherwise(F.round(F.least(F.lit(0.95), score), 4))

    lists = T.once(lists, lambda x: F.struct(x["terms"].alias("terms"), x["name"].alias("name"), x["docstring"].alias("docstring"), F.concat(x["name"], x["signature"], x["docstring"]).alias("own")))
    return T.once(T.once(lists, counts), answer)


_C = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND w LIKE '%ing' THEN left(w, length(w) - 3) WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END"
_W = lambda c: f"list_transform({T.TOKENIZE_SQL.format(c=c)}, lambda w: {_C})"


@query(
    f"""WITH {SYMBOLS_SQL}, q AS (SELECT *, list_filter(['find', 'please', 'a', 'helper', 'for', 'two', 'rings', 'economy', 'fails'], lambda w: w NOT IN ('helper', 'please')) AS terms FROM symbols),
    t AS (SELECT *, list_transform(terms, lambda w: {_C}) AS ct, {_W("local_name")} AS nt, {_W("signature")} AS st, {_W("coalesce(docstring, '')")} AS dt FROM q),
    m AS (SELECT *, len(list_filter(ct, lambda w: list_contains(list_concat(nt, st, dt), w))) AS k, len(list_filter(ct, lambda w: list_contains(nt, w))) AS kn, len(list_filter(ct, lambda w: list_contains(dt, w))) AS kd, array_to_string(list_concat(nt, st, dt), ' ') AS txt,
      len(list_filter(string_split(regexp_extract(signature, '\\(([^)]*)\\)', 1), ','), lambda p: list_contains({_W("regexp_replace(trim(p), '[:=].*$', '')")}, 'ring'))) >= 2 AS fit FROM t),
    p AS (SELECT *, least(3, len(list_filter(list_transform(range(1, len(ct)), lambda i: ct[i] || ' ' || ct[i + 1]), lambda x: contains(txt, x)))) AS ph FROM m),
    s AS (SELECT *, k / len(terms) * 0.62 + least(0.16, ph * 0.08) + CASE WHEN kn > 0 AND (kd >= 2 OR ph > 0) THEN 0.12 ELSE 0 END + CASE WHEN fit THEN 0.1 ELSE 0 END AS raw FROM p)
    SELECT symbol_id, CASE WHEN kind NOT IN ('function', 'method') OR k < 2 THEN 0.0 ELSE round(least(0.95, CASE WHEN kn > 0 THEN raw ELSE least(raw, 0.28) END), 4) END AS score FROM s""",
    covers=("TX50",),
)
def op_tx50_direct_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.lit("Find, please, a helper for two rings: economy fails")
    return spread(Codebase(Tables(spark, sf_dir)).symbols()).select("symbol_id", direct_answer(q, F.col("local_name"), F.col("kind"), F.col("signature"), F.col("docstring")).alias("score"))


def contrast(positive: Column, excluded: Column, excluded_phrases: Column, branches: Column, sides: Column, named: Column, unnamed: Column, words: Column, name: Column) -> tuple[Column, Column]:
    """TX51. (bonus, penalty) of a candidate whose text has ``words``.

    ``positive``, ``excluded`` and ``branches`` are words of the request, ``sides`` pairs of
    word lists of its alternatives, ``named`` and ``unnamed`` identifiers it wants or rules
    out. One it wants is no worse for words around it, unless it's also ruled out.
    """
    hits = lambda terms, most: F.least(F.size(F.array_intersect(terms, words)), F.lit(most))
    both = F.exists(sides, lambda s: F.arrays_overlap(s["a"], words) & F.arrays_overlap(s["b"], words))
    branch = F.least(F.lit(0.24), hits(branches, 6) * 0.06) + F.when(both, 0.12).otherwise(0.0)
    bonus = F.least(F.lit(0.36), F.least(F.lit(0.24), hits(positive, 4) * 0.06) + branch)
    says = F.least(F.size(F.filter(excluded_phrases, lambda p: F.contains(F.array_join(words, " "), p))), F.lit(2))
    is_in = lambda ids: F.exists(ids, lambda x: F.lower(F.element_at(F.split(x, r"[.]|::"), -1)) == F.lower(name))
    raw = hits(excluded, 4) * 0.14 + says * 0.18 + F.when(is_in(unnamed), 0.45).otherwise(0.0)
    return F.round(bonus, 4), F.round(F.when(is_in(named) & ~is_in(unnamed), 0.0).otherwise(F.least(F.lit(0.75), raw)), 4)


@query(
    f"""WITH {SYMBOLS_SQL}, w AS (SELECT *, {T.TOKENIZE_SQL.format(c="local_name || ' ' || fq_name || ' ' || path || ' ' || signature || ' ' || coalesce(docstring, '')")} AS ws FROM symbols),
    h AS (SELECT *, least(4, len(list_intersect(['ring', 'def', 'economy', 'src', 'small'], list_distinct(ws)))) AS p, least(4, len(list_intersect(['widget', 'red', 'class'], list_distinct(ws)))) AS x, least(6, len(list_intersect(['promo', 'standard', 'bolt'], list_distinct(ws)))) AS b,
      len(list_intersect(['promo'], list_distinct(ws))) > 0 AND len(list_intersect(['bolt', 'gear'], list_distinct(ws))) > 0 AS two_sides, least(2, contains(array_to_string(ws, ' '), 'red widget')::INT + contains(array_to_string(ws, ' '), 'def red')::INT) AS ph, lower(local_name) IN ('red_widget', 'smallring') AS wanted, lower(local_name) IN ('redwidget', 'red_widget_30') AS barred FROM w)
    SELECT symbol_id, round(least(0.36, least(0.24, p * 0.06) + least(0.24, b * 0.06) + CASE WHEN two_sides THEN 0.12 ELSE 0 END), 4) AS bonus, CASE WHEN wanted AND NOT barred THEN 0.0 ELSE round(least(0.75, x * 0.14 + ph * 0.18 + CASE WHEN barred THEN 0.45 ELSE 0 END), 4) END AS penalty FROM h""",
    covers=("TX51",),
)
def op_tx51_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda *w: F.array(*map(F.lit, w))
    text = T.tokenize(F.concat_ws(" ", "local_name", "fq_name", "path", "signature", F.coalesce("docstring", F.lit(""))))
    sides = F.array(F.struct(words("promo").alias("a"), words("bolt", "gear").alias("b")))
    bonus, penalty = contrast(words("ring", "def", "economy", "src", "small"), words("widget", "red", "class"), words("red widget", "def red"), words("promo", "standard", "bolt"), sides, words("pkg.red_widget", "SmallRing"), words("x::RedWidget", "red_widget_30"), F.col("w"), F.col("local_name"))
    return Codebase(Tables(spark, sf_dir)).symbols().select("symbol_id", "local_name", text.alias("w")).select("symbol_id", bonus.alias("bonus"), penalty.alias("penalty"))


#: Fixed pattern of a frame in a traceback.
FRAME = r'File "([^"]+)", line (\d+), in ([A-Za-z_<][\w>]*)'


def localization(tasks: DataFrame, paths: DataFrame) -> DataFrame:
    """AN08. task_id, path, grade, line, function: files that a task points at, by how it names them.

    Frames of a traceback and paths in prose go to the files that end with them at a
    border of segments: an equi join on every suffix of the files' paths, so no file is
    laid beside each task. The strongest grade of a file counts; a suffix that several
    files have is no clue.
    """
    frames = tasks.select("task_id", F.explode(all_of(F.col("q"), FRAME)).alias("f")).select("task_id", F.regexp_replace(F.regexp_extract("f", FRAME, 1), r"^(\./|/)+", "").alias("clue"), F.lit("traceback").alias("grade"), F.regexp_extract("f", FRAME, 2).cast("int").alias("line"), F.regexp_extract("f", FRAME, 3).alias("function"))
    prose = tasks.select("task_id", F.explode(F.array_distinct(F.concat(path_clues(F.col("q")), F.transform(route_hints(F.col("q"))[0], F.lower)))).alias("clue"), F.lit("path").alias("grade"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("function"))
    parts = F.split(F.lower("path"), "/")
    suffixes = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("clue"))
    alone = suffixes.groupBy("clue").agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1").drop("n")
    rank = F.when(F.col("grade") == "traceback", 0).otherwise(1)
    hit = frames.unionByName(prose).withColumn("clue", F.lower("clue")).join(alone, "clue")
    best = hit.groupBy("task_id", "path").agg(F.min(F.struct(rank.alias("r"), F.coalesce("line", F.lit(0)).alias("l"), "grade", "line", "function")).alias("b"))
    return best.select("task_id", "path", "b.grade", "b.line", "b.function")


@query(
    f"""WITH {MODULES_SQL}, pv AS (SELECT c_custkey AS task_id, 'src/pkg' || (c_custkey % 5) || '/mod' || (c_custkey % 110) || '.py' AS a, 'pkg' || (c_custkey % 3) || '/Mod' || (c_custkey % 77) || '.py' AS b FROM customer),
    cl AS (SELECT task_id, lower(a) AS clue, 'traceback' AS grade, (task_id % 90 + 1)::INT AS line, 'run_' || (task_id % 4) AS function FROM pv WHERE task_id % 2 = 0 UNION ALL SELECT task_id, lower(b), 'path', NULL, NULL FROM pv),
    sf AS (SELECT path, unnest(list_transform(range(1, len(string_split(lower(path), '/')) + 1), lambda i: array_to_string((string_split(lower(path), '/'))[i:], '/'))) AS clue FROM modules),
    al AS (SELECT clue, min(path) AS path FROM sf GROUP BY clue HAVING count(*) = 1), h AS (SELECT task_id, path, grade, line, function FROM cl JOIN al USING (clue))
    SELECT task_id, path, arg_min(grade, CASE grade WHEN 'traceback' THEN 0 ELSE 1 END) AS grade, max(line) AS line, max(function) AS function FROM h GROUP BY task_id, path""",
    covers=("AN08",),
)
def op_an08_localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    k, s = F.col("c_custkey"), lambda c: c.cast("string")
    frame = F.concat(F.lit('\n  File "/src/pkg'), s(k % 5), F.lit("/mod"), s(k % 110), F.lit('.py", line '), s(k % 90 + 1), F.lit(", in run_"), s(k % 4), F.lit("\n"))
    q = F.concat(F.lit("It fails in pkg"), s(k % 3), F.lit("/Mod"), s(k % 77), F.lit(".py now."), F.when(k % 2 == 0, frame).otherwise(""))
    return localization(t.customer.select(k.alias("task_id"), q.alias("q")), Codebase(t).modules().select("path"))


#: Fixed patterns: grammar rules, parser generators, what generated files say.
GRAMMAR, GENERATOR, BANNER = r"(?m)^\s*def\s+p_[A-Za-z_]\w*\s*\(", r"(?i)\b(?:ply|yacc|lex)\b", r"(?i)\b(?:automatically generated|auto[- ]?generated|generated by|do not edit|do not modify|created by)\b"
TABLES = ("_parsetab", "_lextab")


def generated_beside(sources: DataFrame, files: DataFrame) -> DataFrame:
    """AN12. source, related, confidence, evidence: generated parser tables beside sources (path, text); an equi join on the path they'd have."""
    is_table = F.col("path").rlike(r"(?:_parsetab|_lextab)\.py$|(^|/)(?:parsetab|lextab)\.py$|(^|/)parser\.out$")
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    own = sources.where(~is_table).select(F.col("path").alias("source"), F.col("text").alias("own"), F.explode(F.array(*[F.concat(stem, F.lit(f"{t}.py")) for t in TABLES])).alias("related"))
    held = own.join(files.select(F.col("path").alias("related"), F.substring("text", 1, 4096).alias("head")), "related")
    grammar, tool = F.col("own").rlike(GRAMMAR), F.col("own").rlike(GENERATOR)
    evidence = F.concat_ws("; ", F.when(grammar, "grammar functions").when(tool, "parser generator"), F.when(F.col("head").rlike(BANNER), "banner").otherwise("table name"))
    return held.select("source", "related", F.when(grammar | tool, "high").otherwise("medium").alias("confidence"), evidence.alias("evidence"))


@query(
    f"""WITH {MODULES_SQL}, s AS (SELECT module_id, regexp_replace(path, '\\.py$', '') AS stem, path FROM modules WHERE module_id % 4 > 0), a AS (SELECT stem || '_parsetab.py' AS related, path, module_id, 1 AS k FROM s WHERE module_id % 3 = 0 UNION ALL SELECT stem || '_lextab.py', path, module_id, 2 FROM s WHERE module_id % 5 = 0)
    SELECT path AS source, related, CASE WHEN module_id % 6 < 4 THEN 'high' ELSE 'medium' END AS confidence, concat_ws('; ', CASE WHEN module_id % 6 < 2 THEN 'grammar functions' WHEN module_id % 6 < 4 THEN 'parser generator' END, CASE WHEN k = 1 THEN 'banner' ELSE 'table name' END) AS evidence FROM a""",
    covers=("AN12",),
)
def op_an12_generated_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four modules as sources; a third has a parser table beside it, a fifth a lexer table."""
    m, k = Codebase(Tables(spark, sf_dir)).modules().where("module_id % 4 > 0"), F.col("module_id")
    text = F.when(k % 6 < 2, "import x\ndef p_rule(p):\n  'a : b'").when(k % 6 < 4, "uses PLY here").otherwise("plain")
    stem = F.regexp_replace("path", r"\.py$", "")
    tables = m.where("module_id % 3 = 0").select(F.concat(stem, F.lit("_parsetab.py")).alias("path"), F.lit("# This file is automatically generated. Do not edit.").alias("text"))
    tables = tables.unionByName(m.where("module_id % 5 = 0").select(F.concat(stem, F.lit("_lextab.py")).alias("path"), F.lit("x = 1").alias("text")))
    sources = m.select("path", text.alias("text"))
    return generated_beside(sources.unionByName(tables), sources.unionByName(tables))
