"""Rules of the code-base operators on cases worked out by hand, beside the tables the oracles use."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quernstone.operators import broad, claims, impact, imports, logs, objectives, roles, upserts


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("question", "meaningful", "generic", "hidden"),
    [
        ("KeyError in the grinder", ["grinder"], ["error", "key"], ["key"]),
        ("KeyError: the key of a grinder is lost", ["grinder", "key", "lost"], ["error"], []),
        ("SystemExit after a failed run", ["after"], ["exit", "failed", "run", "system"], ["exit", "system"]),
        ("", [], [], []),
    ],
)
def test_words_of_a_question(spark, question, meaningful, generic, hidden):
    assert tuple(sorted(value(spark, c)) for c in objectives.query_words(F.lit(question))) == (meaningful, generic, hidden)


def test_paths_and_names_in_prose(spark):
    q = F.lit("See ./Tools/Mill.py, (conf/a.d/x.toml) or https://h.org/p/q.py and settings.YAML; not and/or. Call grind() of `Quern`, run_all or a.b.quernstones and x.py")
    assert set(value(spark, objectives.path_clues(q))) == {"tools/mill.py", "conf/a.d/x.toml", "settings.yaml", "and/or."}
    paths, names = (value(spark, c) for c in objectives.route_hints(q))
    assert paths == ["./Tools/Mill.py", "conf/a.d/x.toml"] and names == ["Quern", "grind", "run_all", "a.b.quernstones"]


@pytest.mark.parametrize(
    ("line", "receivers"),
    [
        ("total = mill.grind(2) + stones[0].grind (x)", ["mill", "stones[0]"]),
        ("say('mill.grind()')  # mill.grind()", []),
        ("make().grind()", []),
        ("a.b.c.grind(d.grind(1))", ["a.b.c", "d"]),
        ("mill.grinder(1)", []),
        ('x = "# " + mill.grind(1)', ["mill"]),
    ],
)
def test_method_calls(spark, line, receivers):
    assert value(spark, impact.method_calls(F.lit(line), "grind")) == receivers


def test_tool_calls_of_a_stream(spark):
    lines = ['{"type":"tool_result","content":"early"}', '{"type":"assistant","message":{"content":[{"type":"tool_use","name":"a"},{"type":"text"},{"type":"tool_use","name":"b"}]}}', "{broken", "", '{"type":"tool_result","content":"one"}', '{"type":"tool_result","content":"two"}', '{"type":"tool_use","name":"c"}']
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(lines)], "stream string, line_no long, line string")
    assert [tuple(r) for r in logs.tool_calls(df).orderBy("ordinal").collect()] == [("s", 1, "a", None), ("s", 2, "b", "one"), ("s", 3, "c", None)]


def test_sections_go_by_class_and_size(spark):
    rows = [(1, 0, "top", "essential", 400), (1, 400, "log", "diagnostic", 100), (1, 500, "dump", "diagnostic", 300), (1, 800, "tips", "optional", 200), (1, 1000, "how", "important", 200)]
    df = spark.createDataFrame(rows, "text_id long, start long, name string, priority string, chars long")
    kept = lambda budget: {r.name for r in logs.sections_kept(df, budget).where("kept").collect()}
    assert kept(1200) == {"top", "log", "dump", "tips", "how"} and kept(1199) == {"top", "log", "tips", "how"} and kept(800) == {"top", "how"} and kept(0) == {"top"}


def test_claims(spark):
    strength = lambda *a: value(spark, claims.negative_claim(*map(F.lit, a)))
    assert [strength("ranked_retrieval", 3, 3), strength("path_membership", 3, 0), strength("path_membership", 3, 2), strength("path_membership", 3, 3)] == ["not_observed", "not_observed", "bounded_absence", "authoritative_absence"]
    can = lambda *a: value(spark, claims.can_claim_absence(*map(F.lit, a)))
    assert can("authoritative_absence", "enabled_members", "enabled_members") and not can("authoritative_absence", "enabled_members", "workspace")
    assert can("bounded_absence", "workspace", "scanned_members") and not can("bounded_absence", "workspace", "enabled_members") and not can("not_observed", "workspace", "member_local")


def test_closure_goes_on_through_re_exports_only(spark):
    imports_ = spark.createDataFrame([("b", "a", "name"), ("c", "b", "name"), ("d", "a", "re_export"), ("e", "d", "wildcard"), ("f", "e", "module"), ("g", "f", "name"), ("a", "e", "name")], "importer string, target string, form string")
    found = imports.binding_closure(spark.createDataFrame([("a",)], "path string"), imports_)
    assert {r.path: r.hands_on for r in found.collect()} == {"a": True, "d": True, "e": True, "b": False, "f": False}


def test_run_steps_follow_the_chain(spark):
    runs = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, 4)], "run_id long, previous_run_id long")
    spans = spark.createDataFrame([(1, 5), (3, 5), (5, 5), (2, 3)], "source long, comparison long")
    assert sorted(map(tuple, impact.run_steps(runs, spans).collect())) == [(1, 5, 2, 1), (1, 5, 4, 2), (1, 5, 5, 3), (2, 3, 3, 1)]


def test_direct_answers(spark):
    answer = lambda name, kind="function", sig="", doc=None: value(spark, broad.direct_answer(F.lit("mean of two stones"), F.lit(name), F.lit(kind), F.lit(sig), F.lit(doc).cast("string")))
    assert answer("stone_mean", "class") == 0.0 and answer("grind") == 0.0
    assert answer("stone_mean") == pytest.approx(0.62 * 2 / 4)
    assert answer("stone_mean", sig="def stone_mean(stone1, stone2)") == pytest.approx(0.62 * 2 / 4)
    assert answer("stone_mean", sig="def f(s1, s2)") == pytest.approx(0.62 * 2 / 4 + 0.1)
    assert answer("grind", doc="The mean of two stones.") == 0.28
    assert answer("stone_mean", doc="The mean of two stones.") == pytest.approx(0.62 + 0.16 + 0.12)
    assert answer("stone_mean", sig="def f(s1, s2)", doc="The mean of two stones.") == 0.95


def test_sessions_merge(spark):
    sessions = spark.createDataFrame([("s", "old", 10, 20, "compressed", 30), ("t", None, 10, 20, "compressed", 30)], "session_id string, agent_kind string, started long, last long, status string, compressed_at long")
    activity = spark.createDataFrame([("s", "new", 5, "active", 1), ("t", "first", 15, "inactive", 2), ("t", "second", 25, "inactive", 3), ("u", None, 7, "active", 4)], "session_id string, agent_kind string, at long, status string, seq long")
    got = {r.session_id: tuple(r)[1:] for r in upserts.upsert_sessions(sessions, activity).collect()}
    assert got == {"s": ("old", 5, 20, "active", None), "t": ("first", 10, 25, "inactive", 30), "u": (None, 7, 7, "active", None)}


def test_technical_hint_is_capped(spark):
    hint = lambda name, path: value(spark, roles.technical_hint(["entrypoint", "lowlevel", "serialization"], F.lit(name), F.lit(path)))
    assert [hint("grind", "src/a.py"), hint("mill_core", "src/a.py"), hint("run_mill", "src/a.py"), hint("run_json", "src/a.pyx")] == [0, 8, 14, 20]
