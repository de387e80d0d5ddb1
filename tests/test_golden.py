from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import budget, evaluation, events, extract, graph, lexical, relational, versions


def column(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t"))).collect()]


def test_tokenizer(spark):
    texts = ["mill_stone_2grind", "QuernHandle", "tools/Rotary/hand-quern.rs", "XMLGrainSieve", "--", "", None]
    assert column(spark, texts, T.tokenize) == [["mill", "stone", "2grind"], ["quern", "handle"], ["tools", "rotary", "hand", "quern", "rs"], ["xml", "grain", "sieve"], [], [], None]


def test_bm25(spark):
    """Against the formula by hand: three texts of 4, 2 and 3 words."""
    docs = spark.createDataFrame([(1, "oat oat RyeOat"), (2, "rye bran"), (3, "bran, husk; bran"), (4, None)], "id long, text string")
    got = {r.id: r.score for r in lexical.bm25(docs, "id", "text", ["oat", "bran", "oat"]).collect()}
    idf = lambda n, df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda f, size, df: idf(4, df) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * size / (9 / 4)))
    assert got == pytest.approx({1: part(3, 4, 1), 2: part(1, 2, 2), 3: part(2, 3, 2)})


def test_bm25_reads_texts_once(spark, sf_dir):
    plan = lexical.term_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", ["a", "b"])._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Scan parquet") == 1


def test_stem_and_clip(spark):
    assert column(spark, ["stories", "running", "boxes", "cats", "class"], T.stem) == ["story", "runn", "box", "cat", "class"]
    assert column(spark, ["aé" * 3, "abc", "😀😀"], lambda c: T.clip_bytes(c, 5)) == ["aéa", "abc", "😀"]


def test_file_diff(spark):
    prev = spark.createDataFrame([("alpha", "h"), ("beta", "h"), ("delta", "old")], "path string, content_hash string")
    cur = spark.createDataFrame([("alpha", "h"), ("delta", "new"), ("gamma", "h")], "path string, content_hash string")
    assert {r.path: r.change for r in versions.file_diff(prev, cur).collect()} == {"alpha": "unchanged", "beta": "removed", "delta": "modified", "gamma": "added"}
    assert versions.file_diff(prev.limit(0), prev.limit(0)).count() == 0


def test_symbol_diff_pairs_a_shifted_span(spark):
    schema = "file string, fqn string, kind string, start int, content_hash string"
    a = spark.createDataFrame([("f", "g", "function", 1, "x")], schema)
    b = spark.createDataFrame([("f", "g", "function", 9, "y")], schema)
    assert [r.change for r in versions.symbol_diff(a, b, ["file", "fqn", "kind"], ["start"]).collect()] == ["modified"]


@pytest.mark.parametrize(("n", "gap", "alerts"), [(5, 150, 1), (4, 10, 0), (5, 151, 0)])
def test_thrashing_window_includes_both_ends(spark, n, gap, alerts):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a.py", start + timedelta(seconds=gap * k)) for k in range(n)], "file_path string, ts timestamp_ntz")
    found = events.thrashing(df).collect()
    assert [r.change_count for r in found] == [n] * alerts


def test_greedy_skip(spark):
    rows = spark.createDataFrame([([(1, 200), (2, 200), (3, 100)],)], "r array<struct<id:long,cost:long>>")
    assert rows.select(budget.greedy_skip(F.col("r"), 300, 10)["ids"]).first()[0] == [1, 3]


def test_prefix_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("g", 1, 200), ("g", 2, 200), ("g", 3, 50)], "g string, k int, c int")
    assert [r.k for r in budget.prefix_within(df, ["g"], ["k"], F.col("c"), 300).collect()] == [1]


def test_planted_path_does_not_depend_on_size_or_seed(spark):
    for n, seed in ((12_000, 7), (20_000, 42)):
        found = graph.shortest_paths(graph.synthetic(spark, n, 8, 5, seed), "p0", "p5", 12).collect()
        assert [r.path for r in found] == [[f"p{k}" for k in range(6)]]


def test_traverse_with_cycles_budget_and_no_start(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.distance for r in graph.traverse(e, start, 5).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert {r.node for r in graph.traverse(e, start, 5, edge_budget=1).collect()} == {"a", "b"}
    assert graph.traverse(e, start.limit(0), 5).count() == 0
    assert graph.closure(e, start, most=2) is None


def test_wilson_and_mcnemar(spark):
    df = spark.createDataFrame([(8.0, 10.0, 3, 9), (0.0, 0.0, 0, 0)], "s double, n double, w long, l long")
    low, high = evaluation.wilson(F.col("s"), F.col("n"))
    got = df.select(F.round(low, 4), F.round(high, 4), F.round(evaluation.mcnemar_exact(F.col("w"), F.col("l")), 4)).collect()
    assert tuple(got[0]) == (0.4902, 0.9433, 0.146) and tuple(got[1]) == (0.0, 0.0, 1.0)


def test_ignore_rules():
    import re

    rules = relational.compile_ignore("# c\n*.log\n!keep.log\n/build/\nsrc/**/gen\n[ab].txt\n")

    def hit(path):
        out = False
        for pattern, negated in rules:
            if re.search(pattern, path):
                out = not negated
        return out

    assert [hit(p) for p in ("x.log", "d/x.log", "keep.log", "build/a", "d/build/a", "src/a/b/gen/x", "src/gen", "a.txt", "c.txt")] == [True, True, False, True, False, True, True, True, False]


def test_blanking_keeps_length_and_facts_ignore_literals():
    code = 'x = sorted(a)  # min(b)\ny = "max(c)"\nreturn a[0]\n'
    assert len(extract.blank_literals(code)) == len(code)
    assert extract.mechanism_facts(code) == [("ordering", 0), ("first_item", 2)]


def test_enclosing_falls_back_to_the_nearest(spark):
    spans = spark.createDataFrame([(1, "f", 1, 10), (2, "f", 3, 5), (3, "f", 30, 31)], "span_id long, file string, first long, last long")
    anchors = spark.createDataFrame([(1, "f", 4), (2, "f", 27), (3, "f", 13), (4, "g", 1)], "anchor_id long, file string, line long")
    assert {r.anchor_id: (r.span_id, r.exact) for r in relational.enclosing(anchors, spans, 16).collect()} == {1: (2, True), 2: (3, False), 3: (1, False)}


def test_as_of_results(spark):
    calls = spark.createDataFrame([("l", 1, "a"), ("l", 3, "b")], "log string, idx int, call_id string")
    results = spark.createDataFrame([("l", 2, None, "x"), ("l", 4, "a", "y"), ("l", 5, "gone", "z"), ("m", 1, None, "w")], "log string, idx int, call_id string, output string")
    assert {r.output: r.call_id for r in events.attach_results(calls, results).collect()} == {"x": "a", "y": "a", "z": "b", "w": None}


def test_parse_python_reports_errors(spark):
    src = spark.createDataFrame([("a.py", "import os\nasync def f():\n    g()\n"), ("b.py", "def ("), ("c.py", None)], "path string, code string")
    got = {(r.path, r.kind, r.name, r.parent) for r in extract.parse_python(src).collect()}
    assert got == {("a.py", "import", "os", ""), ("a.py", "function", "f", ""), ("a.py", "call", "g", "f"), ("b.py", "error", "SyntaxError", "")}
