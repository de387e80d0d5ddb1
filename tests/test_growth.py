"""Work that must grow no faster than the input, and odd inputs of the operators that do it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quernstone import registry
from quernstone.operators import objectives, symbols, upserts


def most_rows(df) -> int:
    """The most rows that any step of the plan gave, as it was run."""

    def steps(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return steps(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return steps(plan.plan())
        found = [plan.metrics().apply("numOutputRows").value()] if plan.metrics().contains("numOutputRows") else []
        children = plan.children()
        return found + [n for k in range(children.size()) for n in steps(children.apply(k))]

    df.collect()
    return max(steps(df._jdf.queryExecution().executedPlan()))


def test_title_symbols_of_a_common_name(spark):
    named = spark.range(500).select(F.col("id").alias("symbol_id"), F.lit("mill").alias("local_name"), F.format_string("a.%04d", 500 - F.col("id")).alias("fq_name"))
    requests = spark.range(500).select(F.col("id").alias("request_id"), F.lit("the mill, a mill").alias("title"))
    found = symbols.title_symbols(requests.unionByName(requests.where("request_id < 3")), named)
    assert most_rows(found) <= 4000
    assert sorted(map(tuple, found.where("request_id IN (1, 400)").collect())) == [(r, 500 - p, p) for r in (1, 400) for p in (3, 2, 1)]


def test_module_neighbours_of_a_large_directory(spark):
    path = F.format_string("src/f%d.py", F.floor(F.col("id") / 100))
    held = spark.range(2000).select(F.col("id").alias("symbol_id"), path.alias("path"), (F.col("id") % 100).cast("int").alias("line"))
    held = held.unionByName(held.where("symbol_id = 7"))
    found = upserts.same_module_neighbours(held.where("symbol_id % 4 = 3").select(F.col("symbol_id").alias("seed")), held)
    assert most_rows(found) <= 8000
    rows = {}
    for r in found.orderBy("place").collect():
        rows.setdefault(r.seed, []).append(r.neighbour)
    assert len(rows) == 500 and rows[3] == [100, 101, 102] and rows[1999] == [0, 1, 2] and rows[7] == [100, 100, 101]


@pytest.mark.parametrize("name", ["op_tx17_query_words", "op_tx50_direct_answers", "op_an07_decoys_weakened", "op_rt01_route_hints", "op_src10_parse_python", "op_tx15_actionability", "op_tx44_path_clues"])
def test_work_on_rows_of_a_small_file_is_dealt_out(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_touching_edges_are_told_apart_once_by_keys(spark, sf_dir):
    plan = registry.queries()["op_jn02_touching"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "hashpartitioning(src" not in plan


def test_expansion_shuffles_few_edges(spark, sf_dir):
    plan = registry.queries()["op_gr11_expand"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    edges = [x for x in plan.split("\n") if "Aggregate" in x and ("_custkey" in x or "_partkey" in x or "edge_type" in x)]
    assert not edges and "Join Inner" in plan


def most_shuffled(df) -> int:
    """The most rows that any shuffle of the plan was given, as it was run."""

    def steps(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return steps(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return steps(plan.plan())
        found = [plan.metrics().apply("shuffleRecordsWritten").value()] if plan.metrics().contains("shuffleRecordsWritten") else []
        children = plan.children()
        return found + [n for k in range(children.size()) for n in steps(children.apply(k))]

    df.collect()
    return max(steps(df._jdf.queryExecution().executedPlan()))


def test_identifier_lane_shuffles_no_pairs(spark):
    named = spark.range(700).select(F.col("id").alias("symbol_id"), F.lit("SmallRing").alias("local_name"), F.format_string("src/mod%d.py", F.col("id") % 9).alias("path"))
    asked = spark.range(600).select(F.col("id").alias("question_id"), F.format_string("fix SmallRing in mod%d.py or no_such", F.col("id") % 7).alias("q"))
    found = objectives.identifier_lane(named, asked)
    assert most_shuffled(found) <= 3000
    rows = found.collect()
    assert len(rows) == 420_000 and {(r.question_id, r.symbol_id): r.bonus for r in rows} == {(q, s): 160 if q % 7 == s % 9 else 80 for q in range(600) for s in range(700)}


def test_identifier_lane_of_odd_rows(spark):
    """Repeated and null ids, a file and a symbol of one name, names that are null."""
    named = spark.createDataFrame([(1, "a.py", "src/a.py"), (2, "red_widget", "a.py"), (2, "SmallRing", "b.py"), (None, "red_widget", "c.py"), (None, "red_widget", None), (5, None, None)], "symbol_id long, local_name string, path string")
    asked = spark.createDataFrame([(1, "red_widget a.py a.py"), (2, "SmallRing"), (2, "red_widget"), (None, "SmallRing"), (None, "c.py"), (7, None), (8, "plain")], "question_id long, q string")
    rows = sorted(map(tuple, objectives.identifier_lane(named, asked).collect()), key=str)
    assert rows == sorted([(1, 1, 160), (1, 2, 160), (1, None, 100), (2, 2, 100), (2, None, 100), (None, 2, 80), (None, None, 160)], key=str)
