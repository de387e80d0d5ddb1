"""Retrieval quality and paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.plans.catalog import query
from quernstone.sources.tables import Tables


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """AG30. The score interval of a share; (0, 0) without trials."""
    p, d = successes / n, 1 + z * z / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), (centre - half) / d)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), (centre + half) / d)).otherwise(0.0)


def mcnemar_exact(wins: Column, losses: Column) -> Column:
    """AG31. Two-sided binomial tail of the lesser count, by log-gamma-free sums of logs."""
    n, k = wins + losses, F.least(wins, losses)
    log_sum = lambda a, b: F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(b - a, F.lit(0)).cast("long")), F.lit(0.0), lambda s, i: s + F.when((i > 0) & (a + i <= b), F.log(F.greatest(a + i, F.lit(1)).cast("double"))).otherwise(0.0))
    zero = F.lit(0).cast("long")
    term = lambda j: F.exp(log_sum(n - j, n) - log_sum(zero, j) - n * F.log(F.lit(2.0)))
    tail = F.aggregate(F.sequence(zero, k), F.lit(0.0), lambda s, j: s + term(j))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


@query(
    """SELECT event_type, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS median_rank, round(median(value), 6) AS median_mid, quantile_disc(value, 0.9) AS p90, round(max(value) - min(value), 3) AS span FROM events GROUP BY 1""",
    covers=("AG26", "AG27", "AG28"),
)
def op_ag26_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median_rank"), F.round(F.median("value"), 6).alias("median_mid"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("p90"), F.round(F.max("value") - F.min("value"), 3).alias("span"))


@query(
    """WITH g AS (SELECT l_returnflag AS arm, count(*) FILTER (l_linestatus = 'O') AS s, count(*) AS n FROM lineitem GROUP BY 1), v AS (SELECT *, s / n AS p, 1 + 3.8416 / n AS d FROM g)
    SELECT arm, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n::DOUBLE * n))) / d), 6) AS low, round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n::DOUBLE * n))) / d), 6) AS high FROM v""",
    covers=("AG30",),
)
def op_ag30_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_returnflag").alias("arm")).agg(F.count_if(F.col("l_linestatus") == "O").alias("s"), F.count("*").alias("n"))
    low, high = wilson(F.col("s").cast("double"), F.col("n").cast("double"))
    return g.select("arm", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    """WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS w, count(*) FILTER (event_type = 'error') AS l FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN w + l = 0 THEN 1 ELSE round(least(1, 2 * (SELECT sum(exp(lgamma(w + l + 1) - lgamma(j + 1) - lgamma(w + l - j + 1) - (w + l) * ln(2))) FROM range(0, least(w, l) + 1) t(j))), 6) END AS p FROM g""",
    covers=("AG31",),
)
def op_ag31_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("w"), F.count_if(F.col("event_type") == "error").alias("l"))
    return g.select("user_id", F.round(mcnemar_exact(F.col("w"), F.col("l")), 6).alias("p"))


@query(
    """SELECT c_nationkey, round(CASE WHEN sum(b) = 0 THEN 0 ELSE 100 * (sum(t) - sum(b)) / sum(b) END, 4) AS pooled_pct FROM (SELECT c_nationkey, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS t, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS b FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey) GROUP BY 1""",
    covers=("AG32",),
)
def op_ag32_pooled_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    part = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    g = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy("c_nationkey").agg(part("F").alias("t"), part("O").alias("b"))
    return g.select("c_nationkey", F.round(F.when(F.col("b") == 0, 0.0).otherwise(100 * (F.col("t") - F.col("b")) / F.col("b")), 4).alias("pooled_pct"))


_RANKED = "ranked AS (SELECT source, doc_id, quality = 1 AS gold, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents JOIN labels USING (doc_id))"


@query(
    f"""WITH {_RANKED}, q AS (SELECT source, {', '.join(f'count(*) FILTER (gold AND k <= {n}) / count(*) FILTER (gold) AS r{n}' for n in (1, 3, 5, 10))}, coalesce(1 / min(k) FILTER (gold), 0) AS rr FROM ranked GROUP BY source HAVING count(*) FILTER (gold) > 0)
    SELECT count(*) AS n, {', '.join(f'round(avg(r{n}), 6) AS recall_at_{n}' for n in (1, 3, 5, 10))}, round(avg(rr), 6) AS mrr FROM q""",
    covers=("AG29",),
)
def op_ag29_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 1, 3, 5, 10 and mean reciprocal rank; a source is a query, good documents are gold."""
    t = Tables(spark, sf_dir)
    own = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    ranked = t.documents.select("doc_id", "source", "n_chars").join(t.labels.select("doc_id", (F.col("quality") == 1).alias("gold")), "doc_id").withColumn("k", F.row_number().over(own))
    gold = F.col("gold")
    q = ranked.groupBy("source").agg(F.count_if(gold).alias("g"), *[F.count_if(gold & (F.col("k") <= n)).alias(f"h{n}") for n in (1, 3, 5, 10)], F.min(F.when(gold, F.col("k"))).alias("first")).where("g > 0")
    return q.agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(f"h{n}") / F.col("g")), 6).alias(f"recall_at_{n}") for n in (1, 3, 5, 10)], F.round(F.avg(1 / F.col("first")), 6).alias("mrr"))


@query(
    """WITH a AS (SELECT l_suppkey, list(DISTINCT l_partkey) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey, list(DISTINCT l_partkey) AS y FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
    SELECT s_suppkey, round(CASE WHEN len(coalesce(x, [])) + len(coalesce(y, [])) = 0 THEN 1 ELSE len(list_intersect(coalesce(x, []), coalesce(y, []))) / len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) END, 6) AS jaccard
    FROM supplier LEFT JOIN a ON a.l_suppkey = s_suppkey LEFT JOIN b ON b.l_suppkey = s_suppkey""",
    covers=("AG33",),
)
def op_ag33_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By counts of members of either and of both, so no set is gathered."""
    t = Tables(spark, sf_dir)
    r = F.col("l_returnflag") == "R"
    member = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.bool_or(r).alias("a"), F.bool_or(~r).alias("b"))
    n = member.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count("*").alias("any"))
    return t.supplier.select("s_suppkey").join(n, "s_suppkey", "left").select("s_suppkey", F.round(F.coalesce(F.col("both") / F.col("any"), F.lit(1.0)), 6).alias("jaccard"))


