"""The standard tables as impressions, articles, clicks and vectors; each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(impression_id, user_id, ts, candidate_id, pos, label): orders as impressions, their parts as candidates, returned ones clicked."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("impression_id"), F.col("l_partkey").alias("candidate_id"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_linenumber").alias("first_line"))
    # dealt out by impression at once, so that neither the join nor the window deals them again
    lines = lines.repartition("impression_id").groupBy("impression_id", "candidate_id").agg(F.max("label").alias("label"), F.min("first_line").alias("first_line"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("impression_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    w = W.partitionBy("impression_id").orderBy("first_line", "candidate_id")
    return lines.join(orders, "impression_id").select("impression_id", "user_id", "ts", "candidate_id", (F.row_number().over(w) - 1).alias("pos"), "label")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("text_lexical"), F.col("p_brand").alias("category"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, ts, article_id, read_time) of click events."""
    return table(spark, sf_dir, "events").filter("event_type = 'click'").select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("article_id"), F.col("value").alias("read_time"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("category"))


IC = """ic AS (
  SELECT g.impression_id, o.o_custkey AS user_id, o.o_orderdate AS ts, g.candidate_id,
    CAST(row_number() OVER (PARTITION BY g.impression_id ORDER BY g.first_line, g.candidate_id) - 1 AS INTEGER) AS pos, g.label
  FROM (SELECT l_orderkey AS impression_id, l_partkey AS candidate_id, CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS label,
      min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2) g
  JOIN orders o ON o.o_orderkey = g.impression_id),
imp AS (SELECT DISTINCT impression_id, user_id, ts FROM ic),
cut AS (SELECT ts AS cutoff FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS n, count(*) OVER () AS total FROM imp)
  WHERE n = least(greatest(round_even(total * 0.85, 0), 0), total - 1) + 1),
fit AS (SELECT ic.* FROM ic, cut WHERE coalesce(ts <= cutoff, false)),
tune AS (SELECT ic.* FROM ic, cut WHERE NOT coalesce(ts <= cutoff, false)),
pop AS (SELECT candidate_id, count(*) AS clicks FROM fit WHERE label = 1 GROUP BY 1),
seen AS (SELECT candidate_id, min(ts) AS first_ts FROM fit GROUP BY 1),
hist AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, impression_id, pos) - 1 AS INTEGER) AS idx, candidate_id AS article_id, ts,
    CAST(count(*) OVER (PARTITION BY user_id) AS INTEGER) AS n FROM fit WHERE label = 1),
tail AS (SELECT * FROM hist WHERE idx >= n - 50),
items AS (SELECT t.*, p.p_brand AS category, power(0.9, n - 1 - idx) AS w, sum(power(0.9, n - 1 - idx)) OVER (PARTITION BY user_id) AS total_weight
  FROM tail t LEFT JOIN part p ON p.p_partkey = t.article_id),
prof AS (SELECT user_id, category, count(*) AS cnt, sum(w) AS weight, min(idx) AS first_idx, max(total_weight) AS total_weight,
    CAST(sum(count(*)) OVER (PARTITION BY user_id) AS BIGINT) AS n_known FROM items WHERE category IS NOT NULL GROUP BY 1, 2),
topcat AS (SELECT user_id, category AS top_category FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, first_idx) AS rn FROM prof) WHERE rn = 1)"""

# Scores of the held-out impressions: clicks of each candidate before the cutoff.
SCORED = IC + """,
sc AS (SELECT t.*, CAST(coalesce(p.clicks, 0) AS DOUBLE) AS score FROM tune t LEFT JOIN pop p USING (candidate_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS place,
    row_number() OVER (PARTITION BY impression_id ORDER BY label DESC, pos) AS ideal,
    rank() OVER (PARTITION BY impression_id ORDER BY score) AS low, count(*) OVER (PARTITION BY impression_id, score) AS ties FROM sc),
met AS (SELECT impression_id,
    CASE WHEN sum(label) < count(*) THEN (sum((low + (ties - 1) / 2.0::DOUBLE) * label) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label)::DOUBLE * (count(*) - sum(label))) END AS auc,
    sum(label / place::DOUBLE) / sum(label)::DOUBLE AS mrr,
    sum(CASE WHEN place <= 5 THEN (power(2.0, label) - 1) / log2(place + 1.0) ELSE 0.0 END) / sum(CASE WHEN ideal <= 5 THEN (power(2.0, label) - 1) / log2(ideal + 1.0) ELSE 0.0 END) AS ndcg5,
    sum(CASE WHEN place <= 10 THEN (power(2.0, label) - 1) / log2(place + 1.0) ELSE 0.0 END) / sum(CASE WHEN ideal <= 10 THEN (power(2.0, label) - 1) / log2(ideal + 1.0) ELSE 0.0 END) AS ndcg10
  FROM rk GROUP BY 1 HAVING sum(label) > 0)"""
