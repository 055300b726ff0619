"""Queries of splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits
from .registry import query, table

_H = "((o_orderkey % 1073741824) * 2654435761 + {seed}) % 4294967296"


@query(f"SELECT o_orderpriority, count(*) AS n, sum(({_H.format(seed=7)} < 858993459)::INT)::BIGINT AS n_test FROM orders GROUP BY o_orderpriority")
def holdout_split(spark, sf):
    df = splits.holdout(table(spark, sf, "orders"), "o_orderkey", 0.2, 7)
    return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("bigint")).alias("n_test"))


@query(f"""SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H.format(seed=3)}, o_orderkey) AS r,
greatest(round(count(*) OVER (PARTITION BY o_orderstatus) * 0.1), 1) AS k FROM orders) WHERE r <= k""")
def stratified_split(spark, sf):
    return splits.holdout_exact(table(spark, sf, "orders"), "o_orderkey", 0.1, "o_orderstatus", 3).where("is_test").select("o_orderkey", "o_orderstatus")


@query("SELECT event_id, ntile(7) OVER (ORDER BY event_id) - 1 AS fold FROM events")
def kfold_assign(spark, sf):
    return splits.kfold(table(spark, sf, "events"), "event_id", 7).select("event_id", F.col("fold").cast("bigint").alias("fold"))


@query("SELECT event_type, fold, count(*) AS n FROM (SELECT *, ntile(5) OVER (PARTITION BY event_type ORDER BY ((event_id % 1073741824) * 2654435761 + 11) % 4294967296, event_id) - 1 AS fold FROM events) GROUP BY ALL")
def stratified_kfold(spark, sf):
    df = splits.kfold(table(spark, sf, "events"), "event_id", 5, 11, "event_type")
    return df.groupBy("event_type", F.col("fold").cast("bigint").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, count(*) AS n_test FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER () AS n FROM events)
WHERE r <= least(greatest(round(n * 0.2), 1), n - 1) GROUP BY user_id""")
def chronological_split(spark, sf):
    df = splits.chronological(table(spark, sf, "events").select("event_id", "ts", "user_id"), "ts", "event_id", 0.2)
    return df.where("is_test").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_test"))


@query("""SELECT CASE WHEN h < 0.6 THEN 0 WHEN h < 0.6 + 0.3 THEN 1 ELSE 2 END AS part, count(*) AS n, sum(event_id)::BIGINT AS ids
FROM (SELECT event_id, (((event_id % 1073741824) * 2654435761 + 5) % 4294967296) / 4294967296.0::DOUBLE AS h FROM events) GROUP BY 1""")
def random_parts(spark, sf):
    df = splits.random_parts(table(spark, sf, "events").select("event_id"), "event_id", [0.6, 0.3, 0.1], 5)
    return df.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def subset_rows(spark, sf):
    keys = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return splits.subset(table(spark, sf, "orders"), keys, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 10)")
def complement_rows(spark, sf):
    keys = table(spark, sf, "lineitem").where("l_quantity >= 10").select(F.col("l_orderkey").alias("o_orderkey"))
    return splits.complement(table(spark, sf, "orders"), keys, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT part, count(*) AS n, round(sum(balance), 2) AS balance FROM (SELECT 0 AS part, c_acctbal AS balance FROM customer UNION ALL SELECT 1, s_acctbal FROM supplier) GROUP BY part")
def concat_datasets(spark, sf):
    parts = [table(spark, sf, "customer").select(F.col("c_acctbal").alias("balance")), table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"))]
    return splits.mixed(parts).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def distinct_classes(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c.c_custkey, c.c_acctbal, s.s_suppkey, s.s_acctbal FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) r FROM customer) c JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) r FROM supplier) s ON c.r = s.r")
def paired_rows(spark, sf):
    return splits.paired(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey", table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")
