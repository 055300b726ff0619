"""Queries of scalers, imputers and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preprocessing as pre
from .registry import query, table

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _summary(df, columns, by="l_returnflag"):
    parts = [e for c in columns for e in (F.round(F.avg(c), 4).alias(f"mean_{c}"), F.round(F.stddev_pop(c), 4).alias(f"std_{c}"), F.round(F.max(c), 4).alias(f"max_{c}"))]
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *parts)


def _summary_sql(forms: dict[str, str], source: str, by="l_returnflag") -> str:
    parts = ", ".join(f"round(avg({e}), 4) AS mean_{c}, round(stddev_pop({e}), 4) AS std_{c}, round(max({e}), 4) AS max_{c}" for c, e in forms.items())
    return f"SELECT {by}, count(*) AS n, {parts} FROM {source} GROUP BY {by}"


def _stats(expr: str, table_name: str = "lineitem") -> str:
    return f"(SELECT {expr} FROM {table_name}) s"


@query(_summary_sql({c: f"({c} - m_{c}) / sqrt(greatest(v_{c}, 1e-12))" for c in _NUM}, "lineitem, " + _stats(", ".join(f"avg({c}) m_{c}, var_pop({c}) v_{c}" for c in _NUM))))
def standard_scale(spark, sf):
    return _summary(pre.standard_scale(table(spark, sf, "lineitem").select("l_returnflag", *_NUM), _NUM), _NUM)


@query(_summary_sql({c: f"({c} - m_{c}) / CASE WHEN x_{c} = m_{c} THEN 1 ELSE x_{c} - m_{c} END * 2 - 1" for c in _NUM}, "lineitem, " + _stats(", ".join(f"min({c}) m_{c}, max({c}) x_{c}" for c in _NUM))))
def minmax_scale(spark, sf):
    return _summary(pre.minmax_scale(table(spark, sf, "lineitem").select("l_returnflag", *_NUM), _NUM, -1.0, 1.0), _NUM)


@query(_summary_sql({c: f"{c} / CASE WHEN a_{c} = 0 THEN 1 ELSE a_{c} END" for c in ["c_acctbal"]}, "customer, " + _stats("max(abs(c_acctbal)) a_c_acctbal", "customer"), "c_mktsegment"))
def maxabs_scale(spark, sf):
    return _summary(pre.maxabs_scale(table(spark, sf, "customer").select("c_mktsegment", "c_acctbal"), ["c_acctbal"]), ["c_acctbal"], "c_mktsegment")


@query(_summary_sql({c: f"({c} - m_{c}) / CASE WHEN h_{c} = l_{c} THEN 1 ELSE h_{c} - l_{c} END" for c in _NUM}, "lineitem, " + _stats(", ".join(f"quantile_cont({c}, 0.5) m_{c}, quantile_cont({c}, 0.25) l_{c}, quantile_cont({c}, 0.75) h_{c}" for c in _NUM))))
def robust_scale(spark, sf):
    return _summary(pre.robust_scale(table(spark, sf, "lineitem").select("l_returnflag", *_NUM), _NUM), _NUM)


def _row_norm(norm: str, size: str):
    @query(_summary_sql({c: f"{c} / greatest({size}, 1e-12)" for c in _NUM[:3]}, "lineitem"), f"row_normalize_{norm}")
    def run(spark, sf):
        return _summary(pre.normalize_rows(table(spark, sf, "lineitem").select("l_returnflag", *_NUM[:3]), _NUM[:3], norm), _NUM[:3])


_row_norm("l1", "abs(l_quantity) + abs(l_extendedprice) + abs(l_discount)")
_row_norm("l2", "sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount)")
_row_norm("max", "greatest(abs(l_quantity), abs(l_extendedprice), abs(l_discount))")


@query("SELECT l_returnflag, sum((l_quantity > 25)::INT)::BIGINT AS over_quantity, sum((l_tax > 0.04)::INT)::BIGINT AS over_tax FROM lineitem GROUP BY l_returnflag")
def binarize(spark, sf):
    df = pre.binarize(pre.binarize(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_tax"), ["l_quantity"], 25.0), ["l_tax"], 0.04)
    return df.groupBy("l_returnflag").agg(F.sum("l_quantity").cast("bigint").alias("over_quantity"), F.sum("l_tax").cast("bigint").alias("over_tax"))


_HOLED = "(SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_custkey % 11)::DOUBLE END AS grp FROM orders)"


def _holed(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_custkey") % 11).cast("double")).alias("grp"))


def _impute(strategy: str, price: str, grp: str):
    sql = f"""WITH h AS {_HOLED}, s AS (SELECT ({price}) AS fp, ({grp}) AS fg)
SELECT o_orderstatus, round(avg(coalesce(price, fp)), 2) AS price, round(avg(coalesce(grp, fg)), 4) AS grp, count(*) AS n FROM h, s GROUP BY o_orderstatus"""

    @query(sql, f"impute_{strategy}")
    def run(spark, sf):
        df = pre.impute(_holed(spark, sf), ["price", "grp"], strategy, -1.0)
        return df.groupBy("o_orderstatus").agg(F.round(F.avg("price"), 2).alias("price"), F.round(F.avg("grp"), 4).alias("grp"), F.count(F.lit(1)).alias("n"))


_impute("mean", "SELECT avg(price) FROM h", "SELECT avg(grp) FROM h")
_impute("median", "SELECT median(price) FROM h", "SELECT median(grp) FROM h")
_impute("most_frequent", "SELECT price FROM h WHERE price IS NOT NULL GROUP BY price ORDER BY count(*) DESC, price LIMIT 1", "SELECT grp FROM h WHERE grp IS NOT NULL GROUP BY grp ORDER BY count(*) DESC, grp LIMIT 1")
_impute("constant", "SELECT -1.0::DOUBLE", "SELECT -1.0::DOUBLE")


@query(
    """SELECT l_returnflag, round(avg(l_discount * l_discount), 6) AS dd, round(avg(l_discount * l_tax), 6) AS dt, round(avg(l_tax * l_tax), 6) AS tt,
round(avg(l_discount), 6) AS d, round(avg(l_tax), 6) AS t, sum(1)::DOUBLE AS ones FROM lineitem GROUP BY l_returnflag"""
)
def polynomial_features(spark, sf):
    df = pre.polynomial(table(spark, sf, "lineitem").select("l_returnflag", "l_discount", "l_tax"), ["l_discount", "l_tax"])
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return df.groupBy("l_returnflag").agg(mean("l_discount_l_discount", "dd"), mean("l_discount_l_tax", "dt"), mean("l_tax_l_tax", "tt"), mean("l_discount", "d"), mean("l_tax", "t"), F.sum("one").alias("ones"))


@query("SELECT p_partkey, p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::INT AS code FROM part")
def label_encode(spark, sf):
    return pre.reject_unknown(pre.label_encode(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")).select("p_partkey", "p_brand", "code")


@query("SELECT o_custkey % 10 AS bucket, " + ", ".join(f"sum((o_orderstatus = '{v}')::INT)::BIGINT AS status_{v}" for v in "FOP") + " FROM orders GROUP BY o_custkey % 10")
def one_hot(spark, sf):
    df = pre.one_hot(table(spark, sf, "orders").select("o_custkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])
    return df.groupBy((F.col("o_custkey") % 10).alias("bucket")).agg(*[F.sum(f"o_orderstatus_{v}").alias(f"status_{v}") for v in "FOP"])


@query(
    """WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type), t AS (SELECT count(*) AS a FROM part)
SELECT CASE WHEN n < a * 0.168 THEN 'other' ELSE p_type END AS p_type, sum(n)::BIGINT AS n FROM c, t GROUP BY 1"""
)
def rare_categories(spark, sf):
    return pre.rare_category_merge(table(spark, sf, "part").select("p_type"), "p_type", 0.168).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
