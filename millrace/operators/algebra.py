"""Linear algebra on long tables (i, j, x), lookups and interpolation: joins on indices and partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transposed(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "x")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two matrices; absent cells are zero.  Rows meet on the inner index and are summed before they are shuffled by cell."""
    inner = a.select("i", F.col("j").alias("_k"), F.col("x").alias("_a")).join(b.select(F.col("i").alias("_k"), "j", F.col("x").alias("_b")), "_k")
    return inner.groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("x"))


def contracted(a: DataFrame, b: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """Products of the cells that agree in ``on``, summed over all indices but ``keep``: an einsum of two operands."""
    both = a.join(b.withColumnRenamed("x", "_b"), on)
    return both.groupBy(*keep).agg(F.sum(F.col("x") * F.col("_b")).alias("x"))


def trace(m: DataFrame) -> DataFrame:
    return m.where("i = j").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("trace"))


def lookup(df: DataFrame, index: str, weights: DataFrame, key: str) -> DataFrame:
    """Rows with the vector of their index; an index without one is dropped as by an inner join."""
    return df.join(weights, F.col(index) == F.col(key)).drop(key)


def interpolated(asked: DataFrame, known: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """``asked`` with ``value`` between the nearest known points of its group, linearly; the end points hold outside.

    Both sides are one union in order, so each row sees its neighbours by one shuffle and a window.
    """
    point = lambda rows, own: rows.select(*by, F.col(at), F.struct(*[F.col(c) for c in asked.columns]).alias("_row") if own else F.lit(None).cast(asked.select(F.struct("*")).schema[0].dataType).alias("_row"), F.lit(None).cast("double").alias("_v") if own else F.col(value).cast("double").alias("_v"))
    rows = point(asked, True).unionByName(point(known, False)).withColumn("_p", F.when(F.col("_v").isNotNull(), F.struct(at, "_v")))
    order = Window.partitionBy(*by).orderBy(at)
    near = rows.withColumn("_a", F.last("_p", True).over(order.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first("_p", True).over(order.rangeBetween(0, Window.unboundedFollowing)))
    a, b = F.coalesce("_a", "_b"), F.coalesce("_b", "_a")
    gap = b[at] - a[at]
    out: Column = F.when(gap > 0, a["_v"] + (b["_v"] - a["_v"]) * (F.col(at) - a[at]) / gap).otherwise(a["_v"])
    return near.where("_row IS NOT NULL").select("_row.*", out.alias(value))
