"""Ranks and running sums over whole tables without a window in one task.

Rows are put into ranges of the order's first key by quantiles, one small row of bounds; windows then run inside
ranges, and what lies in the ranges before is added from a table of one row a range.  There are as many ranges as
the session has shuffle partitions, so they grow with the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut


def in_ranges(df: DataFrame, order: Column, ranges: int | None = None) -> DataFrame:
    """Adds ``_range``, which does not fall as a numeric or date ``order`` rises; null comes first."""
    key = order.cast("double")
    ranges = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = df.agg(F.percentile_approx(key, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(1000)).alias("_bounds"))
    held = df.crossJoin(F.broadcast(bounds))
    return held.withColumn("_range", F.when(key.isNull(), -1).otherwise(F.size(F.filter(F.coalesce("_bounds", F.array().cast("array<double>")), lambda b: b < key)))).drop("_bounds")


def running(df: DataFrame, order: Column, ties: list[Column], sums: dict[str, Column], descending: bool = False, by: str | None = None) -> DataFrame:
    """Adds for each name of ``sums`` the sum over this row and all before it, and ``<name>_all`` over all rows.

    With ``by``, within the rows of each of its values (nulls together); a value that has many rows lies in many ranges.
    """
    rows = in_ranges(df, order)
    key = [] if by is None else [by]
    per = rows.groupBy(*key, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    group = Window.partitionBy(*(key or [F.lit(0)]))  # a row a range
    before = group.orderBy(F.desc("_range") if descending else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias("_by") for k in key], F.col("_range").alias("_at"), *[e for n in sums for e in (F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_b_{n}"), F.sum(f"_{n}").over(group).alias(f"{n}_all"))])
    inside = Window.partitionBy(*key, "_range").orderBy(order.desc() if descending else order.asc(), *ties).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_range") == F.col("_at")
    out = rows.join(F.broadcast(per), same) if by is None else rows.join(per, same & F.col(by).eqNullSafe(F.col("_by")))
    return out.withColumns({n: F.col(f"_b_{n}") + F.sum(c).over(inside) for n, c in sums.items()}).drop("_range", "_at", "_by", *[f"_b_{n}" for n in sums])


def ranked(df: DataFrame, order: Column, *ties: Column, descending: bool = False, by: str | None = None) -> DataFrame:
    """Adds ``rank``, from 1 and without gaps, and ``rank_all``, how many rows there are (of the same ``by``)."""
    return running(df, order, list(ties), {"rank": F.lit(1).cast("long")}, descending, by)


def numbered(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in the order of a column of any type that can be ordered, null first.

    Rows are dealt out by ranges of the column and written with their range, so that counts and places agree.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = cut(df.repartitionByRange(n, F.asc_nulls_first(column)).withColumn("_range", F.spark_partition_id()), "ranges")
    small = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(small), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_first(column)))
    return held.join(F.broadcast(per), "_range").withColumn(out, F.col("_before") + place - 1).drop("_range", "_n", "_before")


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """One row with an array ``q_<column>`` for each column: exact quantiles, interpolated between neighbours; null without values.

    Rows are counted by value first and counts are summed in ranges, so neither a very common value nor the number of
    distinct values meets in one task or buffer.  Nulls and NaNs do not count.
    """
    out = None
    for c in columns:
        x = F.col(c).cast("double")
        values = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        held = running(values, F.col("x"), [], {"upto": F.col("n")})
        at = [F.lit(float(s)) * (F.col("upto_all") - 1) for s in shares]
        least = lambda t: F.min(F.when(F.col("upto") > t, F.col("x")))
        row = held.agg(*[least(F.floor(t)).alias(f"lo{k}") for k, t in enumerate(at)], *[least(F.ceil(t)).alias(f"hi{k}") for k, t in enumerate(at)], *[F.max(t - F.floor(t)).alias(f"f{k}") for k, t in enumerate(at)])
        row = row.select(F.array(*[F.col(f"lo{k}") + F.when(F.col(f"f{k}") > 0, (F.col(f"hi{k}") - F.col(f"lo{k}")) * F.col(f"f{k}")).otherwise(0.0) for k in range(len(shares))]).alias(f"q_{c}"))
        out = row if out is None else out.crossJoin(F.broadcast(row))  # one row each
    return out
