"""Scalers, imputers and encoders: fitted by one aggregation, applied by a projection.

A fitted state is a one-row (or small dimension) DataFrame that stays in the plan, so fitting and applying
are one query and nothing is collected.
"""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered, quantiles


def _apply(df: DataFrame, stats: list[Column], columns: list[str], form) -> DataFrame:
    """``df`` beside the one row of its own statistics."""
    one = df.agg(*stats)
    return df.crossJoin(one).select(*[form(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def standard_scale(df: DataFrame, columns: list[str], with_mean: bool = True, with_std: bool = True) -> DataFrame:
    """(x - mean) / sqrt(max(population variance, 1e-12))."""
    stats = [s for c in columns for s in (F.avg(c).alias(f"_mean_{c}"), F.var_pop(c).alias(f"_var_{c}"))]

    def form(c: str) -> Column:
        x = F.col(c) - F.col(f"_mean_{c}") if with_mean else F.col(c)
        return x / F.sqrt(F.greatest(F.col(f"_var_{c}"), F.lit(1e-12))) if with_std else x

    return _apply(df, stats, columns, form)


def minmax_scale(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """To [low, high]; a constant column has divisor 1."""
    stats = [s for c in columns for s in (F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}"))]

    def form(c: str) -> Column:
        span = F.col(f"_max_{c}") - F.col(f"_min_{c}")
        return (F.col(c) - F.col(f"_min_{c}")) / F.when(span == 0, 1.0).otherwise(span) * (high - low) + low

    return _apply(df, stats, columns, form)


def maxabs_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = [F.max(F.abs(F.col(c))).alias(f"_abs_{c}") for c in columns]
    return _apply(df, stats, columns, lambda c: F.col(c) / F.when(F.col(f"_abs_{c}") == 0, 1.0).otherwise(F.col(f"_abs_{c}")))


def robust_scale(df: DataFrame, columns: list[str], low: float = 0.25, high: float = 0.75) -> DataFrame:
    """(x - median) / (upper - lower quantile), linearly interpolated; a zero range has divisor 1."""
    one = quantiles(df, columns, [0.5, low, high])

    def form(c: str) -> Column:
        q = F.col(f"q_{c}")
        return (F.col(c) - q[0]) / F.when(q[2] - q[1] == 0, 1.0).otherwise(q[2] - q[1])

    return df.crossJoin(F.broadcast(one)).select(*[form(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def normalize_rows(df: DataFrame, columns: list[str], norm: str = "l2") -> DataFrame:
    """Each row divided by its norm (l1, l2 or max), at least 1e-12."""
    parts = [F.abs(F.col(c)) for c in columns]
    if norm == "l1":
        size = sum(parts[1:], parts[0])
    elif norm == "l2":
        size = F.sqrt(sum([p * p for p in parts[1:]], parts[0] * parts[0]))
    elif norm == "max":
        size = F.greatest(*parts) if len(parts) > 1 else parts[0]
    else:
        raise ValueError(f"norm must be l1, l2 or max, not {norm!r}")
    size = F.greatest(size, F.lit(1e-12))
    return df.select(*[(F.col(c) / size).alias(c) if c in columns else F.col(c) for c in df.columns])


def binarize(df: DataFrame, columns: list[str], threshold: float = 0.0) -> DataFrame:
    return df.select(*[(F.col(c) > threshold).cast("double").alias(c) if c in columns else F.col(c) for c in df.columns])


def impute(df: DataFrame, columns: list[str], strategy: str = "mean", value: float = 0.0) -> DataFrame:
    """Nulls and NaNs become the mean, median, most frequent value (the smallest of equals) or a constant; 0 where a column has no value."""
    clean = df.select(*[F.when(F.isnan(F.col(c)), None).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
    if strategy == "constant":
        return clean.fillna(value, columns)
    if strategy == "most_frequent":
        state = None
        for c in columns:
            best = clean.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.min_by(c, F.struct(-F.col("count"), F.col(c))).alias(f"_fill_{c}"))
            state = best if state is None else state.crossJoin(best)
    elif strategy == "median":
        state = quantiles(clean, columns, [0.5]).select(*[F.col(f"q_{c}")[0].alias(f"_fill_{c}") for c in columns])
    elif strategy == "mean":
        state = clean.agg(*[F.avg(c).alias(f"_fill_{c}") for c in columns])
    else:
        raise ValueError(f"no strategy {strategy!r}")
    fill = lambda c: F.coalesce(F.col(c), F.col(f"_fill_{c}"), F.lit(0.0))
    return clean.crossJoin(state).select(*[fill(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, bias: bool = True, interaction_only: bool = False) -> DataFrame:
    """Monomials of the columns up to a degree, in the order of combinations; names join the factors by ``*``."""
    pick = combinations if interaction_only else combinations_with_replacement
    terms = [F.lit(1.0).alias("one")] if bias else []
    for d in range(1, degree + 1):
        for group in pick(columns, d):
            product = F.col(group[0])
            for c in group[1:]:
                product = product * F.col(c)
            terms.append(product.alias("_".join(group)))
    return df.select(*[c for c in df.columns if c not in columns], *terms)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): the distinct values numbered in sorted order, from 0."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return numbered(values, column, "code").withColumn("code", F.col("code").cast("int"))


def label_encode(df: DataFrame, column: str, codes: DataFrame | None = None) -> DataFrame:
    """``df`` with the code of ``column``; a value that ``codes`` lacks has a null code, which :func:`reject_unknown` turns into an error."""
    return df.join(codes if codes is not None else label_codes(df, column), column, "left")


def reject_unknown(df: DataFrame, code: str = "code") -> DataFrame:
    return df.withColumn(code, F.coalesce(F.col(code), F.raise_error(F.lit("a value was not seen in fitting")).cast("int")))


def one_hot(df: DataFrame, column: str, categories: list) -> DataFrame:
    """An indicator column per category; another value has zeros."""
    return df.select("*", *[(F.col(column) == v).cast("int").alias(f"{column}_{v}") for v in categories])


def rare_category_merge(df: DataFrame, column: str, min_share: float, other: str = "other") -> DataFrame:
    """Categories with less than a share of the rows become ``other``."""
    share = df.groupBy(column).count().crossJoin(df.agg(F.count(F.lit(1)).alias("_all"))).withColumn("_rare", F.col("count") < F.col("_all") * min_share)
    return df.join(share.select(column, "_rare"), column, "left").withColumn(column, F.when(F.col("_rare"), other).otherwise(F.col(column))).drop("_rare")
