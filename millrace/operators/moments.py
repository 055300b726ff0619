"""Means and covariances of vectors that merge, and scores of generated samples that rest on them.

A task keeps one count, mean and matrix of centred cross products and merges every batch into it; what tasks hold is
merged in rounds of a bounded fan-in.  No column pair is an aggregate of its own, and far-off means cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import softmax
from ..tables import cut
from .arrow import lists, matrix
from .ranks import ranked

#: Parts that are merged at once.
FAN = 32


@dataclass
class Moments:
    """Count, mean, and summed products of centred components."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(0)
        centred = x - mean
        return cls(float(len(x)), mean, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n))

    def covariance(self, ddof: int = 1) -> np.ndarray:
        return self.cross / max(self.n - ddof, 1.0)


def moments(df: DataFrame, vector: str, by: str | None = None) -> dict:
    """Moments by the values of ``by`` (few; None: one entry under None); vectors that are null or hold null do not count."""
    group = F.lit("") if by is None else F.coalesce(F.col(by).cast("string"), F.lit(""))
    rows = df.select(group.alias("g"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("part", T.LongType()), T.StructField("n", T.DoubleType()), T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("cross", T.ArrayType(T.DoubleType()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, Moments] = {}
        for batch in batches:
            if not len(batch):
                continue
            x, names = matrix(batch.column(1)), np.array(batch.column(0).to_pylist())
            for name in np.unique(names).tolist():
                new = Moments.of(x[names == name])
                held[name] = held[name].merged(new) if name in held else new
        if held:
            at, m = TaskContext.get().partitionId(), list(held.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([at] * len(m), pa.int64()), pa.array([x.n for x in m]), lists(np.array([x.mean for x in m])), lists(np.array([x.cross.reshape(-1) for x in m]))], names=schema.names)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _merged(pdf[["n", "mean", "cross"]].itertuples(index=False))
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "part": [int(pdf["part"].min()) // FAN], "n": [m.n], "mean": [m.mean], "cross": [m.cross.reshape(-1)]})

    parts = cut(rows.mapInArrow(fold, schema), "moments")
    count = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while count > FAN:
        parts = parts.groupBy("g", F.floor(F.col("part") / FAN).alias("of")).applyInPandas(merge, schema)
        count = -(-count // FAN)
    found: dict = {}
    for r in parts.orderBy("g", "part").collect():  # at most FAN parts a group
        new = _merged([(r["n"], r["mean"], r["cross"])])
        name = None if by is None else r["g"]
        found[name] = found[name].merged(new) if name in found else new
    return found


def _merged(parts) -> Moments:
    out = None
    for n, mean, cross in parts:
        mean = np.asarray(mean, float)
        new = Moments(float(n), mean, np.asarray(cross, float).reshape(len(mean), -1))
        out = new if out is None else out.merged(new)
    return out


def root(m: np.ndarray) -> np.ndarray:
    """The symmetric root of a positive semidefinite matrix; eigenvalues that rounding left below zero count as zero."""
    values, axes = np.linalg.eigh((m + m.T) / 2)
    return (axes * np.sqrt(np.maximum(values, 0))) @ axes.T


def frechet(a: Moments, b: Moments) -> float:
    """Squared distance of the means plus trace(A + B - 2 (AB)^1/2) of the covariances, at least 0.

    The trace of the root of AB is that of the root of A^1/2 B A^1/2, which is symmetric.
    """
    ca, cb = a.covariance(), b.covariance()
    half = root(ca)
    inner = np.linalg.eigvalsh((half @ cb @ half + (half @ cb @ half).T) / 2)
    gap = a.mean - b.mean
    return max(0.0, float(gap @ gap + np.trace(ca) + np.trace(cb) - 2 * np.sqrt(np.maximum(inner, 0)).sum()))


def frechet_distance(real: DataFrame, made: DataFrame, vector: str) -> float:
    """The Fréchet distance of two sets of feature vectors."""
    return frechet(moments(real, vector)[None], moments(made, vector)[None])


def inception_score(df: DataFrame, logits: str, eps: float = 1e-12) -> DataFrame:
    """One row ``score``: exp of the mean divergence of each row's softmax from the mean softmax."""
    p = df.where(F.col(logits).isNotNull()).select(softmax(F.col(logits).cast("array<double>")).alias("p"))
    mean = p.select(F.posexplode("p").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"))
    logs = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: F.ln(s["m"] + eps)).alias("logs"))  # a value a class
    own = F.zip_with("p", "logs", lambda x, q: F.when(x > 0, x * (F.ln(x) - q)).otherwise(0.0))
    each = p.crossJoin(F.broadcast(logs)).select(F.aggregate(own, F.lit(0.0), lambda s, x: s + x).alias("d"))
    return each.agg(F.exp(F.avg("d")).alias("score"))


def inception_score_splits(df: DataFrame, logits: str, key: str, splits: int = 10, eps: float = 1e-12) -> DataFrame:
    """One row ``mean``, ``std`` and ``scores``: the score of each of ``splits`` even parts in the order of a numeric key; what is left over does not count."""
    placed = ranked(df.where(F.col(logits).isNotNull()), F.col(key))
    part = F.floor((F.col("rank") - 1) / F.floor(F.col("rank_all") / splits)).cast("int")
    p = placed.withColumn("part", part).where(F.col("part") < splits).select("part", softmax(F.col(logits).cast("array<double>")).alias("p"))
    mean = p.select("part", F.posexplode("p").alias("k", "x")).groupBy("part", "k").agg(F.avg("x").alias("m"))
    logs = mean.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: F.ln(s["m"] + eps)).alias("logs"))  # a row a part
    own = F.zip_with("p", "logs", lambda x, q: F.when(x > 0, x * (F.ln(x) - q)).otherwise(0.0))
    each = p.join(F.broadcast(logs), "part").select("part", F.aggregate(own, F.lit(0.0), lambda s, x: s + x).alias("d")).groupBy("part").agg(F.exp(F.avg("d")).alias("score"))
    return each.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.transform(F.array_sort(F.collect_list(F.struct("part", "score"))), lambda s: s["score"]).alias("scores"))
