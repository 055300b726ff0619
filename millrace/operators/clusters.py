"""k-means from the start on: seeding in oversampled rounds, restarts, and prediction.

Seeding takes a few passes, however many clusters there are: every round draws rows in proportion to their squared
distance from the candidates so far, some 2k of them at a time; the candidates, weighted by the rows nearest to
each, are then clustered on the driver.  What reaches the driver is candidates, centres and one sum a centre.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import lists, matrix, squared_distances
from .resample import drawn


@dataclass
class Clusters:
    """Centres as rows, the inertia they end with, and the inertia before every step of the run that won."""

    centres: np.ndarray
    inertia: float
    history: list[float] = field(default_factory=list)


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) of the rows with a key and a vector without nulls or non-finite components."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("key").isNotNull() & F.col("v").isNotNull() & ~bad)


def nearest(rows: DataFrame, centres: np.ndarray, vector: str = "v", centre: str = "centre", d: str = "d") -> DataFrame:
    """``rows`` with the number of the nearest centre (the smaller of equals) and the squared distance to it."""
    schema = T.StructType([*rows.schema.fields, T.StructField(centre, T.IntegerType()), T.StructField(d, T.DoubleType())])
    at = rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                far = squared_distances(matrix(batch.column(at)), centres)
                own = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own])], names=schema.names)

    return rows.mapInArrow(run, schema)


def seed_round(rows: DataFrame, centres: np.ndarray, more: float, seed: int, salt: int) -> DataFrame:
    """The rows that a round draws: each with the chance ``more`` times its share of the summed squared distance."""
    far = nearest(rows, centres)
    cost = far.agg(F.sum("d")).first()[0] or 0.0
    if cost <= 0:
        return rows.where("false")
    return far.where(drawn("key", seed, salt) < F.col("d") * more / cost).select("key", "v")


def seeded(rows: DataFrame, k: int, rounds: int = 5, factor: float = 2.0, seed: int = 0) -> np.ndarray:
    """k centres for (key, v) to start from; fewer if there are fewer distinct vectors.

    About ``factor * k`` candidates a round are expected; vectors that are drawn twice count once.
    """
    first = rows.orderBy(drawn("key", seed, "first"), "key").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    found = np.array([first[0]["v"]])
    for r in range(rounds):
        more = seed_round(rows, found, factor * k, seed, r).select("v").distinct().collect()
        if more:
            found = np.unique(np.concatenate([found, np.array([m["v"] for m in more])]), axis=0)
    weight = {r["centre"]: r["n"] for r in nearest(rows, found).groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _reclustered(found, np.array([weight.get(c, 0) for c in range(len(found))], float), k, np.random.default_rng(seed))


def _reclustered(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator, steps: int = 20) -> np.ndarray:
    """k centres of weighted points: the next one in proportion to weight times squared distance, then Lloyd's steps."""
    if len(points) <= k:
        return points
    chosen = [int(rng.choice(len(points), p=weight / weight.sum()))]
    far = squared_distances(points, points[chosen])[:, 0]
    while len(chosen) < k:
        mass = weight * far
        if mass.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=mass / mass.sum())))
        far = np.minimum(far, squared_distances(points, points[chosen[-1:]])[:, 0])
    centres = points[chosen].copy()
    for _ in range(steps):
        own = squared_distances(points, centres).argmin(1)
        for c in range(len(centres)):
            w = weight * (own == c)
            if w.sum() > 0:
                centres[c] = (points * w[:, None]).sum(0) / w.sum()
    return centres


def _sums(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums and counts of the rows of every centre, and the inertia; tasks add up whole batches first."""
    k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, cost = np.zeros((k, width)), np.zeros(k), np.zeros(k)
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0))
                far = squared_distances(x, centres)
                own = far.argmin(1)
                np.add.at(total, own, x)
                np.add.at(cost, own, far[np.arange(len(own)), own])
                count += np.bincount(own, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(cost[used]), lists(total[used])], names=["centre", "n", "cost", "total"])

    parts = rows.select("v").mapInArrow(run, "centre int, n double, cost double, total array<double>")
    long = parts.select("centre", "n", "cost", F.posexplode("total").alias("place", "x"))
    found = long.groupBy("centre", "place").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("cost").alias("cost")).collect()
    total, count, cost = np.zeros((k, width)), np.zeros(k), 0.0
    for r in found:
        total[r["centre"], r["place"]], count[r["centre"]] = r["x"], r["n"]
        cost += r["cost"] if r["place"] == 0 else 0.0
    return total, count, cost


def lloyd(rows: DataFrame, centres: np.ndarray, steps: int = 50, tol: float = 1e-4) -> Clusters:
    """Lloyd's steps on (key, v) until no centre moves by more than ``tol``.

    Centres without rows take the rows that are farthest from theirs, one each (ties to the smaller key).
    """
    history: list[float] = []
    for _ in range(steps):
        total, count, cost = _sums(rows, centres)
        history.append(cost)
        after = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = nearest(rows, centres).where("d > 0").orderBy(F.desc("d"), "key").limit(len(empty)).collect()
            for c, r in zip(empty, far):
                after[c] = r["v"]
        shift = np.sqrt(((after - centres) ** 2).sum(1)).max()
        centres = after
        if shift <= tol:
            break
    return Clusters(centres, _sums(rows, centres)[2], history)


def kmeans(df: DataFrame, key: str, vector: str, k: int, restarts: int = 3, init: str = "parallel", steps: int = 50, tol: float = 1e-4, seed: int = 0) -> Clusters:
    """The best of ``restarts`` runs by inertia; init: parallel (rounds of oversampling) or random (rows by a hash of their key)."""
    rows = vectors(df, key, vector).persist()
    best: Clusters | None = None
    for r in range(restarts):
        if init == "parallel":
            start = seeded(rows, k, seed=seed + r)
        elif init == "random":
            start = np.array([x["v"] for x in rows.orderBy(drawn("key", seed + r, "first"), "key").limit(k).collect()])
        else:
            raise ValueError(f"init must be parallel or random, not {init!r}")
        if not len(start):
            raise ValueError("there are no vectors to cluster")
        run = lloyd(rows, start, steps, tol)
        best = run if best is None or run.inertia < best.inertia else best
    rows.unpersist()
    return best
