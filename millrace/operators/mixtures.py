"""Gaussian mixtures, mini-batch clustering, discriminants and factors: Spark sums the statistics, each step is one aggregation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import lists, matrix
from .moments import moments
from .resample import chance


def _joint(features: list[str], weights, means, variances) -> list[Column]:
    """Log of weight times density for every part, diagonal variances."""
    out = []
    for w, m, v in zip(weights, means, variances):
        fixed = float(np.log(w + 1e-300) - 0.5 * np.sum(np.log(2 * np.pi * np.asarray(v))))
        out.append(F.lit(fixed) - 0.5 * reduce(Column.__add__, [(F.col(c) - float(a)) * (F.col(c) - float(a)) / float(b) for c, a, b in zip(features, m, v)]))
    return out


def _log_sum(logs: list[Column]) -> tuple[Column, Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    return top, top + F.ln(reduce(Column.__add__, [F.exp(x - top) for x in logs]))


def responsibilities(features: list[str], model: tuple) -> Column:
    """The share of every part in a row, an array."""
    logs = _joint(features, *model)
    _, total = _log_sum(logs)
    return F.transform(F.array(*logs), lambda x: F.exp(x - total))


def mixture_step(df: DataFrame, features: list[str], model: tuple, floor: float = 1e-6) -> tuple[tuple, float]:
    """One step of expectation and maximisation: the next (weights, means, variances) and the mean log-likelihood of ``model``."""
    logs = _joint(features, *model)
    k, d = len(logs), len(features)
    held = df.select(*features, F.array(*logs).alias("_l"))
    held = held.withColumn("_top", F.array_max("_l"))
    held = held.withColumn("_sum", F.col("_top") + F.ln(F.aggregate("_l", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top")))))
    sums = [F.count("_sum"), F.sum("_sum")]
    for j in range(k):
        r = F.exp(F.col("_l")[j] - F.col("_sum"))
        sums += [F.sum(r), *[F.sum(r * F.col(c)) for c in features], *[F.sum(r * F.col(c) * F.col(c)) for c in features]]
    row = [float(x or 0.0) for x in held.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    n, likelihood, flat = row[0], row[1], np.array(row[2:]).reshape(k, 1 + 2 * d)
    size = np.maximum(flat[:, :1], 1e-12)
    means = flat[:, 1 : 1 + d] / size
    variances = np.maximum(flat[:, 1 + d :] / size - means**2, 0) + floor
    return (flat[:, 0] / max(n, 1.0), means, variances), likelihood / max(n, 1.0)


def mixture(df: DataFrame, features: list[str], start: np.ndarray, steps: int = 50, tol: float = 1e-4, floor: float = 1e-6) -> tuple[tuple, float]:
    """A mixture from the means ``start``, equal weights and the variances of all rows; it stops when the mean log-likelihood gains less than ``tol``."""
    spread = np.array([float(x or 0.0) for x in df.agg(*[F.var_pop(c).alias(c) for c in features]).first()]) + floor
    model, before = (np.full(len(start), 1 / len(start)), np.asarray(start, float), np.tile(spread, (len(start), 1))), -np.inf
    for _ in range(steps):
        model, now = mixture_step(df, features, model, floor)
        if now - before < tol:
            break
        before = now
    return model, now


def full_mixture(df: DataFrame, vector: str, start: np.ndarray, steps: int = 50, tol: float = 1e-4, floor: float = 1e-6) -> tuple[tuple, float]:
    """A mixture with full covariances from the means ``start``: (weights, means, covariances) and the mean log-likelihood before the last step.

    Each step is one pass; tasks add up a count, a sum and a matrix of products, centred at the part's old mean, for every
    part.  ``floor`` is added to the variances.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).persist()
    whole = moments(rows, "v")[None]
    k, d = start.shape
    model = (np.full(k, 1 / k), np.asarray(start, float), np.tile(whole.covariance(0) + floor * np.eye(d), (k, 1, 1)))
    before = -np.inf
    for _ in range(steps):
        n, first, second, likelihood = _full_sums(rows, model)
        size = np.maximum(n, 1e-12)[:, None]
        shift = first / size
        covariances = second / size[:, :, None] - shift[:, :, None] * shift[:, None, :] + floor * np.eye(d)
        model, now = (n / whole.n, model[1] + shift, covariances), likelihood / whole.n
        if now - before < tol:
            break
        before = now
    rows.unpersist()
    return model, now


def log_densities(x: np.ndarray, model: tuple) -> np.ndarray:
    """Log of weight times density of every part, full covariances."""
    out = np.empty((len(x), len(model[0])))
    for j, (w, m, c) in enumerate(zip(*model)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, j] = np.log(w + 1e-300) - 0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def _full_sums(rows: DataFrame, model: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    k, d = model[1].shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 2 + d + d * d))
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(0))
            logs = log_densities(x, model)
            top = logs.max(1)
            each = top + np.log(np.exp(logs - top[:, None]).sum(1))
            share = np.exp(logs - each[:, None])
            total[0, 0] += each.sum()
            for j in range(k):
                gap = x - model[1][j]
                pulled = gap * share[:, j : j + 1]
                total[j, 1] += share[:, j].sum()
                total[j, 2 : 2 + d] += pulled.sum(0)
                total[j, 2 + d :] += (pulled.T @ gap).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), lists(total)], names=["j", "s"])

    found = np.zeros((k, 2 + d + d * d))
    for r in rows.mapInArrow(add, "j int, s array<double>").select("j", F.posexplode("s").alias("i", "x")).groupBy("j", "i").agg(F.sum("x").alias("x")).collect():
        found[r["j"], r["i"]] = r["x"]
    return found[:, 1], found[:, 2 : 2 + d], found[:, 2 + d :].reshape(k, d, d), float(found[0, 0])


def mini_batch_kmeans(df: DataFrame, features: list[str], key: str, start: np.ndarray, steps: int = 20, share: float = 0.1, seed: int = 0) -> np.ndarray:
    """Centres after ``steps`` batches, each a hashed share of the rows; a centre moves by the mean of its rows with a rate of its counts."""
    centres, counts = np.array(start, float), np.zeros(len(start))
    for step in range(steps):
        far = [reduce(Column.__add__, [(F.col(c) - float(x)) * (F.col(c) - float(x)) for c, x in zip(features, at)]) for at in centres]
        near = F.array_position(F.array(*far), F.array_min(F.array(*far))) - 1
        batch = df.where(chance(key, seed, step) < share).select(near.cast("int").alias("_near"), *features)
        for r in batch.groupBy("_near").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in features]).collect():
            k, n, s = r["_near"], r["_n"], np.array([r[c] for c in features], float)
            counts[k] += n
            centres[k] += (s - n * centres[k]) / counts[k]
    return centres


def discriminants(df: DataFrame, features: list[str], label: str, k: int, ridge: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Linear discriminants: eigenvalues and directions (rows, largest element positive) of between- against within-class scatter, from one aggregation by class."""
    d = len(features)
    cross = [F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if j >= i]
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(features)], *cross).collect()
    n = np.array([r["_n"] for r in rows], float)
    s = np.array([[r[f"s{i}"] for i in range(d)] for r in rows], float)
    total, mean = np.zeros((d, d)), s.sum(0) / n.sum()
    for i in range(d):
        for j in range(i, d):
            total[i, j] = total[j, i] = sum(r[f"x{i}_{j}"] for r in rows)
    means = s / n[:, None]
    within = total - (means.T * n) @ means
    between = ((means - mean).T * n) @ (means - mean)
    value, vector = np.linalg.eig(np.linalg.solve(within + ridge * np.eye(d), between))
    turn = np.argsort(value.real)[::-1][:k]
    parts = vector.real[:, turn].T
    parts /= np.linalg.norm(parts, axis=1, keepdims=True)
    return value.real[turn], parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(1)])[:, None]


def factors(ratings: DataFrame, user: str, item: str, value: str, rank: int = 8, steps: int = 10, reg: float = 0.05, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(id, features) of users and of items by alternating least squares; ids must be integers."""
    from pyspark.ml.recommendation import ALS

    model = ALS(userCol=user, itemCol=item, ratingCol=value, rank=rank, maxIter=steps, regParam=reg, seed=seed).fit(ratings)
    return model.userFactors, model.itemFactors


def predicted_rating(pairs: DataFrame, users: DataFrame, items: DataFrame, user: str, item: str) -> DataFrame:
    """``pairs`` with ``predicted``, the product of both sides' factors; null where a side is not known."""
    u = users.select(F.col("id").alias(user), F.col("features").alias("_u"))
    i = items.select(F.col("id").alias(item), F.col("features").alias("_i"))
    both = pairs.join(u, user, "left").join(i, item, "left")
    return both.withColumn("predicted", F.aggregate(F.zip_with("_u", "_i", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)).drop("_u", "_i")
