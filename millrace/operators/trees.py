"""Decision trees, forests and boosting by histograms: one aggregation over the rows a level, for all trees of a forest at once.

Features are cut at quantiles, at most ``bins`` a feature; a feature with fewer values is cut at each.  A level sums weights
and targets by (tree, node, feature, bin): every task adds its rows, batch by batch, to one histogram, and only histograms are
shuffled, however many rows, features and trees there are.  Each node's best cut comes from those sums.  Only cuts and leaves, whose number the depth bounds, come to the driver; a model is an expression
over the features, so predicting is a projection.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import matrix
from .resample import chance


@dataclass
class Tree:
    """Nodes are numbered from 1; the children of n are 2 n (x <= threshold, or null) and 2 n + 1."""

    splits: dict[int, tuple[str, float, float]] = field(default_factory=dict)  # node: feature, threshold, gain
    values: dict[int, list[float]] = field(default_factory=dict)  # node: mean of every target

    def node(self) -> Column:
        """The leaf of a row."""

        def at(n: int) -> Column:
            if n not in self.splits:
                return F.lit(n)
            feature, cut, _ = self.splits[n]
            return F.when(F.col(feature) > cut, at(2 * n + 1)).otherwise(at(2 * n))

        return at(1)

    def value(self, target: int = 0) -> Column:
        def at(n: int) -> Column:
            if n not in self.splits:
                return F.lit(float(self.values[n][target]))
            feature, cut, _ = self.splits[n]
            return F.when(F.col(feature) > cut, at(2 * n + 1)).otherwise(at(2 * n))

        return at(1)

    def importances(self) -> dict[str, float]:
        """Share of each feature in the gains."""
        found: dict[str, float] = {}
        for feature, _, gain in self.splits.values():
            found[feature] = found.get(feature, 0.0) + gain
        total = sum(found.values()) or 1.0
        return {f: g / total for f, g in found.items()}


def cuts(df: DataFrame, features: list[str], bins: int = 64) -> dict[str, list[float]]:
    """At most ``bins`` values of every feature, by quantiles."""
    at = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, F.lit(max(1000, 20 * bins))).alias(c) for c in features]).first()
    return {c: sorted(set(row[c] or [])) for c in features}


#: Numbers of a histogram that a task holds at once; more trees are summed in turns of their own.
CELLS = 1 << 23


def _histograms(rows: DataFrame, trees: list[Tree], numbers: list[int], features: list[str], edges: dict[str, list[float]], level: int, targets: int) -> DataFrame:
    """(tree, node, feature, bin, n, from, to, s0, s1, ...) of the nodes of a level, from (x, y, w): arrays of features, targets and weights.

    In ``x`` null is minus infinity and NaN is infinity, as they order; they are in the first and last bin and bound no cut.
    """
    low = 1 << level
    bounds = [np.array(edges[c], float) for c in features]
    size = max(len(b) for b in bounds) + 1
    ways = []
    for k in numbers:
        feature, at = np.full(2 * low, -1), np.zeros(2 * low)
        for n, (name, cut, _) in trees[k].splits.items():
            if n < low:
                feature[n], at[n] = features.index(name), cut
        ways.append((feature, at))
    shape = (len(numbers), low, len(features), size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros(shape), np.zeros((targets, *shape))
        least, most = np.full(shape, np.inf), np.full(shape, -np.inf)
        for batch in batches:
            if not len(batch):
                continue
            x, y, w = (matrix(batch.column(i)) for i in range(3))
            bins = np.stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(bounds)], 1)
            known = np.isfinite(x)
            every = np.arange(len(x))
            for i, (feature, at) in enumerate(ways):
                node = np.ones(len(x), np.int64)
                for _ in range(level):
                    f = feature[node]
                    node = np.where(f >= 0, 2 * node + (x[every, np.maximum(f, 0)] > at[node]), node)
                here = np.flatnonzero((node >= low) & (w[:, i] > 0))
                for j in range(len(features)):
                    place = (node[here] - low) * size + bins[here, j]
                    own = w[here, i]
                    weight[i, :, j] += np.bincount(place, own, low * size).reshape(low, size)
                    for t in range(targets):
                        total[t, i, :, j] += np.bincount(place, own * y[here, t], low * size).reshape(low, size)
                    real = known[here, j]
                    ends = least[i, :, j].reshape(-1), most[i, :, j].reshape(-1)
                    np.minimum.at(ends[0], place[real], x[here[real], j])
                    np.maximum.at(ends[1], place[real], x[here[real], j])
                    least[i, :, j], most[i, :, j] = ends[0].reshape(low, size), ends[1].reshape(low, size)
        t, n, f, b = np.nonzero(weight)
        finite = lambda v: pa.array(v, mask=~np.isfinite(v))
        sums = [pa.array(total[k][t, n, f, b]) for k in range(targets)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(numbers, np.int32)[t]), pa.array((n + low).astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(weight[t, n, f, b]), finite(least[t, n, f, b]), finite(most[t, n, f, b]), *sums], names=["tree", "node", "feature", "bin", "n", "from", "to", *[f"s{k}" for k in range(targets)]])

    return rows.mapInArrow(add, "tree int, node int, feature int, bin int, n double, `from` double, `to` double" + "".join(f", s{k} double" for k in range(targets)))


def _chosen(tree: int, node: int, features: list[str], share: float, seed: int) -> list[str]:
    """The features that a node may be cut at."""
    if share >= 1:
        return features
    return random.Random(seed * 1_000_003 + tree * 8191 + node).sample(features, max(1, round(share * len(features))))


def grow(df: DataFrame, features: list[str], targets: list[Column], depth: int = 3, *, bins: int = 64, weights: list[Column] | None = None, least: float = 1.0, share: float = 1.0, seed: int = 0, edges: dict[str, list[float]] | None = None) -> list[Tree]:
    """One tree for each of ``weights`` (one of weight 1 without).  Of indicator targets the gain is that of Gini, of a number that of squared error.

    A cut lies midway between the values that are next to it; both sides must weigh ``least``.  Equal gains go to the first feature
    and the smallest threshold.  Rows with a null target take no part; an empty table gives trees of one leaf with zeros.
    """
    edges = edges or cuts(df, features, bins)
    trees = [Tree() for _ in weights or [None]]
    rows = df.where(reduce(Column.__and__, [t.isNotNull() for t in targets]))
    sums = [f"s{k}" for k in range(len(targets))]
    x = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(float("inf"))), F.lit(float("-inf"))) for c in features])
    y = F.array(*[t.cast("double") for t in targets])
    for level in range(depth + 1):
        cells = None
        most = max(1, CELLS // ((1 << level) * (max(len(edges[c]) for c in features) + 1) * len(features) * (3 + len(targets))))
        for first in range(0, len(trees), most):
            numbers = list(range(first, min(len(trees), first + most)))
            own = F.array(*[(weights[k] if weights else F.lit(1.0)).cast("double") for k in numbers])
            part = _histograms(rows.select(x.alias("x"), y.alias("y"), own.alias("w")), trees, numbers, features, edges, level, len(targets))
            cells = part if cells is None else cells.unionByName(part)
        cells = cells.groupBy("tree", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.min("from").alias("from"), F.max("to").alias("to"), *[F.sum(s).alias(s) for s in sums])
        group = Window.partitionBy("tree", "node", "feature")
        upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.select("tree", "node", "feature", "bin", F.sum("n").over(upto).alias("nl"), F.sum("n").over(group).alias("na"), ((F.col("to") + F.lead("from").over(group.orderBy("bin"))) / 2).alias("cut"), *[e for s in sums for e in (F.sum(s).over(upto).alias(f"l{s}"), F.sum(s).over(group).alias(f"a{s}"))])
        square = lambda parts, n: reduce(Column.__add__, [p * p for p in parts]) / n
        left, whole = [F.col(f"l{s}") for s in sums], [F.col(f"a{s}") for s in sums]
        gain = square(left, F.col("nl")) + square([a - b for a, b in zip(whole, left)], F.col("na") - F.col("nl")) - square(whole, F.col("na"))
        fair = F.col("cut").isNotNull() & (F.col("nl") >= least) & (F.col("na") - F.col("nl") >= least)
        if share < 1:
            allowed = [(k, n, features.index(f)) for k in range(len(trees)) for n in range(1 << level, 2 << level) for f in _chosen(k, n, features, share, seed)]
            fair = fair & F.array_contains(F.lit([f"{a}:{b}:{c}" for a, b, c in allowed]), F.concat_ws(":", "tree", "node", "feature"))
        best = F.max_by(F.struct("feature", "cut", "gain"), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("best")
        cells = cells.withColumn("gain", F.when(fair, F.round(gain, 9)))
        found = cells.groupBy("tree", "node").agg(best, F.max("na").alias("n"), *[F.max(f"a{s}").alias(s) for s in sums]).collect()
        for r in found:
            tree = trees[r["tree"]]
            tree.values[r["node"]] = [r[s] / r["n"] for s in sums]
            b = r["best"]
            if level < depth and b is not None and b["gain"] is not None and b["gain"] > 1e-9:
                name = features[b["feature"]]
                tree.splits[r["node"]] = (name, b["cut"], b["gain"])
        if not any(n >= 1 << level for t in trees for n in t.splits):
            break
    for t in trees:
        t.values.setdefault(1, [0.0] * len(targets))
    return trees


def classifier(df: DataFrame, features: list[str], label: str, classes: list, depth: int = 3, **options) -> Tree:
    return grow(df, features, [(F.col(label) == c).cast("double") for c in classes], depth, **options)[0]


def regressor(df: DataFrame, features: list[str], target: str, depth: int = 3, **options) -> Tree:
    return grow(df, features, [F.col(target)], depth, **options)[0]


def shares(trees: list[Tree], classes: list) -> list[Column]:
    """The mean share of every class over the trees: class probabilities."""
    return [(reduce(Column.__add__, [t.value(k) for t in trees]) / float(len(trees))).alias(f"p_{c}") for k, c in enumerate(classes)]


def vote(trees: list[Tree], classes: list) -> Column:
    """The class of the largest mean share, ties to the first."""
    p = shares(trees, classes)
    top = F.greatest(*p) if len(p) > 1 else p[0]
    return F.coalesce(*[F.when(q == top, F.lit(c)) for q, c in zip(p, classes)])


def forest(df: DataFrame, features: list[str], targets: list[Column], key: str, trees: int = 10, depth: int = 4, share: float | None = None, seed: int = 0, **options) -> list[Tree]:
    """Trees on Poisson bootstraps, drawn by the hash of ``key``; each node sees a seeded share of the features (their root's part by default)."""

    def copies(k: int) -> Column:
        u, total, p, count = chance(key, seed, k), 0.0, math.exp(-1), F.lit(0)
        for j in range(8):
            total += p
            count, p = count + (u >= total).cast("int"), p / (j + 1)
        return count

    share = math.sqrt(len(features)) / len(features) if share is None else share
    return grow(df, features, targets, depth, weights=[copies(k) for k in range(trees)], share=share, seed=seed, **options)


def boosted(df: DataFrame, features: list[str], target: str, rounds: int = 10, depth: int = 2, rate: float = 0.1, logistic: bool = False, **options) -> Column:
    """Gradient boosting as one expression: the prediction, or with ``logistic`` the probability of label 1.

    Each round fits a tree to the residuals of the rounds before it; edges are found once.
    """
    edges = cuts(df, features, options.pop("bins", 64))
    mean = df.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
    mean = min(max(mean, 1e-6), 1 - 1e-6) if logistic else mean
    score = F.lit(math.log(mean / (1 - mean)) if logistic else mean)
    turn = (lambda s: 1 / (1 + F.exp(-s))) if logistic else (lambda s: s)
    for _ in range(rounds):
        tree = grow(df, features, [F.col(target) - turn(score)], depth, edges=edges, **options)[0]
        score = score + rate * tree.value()
    return turn(score)


def adaboost(df: DataFrame, features: list[str], label: str, rounds: int = 10, depth: int = 1, **options) -> tuple[Column, list[tuple[float, Tree]]]:
    """SAMME on labels 0 and 1: the predicted label, and the trees with their weights; it ends at a tree without error or no better than chance."""
    edges, weight, held = cuts(df, features, options.pop("bins", 64)), F.lit(1.0), []
    y = F.col(label).cast("int")
    for _ in range(rounds):
        tree = grow(df, features, [(y == 0).cast("double"), (y == 1).cast("double")], depth, weights=[weight], edges=edges, least=1e-9, **options)[0]
        said = (tree.value(1) > tree.value(0)).cast("int")
        error = df.agg(F.sum(F.when(said != y, weight).otherwise(0.0)) / F.sum(weight)).first()[0]
        if error is None or error >= 0.5:
            break
        alpha = math.log((1 - error + 1e-12) / (error + 1e-12))
        held.append((alpha, tree))
        if error < 1e-12:
            break
        weight = weight * F.when(said != y, math.exp(alpha)).otherwise(1.0)
    total = reduce(Column.__add__, [a * F.when(t.value(1) > t.value(0), 1.0).otherwise(-1.0) for a, t in held], F.lit(0.0))
    return (total > 0).cast("int"), held
