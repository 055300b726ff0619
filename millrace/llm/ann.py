"""Approximate nearest neighbours: a navigable small-world graph per shard, results of shards merged.

Equal vectors are one point of the graph, with their smallest ids.  Points are dealt to shards by a hash; a
shard is built in one task and stored as flat arrays: ids, vectors, levels, and per level a table of
neighbours with a fixed number of places.  Every block of queries searches every shard of its dimension, and
the nearest of all shards are ranked by exact distance.  A shard and a block have bounded sizes.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

#: Points of a shard, on average, and queries of a block, at most about.
SHARD_POINTS = 4096
BLOCK_QUERIES = 2048
#: Links of a point on upper levels (twice as many on the lowest), and how wide building and searching look.
LINKS = 12
BUILD_WIDTH = 64
SEARCH_WIDTH = 128
SEED = 3

INDEX = "dim int, shard long, points int, members array<array<long>>, vectors binary, levels binary, tables array<binary>, entry int"


@dataclass
class SmallWorld:
    """A layered graph over the rows of ``vectors``; ``tables[l]`` holds each point's neighbours on level l, -1 for none."""

    vectors: np.ndarray
    levels: np.ndarray
    tables: list[np.ndarray]
    entry: int

    def _near(self, q: np.ndarray, points) -> np.ndarray:
        """Squared distances, from differences: an expansion into norms loses all digits far from the origin."""
        gap = self.vectors[points] - q
        return np.einsum("ij,ij->i", gap, gap)

    def layer(self, q: np.ndarray, starts: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest points found on a level from ``starts``, nearest first."""
        table = self.tables[level]
        seen = np.zeros(len(self.vectors), bool)
        seen[[p for _, p in starts]] = True
        open_ = list(starts)
        heapq.heapify(open_)
        best = [(-d, p) for d, p in starts]
        heapq.heapify(best)
        while open_:
            d, p = heapq.heappop(open_)
            if len(best) >= width and d > -best[0][0]:
                break
            row = table[p]
            near = row[row >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            far = -best[0][0] if len(best) >= width else np.inf
            distances = self._near(q, near)
            for k in np.flatnonzero(distances < far) if far < np.inf else range(len(near)):
                e, x = distances[k], int(near[k])
                if len(best) < width:
                    heapq.heappush(best, (-e, x))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, x))
                else:
                    continue
                heapq.heappush(open_, (e, x))
        return sorted((-d, p) for d, p in best)

    def search(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        """The k nearest points found."""
        at = [(self._near(q, [self.entry])[0], self.entry)]
        for level in range(len(self.tables) - 1, 0, -1):
            at = self.layer(q, at, 1, level)
        return self.layer(q, at, max(width, k), 0)[:k]

    def _spread(self, base: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of points by distance those that are nearer to the base than to any chosen before, filled up with the nearest.

        Distances between them are expanded about the base, which is near.
        """
        points = [p for _, p in found]
        own = self.vectors[points] - base
        norms = np.einsum("ij,ij->i", own, own)
        between = norms[:, None] + norms[None, :] - 2 * own @ own.T
        chosen: list[int] = []
        for k, (d, _) in enumerate(found):
            if len(chosen) == most:
                break
            if not chosen or d < between[k, chosen].min():
                chosen.append(k)
        rest = [k for k in range(len(found)) if k not in set(chosen)]
        return [points[k] for k in (chosen + rest)[:most]]

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = SEED) -> SmallWorld:
        n = len(vectors)
        levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(np.int32), 8)
        tables = [np.full((n, links * (2 if level == 0 else 1)), -1, np.int32) for level in range(int(levels.max()) + 1)]
        graph = cls(vectors, levels, tables, 0)
        top = int(levels[0])
        for p in range(1, n):
            q = vectors[p]
            at = [(graph._near(q, [graph.entry])[0], graph.entry)]
            for level in range(top, int(levels[p]), -1):
                at = graph.layer(q, at, 1, level)
            for level in range(min(top, int(levels[p])), -1, -1):
                at = graph.layer(q, at, width, level)
                table = tables[level]
                near = graph._spread(q, at, links)
                table[p, : len(near)] = near
                for x in near:
                    row = table[x]
                    free = np.flatnonzero(row < 0)
                    if len(free):
                        row[free[0]] = p
                    else:
                        known = np.append(row, p)
                        distances = graph._near(vectors[x], known)
                        turn = np.argsort(distances)
                        row[:] = graph._spread(vectors[x], [(distances[k], int(known[k])) for k in turn], len(row))
            if levels[p] > top:
                top, graph.entry = int(levels[p]), p
        return graph


def spacious(vectors: np.ndarray) -> np.ndarray:
    """Vectors in the type that their squared distances need: doubles, or the longest type where squares leave the range of doubles."""
    size = np.abs(vectors)
    small = size[size > 0].min(initial=1.0)
    return vectors if size.max(initial=0.0) < 1e150 and small > 1e-150 else vectors.astype(np.longdouble)


def distances(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in doubles, each scaled by a power of two so that no square leaves their range."""
    gap = vectors - q
    power = np.frexp(np.abs(gap).max(1, initial=0.0))[1]
    gap = np.ldexp(gap, -power[:, None])
    return np.ldexp(np.sqrt((gap**2).sum(1)), power)


def valid_vectors(table: DataFrame, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector that is not null, empty or zero and has finite components only."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(f"`{row_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0.0))


def build_index(vectors: DataFrame, k: int, shard_points: int = SHARD_POINTS, links: int = LINKS, width: int = BUILD_WIDTH) -> DataFrame:
    """The written index (INDEX), one row per shard, of (vec_id, v).

    Of equal vectors the k + 1 smallest different ids stay: with a query's own id among them, no more can be in its
    k nearest.  Tasks cut a vector's ids before they are shuffled, so a very common vector stays small.  Rows that
    repeat an id with its vector count once.
    """
    vectors = vectors.dropDuplicates(["vec_id", "v"])
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    points = vectors.withColumn("place", place).where(F.col("place") <= k + 1)
    points = cut(points.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).withColumn("dim", F.size("v")), "ann-points")
    sizes = points.groupBy("dim").agg(F.greatest(F.round(F.count(F.lit(1)) / shard_points), F.lit(1)).cast("long").alias("shards"))
    dealt = points.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), "shards"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("members", key=lambda s: s.str[0])
        own = np.array(pdf["v"].tolist(), np.float64)
        graph = SmallWorld.build(spacious(own), links, width)
        row = (int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), len(own), [list(m) for m in pdf["members"]], own.tobytes(), graph.levels.tobytes(), [t.tobytes() for t in graph.tables], graph.entry)
        return pd.DataFrame([row], columns=["dim", "shard", "points", "members", "vectors", "levels", "tables", "entry"])

    return cut(_spread_out(dealt, "dim", "shard").groupBy("dim", "shard").applyInPandas(build, INDEX), "ann-index")


def _spread_out(rows: DataFrame, *keys: str) -> DataFrame:
    """Dealt by ``keys`` over all shuffle partitions: graphs cost far more than their bytes tell, so tasks are not merged by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def nearest(queries: DataFrame, index: DataFrame, k: int = 10, width: int = SEARCH_WIDTH, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (vec_id, v) but itself, by Euclidean distance, ties to smaller vec_id."""
    counts = queries.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / block_queries).alias("blocks"))
    asked = queries.withColumn("dim", F.size("v")).join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        row = (int(pdf["dim"].iloc[0]), int(pdf["block"].iloc[0]), pdf["vec_id"].to_numpy(np.int64).tobytes(), np.array(pdf["v"].tolist(), np.float64).tobytes())
        return pd.DataFrame([row], columns=["dim", "block", "ids", "asked"])

    blocks = asked.groupBy("dim", "block").applyInPandas(pack, "dim int, block long, ids binary, asked binary")
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    sent = blocks.join(shards, "dim").select("dim", "block", "ids", "asked", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("shard"))
    tasks = index.join(sent, ["dim", "shard"])

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            own = np.frombuffer(r.vectors, np.float64).reshape(r.points, r.dim)
            asked = np.frombuffer(r.asked, np.float64).reshape(-1, r.dim)
            wide = spacious(np.concatenate([own, asked]))
            tables = [np.frombuffer(t, np.int32).reshape(r.points, -1) for t in r.tables]
            graph = SmallWorld(wide[: r.points], np.frombuffer(r.levels, np.int32), tables, r.entry)
            for query, q, wide_q in zip(np.frombuffer(r.ids, np.int64), asked, wide[r.points :]):
                points = [p for _, p in graph.search(wide_q, k + 1, width)]
                exact = distances(own[points], q)
                found = sorted((float(d), int(m)) for d, p in zip(exact, points) for m in r.members[p] if m != query)
                out += [(int(query), m, d) for d, m in found[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = _spread_out(tasks, "shard", "block", "dim").groupBy("shard", "block", "dim").applyInPandas(look, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_all(table: DataFrame, queries: DataFrame, row_id: str = "vec_id", vector: str = "embedding", k: int = 10, **build) -> DataFrame:
    """Index the valid vectors of ``table`` and search them for those of ``queries``.

    Invalid vectors take no part on either side.  Vectors are compared with those of their own length only.  Rows that
    repeat an id with its vector count once; of an id with several vectors the smallest is the query, its other rows
    are no candidates of it, and as a candidate it stands with its nearest vector.  Any finite vector is
    compared to full precision; where squares would leave the range of doubles, searching takes the machine's longest
    type.  Other columns are not looked at, whatever their names; an empty table gives an empty result.
    """
    index = build_index(valid_vectors(table, row_id, vector), k, **build)
    return nearest(valid_vectors(queries, row_id, vector).groupBy("vec_id").agg(F.min("v").alias("v")), index, k)
