"""Nearest neighbours, cluster steps and box overlaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import cut
from .arrow import lists, matrix, squared_distances
from .frequent import with_group

#: Queries of a block, and rows of a chunk, that meet in a task as two matrices.
BLOCK_ROWS = 4096
#: Vectors of a cell of the partitioned neighbour join, and how often all vectors are cut into cells.
CELL_ROWS, CUTS = 2048, 12


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _packed(rows: DataFrame, block: str) -> DataFrame:
    """(block, ids, v): the rows of each block as one row of two arrays."""
    return rows.groupBy(block).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("v"))


def knn(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, key, distance, rank): the k nearest rows of each query but itself, ties to the smaller key; exact.

    All rows are asked, so work is queries times rows.  Queries are dealt to blocks and rows to chunks of bounded
    sizes; each pair of a block and a chunk is one record and a matrix in a task, of which the k best of every
    query are kept.  With many blocks rows are shuffled once for each.  Rows without a key or a vector take no part.
    """
    kind = rows.schema[key].dataType
    asked, known = (t.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null") for t in (queries, rows))
    blocks, chunks = (max(1, -(-t.count() // block_rows)) for t in (asked, known))
    left = _packed(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "block").toDF("block", "asked", "q")
    right = _packed(known.withColumn("chunk", F.pmod(F.xxhash64("id", "v"), F.lit(chunks))), "chunk").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = right.join(left, "block").repartition(max(blocks * chunks, 1) if blocks * chunks < 1000 else 1000, "block", "chunk").select("asked", "q", "ids", "v")

    def best(batches):
        for batch in batches:
            for i in range(len(batch)):
                ask, own = batch.column(0)[i].values, batch.column(2)[i].values
                q = batch.column(1)[i].values.to_numpy(zero_copy_only=False).reshape(len(ask), -1)
                x = batch.column(3)[i].values.to_numpy(zero_copy_only=False).reshape(len(own), -1)
                names, asks, found = own.to_pylist(), ask.to_pylist(), [[], [], []]
                places: dict = {}
                for c, name in enumerate(names):
                    places.setdefault(name, []).append(c)
                step = max(1, (1 << 22) // max(1, len(own)))
                for low in range(0, len(asks), step):
                    d = np.sqrt(squared_distances(q[low : low + step], x))
                    for r, line in enumerate(d):
                        line[places.get(asks[low + r], [])] = np.inf
                    edge = np.partition(d, min(k, len(names)) - 1, 1)[:, min(k, len(names)) - 1]
                    for r, (line, most) in enumerate(zip(d, edge)):
                        near = sorted((line[c], names[c]) for c in np.flatnonzero((line <= most) & (line < np.inf)).tolist())[:k]
                        for column, values in zip(found, ([asks[low + r]] * len(near), [n for _, n in near], [float(e) for e, _ in near])):
                            column += values
                yield pa.RecordBatch.from_arrays([pa.array(found[0], ask.type), pa.array(found[1], own.type), pa.array(found[2], pa.float64())], names=["query", key, "distance"])

    schema = T.StructType([T.StructField("query", queries.schema[key].dataType), T.StructField(key, kind), T.StructField("distance", T.DoubleType())])
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    return pairs.mapInArrow(best, schema).withColumn("rank", rank).where(F.col("rank") <= k)


def _cells(points: DataFrame, cell_rows: int, cuts: int, seed: int) -> DataFrame:
    """(point, cut, cell): every vector in one cell of each of ``cuts`` partitions.

    A cell is halved at the median of a random projection until cells hold about ``cell_rows``; each level is one
    aggregate of medians, and halves are even whatever the vectors are.
    """
    n = points.count()
    levels = max(0, int(np.ceil(np.log2(max(n, 1) / cell_rows))))
    if levels == 0:
        return points.select("point", F.lit(0).alias("cut"), F.lit(0).cast("long").alias("cell"))
    width = points.select(F.size("v")).first()[0]
    directions = np.random.default_rng(seed).normal(size=(cuts * levels, width))

    def project(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(matrix(batch.column(1)) @ directions.T)], names=["point", "all"])

    schema = T.StructType([points.schema["point"], T.StructField("all", T.ArrayType(T.DoubleType()))])
    each = points.select("point", "v").mapInArrow(project, schema)
    each = each.select("point", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("cut"), "all").select("point", "cut", F.slice("all", F.col("cut") * levels + 1, levels).alias("p"), F.lit(0).cast("long").alias("cell"))
    for level in range(levels):
        each = cut(each, "cells")
        middle = each.groupBy("cut", "cell").agg(F.percentile_approx(F.col("p")[level], 0.5, 1000).alias("m"))
        each = each.join(middle, ["cut", "cell"]).select("point", "cut", (F.col("cell") * 2 + (F.col("p")[level] > F.col("m")).cast("long")).alias("cell"), "p")
    return each.select("point", "cut", "cell")


def near(df: DataFrame, key: str, vector: str, k: int, asked: Column | None = None, cell_rows: int = CELL_ROWS, cuts: int = CUTS, seed: int = 0) -> DataFrame:
    """(query, key, distance, rank): the k nearest rows found for the rows that are ``asked`` (default: all), ties to the smaller key.

    The table joins itself cell by cell instead of pair by pair: vectors are cut into cells several times over, by
    different random projections; inside a cell all are compared, and the candidates of all cells are ranked by
    exact distance.  A table of one cell gets exact answers; beyond that a neighbour is missed if every cut parts it
    from the row.  Equal vectors are one point with its k + 1 smallest keys, so copies neither fill cells nor count
    twice.  Rows with null keys or vectors, or null or non-finite components, take no part; vectors have one length.
    """
    kind = df.schema[key].dataType
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))).alias("asks"))
    rows = cut(rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad).withColumn("point", F.md5(F.to_json(F.struct("v")))), "near-rows")
    place = F.row_number().over(Window.partitionBy("point").orderBy("id"))
    members = rows.select("point", "id").withColumn("place", place).where(F.col("place") <= k + 1).groupBy("point").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asks = rows.groupBy("point").agg(F.max("asks").alias("asks"), F.count(F.lit(1)).alias("n"))
    one = rows.join(members.select("point", F.element_at("ids", 1).alias("id")), ["point", "id"]).dropDuplicates(["point"]).select("point", "v")
    points = cut(one.join(members, "point").join(asks, "point"), "near-points")
    held = _cells(points, cell_rows, cuts, seed).join(points.select("point", "v", "asks", F.element_at("ids", 1).alias("id")), "point")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)  # a stable sort by distance then settles ties
        x, names = np.array(pdf["v"].tolist(), np.float64), pdf["point"].to_numpy()
        rows_, out = np.flatnonzero(pdf["asks"].to_numpy()), [(np.zeros(0, object), np.zeros(0, object), np.zeros(0))]
        step = max(1, (1 << 22) // len(x))
        for low in range(0, len(rows_), step):
            own = rows_[low : low + step]
            d = np.sqrt(squared_distances(x[own], x))
            d[np.arange(len(own)), own] = np.inf
            best = np.argsort(d, 1, kind="stable")[:, : min(k, len(x) - 1)]
            out.append((np.repeat(names[own], best.shape[1]), names[best.ravel()], np.take_along_axis(d, best, 1).ravel()))
        return pd.DataFrame({c: pd.Series(np.concatenate(parts), dtype=kind) for c, kind, parts in zip(("point", "near", "d"), (object, object, float), zip(*out))})

    pairs = held.groupBy("cut", "cell").applyInPandas(inside, "point string, near string, d double").groupBy("point", "near").agg(F.min("d").alias("d"))
    firsts = points.select(F.col("point").alias("near"), "ids")
    order = Window.partitionBy("point").orderBy("d", F.element_at("ids", 1))
    kept = pairs.join(firsts, "near").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("point", "d", "ids")
    kept = kept.unionByName(points.where("asks").select("point", F.lit(0.0).alias("d"), "ids"))
    lists_ = kept.groupBy("point").agg(F.collect_list(F.struct("d", "ids")).alias("found"))
    groups = cut(lists_.join(points.select("point", "n"), "point"), "near-found")
    answered = with_group(rows.where("asks").select("point", "id"), groups, "point", "n")
    each = answered.select(F.col("id").alias("query"), F.explode("found").alias("f")).select("query", F.col("f.d").alias("distance"), F.explode("f.ids").alias("near")).where(F.col("near") != F.col("query"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "near"))
    return each.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query", F.col("near").cast(kind).alias(key), "distance", "rank")


def vote(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(query, predicted): the most frequent label among the neighbours, the smallest of equals."""
    counts = neighbours.join(labels.select(key, label), key).groupBy("query", label).count()
    return counts.groupBy("query").agg(F.max_by(label, F.struct("count", -F.col(label))).alias("predicted"))


def assign(rows: DataFrame, centres: DataFrame, vector: str, centre: str = "centre", at: str = "at") -> DataFrame:
    """Rows with the nearest centre (ties to the smallest) and its squared distance; centres are one small array."""
    one = centres.agg(F.array_sort(F.collect_list(F.struct(centre, at))).alias("_c"))
    each = F.transform("_c", lambda c: F.struct(F.aggregate(F.zip_with(F.col(vector), c[at], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("d"), c[centre].alias(centre)))
    return rows.crossJoin(F.broadcast(one)).withColumn("_best", F.array_min(each)).withColumn(centre, F.col(f"_best.{centre}")).withColumn("d", F.col("_best.d")).drop("_best", "_c")


def update(assigned: DataFrame, vector: str, centre: str = "centre", at: str = "at") -> DataFrame:
    """New centres: means by position, partially aggregated."""
    long = assigned.select(centre, F.posexplode(vector).alias("k", "x")).groupBy(centre, "k").agg(F.avg("x").alias("m"))
    return long.groupBy(centre).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias(at))


def kmeans(rows: DataFrame, centres: DataFrame, vector: str, steps: int = 20, tol: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """Lloyd's steps from given centres: final centres, and the inertia before each step; only centres reach the driver."""
    spark, history = rows.sparkSession, []
    for _ in range(steps):
        assigned = assign(rows, centres, vector)
        history.append(assigned.agg(F.sum("d")).first()[0])
        after = {r["centre"]: list(r["at"]) for r in update(assigned, vector).collect()}
        before = {r["centre"]: list(r["at"]) for r in centres.collect()}
        merged = [(c, after.get(c, p)) for c, p in before.items()]
        shift = max(sum((x - y) ** 2 for x, y in zip(before[c], p)) ** 0.5 for c, p in merged)
        centres = spark.createDataFrame(merged, centres.schema)
        if shift <= tol:
            break
    return centres, history


def box_pairs(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(by, box_a, box_b, iou, ...): the pairs of boxes of one image with their overlap; an image has few boxes."""
    from ..functions.expressions import box_iou

    return a.join(b, by).withColumn("iou", box_iou("box_a", "box_b"))
