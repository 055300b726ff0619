"""Metrics of sequences and detections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boxes import area
from .ranks import in_ranges

EPS = 1e-12


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one number, changed by a few operations."""
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    whole = (1 << len(a)) - 1
    row = whole  # a zero at place k: the length grows at a[k]
    for y in b:
        met = row & places.get(y, 0)
        row = ((row + met) | (row - met)) & whole
    return len(a) - row.bit_count()


def lcs(a: Column, b: Column) -> Column:
    """Longest common subsequence of two arrays of strings, for rows of a sentence's size; null where one is null."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([None if x is None or y is None else common_length(list(x), list(y)) for x, y in zip(left, right)], dtype="Int64")

    return F.pandas_udf(run, "long")(a, b)


def rouge_l(common: Column, said: Column, meant: Column, beta: float = 1.2, eps: float = EPS) -> Column:
    """F-measure of a common length (of :func:`lcs`) and the sizes of prediction and target; 0 where one is empty."""
    recall, precision = common / (meant + eps), common / (said + eps)
    return F.when((said == 0) | (meant == 0), 0.0).otherwise((1 + beta * beta) * recall * precision / (recall + beta * beta * precision + eps))


def rouge_l_best(df: DataFrame, by: str, common: str, said: str, meant: str, beta: float = 1.2) -> DataFrame:
    """(by, rouge_l): the best over the references of a prediction, which are rows of the same ``by``."""
    return df.groupBy(by).agg(F.max(rouge_l(F.col(common), F.col(said), F.col(meant), beta)).alias("rouge_l"))


def _overlap(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    common = side("x1", "x2") * side("y1", "y2")
    return common / (area(a) + area(b) - common + EPS)


def detections(predicted: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(label, key, score, hit) of predictions (image, key, label, score, box) against truths (image, key, label, box).

    A prediction takes the truth of its image and label that it overlaps most (ties to the smaller key); of those that take the
    same one, the best score (ties to the smaller key) hits, if it overlaps by ``threshold``.
    """
    t = truth.select("image", "label", F.col("key").alias("_t"), F.col("box").alias("_box"))
    best = predicted.join(t, ["image", "label"]).groupBy("image", "label", "key").agg(F.first("score").alias("score"), F.max(F.struct(_overlap(F.col("box"), F.col("_box")).alias("o"), (-F.col("_t")).alias("t"))).alias("b"))
    first = Window.partitionBy("image", "label", "b.t").orderBy(F.desc("score"), "key")
    hits = best.where(F.col("b.o") >= threshold).withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select("image", "label", "key", F.lit(True).alias("_hit"))
    return predicted.join(hits, ["image", "label", "key"], "left").select("label", "key", "score", F.coalesce("_hit", F.lit(False)).alias("hit"))


def average_precision(found: DataFrame, truth: DataFrame, eps: float = EPS) -> DataFrame:
    """(label, ap) of every label with a truth, from :func:`detections`: precision, made to fall, over recall.

    Rows are ranked by falling score (ties to the smaller key) in ranges of scores, so that no label has to fit in one task.
    """
    rows = in_ranges(found, F.col("score"))
    sums = [F.sum(F.col("hit").cast("long")).alias("_h"), F.count(F.lit(1)).alias("_n")]
    per = rows.groupBy("label", "_range").agg(*sums)
    ahead = Window.partitionBy("label").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("label", "_range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_b{c}") for c in ("_h", "_n")])
    inside = Window.partitionBy("label", "_range").orderBy(F.desc("score"), "key")
    upto, rest = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.join(F.broadcast(per), ["label", "_range"])
    rows = rows.withColumn("_p", (F.col("_b_h") + F.sum(F.col("hit").cast("long")).over(upto)) / (F.col("_b_n") + F.count(F.lit(1)).over(upto) + eps))
    after = Window.partitionBy("label").orderBy(F.desc("_range")).rowsBetween(1, Window.unboundedFollowing)
    later = rows.groupBy("label", "_range").agg(F.max("_p").alias("_m")).select("label", "_range", F.max("_m").over(after).alias("_later"))
    rows = rows.withColumn("_p", F.max("_p").over(rest)).join(F.broadcast(later), ["label", "_range"])
    area_of = rows.groupBy("label").agg(F.sum(F.when(F.col("hit"), F.greatest("_p", F.coalesce("_later", F.lit(0.0)))).otherwise(0.0)).alias("_s"))
    return truth.groupBy("label").agg(F.count(F.lit(1)).alias("_g")).join(area_of, "label", "left").select("label", (F.coalesce("_s", F.lit(0.0)) / (F.col("_g") + eps)).alias("ap"))
