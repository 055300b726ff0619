"""Boxes as structs (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clipped(box: Column, width: float, height: float) -> Column:
    """A box cut to an image."""
    inside = lambda c, most: F.greatest(F.least(c, F.lit(float(most))), F.lit(0.0))
    return F.struct(inside(box["x1"], width).alias("x1"), inside(box["y1"], height).alias("y1"), inside(box["x2"], width).alias("x2"), inside(box["y2"], height).alias("y2"))


def at_least(box: Column, size: float) -> Column:
    """Whether both sides of a box reach ``size``."""
    return (box["x2"] - box["x1"] >= size) & (box["y2"] - box["y1"] >= size)


def area(box: Column) -> Column:
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def size_iou(w: Column, h: Column, anchor_w: Column, anchor_h: Column) -> Column:
    """Overlap of two sizes that share a corner."""
    common = F.least(w, anchor_w) * F.least(h, anchor_h)
    return common / (w * h + anchor_w * anchor_h - common)


def suppressed(df: DataFrame, by: str, key: str, box: str, score: str, threshold: float) -> DataFrame:
    """The boxes that greedy suppression keeps, per image by falling score (ties to the smaller key).

    An image's boxes, few at every size of the table, are one array, folded from the best on: a box stays if no
    box kept before overlaps it by more than ``threshold``.
    """
    item = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), F.col(box).alias("b"))
    lists = df.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("_all"))

    def iou(a: Column, b: Column) -> Column:
        common = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0)) * F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
        return common / (area(a) + area(b) - common + 1e-12)

    step = lambda kept, x: F.when(F.exists(kept, lambda y: iou(y["b"], x["b"]) > threshold), kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate("_all", F.slice("_all", 1, 0), step)
    ids = lists.select(by, F.explode(kept).alias("_x")).select(by, F.col("_x.k").alias(key))
    return df.join(ids, [by, key], "left_semi")
