"""Training targets of detectors: truths at grid cells and anchors, and proposals matched with truths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boxes import area


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def targets_per_scale(truths: DataFrame, img: str, key: str, anchors: list[list[tuple[float, float]]], strides: list[int], height: int, width: int, classes: int) -> DataFrame:
    """(img, scale, anchor, row, column, key, box, label): the cells of all scales that are to find an object.

    ``truths`` has ``cx, cy, w, h, label`` beside the keys.  A truth belongs to the anchor that its size overlaps most
    (the first of equals over all scales) and to the cell of that scale in which its centre lies; boxes without a size
    and centres outside the image do not count.  Where two truths claim a cell the larger key owns it.  Boxes are cut
    to the image; a label outside the classes is null.
    """
    flat = [(w, h, s, a, strides[s]) for s, scale in enumerate(anchors) for a, (w, h) in enumerate(scale)]

    def overlap(w: float, h: float) -> Column:
        common = F.least(F.col("w"), F.lit(float(w))) * F.least(F.col("h"), F.lit(float(h)))
        return common / (F.col("w") * F.col("h") + w * h - common + 1e-7)

    inside = (F.col("w") > 0) & (F.col("h") > 0) & (F.col("cx") >= 0) & (F.col("cy") >= 0) & (F.col("cx") < width) & (F.col("cy") < height)
    best = F.array_max(F.array(*[F.struct(overlap(w, h).alias("o"), F.lit(-k).alias("k"), F.lit(s).alias("scale"), F.lit(a).alias("anchor"), F.lit(stride).alias("stride")) for k, (w, h, s, a, stride) in enumerate(flat)]))
    cells = truths.where(inside).withColumn("_b", best)
    at = lambda c: F.floor(F.col(c) / F.col("_b.stride")).cast("int")
    edge = lambda c, side, sign, most: F.greatest(F.least(F.col(c) + sign * F.col(side) / 2, F.lit(float(most))), F.lit(0.0))
    whole = box(edge("cx", "w", -1, width), edge("cy", "h", -1, height), edge("cx", "w", 1, width), edge("cy", "h", 1, height))
    label = F.when((F.col("label") >= 0) & (F.col("label") < classes), F.col("label"))
    cells = cells.select(F.col(img), F.col("_b.scale").alias("scale"), F.col("_b.anchor").alias("anchor"), at("cy").alias("row"), at("cx").alias("column"), F.struct(F.col(key).alias("key"), whole.alias("box"), label.alias("label")).alias("_t"), F.col("_b.stride").alias("_stride"))
    cells = cells.where((F.col("row") < F.floor(F.lit(height) / F.col("_stride"))) & (F.col("column") < F.floor(F.lit(width) / F.col("_stride"))))
    owner = cells.groupBy(img, "scale", "anchor", "row", "column").agg(F.max_by("_t", "_t.key").alias("_t"))
    return owner.select(img, "scale", "anchor", "row", "column", F.col("_t.key").alias(key), "_t.box", "_t.label")


def _cells(df: DataFrame, img: str, b: str, cell: float) -> DataFrame:
    span = lambda low, high: F.sequence(F.floor(F.col(f"{b}.{low}") / cell), F.floor(F.col(f"{b}.{high}") / cell))
    return df.withColumn("_cy", F.explode(span("y1", "y2"))).withColumn("_cx", F.explode(span("x1", "x2")))


def overlapping(a: DataFrame, b: DataFrame, img: str, cell: float = 64.0, eps: float = 0.0) -> DataFrame:
    """Pairs of boxes ``box_a`` and ``box_b`` of one image that overlap, with ``iou``; all columns of both.

    Boxes meet in the cells of a grid that they touch, not image by image; a pair counts in the cell that holds the
    upper left corner of what the boxes share, so once.  A box of w by h has about (1 + w / cell) (1 + h / cell) cells.
    """
    real = lambda df, c: df.where((F.col(f"{c}.x2") > F.col(f"{c}.x1")) & (F.col(f"{c}.y2") > F.col(f"{c}.y1")))
    pairs = _cells(real(a, "box_a"), img, "box_a", cell).join(_cells(real(b, "box_b"), img, "box_b", cell), [img, "_cy", "_cx"])
    x, y = F.greatest("box_a.x1", "box_b.x1"), F.greatest("box_a.y1", "box_b.y1")
    w, h = F.least("box_a.x2", "box_b.x2") - x, F.least("box_a.y2", "box_b.y2") - y
    pairs = pairs.where((w > 0) & (h > 0) & (F.floor(x / cell) == F.col("_cx")) & (F.floor(y / cell) == F.col("_cy")))
    return pairs.withColumn("iou", w * h / (area(F.col("box_a")) + area(F.col("box_b")) - w * h + eps)).drop("_cy", "_cx")


def encoded(proposal: Column, truth: Column) -> Column:
    """A truth relative to a proposal: shifts of the centre in sizes of the proposal, logs of the ratios of sizes."""
    side = lambda b, low, high: F.greatest(b[high] - b[low], F.lit(1e-6))
    pw, ph, gw, gh = side(proposal, "x1", "x2"), side(proposal, "y1", "y2"), side(truth, "x1", "x2"), side(truth, "y1", "y2")
    shift = lambda low, p, g: (truth[low] + 0.5 * g - proposal[low] - 0.5 * p) / p
    return F.struct(shift("x1", pw, gw).alias("dx"), shift("y1", ph, gh).alias("dy"), F.ln(gw / pw).alias("dw"), F.ln(gh / ph).alias("dh"))


def decoded(proposal: Column, delta: Column) -> Column:
    """The box that :func:`encoded` was given."""
    side = lambda low, high: F.greatest(proposal[high] - proposal[low], F.lit(1e-6))
    pw, ph = side("x1", "x2"), side("y1", "y2")
    cx, cy = proposal["x1"] + 0.5 * pw + delta["dx"] * pw, proposal["y1"] + 0.5 * ph + delta["dy"] * ph
    w, h = pw * F.exp(delta["dw"]), ph * F.exp(delta["dh"])
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def matched(proposals: DataFrame, truths: DataFrame, img: str, key: str, positive: float = 0.5, negative: float = 0.3, cell: float = 64.0) -> DataFrame:
    """``proposals`` (img, key, box) with the truth (img, key, box, label) that each overlaps most: ``truth``, ``iou``, ``state``, ``label``, ``delta``.

    Ties go to the smaller key.  From ``positive`` on a proposal is positive and has the truth's label and deltas; below
    ``negative`` it is negative with label 0, also if its image has no truth; between them it is ignored, with label 0.
    """
    a = proposals.select(img, F.col(key).alias("_p"), F.col("box").alias("box_a"))
    b = truths.select(img, F.col(key).alias("_t"), F.col("box").alias("box_b"), F.col("label").alias("_label"))
    rank = F.row_number().over(Window.partitionBy(img, "_p").orderBy(F.desc("iou"), "_t"))
    best = overlapping(a, b, img, cell).withColumn("_r", rank).where("_r = 1").select(F.col(img).alias("_img"), "_p", "_t", "box_b", "_label", "iou")
    out = proposals.join(best, (F.col(img) == F.col("_img")) & (F.col(key) == F.col("_p")), "left")
    iou = F.coalesce("iou", F.lit(0.0))
    hit = iou >= positive
    state = F.when(hit, "positive").when(iou < negative, "negative").otherwise("ignored")
    return out.select(*[F.col(c) for c in proposals.columns], F.col("_t").alias("truth"), iou.alias("iou"), state.alias("state"), F.when(hit, F.col("_label")).otherwise(0).alias("label"), F.when(hit, encoded(F.col("box"), F.col("box_b"))).alias("delta"))


def decoded_cells(df: DataFrame, anchors: list[tuple[float, float]], stride: int, height: int, width: int, values: str = "values") -> DataFrame:
    """``df`` (anchor, row, column, values) with ``box``, ``score`` and ``classes`` from a head's numbers: two for the centre, two for the size, one for an object, one a class."""
    v = lambda k: F.element_at(values, k + 1).cast("double")
    one = lambda x: 1 / (1 + F.exp(-x))
    side = lambda k, at: F.exp(v(k)) * F.element_at(F.lit([float(a[at]) for a in anchors]), F.col("anchor") + 1)
    cx, cy = (one(v(0)) + F.col("column")) * stride, (one(v(1)) + F.col("row")) * stride
    inside = lambda x, most: F.greatest(F.least(x, F.lit(float(most))), F.lit(0.0))
    whole = box(inside(cx - side(2, 0) / 2, width), inside(cy - side(3, 1) / 2, height), inside(cx + side(2, 0) / 2, width), inside(cy + side(3, 1) / 2, height))
    classes = F.transform(F.slice(values, F.lit(6), F.greatest(F.size(values) - 5, F.lit(0))), lambda x: one(x.cast("double")))
    return df.withColumn("box", whole).withColumn("score", one(v(4))).withColumn("classes", classes)


def anchor_boxes(images: DataFrame, sizes: list[float], ratios: list[float], stride: int, rows: int, columns: int) -> DataFrame:
    """``images`` with a row for every anchor: ``row``, ``column``, ``anchor`` and ``box`` of the given sizes and ratios (height to width) about the cells' centres."""
    shapes = [((s * s / r) ** 0.5, (s * s * r) ** 0.5) for s in sizes for r in ratios]
    each = images.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).withColumn("anchor", F.explode(F.sequence(F.lit(0), F.lit(len(shapes) - 1))))
    w, h = (F.element_at(F.lit([s[k] for s in shapes]), F.col("anchor") + 1) for k in (0, 1))
    x, y = (F.col("column") + 0.5) * stride, (F.col("row") + 0.5) * stride
    return each.withColumn("box", box(x - w / 2, y - h / 2, x + w / 2, y + h / 2))
