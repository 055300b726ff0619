"""Queries of images, windows over pixels, detection targets, record files, spectra and early stopping.

The 64 components of a vector are an image of 8 by 8 here.
"""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import detection, images, pixels, spectra
from ..sources.records import unpacked_idx
from ..streaming import stopping
from .registry import query, table

_P = "(SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings)"


def _pictures(spark, sf, c=1, h=8, w=8):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", F.lit(c).alias("c"), F.lit(h).alias("h"), F.lit(w).alias("w"), v.alias("pixels"))


def _values(df, *keys):
    return pixels.pixel_rows(df, *keys).select(*keys, "y", "x", (F.round("value", 6) + 0.0).alias("value"))


@query(f"SELECT vec_id, y, x, round(v[(7 - x) * 8 + y + 1], 6) + 0 AS value FROM {_P}, range(8) AS a(y), range(8) AS b(x)")
def picture_turns(spark, sf):
    """Every image turned by a quarter."""
    return _values(images.warped(_pictures(spark, sf), images.quarter_turns(1)), "vec_id")


@query(f"""WITH g AS (SELECT y, x, y * 7 / 4.0 AS sy, x * 7 / 10.0 AS sx FROM range(5) AS a(y), range(11) AS b(x)),
f AS (SELECT y, x, floor(sy)::INT AS y0, floor(sx)::INT AS x0, sy - floor(sy) AS fy, sx - floor(sx) AS fx FROM g)
SELECT vec_id, y, x, round((1 - fy) * ((1 - fx) * v[y0 * 8 + x0 + 1] + fx * v[y0 * 8 + least(x0 + 1, 7) + 1]) + fy * ((1 - fx) * v[least(y0 + 1, 7) * 8 + x0 + 1] + fx * v[least(y0 + 1, 7) * 8 + least(x0 + 1, 7) + 1]), 6) + 0 AS value FROM {_P}, f""")
def picture_sizes(spark, sf):
    """Every image in 5 by 11."""
    return _values(images.resized(_pictures(spark, sf), 5, 11), "vec_id")


@query(f"""SELECT vec_id, crop, y, x, round(v[(y + CASE WHEN crop % 5 < 2 THEN 0 WHEN crop % 5 < 4 THEN 3 ELSE 1 END) * 8 + (CASE WHEN crop >= 5 THEN 5 - x ELSE x END) + CASE WHEN crop % 5 IN (0, 2) THEN 0 WHEN crop % 5 < 4 THEN 2 ELSE 1 END + 1], 6) + 0 AS value
FROM {_P}, range(5) AS a(y), range(6) AS b(x), range(10) AS k(crop)""")
def picture_crops(spark, sf):
    """The corners and the centre of every image, and the same mirrored."""
    found = images.corner_crops(_pictures(spark, sf), 5, 6, mirrored=True)
    return _values(found, "vec_id", "crop").withColumn("crop", F.col("crop").cast("long"))


@query()
def picture_augmentations(spark, sf):
    """Every image under every drawn change: its size and the sum of its pixels after it."""
    base = _pictures(spark, sf, 3, 4, 4).withColumn("pixels", F.transform(F.slice("pixels", 1, 48), lambda x: 1 / (1 + F.exp(-8 * x))))
    k = "vec_id"
    made = {
        "rotation": images.warped(base, images.rotation(k, 30)),
        "translation": images.warped(base, images.translation(k, 1)),
        "shear": images.warped(base, images.shearing(k)),
        "zoom": images.warped(base, images.zooming(k)),
        "affine": images.warped(base, images.affinity(k)),
        "perspective": images.perspective(base, images.jittered_corners(k)),
        "crop": images.crop_padded(base, k, 4, 4, 1),
        "colour": images.colour_jittered(base, k, 0.1, 0.2, 0.3, 0.1),
        "gamma": images.gamma_corrected(base, k),
        "grey": images.chance_of(base, images.greyed, k, 0.5),
        "solarize": images.solarized(base),
        "posterize": images.posterized(base),
        "equalize": images.equalized(base),
        "noise": images.noisy(base, k),
        "salt": images.salted(base, k, 0.2),
        "erase": images.erased(base, k),
        "grid": images.grid_masked(base, k, 2, 3),
        "blocky": images.blocky(base, k),
        "channel": images.channel_dropped(base, k),
        "elastic": images.elastic(base, k, 2.0, 1.0),
        "blur": pixels.blurred(base, k),
        "motion": pixels.motion_blurred(base, k, 3),
    }
    out = None
    for name, df in made.items():
        total = F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x)
        own = df.select(F.lit(name).alias("kind"), "vec_id", "c", "h", "w", F.round(total, 6).alias("total"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""WITH w AS (SELECT vec_id, y, x, v[(y * 2 + a) * 8 + x * 2 + b + 1] AS p FROM {_P}, range(3) AS i(y), range(3) AS j(x), range(3) AS k(a), range(3) AS l(b))
SELECT vec_id, y, x, round(avg(p), 6) + 0 AS average, round(max(p), 6) + 0 AS largest FROM w GROUP BY ALL""")
def picture_pools(spark, sf):
    """Averages and largest values of windows of 3 by 3, every second place."""
    base = _pictures(spark, sf)
    a, b = (pixels.pixel_rows(pixels.pooled(base, 3, 2, kind=kind), "vec_id").select("vec_id", "y", "x", (F.round("value", 6) + 0.0).alias(kind)) for kind in ("average", "largest"))
    return a.join(b, ["vec_id", "y", "x"])


@query("SELECT vec_id, y * 4 + x AS patch, " + ", ".join(f"v[(y * 2 + {k // 2}) * 8 + x * 2 + {k % 2 + 1}] AS p{k}" for k in range(4)) + f" FROM {_P}, range(4) AS a(y), range(4) AS b(x)")
def picture_patches(spark, sf):
    """The sixteen patches of 2 by 2 of every image."""
    return pixels.patches(_pictures(spark, sf), 2, 2).select("vec_id", F.col("patch").cast("long").alias("patch"), *[F.col("pixels")[k].alias(f"p{k}") for k in range(4)])


_LINE = "k AS (SELECT d, exp(-d * d / 2.0) / (SELECT sum(exp(-e * e / 2.0)) FROM range(-2, 3) AS s(e)) AS w FROM range(-2, 3) AS r(d))"


@query(f"""WITH {_LINE}, p AS (SELECT vec_id, y, x, v[y * 8 + x + 1] AS p FROM {_P}, range(8) AS a(y), range(8) AS b(x))
SELECT p.vec_id, p.y - i.d AS y, p.x - j.d AS x, round(sum(p.p * i.w * j.w), 6) + 0 AS value FROM p, k i, k j WHERE p.y - i.d BETWEEN 0 AND 7 AND p.x - j.d BETWEEN 0 AND 7 GROUP BY ALL""")
def picture_blur_by_tiles(spark, sf):
    """Every image cut into tiles of 3 by 3 and blurred tile by tile."""
    line = pixels.gaussian(2, 1.0)
    tiles = pixels.tile_filtered(pixels.tiled(_pictures(spark, sf), "vec_id", 3), "vec_id", line, line)
    found = pixels.pixel_rows(tiles, "vec_id", "ty", "tx")
    return found.select("vec_id", (F.col("ty") * 3 + F.col("y")).cast("long").alias("y"), (F.col("tx") * 3 + F.col("x")).cast("long").alias("x"), (F.round("value", 6) + 0.0).alias("value"))


@query(f"""WITH k AS (SELECT d, exp(-d * d / 4.5) / (SELECT sum(exp(-e * e / 4.5)) FROM range(-2, 3) AS s(e)) AS w FROM range(-2, 3) AS r(d)),
p AS (SELECT a.vec_id, y, x, a.v[y * 8 + x + 1] AS p, b.v[y * 8 + x + 1] AS q FROM {_P} a JOIN {_P} b ON b.vec_id = a.vec_id + 1, range(8) AS s(y), range(8) AS t(x)),
m AS (SELECT vec_id, y - i.d AS y, x - j.d AS x, sum(p * i.w * j.w) AS p, sum(q * i.w * j.w) AS q, sum(p * p * i.w * j.w) AS pp, sum(q * q * i.w * j.w) AS qq, sum(p * q * i.w * j.w) AS pq
      FROM p, k i, k j WHERE y - i.d BETWEEN 0 AND 7 AND x - j.d BETWEEN 0 AND 7 GROUP BY ALL)
SELECT vec_id, round(avg((2 * p * q + 0.0001) * (2 * (pq - p * q) + 0.0009) / ((p * p + q * q + 0.0001) * (pp - p * p + qq - q * q + 0.0009) + 1e-12)), 6) + 0 AS ssim FROM m GROUP BY vec_id""")
def picture_similarity(spark, sf):
    """The structural similarity of every image and the next one."""
    base = _pictures(spark, sf)
    after = base.select((F.col("vec_id") - 1).alias("vec_id"), F.col("pixels").alias("other"))
    return pixels.ssim(base.join(after, "vec_id"), size=5).select("vec_id", (F.round("ssim", 6) + 0.0).alias("ssim"))


# detection

_TRUTH = "(SELECT p_partkey AS k, p_partkey // 20 AS img, (p_partkey * 37 % 416)::DOUBLE AS cx, (p_partkey * 53 % 416)::DOUBLE AS cy, (p_size * 3 + 4)::DOUBLE AS w, (p_partkey * 7 % 90 + 5)::DOUBLE AS h, (p_partkey % 4)::INT AS label FROM part)"
_ANCHORS = [[(10, 13), (33, 23)], [(62, 45), (59, 119)], [(116, 90), (156, 198)]]
_STRIDES = [8, 16, 32]


def _truths(spark, sf):
    k = F.col("p_partkey")
    number = lambda e: e.cast("double")
    return table(spark, sf, "part").select(k.alias("k"), F.floor(k / 20).alias("img"), number(k * 37 % 416).alias("cx"), number(k * 53 % 416).alias("cy"), number(F.col("p_size") * 3 + 4).alias("w"), number(k * 7 % 90 + 5).alias("h"), (k % 4).cast("int").alias("label"))


@query(f"""WITH a AS (SELECT * FROM (VALUES {', '.join(f'({s}, {n}, {s * 2 + n}, {w}, {h}, {_STRIDES[s]})' for s, scale in enumerate(_ANCHORS) for n, (w, h) in enumerate(scale))}) AS t(scale, anchor, number, aw, ah, stride)),
o AS (SELECT t.*, a.*, row_number() OVER (PARTITION BY k ORDER BY least(w, aw) * least(h, ah) / (w * h + aw * ah - least(w, aw) * least(h, ah) + 1e-7) DESC, number) AS r FROM {_TRUTH} t, a),
c AS (SELECT *, floor(cy / stride)::INT AS "row", floor(cx / stride)::INT AS "column" FROM o WHERE r = 1)
SELECT img, scale, anchor, "row", "column", max(k) AS k, arg_max(greatest(cx - w / 2, 0), k) AS x1, arg_max(least(cy + h / 2, 416), k) AS y2, arg_max(CASE WHEN label < 3 THEN label ELSE -1 END, k) AS label
FROM c GROUP BY img, scale, anchor, "row", "column" """)
def detection_targets(spark, sf):
    """The cells and anchors that are to find the objects of every image."""
    found = detection.targets_per_scale(_truths(spark, sf), "img", "k", _ANCHORS, _STRIDES, 416, 416, 3)
    return found.select("img", "scale", "anchor", "row", "column", "k", F.col("box.x1").alias("x1"), F.col("box.y2").alias("y2"), F.coalesce("label", F.lit(-1)).alias("label"))


@query(f"""WITH t AS (SELECT k, img, label + 1 AS label, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM {_TRUTH}),
q AS (SELECT k, img, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM (SELECT t.k, t.img, t.x1 + t.k % 5 AS x1, t.y1 - t.k % 9 AS y1, t.x2 - t.x1 + t.k % 13 AS w, t.y2 - t.y1 + t.k % 3 AS h FROM t)),
o AS (SELECT q.img, q.k, t.k AS truth, t.label, greatest(least(q.x2, t.x2) - greatest(q.x1, t.x1), 0) * greatest(least(q.y2, t.y2) - greatest(q.y1, t.y1), 0) AS i, (q.x2 - q.x1) * (q.y2 - q.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS s,
      (t.x1 + t.x2 - q.x1 - q.x2) / 2 / (q.x2 - q.x1) AS dx, ln((t.y2 - t.y1) / (q.y2 - q.y1)) AS dh FROM q JOIN t ON t.img = q.img),
r AS (SELECT *, i / (s - i) AS iou, row_number() OVER (PARTITION BY img, k ORDER BY i / (s - i) DESC, truth) AS r FROM o)
SELECT img, k, CASE WHEN iou > 0 THEN truth ELSE -1 END AS truth, round(iou, 9) AS iou, CASE WHEN iou >= 0.5 THEN 'positive' WHEN iou < 0.3 THEN 'negative' ELSE 'ignored' END AS state, CASE WHEN iou >= 0.5 THEN label ELSE 0 END AS label,
  CASE WHEN iou >= 0.5 THEN round(dx, 9) + 0 END AS dx, CASE WHEN iou >= 0.5 THEN round(dh, 9) + 0 END AS dh FROM r WHERE r = 1""")
def proposals_matched(spark, sf):
    """A shifted copy of every object as a proposal, with the object that it overlaps most."""
    t, k = _truths(spark, sf), F.col("k")
    x1, y1 = F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2
    truths = t.select("img", "k", detection.box(x1, y1, F.col("cx") + F.col("w") / 2, F.col("cy") + F.col("h") / 2).alias("box"), (F.col("label") + 1).alias("label"))
    px, py = x1 + k % 5, y1 - k % 9
    proposals = t.select("img", "k", detection.box(px, py, px + F.col("w") + k % 13, py + F.col("h") + k % 3).alias("box"))
    found = detection.matched(proposals, truths, "img", "k")
    delta = lambda c: (F.round(f"delta.{c}", 9) + 0.0).alias(c)
    return found.select("img", "k", F.coalesce("truth", F.lit(-1)).alias("truth"), F.round("iou", 9).alias("iou"), "state", "label", delta("dx"), delta("dh"))


# record files


@query("""SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, list_sum(list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 100)))::BIGINT AS total,
floor((embedding[64]::DOUBLE + 1) * 100)::BIGINT AS last FROM embeddings""")
def idx_records(spark, sf):
    """The vectors of each label packed as an IDX file of images, and read again."""
    small = F.transform("pixels", lambda x: F.floor((x + 1) * 100).cast("int"))
    rows = _pictures(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id").select("label", "vec_id", small.alias("values"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.array(pdf.sort_values("vec_id")["values"].tolist(), np.uint8)
        head = b"\0\0\x08\x03" + b"".join(int(n).to_bytes(4, "big") for n in (len(values), 8, 8))
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "content": [gzip.compress(head + values.tobytes(), 1)]})

    found = unpacked_idx(rows.groupBy("label").applyInPandas(pack, "label int, content binary"))
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x).cast("long")
    return found.select("label", "pos", total.alias("total"), F.element_at("values", -1).cast("long").alias("last"))


# spectra


@query(f"SELECT vec_id, round(list_sum([x * x FOR x IN v]), 6) AS energy, round(list_sum(v), 6) + 0 AS mean FROM {_P}")
def spectrum_energy(spark, sf):
    """The energy of every vector from its spectrum, and the sum of its values from the first frequency."""
    found = spectra.power(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v")
    inner = F.aggregate(F.slice("power", 2, 31), F.lit(0.0), lambda s, x: s + x)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return found.select("vec_id", F.round((F.element_at("power", 1) + 2 * inner + F.element_at("power", 33)) / 64, 6).alias("energy"), (F.round(F.signum(total) * F.sqrt(F.element_at("power", 1)), 6) + 0.0).alias("mean"))


@query()
def frequency_dropout(spark, sf):
    """Every vector without a drawn band of its frequencies, at an even chance."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return spectra.frequency_dropout(v, "vec_id", "v", chance=0.5).select("vec_id", F.transform("v", lambda x: F.round(x, 9)).alias("v"))


# early stopping


@query("""WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value FROM events),
b AS (SELECT *, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved, min(value) OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS best FROM r),
w AS (SELECT *, max(CASE WHEN improved THEN step END) OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS best_step FROM b),
s AS (SELECT *, min(CASE WHEN step - best_step >= 5 THEN step END) OVER (PARTITION BY user_id) AS stop FROM w)
SELECT user_id::VARCHAR AS run, step, value, improved, best, best_step, step - best_step AS waited, step IS NOT DISTINCT FROM stop AS stopped FROM s WHERE stop IS NULL OR step <= stop""")
def early_stopping(spark, sf):
    """Every user's values as the steps of a run that stops when five in a row are no better."""
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return stopping.early_stopping(table(spark, sf, "events").withColumn("step", step), "user_id", "step", "value")
