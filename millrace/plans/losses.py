"""Queries of class losses, long-table linear algebra, boxes and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import losses as L
from ..operators import algebra, boxes
from .registry import query, table

_V = "(SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings)"
_SOFT = f"(SELECT vec_id, label, v, list_max(v) AS top, list_sum([exp(x - list_max(v)) FOR x IN v]) AS total FROM {_V})"


def _scores(spark, sf):
    """All components as the scores of as many classes."""
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query(f"SELECT vec_id, round(-(v[label + 1] - top - ln(total)), 6) AS loss, round(-(0.9 * (v[label + 1] - top - ln(total)) + 0.1 / 64 * list_sum([x - top - ln(total) FOR x IN v])), 6) AS smooth FROM {_SOFT}")
def cross_entropy(spark, sf):
    d = _scores(spark, sf)
    return d.select("vec_id", F.round(L.cross_entropy(F.col("v"), F.col("label")), 6).alias("loss"), F.round(L.cross_entropy(F.col("v"), F.col("label"), 0.1), 6).alias("smooth"))


@query(f"SELECT round(avg(-(v[label + 1] - top - ln(total))), 6) AS nll, count(*) AS n FROM {_SOFT}")
def nll_loss(spark, sf):
    from ..functions import vectors as V

    d = _scores(spark, sf).withColumn("logp", V.log_softmax(F.col("v"), 0.0))
    return d.agg(F.round(F.avg(L.nll(F.col("logp"), F.col("label"))), 6).alias("nll"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT a.vec_id, round(greatest(list_distance(a.v, p.v) - list_distance(a.v, n.v) + 1, 0), 6) AS loss FROM {_V} a JOIN {_V} p ON p.vec_id = a.vec_id + 1 JOIN {_V} n ON n.vec_id = a.vec_id + 2")
def triplet_loss(spark, sf):
    """Every vector against the next as its like and the one after as its unlike."""
    d = _scores(spark, sf)
    next_ = lambda k: d.select((F.col("vec_id") - k).alias("vec_id"), F.col("v").alias(f"v{k}"))
    both = d.join(next_(1), "vec_id").join(next_(2), "vec_id")
    return both.select("vec_id", F.round(L.triplet(F.col("v"), F.col("v1"), F.col("v2"), 1.0), 6).alias("loss"))


@query(f"WITH s AS (SELECT vec_id, [exp(x - top) / total FOR x IN v] AS p FROM {_SOFT}) SELECT vec_id, round(list_sum([x * (ln(x) - ln(1 / 64.0)) FOR x IN p]), 6) AS kl FROM s")
def kl_divergence(spark, sf):
    from ..functions import vectors as V

    d = _scores(spark, sf).withColumn("p", V.softmax(F.col("v")))
    return d.select("vec_id", F.round(L.kl_divergence(F.col("p"), F.array_repeat(F.lit(1 / 64.0), 64)), 6).alias("kl"))


_MATRIX = "(SELECT vec_id AS i, unnest(range(1, 65)) - 1 AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _matrix(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "x"))


@query(f"SELECT a.j AS i, b.j AS j, round(sum(a.x * b.x), 4) AS x FROM {_MATRIX} a JOIN {_MATRIX} b ON a.i = b.i GROUP BY a.j, b.j")
def matmul_long(spark, sf):
    m = _matrix(spark, sf)
    return algebra.matmul(algebra.transposed(m), m).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("x", 4).alias("x"))


@query(f"SELECT round(sum(x), 6) AS trace FROM {_MATRIX} WHERE i = j")
def trace(spark, sf):
    return algebra.trace(_matrix(spark, sf)).select(F.round("trace", 6).alias("trace"))


@query(f"SELECT j, round(sum(x * x), 5) AS x FROM {_MATRIX} GROUP BY j")
def einsum_column_norms(spark, sf):
    m = _matrix(spark, sf)
    return algebra.contracted(m, m, ["i", "j"], ["j"]).select(F.col("j").cast("long").alias("j"), F.round("x", 5).alias("x"))


@query("WITH w AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings) SELECT event_id, round(v[1], 6) AS first, round(list_sum(v), 4) AS total FROM events JOIN w ON vec_id = user_id % 100")
def embedding_lookup(spark, sf):
    w = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    found = algebra.lookup(table(spark, sf, "events").select("event_id", (F.col("user_id") % 100).alias("id")), "id", w, "vec_id")
    return found.select("event_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""WITH o AS (SELECT user_id, epoch_ms(ts)::DOUBLE AS t, min(value) AS v FROM events GROUP BY ALL), q AS (SELECT event_id, user_id, epoch_ms(ts)::DOUBLE + 1800000 AS t FROM events WHERE event_type = 'click'),
a AS (SELECT q.event_id, max(o.t) FILTER (o.t <= q.t) AS t0, min(o.t) FILTER (o.t >= q.t) AS t1, any_value(q.t) AS t, any_value(q.user_id) AS user_id FROM q JOIN o USING (user_id) GROUP BY q.event_id)
SELECT event_id, floor(1000 * CASE WHEN t1 IS NULL THEN x.v WHEN t0 = t1 THEN x.v ELSE x.v + (y.v - x.v) * (a.t - t0) / (t1 - t0) END)::BIGINT AS value FROM a JOIN o x ON x.user_id = a.user_id AND x.t = t0 LEFT JOIN o y ON y.user_id = a.user_id AND y.t = t1""")
def interpolated(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    known = e.groupBy("user_id", "t").agg(F.min("value").alias("v"))
    asked = e.where("event_type = 'click'").select("event_id", "user_id", (F.col("t") + 1800000).alias("t"))
    return algebra.interpolated(asked, known, ["user_id"], "t", "v").select("event_id", F.floor(F.col("v") * 1000).alias("value"))


_BOX = "(SELECT p_partkey AS k, p_partkey // 20 AS img, (p_partkey * 7 % 40 - 5)::DOUBLE AS x1, (p_partkey * 11 % 40 - 5)::DOUBLE AS y1, (p_partkey * 7 % 40 + 5 + p_size)::DOUBLE AS x2, (p_partkey * 11 % 40 + 15)::DOUBLE AS y2, (p_partkey * 37 % 101)::DOUBLE AS score FROM part)"


def _boxes(spark, sf):
    k, number = F.col("p_partkey"), lambda e: e.cast("double")
    box = F.struct(number(k * 7 % 40 - 5).alias("x1"), number(k * 11 % 40 - 5).alias("y1"), number(k * 7 % 40 + 5 + F.col("p_size")).alias("x2"), number(k * 11 % 40 + 15).alias("y2"))
    return table(spark, sf, "part").select(k.alias("k"), F.floor(k / 20).alias("img"), box.alias("box"), number(k * 37 % 101).alias("score"))


@query(f"WITH c AS (SELECT k, greatest(least(x1, 50), 0) AS x1, greatest(least(y1, 40), 0) AS y1, greatest(least(x2, 50), 0) AS x2, greatest(least(y2, 40), 0) AS y2 FROM {_BOX}) SELECT k, (x2 - x1) * (y2 - y1) AS area FROM c WHERE x2 - x1 >= 10 AND y2 - y1 >= 10")
def clipped_boxes(spark, sf):
    d = _boxes(spark, sf).withColumn("box", boxes.clipped(F.col("box"), 50, 40)).where(boxes.at_least(F.col("box"), 10))
    return d.select("k", boxes.area(F.col("box")).alias("area"))


@query(f"WITH s AS (SELECT k, x2 - x1 AS w, y2 - y1 AS h FROM {_BOX}) SELECT k, round(least(w, 20) * least(h, 30) / (w * h + 600 - least(w, 20) * least(h, 30)), 6) AS iou FROM s")
def anchor_overlaps(spark, sf):
    b = F.col("box")
    return _boxes(spark, sf).select("k", F.round(boxes.size_iou(b["x2"] - b["x1"], b["y2"] - b["y1"], F.lit(20.0), F.lit(30.0)), 6).alias("iou"))


@query(f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, k) AS r FROM {_BOX}), o AS (SELECT a.img, a.r AS ra, c.r AS rb FROM b a JOIN b c ON a.img = c.img AND a.r < c.r
WHERE greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) > 0.5 * ((a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0))),
n AS (SELECT img, 1::BIGINT AS r, [1::BIGINT] AS kept FROM b WHERE r = 1 UNION ALL SELECT n.img, n.r + 1, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.img = n.img AND o.rb = n.r + 1 AND list_contains(n.kept, o.ra)) THEN n.kept ELSE list_append(n.kept, n.r + 1) END FROM n JOIN b ON b.img = n.img AND b.r = n.r + 1)
SELECT b.k FROM b JOIN (SELECT img, arg_max(kept, r) AS kept FROM n GROUP BY img) f ON f.img = b.img WHERE list_contains(f.kept, b.r)""")
def nms(spark, sf):
    return boxes.suppressed(_boxes(spark, sf), "img", "k", "box", "score", 0.5).select("k")
