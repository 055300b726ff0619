"""Queries of elementwise mathematics, activations, losses and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import vectors as V
from .registry import query, table

#: A value in about [-2.5, 2.5] from an order line, in both engines.
_X = "((l_quantity - 25) / 10)"
_ACTIVATIONS = {
    "linear": "x",
    "relu": "greatest(x, 0)",
    "leaky_relu": "CASE WHEN x > 0 THEN x ELSE x * 0.01::DOUBLE END",
    "relu6": "greatest(least(x, 6), 0)",
    "sigmoid": "1 / (1 + exp(-x))",
    "log_sigmoid": "-ln(1 + exp(-x))",
    "softplus": "ln(1 + exp(x))",
    "swish": "x / (1 + exp(-x))",
    "mish": "x * tanh(ln(1 + exp(x)))",
    "gelu": "0.5::DOUBLE * x * (1 + tanh(0.7978845608028654::DOUBLE * (x + 0.044715::DOUBLE * x * x * x)))",
    "elu": "CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END",
    "selu": "1.0507009873554805::DOUBLE * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772::DOUBLE * (exp(x) - 1) END",
    "tanh": "tanh(x)",
}


@query("SELECT l_returnflag, " + ", ".join(f"round(avg({e}), 6) AS {n}" for n, e in _ACTIVATIONS.items()) + f" FROM (SELECT l_returnflag, {_X} AS x FROM lineitem) GROUP BY l_returnflag")
def activations(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", ((F.col("l_quantity") - 25) / 10).alias("x"))
    return d.groupBy("l_returnflag").agg(*[F.round(F.avg(X.activation(n)(F.col("x"))), 6).alias(n) for n in _ACTIVATIONS])


@query(
    f"""SELECT l_linestatus, round(avg(exp(x)), 6) AS exp_x, round(avg(CASE WHEN x > 0 THEN ln(x) END), 6) AS log_x, round(avg(sqrt(abs(x))), 6) AS sqrt_abs,
round(avg(greatest(least(x, 1), -1)), 6) AS clipped, round(avg(power(abs(x), 1.5::DOUBLE)), 6) AS power_x, round(avg(greatest(x, t)), 6) AS largest, round(avg(least(x, t)), 6) AS smallest,
round(avg(CASE WHEN x > 0 THEN x ELSE t END), 6) AS chosen, round(avg(x / nullif(t, 0)), 4) AS ratio, round(avg(-x + t - x * t), 6) AS mixed
FROM (SELECT l_linestatus, {_X} AS x, l_tax AS t FROM lineitem) GROUP BY l_linestatus"""
)
def elementwise(spark, sf):
    d = table(spark, sf, "lineitem").select("l_linestatus", ((F.col("l_quantity") - 25) / 10).alias("x"), F.col("l_tax").alias("t"))
    x, t = F.col("x"), F.col("t")
    forms = {"exp_x": (F.exp(x), 6), "log_x": (F.when(x > 0, F.ln(x)), 6), "sqrt_abs": (F.sqrt(F.abs(x)), 6), "clipped": (X.clip(x, -1, 1), 6), "power_x": (F.pow(F.abs(x), F.lit(1.5)), 6), "largest": (F.greatest(x, t), 6), "smallest": (F.least(x, t), 6), "chosen": (F.when(x > 0, x).otherwise(t), 6), "ratio": (X.safe_divide(x, t), 4), "mixed": (-x + t - x * t, 6)}
    return d.groupBy("l_linestatus").agg(*[F.round(F.avg(e), k).alias(n) for n, (e, k) in forms.items()])


@query(
    """SELECT o_orderpriority, sum((a = b)::INT)::BIGINT AS n_eq, sum((a <> b)::INT)::BIGINT AS n_ne, sum((a < b)::INT)::BIGINT AS n_lt, sum((a <= b)::INT)::BIGINT AS n_le,
sum((a > b)::INT)::BIGINT AS n_gt, sum((a >= b)::INT)::BIGINT AS n_ge, sum((p AND q)::INT)::BIGINT AS n_and, sum((p OR q)::INT)::BIGINT AS n_or, sum((p <> q)::INT)::BIGINT AS n_xor,
sum((NOT p)::INT)::BIGINT AS n_not, bool_and(p OR q) AS all_either, bool_or(p AND q) AS any_both
FROM (SELECT o_orderpriority, o_orderkey % 5 AS a, o_custkey % 5 AS b, o_totalprice > 150000 AS p, o_orderstatus = 'F' AS q FROM orders) GROUP BY o_orderpriority"""
)
def predicates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", (F.col("o_orderkey") % 5).alias("a"), (F.col("o_custkey") % 5).alias("b"), (F.col("o_totalprice") > 150000).alias("p"), (F.col("o_orderstatus") == "F").alias("q"))
    a, b, p, q = (F.col(c) for c in "abpq")
    forms = {"n_eq": a == b, "n_ne": a != b, "n_lt": a < b, "n_le": a <= b, "n_gt": a > b, "n_ge": a >= b, "n_and": p & q, "n_or": p | q, "n_xor": p != q, "n_not": ~p}
    return o.groupBy("o_orderpriority").agg(*[F.count_if(e).alias(n) for n, e in forms.items()], F.bool_and(p | q).alias("all_either"), F.bool_or(p & q).alias("any_both"))


_LOSS = "(SELECT o_orderstatus AS g, (o_totalprice % 1000) / 1000 AS y, (o_custkey % 97 + 1) / 99.0::DOUBLE AS p, (o_orderkey % 2)::DOUBLE AS t FROM orders)"


@query(
    f"""SELECT g, round(avg(abs(p - y)), 6) AS mae, round(avg((p - y) * (p - y)), 6) AS mse, round(avg(CASE WHEN abs(p - y) < 0.5 THEN (p - y) * (p - y) ELSE abs(p - y) - 0.25::DOUBLE END), 6) AS huber,
round(avg(-(t * ln(p) + (1 - t) * ln(1 - p))), 6) AS bce, round(avg(ln(1 + exp(-abs(p))) + greatest(p, 0) - p * t), 6) AS bce_logits,
round(pow(1 - exp(-avg(-(t * ln(p) + (1 - t) * ln(1 - p)))), 2) * avg(-(t * ln(p) + (1 - t) * ln(1 - p))) * 0.25::DOUBLE, 6) AS focal,
round(1 - (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1), 6) AS dice FROM {_LOSS} GROUP BY g"""
)
def losses(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("g"), (F.col("o_totalprice") % 1000 / 1000).alias("y"), ((F.col("o_custkey") % 97 + 1) / 99.0).alias("p"), (F.col("o_orderkey") % 2).cast("double").alias("t"))
    y, p, t = F.col("y"), F.col("p"), F.col("t")
    bce = F.avg(X.binary_cross_entropy(p, t))
    out = {"mae": F.avg(X.absolute_error(p, y)), "mse": F.avg(X.squared_error(p, y)), "huber": F.avg(X.huber(p, y, 0.5)), "bce": bce, "bce_logits": F.avg(X.binary_cross_entropy_with_logits(p, t)), "focal": X.focal(bce), "dice": X.dice_loss(F.sum(p * t), F.sum(p), F.sum(t), 1.0)}
    return d.groupBy("g").agg(*[F.round(e, 6).alias(n) for n, e in out.items()])


_VEC = "(SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings)"


@query(
    f"""SELECT vec_id, round(list_sum(v), 5) AS total, round(list_avg(v), 6) AS mean, round(list_var_pop(v), 6) AS variance, round(list_max(v), 6) AS largest, round(list_min(v), 6) AS smallest,
list_position(v, list_max(v)) - 1 AS argmax, list_position(v, list_min(v)) - 1 AS argmin, round(sqrt(list_sum([x * x FOR x IN v])), 5) AS l2, round(list_sum([abs(x) FOR x IN v]), 5) AS l1,
round(list_max(v) + ln(list_sum([exp(x - list_max(v)) FOR x IN v])), 5) AS logsumexp, round(list_max([exp(x - list_max(v)) FOR x IN v]) / list_sum([exp(x - list_max(v)) FOR x IN v]), 6) AS top_softmax FROM {_VEC}"""
)
def vector_reductions(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = F.col("v")
    out = {"total": (V.vsum(v), 5), "mean": (V.vmean(v), 6), "variance": (V.vvar(v), 6), "largest": (F.array_max(v), 6), "smallest": (F.array_min(v), 6), "l2": (V.norm(v), 5), "l1": (V.norm(v, 1), 5), "logsumexp": (V.logsumexp(v), 5), "top_softmax": (F.array_max(V.softmax(v)), 6)}
    return e.select("vec_id", *[F.round(x, k).alias(n) for n, (x, k) in out.items()], V.argmax(v).alias("argmax"), V.argmin(v).alias("argmin"))


@query(
    f"""SELECT vec_id, round(v[1] / (sqrt(list_sum([x * x FOR x IN v])) + 1e-8), 6) AS unit_first, round(CASE WHEN n > 1 THEN v[1] / n ELSE v[1] END, 6) AS renormed_first, round(v[64], 6) AS rolled_first,
round(v[3] + v[1], 6) AS gathered, len(v[1:8]) AS sliced, round(list_sum(v[1:5]), 5) AS running_five, round(v[2], 6) AS transposed, (SELECT sum((x < 0)::INT) FROM (SELECT unnest(v) AS x))::INT AS below_zero
FROM (SELECT *, sqrt(list_sum([x * x FOR x IN v])) AS n FROM {_VEC})"""
)
def vector_shapes(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = F.col("v")
    first = lambda a, k=1: F.round(F.element_at(a, k), 6)
    picked = V.gather(v, F.array(F.lit(2), F.lit(0)))
    out = {"unit_first": first(V.l2_normalize(v)), "renormed_first": first(V.renorm(v)), "rolled_first": first(V.roll(v, 1)), "gathered": F.round(V.vsum(picked), 6), "sliced": F.size(F.slice(v, 1, 8)).cast("long"), "running_five": F.round(F.element_at(V.cumsum(F.slice(v, 1, 5)), 5), 5), "transposed": F.round(F.element_at(F.element_at(V.transpose(V.reshape(v, 8)), 2), 1), 6), "below_zero": V.searchsorted(F.sort_array(v), F.lit(0.0))}
    return e.select("vec_id", *[x.alias(n) for n, x in out.items()])


@query(
    f"""SELECT a.vec_id, round(1 - greatest(-1, least(1, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))))), 6) AS cosine,
round(list_sum([x * y FOR x, y IN list_zip(a.v, b.v)]), 5) AS dot FROM {_VEC} a JOIN {_VEC} b ON b.vec_id = a.vec_id + 1""".replace("[x * y FOR x, y IN list_zip(a.v, b.v)]", "list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])")
)
def cosine_loss(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    dot = V.dot(F.col("v"), F.col("w"))
    return pairs.select("vec_id", F.round(1 - X.clip(dot / (V.norm(F.col("v")) * V.norm(F.col("w"))), -1, 1), 6).alias("cosine"), F.round(dot, 5).alias("dot"))
