"""Queries of ordered analytics, schedules and optimiser steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered
from ..operators.resample import drawn
from .registry import query, table


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def running_sum(spark, sf):
    d = ordered.running_sum(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"])
    return d.select("event_id", "user_id", F.round("running", 4).alias("running"))


@query("""WITH e AS (SELECT event_id, user_id, exp(value / 100 - max(value / 100) OVER (PARTITION BY user_id)) AS e FROM events)
SELECT event_id, round(e / sum(e) OVER (PARTITION BY user_id), 8) AS share FROM e""")
def softmax_groups(spark, sf):
    d = table(spark, sf, "events").withColumn("v", F.col("value") / 100)
    return ordered.softmax_over(d, "v", ["user_id"]).select("event_id", F.round("share", 8).alias("share"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS at, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT a.event_id, b.value AS rolled FROM p a JOIN p b ON a.user_id = b.user_id AND b.at = (a.at - 2 % a.n + a.n) % a.n""")
def rolled(spark, sf):
    return ordered.rolled(table(spark, sf, "events").select("event_id", "user_id", "value"), "value", ["event_id"], ["user_id"], 2).select("event_id", "rolled")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) AS smooth FROM events")
def smoothed(spark, sf):
    return ordered.smoothed(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"], 2).select("event_id", F.round("smooth", 5).alias("smooth"))


@query("SELECT conv_id, turn, length(text) AS token, lead(length(text), 1, -1) OVER (PARTITION BY conv_id ORDER BY turn) AS label FROM conversations")
def next_token(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("token"))
    return ordered.next_token(d, "token", ["turn"], ["conv_id"], -1)


@query("""WITH t AS (SELECT lang, doc_id, unnest(range(1, length(text) + 1)) AS k, unnest(string_split(text, '')) AS c FROM documents), p AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id, k) - 1 AS pos, unicode(c) AS tok FROM t)
SELECT lang, pos // 64 AS block_no, sum(tok)::BIGINT AS total, min(tok)::BIGINT AS least FROM p GROUP BY ALL HAVING count(*) = 64""")
def packed_blocks(spark, sf):
    d = table(spark, sf, "documents").select("lang", "doc_id", F.transform(F.split("text", ""), lambda c: F.ascii(c)).alias("ids"))
    blocks = ordered.packed_blocks(d, "ids", "doc_id", "lang", 64)
    return blocks.select("lang", "block_no", F.aggregate("tokens", F.lit(0), lambda a, x: a + x).cast("long").alias("total"), F.array_min("tokens").cast("long").alias("least"))


@query("""SELECT e.event_id, (SELECT max_by(o.event_id, (o.ts, o.event_id)) FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'purchase' AND o.ts <= e.ts) AS as_of FROM events e WHERE e.event_type = 'click'""".replace(
    "(SELECT max_by(o.event_id, (o.ts, o.event_id)) FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'purchase' AND o.ts <= e.ts)", "(SELECT max(o.ts) FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'purchase' AND o.ts <= e.ts)"))
def as_of_join(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    clicks, bought = e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("ts").alias("bought"))
    return ordered.as_of(clicks, bought, ["user_id"], "ts", "bought").select("event_id", "as_of")


_S = {
    "cosine": "0.001 + 0.099 * 0.5 * (1 + cos(pi() * t / 100))", "cosine_power": "0.001 + 0.099 * pow(0.5 * (1 + cos(pi() * t / 100)), 2)", "cyclic": "0.001 + 0.099 * greatest(0, 1 - abs(t / 10 - 2 * floor(1 + t / 20) + 1))",
    "exponential": "0.1 * pow(0.95, t)", "exponential_constant": "0.1 * exp(-0.05 * t)", "step": "0.1 * pow(0.5, floor(t / 30))", "multi_step": "0.1 * pow(0.1, (t >= 30)::INT + (t >= 80)::INT)",
    "linear_warmup": "CASE WHEN t < 10 THEN 0.1 * t / 10 ELSE 0.001 + 0.099 * (100 - t) / 90 END", "warm_cosine": "CASE WHEN t < 10 THEN 0.1 * t / 10 ELSE 0.001 + 0.099 * 0.5 * (1 + cos(pi() * (t - 10) / 90)) END",
    "noam": "pow(512, -0.5) * least(pow(t + 1, -0.5), (t + 1) * pow(40, -1.5))", "polynomial": "0.001 + 0.099 * pow(1 - t / 100, 2)", "time_based": "0.1 / (1 + 0.01 * t)", "tanh_decay": "0.001 + 0.099 * 0.5 * (1 - tanh(5 * (t / 100 - 1)))",
    "flat": "CASE WHEN t / 100 < 0.3 THEN 0.1 ELSE 0.001 + 0.099 * 0.5 * (1 + cos(pi() * (t / 100 - 0.3) / 0.7)) END", "slanted": "0.1 * (1 + CASE WHEN t < 10 THEN t / 10 ELSE 1 - (t - 10) / 90 END * 31) / 32", "warm_restarts": "0.001 + 0.099 * 0.5 * (1 + cos(pi() * (t % 25) / 25))",
}


_S |= {
    "exponential_warmup": "CASE WHEN t < 10 THEN 0.1 * (exp(t / 10) - 1) / (exp(1) - 1) ELSE 0.001 + 0.099 * (1 - (t - 10) / 90) END",
    "gradual_warmup": "0.1 * CASE WHEN t < 10 THEN 1 + t / 10 ELSE 2 END",
    "one_cycle": "CASE WHEN t <= 29 THEN 0.1 + (0.004 - 0.1) / 2 * (1 + cos(pi() * t / 29)) ELSE 0.0000004 + (0.1 - 0.0000004) / 2 * (1 + cos(pi() * (t - 29) / 70)) END",
}


@query("SELECT event_id, t::BIGINT AS t, " + ", ".join(f"round(({e})::DOUBLE, 8) AS {n}" for n, e in _S.items()) + " FROM (SELECT event_id, (event_id % 100)::DOUBLE AS t FROM events)")
def learning_rates(spark, sf):
    """The rates of every event as a step of a hundred."""
    d = table(spark, sf, "events").select("event_id", (F.col("event_id") % 100).alias("t"))
    return d.select("event_id", "t", *[F.round(e, 8).alias(n) for n, e in ordered.schedules().items()])


_O = {
    "sgd": "w - 0.01 * g", "momentum": "w - 0.01 * 0.1 * g", "adagrad": "w - 0.01 * g / (abs(g) + 1e-8)", "rmsprop": "w - 0.01 * g / (sqrt(0.1 * g * g) + 1e-8)", "adadelta": "w - sqrt(1e-8) / sqrt(0.05 * g * g + 1e-8) * g",
    "adam": "w - 0.01 * g / (abs(g) + 1e-8)", "adamw": "w - 0.01 * g / (abs(g) + 1e-8) - 0.0001 * w", "nadam": "w - 0.01 * 1.9 * g / (abs(g) + 1e-8)", "radam": "w - 0.01 * g", "lion": "w - 0.01 * sign(g)", "qhadam": "w - 0.01 * (0.3 * g + 0.07 * g) / (sqrt(0.001 * g * g) + 1e-8)",
}


@query("SELECT c_custkey, " + ", ".join(f"round(({e})::DOUBLE, 6) AS {n}" for n, e in _O.items()) + " FROM (SELECT c_custkey, (c_custkey % 13 - 6) / 6.0::DOUBLE AS w, c_acctbal / 10000 + 0.0003::DOUBLE AS g FROM customer)")
def optimiser_steps(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") % 13 - 6) / 6.0).alias("w"), (F.col("c_acctbal") / 10000 + 0.0003).alias("g"))
    return d.select("c_custkey", *[F.round(e, 6).alias(n) for n, e in ordered.first_steps(F.col("w"), F.col("g")).items()])


@query("SELECT c_custkey, round(c_acctbal * least(1, 1000 / (n + 1e-12)), 6) AS c_acctbal FROM customer, (SELECT sqrt(sum(c_acctbal * c_acctbal)) AS n FROM customer)")
def clipped_gradients(spark, sf):
    return ordered.clip_by_global_norm(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 1000.0).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("SELECT p_brand, round(1e-4 * sum(abs(p_retailprice)), 4) AS l1, round(0.5e-4 * sum(p_retailprice * p_retailprice), 2) AS l2, round(1e-4 * sum(abs(p_retailprice)) + 0.5e-4 * sum(p_retailprice * p_retailprice), 2) AS elastic_net, round(1e-4 * avg(abs(p_retailprice)), 6) AS activity_l1, round(1e-4 * avg(p_retailprice * p_retailprice), 4) AS activity_l2 FROM part GROUP BY p_brand")
def penalties(spark, sf):
    digits = {"l1": 4, "l2": 2, "elastic_net": 2, "activity_l1": 6, "activity_l2": 4}
    return table(spark, sf, "part").groupBy("p_brand").agg(*[F.round(f(F.col("p_retailprice")), digits[n]).alias(n) for n, f in ordered.PENALTIES.items()])


_N = "('0x' || substr(md5('3:{}:' || event_id), 1, 13))::BIGINT / 4503599627370496.0"


@query(f"""WITH s AS (SELECT t, exp(sum(ln(1 - (0.0001::DOUBLE + t * (0.0199::DOUBLE / 999)))) OVER (ORDER BY t)) AS left_over FROM range(0, 1000) AS r(t)),
e AS (SELECT event_id, value, event_id % 1000 AS t, sqrt(-2 * ln(1 - {_N.format('a')})) * cos(2 * pi() * {_N.format('b')}) AS noise FROM events)
SELECT event_id, t, round(sqrt(left_over) * value + sqrt(1 - left_over) * noise, 6) AS x FROM e JOIN s USING (t)""")
def diffusion_schedule(spark, sf):
    """Every event's value after as many steps of a noise schedule as its number says."""
    noise = F.sqrt(-2 * F.ln(1 - drawn("event_id", 3, "a"))) * F.cos(2 * F.pi() * drawn("event_id", 3, "b"))
    d = table(spark, sf, "events").select("event_id", (F.col("event_id") % 1000).alias("t"), "value")
    return d.select("event_id", "t", F.round(ordered.noised(F.col("value"), F.col("t"), noise), 6).alias("x"))


_G = "(SELECT vec_id, unnest(embedding)::DOUBLE AS g, generate_subscripts(embedding, 1) AS t FROM embeddings)"


@query(f"""WITH g AS {_G}, m AS (SELECT a.vec_id, a.t, sum(0.1 * 0.9 ** (a.t - b.t) * b.g) AS m, sum(0.001 * 0.999 ** (a.t - b.t) * b.g * b.g) AS v, any_value(a.g) AS g FROM g a JOIN g b ON a.vec_id = b.vec_id AND b.t <= a.t GROUP BY ALL),
s AS (SELECT *, sum(0.01 * m / (1 - 0.9 ** t) / (sqrt(v / (1 - 0.999 ** t)) + 1e-8)) OVER o AS adam, sum(0.01 * m) OVER o AS momentum, sum(g * g) OVER o AS squares FROM m WINDOW o AS (PARTITION BY vec_id ORDER BY t)),
a AS (SELECT *, sum(0.01 * g / (sqrt(squares) + 1e-8)) OVER (PARTITION BY vec_id ORDER BY t) AS adagrad FROM s)
SELECT vec_id, t, round(1 - adam, 6) AS adam, round(1 - momentum, 6) AS momentum, round(1 - adagrad, 6) AS adagrad FROM a""")
def optimiser_runs(spark, sf):
    """A weight after every step along a vector's components as gradients, by three optimisers."""
    g = F.col("embedding").cast("array<double>")
    d = table(spark, sf, "embeddings").select("vec_id", *[ordered.optimised(F.lit(1.0), g, k).alias(k) for k in ("adam", "momentum", "adagrad")])
    each = d.select("vec_id", F.posexplode(F.arrays_zip("adam", "momentum", "adagrad")).alias("t", "s"))
    return each.select("vec_id", (F.col("t") + 1).cast("long").alias("t"), *[F.round(f"s.{k}", 6).alias(k) for k in ("adam", "momentum", "adagrad")])
