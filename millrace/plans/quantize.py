"""Queries of quantisation and resampling weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quantize as Z
from .registry import query, table

_L = "[" + ", ".join(f"{v}::DOUBLE" for v in Z.NF4) + "]"


@query(f"""WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT vec_id, k // 32 AS b, max(abs(x)) AS scale FROM e GROUP BY ALL),
c AS (SELECT e.vec_id, x, scale, list_position([abs(x / scale - l) FOR l IN {_L}], list_min([abs(x / scale - l) FOR l IN {_L}])) - 1 AS code FROM e JOIN s ON e.vec_id = s.vec_id AND e.k // 32 = s.b)
SELECT vec_id, sum(code)::BIGINT AS codes, round(avg(abs(x - {_L}[code + 1] * scale)), 6) AS error FROM c GROUP BY vec_id""")
def quantize_4bit(spark, sf):
    long = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x"))
    q = Z.quantize_4bit(long, "vec_id", "k", "x", 32)
    return q.groupBy("vec_id").agg(F.sum("code").alias("codes"), F.round(F.avg(F.abs(F.col("x") - F.col("restored"))), 6).alias("error"))


@query("SELECT c_custkey, (c_custkey % 16 * 16 + c_custkey % 7)::INT AS packed, (c_custkey % 16)::INT AS high, (c_custkey % 7)::INT AS low FROM customer")
def pack_4bit(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", Z.pack_4bit((F.col("c_custkey") % 16).cast("int"), (F.col("c_custkey") % 7).cast("int")).alias("packed"))
    high, low = Z.unpack_4bit(F.col("packed"))
    return d.select("c_custkey", "packed", high.alias("high"), low.alias("low"))


@query("""WITH e AS (SELECT event_id, value AS x, greatest(floor(log2(greatest(abs(value), pow(2, -20)))), -6) AS ex FROM events)
SELECT event_id, CASE WHEN abs(x) < pow(2, -9) THEN 0 ELSE sign(x) * least(round_even(abs(x) / pow(2, ex - 3), 0) * pow(2, ex - 3), 448) END AS fp8 FROM e""")
def quantize_fp8(spark, sf):
    return table(spark, sf, "events").select("event_id", (Z.fp8(F.col("value")) + 0.0).alias("fp8"))


@query("SELECT o_orderpriority, round(sum(round_even(o_totalprice / 250, 0) * 250), 0) AS total FROM orders GROUP BY o_orderpriority")
def rounded_to_step(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.sum(Z.rounded_to_step(F.col("o_totalprice"), 250.0)), 0).alias("total"))


@query("""SELECT p_partkey, round((1 / (count(*) OVER (PARTITION BY p_brand) / n + 1e-6) + 1 / (count(*) OVER (PARTITION BY p_type) / n + 1e-6)) / 2, 5) AS weight FROM part, (SELECT count(*)::DOUBLE AS n FROM part)""")
def rare_category_weights(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    total = p.agg(F.count(F.lit(1)).alias("n"))
    freq = lambda c: p.groupBy(c).agg(F.count(F.lit(1)).alias(f"_{c}"))
    joined = p.join(freq("p_brand"), "p_brand").join(freq("p_type"), "p_type").crossJoin(total)
    inverse = lambda c: 1 / (F.col(f"_{c}") / F.col("n") + 1e-6)
    return joined.select("p_partkey", F.round((inverse("p_brand") + inverse("p_type")) / 2, 5).alias("weight"))


@query("""WITH l AS (SELECT s, CASE WHEN e = 0 THEN m / 8.0 * 2.0 ** -6 ELSE (1 + m / 8.0) * 2.0 ** (e - 7) END * CASE WHEN s = 1 THEN -1 ELSE 1 END AS v, s * 128 + e * 8 + m AS byte FROM range(2) AS a(s), range(16) AS b(e), range(8) AS c(m) WHERE e * 8 + m < 127),
x AS (SELECT vec_id, k, x, CASE WHEN abs(x) < 2.0 ** -9 THEN 0.0 ELSE x END AS y FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)),
r AS (SELECT vec_id, k, v, row_number() OVER (PARTITION BY vec_id, k ORDER BY abs(y - v), byte % 2) AS r FROM x JOIN l ON l.s = (x.x < 0)::INT)
SELECT vec_id, k, round(v, 9) + 0 AS restored FROM r WHERE r = 1""")
def fp8_bytes(spark, sf):
    """Every component as a byte of eight bits and back."""
    d = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x"))
    return d.select("vec_id", F.col("k").cast("long").alias("k"), (F.round(Z.fp8_value(Z.fp8_byte(F.col("x"))), 9) + 0.0).alias("restored"))


@query()
def packed_4bit(spark, sf):
    """The components of every vector as packed codes with scales of a byte, and the largest error after unpacking."""
    d = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x"))
    packed = Z.packed_blocks_4bit(d, "vec_id", "k", "x", 16)
    back = Z.unpacked_blocks_4bit(packed, "vec_id", "k", 16).join(d, ["vec_id", "k"])
    sizes = packed.groupBy("vec_id").agg(F.sum(F.length("packed") + 1).alias("bytes"))
    return back.groupBy("vec_id").agg(F.round(F.max(F.abs(F.col("restored") - F.col("x"))), 9).alias("error")).join(sizes, "vec_id")
