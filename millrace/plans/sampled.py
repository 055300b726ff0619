"""Queries of seeding and restarts of k-means, weighted draws, and oversampling by neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import clusters, resample, sampling
from .registry import query, table

_V = "(SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings)"
_U = "('0x' || substr(md5('{seed}:{salt}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0"


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query(f"""WITH e AS {_V}, f AS (SELECT v FROM e ORDER BY {_U.format(seed=4, salt="first", key="vec_id")}, vec_id LIMIT 1),
d AS (SELECT e.vec_id, list_distance(e.v, f.v) ** 2 AS d FROM e, f)
SELECT vec_id FROM d WHERE {_U.format(seed=4, salt="0", key="vec_id")} < d * 20 / (SELECT sum(d) FROM d)""")
def kmeans_seed_round(spark, sf):
    """The candidates of the first round of seeding."""
    rows = clusters.vectors(_embeddings(spark, sf), "vec_id", "v")
    first = rows.orderBy(resample.drawn("key", 4, "first"), "key").limit(1).first()
    return clusters.seed_round(rows, np.array([first["v"]]), 20, 4, 0).select(F.col("key").alias("vec_id"))


@query()
def kmeans_restarts(spark, sf):
    """The cluster of every vector in the best of three seeded runs."""
    df = _embeddings(spark, sf)
    found = clusters.kmeans(df, "vec_id", "v", 10)
    rows = clusters.nearest(clusters.vectors(df, "vec_id", "v"), found.centres)
    return rows.select(F.col("key").alias("vec_id"), "centre", F.round("d", 6).alias("d"))


@query(f"""WITH w AS (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) - p_size AS at FROM part),
d AS (SELECT k AS draw, {_U.format(seed=5, salt="0", key="k")} * (SELECT sum(p_size) FROM part) AS at FROM range((SELECT count(*) FROM part)) AS r(k))
SELECT d.draw, w.p_partkey FROM d ASOF JOIN w ON d.at >= w.at""")
def weighted_sample(spark, sf):
    """As many parts as there are, drawn with replacement in proportion to their size."""
    part = table(spark, sf, "part")
    return sampling.weighted_sample(part, "p_partkey", F.col("p_size"), part.count(), 5)


@query(f"""WITH d AS (SELECT k AS draw, {_U.format(seed=6, salt="0", key="k")} AS u, {_U.format(seed=7, salt="0", key="k")} AS pos FROM range((SELECT count(*) FROM customer)) AS r(k)),
a AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer), b AS (SELECT s_suppkey AS key, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier),
x AS (SELECT draw, pos * (SELECT count(*) FROM a) AS pos FROM d WHERE u < 0.75), y AS (SELECT draw, pos * (SELECT count(*) FROM b) AS pos FROM d WHERE u >= 0.75)
SELECT draw, 0 AS source, key FROM x ASOF JOIN a ON x.pos >= a.pos UNION ALL SELECT draw, 1, key FROM y ASOF JOIN b ON y.pos >= b.pos""")
def mixed_tables(spark, sf):
    """Draws from two tables, three of four from the first."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"))
    return sampling.mixed([a, b], "key", [3.0, 1.0], a.count(), 6)


@query(f"""WITH p AS (SELECT vec_id, [exp(x::DOUBLE) FOR x IN embedding] AS e FROM embeddings),
c AS (SELECT vec_id, pos - 1 AS pos, coalesce(sum(y) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(y) OVER (PARTITION BY vec_id) AS low
      FROM (SELECT vec_id, unnest(e) AS y, generate_subscripts(e, 1) AS pos FROM p)),
d AS (SELECT vec_id, k, {_U.format(seed=8, salt="' || k || '", key="vec_id")} AS u FROM p, range(1, 4) AS r(k))
SELECT vec_id, k AS draw, max(pos)::INT AS drawn FROM d JOIN c USING (vec_id) WHERE low <= u GROUP BY vec_id, k""")
def multinomial(spark, sf):
    """Three places of every vector, drawn from its softmax."""
    df = _embeddings(spark, sf)
    return df.select("vec_id", F.posexplode(sampling.categorical(F.col("v"), "vec_id", 3, 8)).alias("k", "drawn")).select("vec_id", (F.col("k") + 1).cast("long").alias("draw"), "drawn")


_RARE = f"""WITH e AS {_V}, c AS (SELECT label, count(*) AS n FROM e GROUP BY label),
v AS (SELECT label AS value, (SELECT max(n) FROM c) - n AS want FROM c ORDER BY n, label LIMIT 1),
p AS (SELECT q.vec_id, (e.label <> value)::INT AS other, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, e.v), e.vec_id) AS r
      FROM e q JOIN v ON q.label = value JOIN e ON e.vec_id <> q.vec_id),
s AS (SELECT vec_id, sum(other)::BIGINT AS "foreign" FROM p WHERE r <= 10 GROUP BY vec_id)"""


def _rarest(df):
    return df.groupBy("label").count().orderBy("count", "label").first()["label"]


@query(_RARE + """, a AS (SELECT vec_id, "foreign", floor("foreign" / (SELECT sum("foreign") FROM s)::DOUBLE * want)::BIGINT AS base, want FROM s, v)
SELECT vec_id, base + (row_number() OVER (ORDER BY "foreign" DESC, vec_id) <= want - sum(base) OVER ())::BIGINT AS copies FROM a""")
def adaptive_allocation(spark, sf):
    """How many new rows each row of the rarest label gives, by the neighbours of other labels around it."""
    df = _embeddings(spark, sf)
    value = _rarest(df)
    shares = resample.foreign_share(df, "vec_id", "v", "label", value)
    return resample.shared_out(shares, "vec_id", "foreign", resample.wanted(df, "label", value))


@query(_RARE + ' SELECT vec_id, "foreign" FROM s WHERE "foreign" >= 5')
def borderline_rows(spark, sf):
    """The rows of the rarest label with at least half of their neighbours of other labels."""
    df = _embeddings(spark, sf)
    return resample.foreign_share(df, "vec_id", "v", "label", _rarest(df)).where(F.col("foreign") >= 5).select("vec_id", "foreign")


@query()
def oversampled(spark, sf):
    """New rows of the rarest label until it has as many as the most frequent one, both ways."""
    df = _embeddings(spark, sf)
    value = _rarest(df)
    rounded = F.transform("v", lambda x: F.round(x, 9)).alias("v")
    made = [f(df, "vec_id", "v", "label", value, seed=9).select(F.lit(n).alias("kind"), "query", F.col("copy").cast("long").alias("copy"), rounded) for n, f in (("adaptive", resample.adaptive), ("borderline", resample.borderline))]
    return made[0].unionByName(made[1])
