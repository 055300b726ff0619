"""Queries of neighbours, clusters, boxes and classical models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import classifiers, mixtures, models, neighbours, text
from .registry import query, table

_E = "(SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings)"
_KNN = f"""WITH e AS {_E}, p AS (SELECT q.vec_id AS query, e.vec_id, e.label, list_distance(q.v, e.v) AS d FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS rank FROM p)"""


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _near(spark, sf, k=5):
    e = _embeddings(spark, sf)
    return neighbours.knn(e.where("vec_id % 50 = 0"), e, "vec_id", "v", k)


@query(_KNN + " SELECT query, vec_id, round(d, 5) AS distance, rank FROM r WHERE rank <= 5")
def knn_join(spark, sf):
    return _near(spark, sf).select("query", "vec_id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(_KNN + ", c AS (SELECT query, label, count(*) AS n FROM r WHERE rank <= 5 GROUP BY ALL) SELECT query, arg_max(label, n * 1000 - label) AS predicted FROM c GROUP BY query")
def knn_classify(spark, sf):
    return neighbours.vote(_near(spark, sf), _embeddings(spark, sf), "vec_id", "label")


@query(_KNN + " SELECT query, round(avg(label), 6) AS predicted FROM r WHERE rank <= 5 GROUP BY query")
def knn_regress(spark, sf):
    near = _near(spark, sf).join(_embeddings(spark, sf).select("vec_id", "label"), "vec_id")
    return near.groupBy("query").agg(F.round(F.avg("label"), 6).alias("predicted"))


@query(f"""WITH e AS {_E}, c AS (SELECT vec_id AS centre, v AS at FROM e WHERE vec_id < 8), d AS (SELECT e.vec_id, e.v, c.centre, list_sum(list_transform(list_zip(e.v, c.at), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM e, c)
SELECT vec_id, arg_min(centre, d) AS centre, round(min(d), 5) AS d FROM d GROUP BY vec_id""")
def kmeans_assign(spark, sf):
    e = _embeddings(spark, sf)
    centres = e.where("vec_id < 8").select(F.col("vec_id").alias("centre"), F.col("v").alias("at"))
    return neighbours.assign(e, centres, "v").select("vec_id", "centre", F.round("d", 5).alias("d"))


@query(f"""WITH e AS {_E}, c AS (SELECT vec_id AS centre, v AS at FROM e WHERE vec_id < 8), d AS (SELECT e.vec_id, e.v, c.centre, list_sum(list_transform(list_zip(e.v, c.at), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM e, c),
a AS (SELECT vec_id, any_value(v) AS v, arg_min(centre, d) AS centre FROM d GROUP BY vec_id)
SELECT centre, count(*) AS n, round(avg(v[1]), 6) AS first, round(avg(v[64]), 6) AS last FROM a GROUP BY centre""")
def kmeans_update(spark, sf):
    e = _embeddings(spark, sf)
    centres = e.where("vec_id < 8").select(F.col("vec_id").alias("centre"), F.col("v").alias("at"))
    assigned = neighbours.assign(e, centres, "v")
    new = neighbours.update(assigned, "v").select("centre", F.round(F.element_at("at", 1), 6).alias("first"), F.round(F.element_at("at", 64), 6).alias("last"))
    return assigned.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).join(new, "centre")


@query()
def kmeans_fit(spark, sf):
    e = _embeddings(spark, sf)
    centres = e.where("vec_id < 4").select(F.col("vec_id").alias("centre"), F.col("v").alias("at"))
    found, _ = neighbours.kmeans(e, centres, "v", 8)
    return found


_BOX = "(SELECT p_partkey AS k, p_partkey // 20 AS img, p_partkey % 2 AS side, (p_partkey * 7 % 40)::DOUBLE AS x1, (p_partkey * 11 % 40)::DOUBLE AS y1, (p_partkey * 7 % 40 + 10 + p_size)::DOUBLE AS x2, (p_partkey * 11 % 40 + 20)::DOUBLE AS y2 FROM part)"


@query(f"""WITH b AS {_BOX}, p AS (SELECT a.img, a.k AS ka, b.k AS kb, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
FROM b a JOIN b ON a.img = b.img AND a.k < b.k) SELECT ka, kb, round(i / (s - i + 1e-12), 6) AS iou FROM p WHERE i > 0""")
def box_overlaps(spark, sf):
    k = F.col("p_partkey")
    number = lambda e: e.cast("double")
    box = F.struct(number(k * 7 % 40).alias("x1"), number(k * 11 % 40).alias("y1"), number(k * 7 % 40 + 10 + F.col("p_size")).alias("x2"), number(k * 11 % 40 + 20).alias("y2"))
    b = table(spark, sf, "part").select(F.floor(k / 20).alias("img"), k.alias("k"), box.alias("box"))
    pairs = neighbours.box_pairs(b.select("img", F.col("k").alias("ka"), F.col("box").alias("box_a")), b.select("img", F.col("k").alias("kb"), F.col("box").alias("box_b")), "img")
    return pairs.where("ka < kb AND iou > 0").select("ka", "kb", F.round("iou", 6).alias("iou"))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem")
def ols(spark, sf):
    w = models.linear(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(float(w[0]), 2), round(float(w[1]), 3))], "intercept double, slope double")


@query("""WITH c AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my FROM lineitem), s AS (SELECT sum((l_quantity - mx) * (l_quantity - mx)) + 10 AS xx, sum((l_discount - mz) * (l_discount - mz)) + 10 AS zz, sum((l_quantity - mx) * (l_discount - mz)) AS xz,
sum((l_quantity - mx) * (l_extendedprice - my)) AS xy, sum((l_discount - mz) * (l_extendedprice - my)) AS zy FROM lineitem, c) SELECT round((zz * xy - xz * zy) / (xx * zz - xz * xz), 2) AS quantity, round((xx * zy - xz * xy) / (xx * zz - xz * xz), 0) AS discount FROM s""")
def ridge(spark, sf):
    w = models.linear(table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_extendedprice"), ["l_quantity", "l_discount"], "l_extendedprice", 10.0)
    return spark.createDataFrame([(round(float(w[1]), 2), float(round(float(w[2]))))], "quantity double, discount double")


@query("SELECT label, count(*) AS n, " + ", ".join(f"round(avg(embedding[{k}]::DOUBLE), 6) AS mean_f{k}, round(var_pop(embedding[{k}]::DOUBLE) + 1e-9, 6) AS var_f{k}" for k in range(1, 65)) + " FROM embeddings GROUP BY label")
def gaussian_nb_fit(spark, sf):
    d = table(spark, sf, "embeddings").select("label", *[F.element_at("embedding", k).cast("double").alias(f"f{k}") for k in range(1, 65)])
    m = models.gaussian_nb(d, d.columns[1:], "label")
    return m.select(*[F.round(c, 6).alias(c) if "_f" in c else c for c in m.columns])


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS k FROM embeddings), m AS (SELECT label AS c, k, count(*) AS n, avg(x) AS m, var_pop(x) + 1e-9 AS v FROM e GROUP BY ALL), a AS (SELECT count(*) AS n FROM embeddings),
l AS (SELECT vec_id, c, any_value(ln(m.n / a.n)) - 0.5 * sum(ln(2 * pi() * v) + (x - m) * (x - m) / v) AS l FROM e JOIN m USING (k), a GROUP BY vec_id, c) SELECT vec_id, arg_max(c, l) AS predicted FROM l GROUP BY vec_id""")
def gaussian_nb_score(spark, sf):
    d = table(spark, sf, "embeddings").select("vec_id", "label", *[F.element_at("embedding", k).cast("double").alias(f"f{k}") for k in range(1, 65)])
    return models.gaussian_nb_predict(d, models.gaussian_nb(d, d.columns[2:], "label"), d.columns[2:], "label").select("vec_id", "predicted")


@query("SELECT label, 'f' || k AS feature, round((sum((x > 0)::INT) + 1) / (count(*) + 2), 8) AS p FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS k FROM embeddings) GROUP BY label, k")
def bernoulli_nb(spark, sf):
    d = table(spark, sf, "embeddings").select("label", *[F.element_at("embedding", k).alias(f"f{k}") for k in range(1, 65)])
    return models.bernoulli_nb(d, d.columns[1:], "label").withColumn("p", F.round("p", 8))


@query("""WITH t AS (SELECT lang, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM documents), c AS (SELECT lang, w, count(*) AS n FROM t GROUP BY ALL), v AS (SELECT count(DISTINCT w) AS v FROM c)
SELECT lang, w, round((n + 1) / (sum(n) OVER (PARTITION BY lang) + v), 10) AS p FROM c, v""")
def multinomial_nb(spark, sf):
    t = table(spark, sf, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w"))
    return models.multinomial_nb(t.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")), "lang", "w", "n").withColumn("p", F.round("p", 10))


@query("""WITH t AS (SELECT l_quantity AS x, count(*) AS n, sum(y) AS s FROM (SELECT l_quantity, (l_returnflag = 'R')::INT::DOUBLE AS y FROM lineitem) GROUP BY 1), r AS (SELECT x, lead(x) OVER o AS nx, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER () AS na, sum(s) OVER () AS sa FROM t WINDOW o AS (ORDER BY x)),
g AS (SELECT (x + nx) / 2 AS threshold, (sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) - sa * sa / na) / na AS gain FROM r WHERE nx IS NOT NULL) SELECT arg_max(threshold, gain) AS threshold, round(max(gain), 9) AS gain FROM g""")
def stump_split(spark, sf):
    d = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("double").alias("y"))
    return models.best_split(d, "l_quantity", "y").select("threshold", F.round("gain", 9).alias("gain"))


@query("""WITH r AS (SELECT event_id, user_id AS u, event_type AS i, value AS v FROM events), m AS (SELECT avg(v) AS mu FROM r), bu AS (SELECT u, avg(v - mu) AS b FROM r, m GROUP BY u), bi AS (SELECT i, avg(v - mu) AS b FROM r, m GROUP BY i)
SELECT event_id, round(mu + bu.b + bi.b, 5) AS predicted FROM r JOIN bu USING (u) JOIN bi USING (i), m""")
def biased_baseline(spark, sf):
    return models.biased_baseline(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), "user_id", "event_type", "value").select("event_id", F.round("predicted", 5).alias("predicted"))


@query("SELECT round(covar_samp(l_quantity, l_discount), 6) AS qd, round(var_samp(l_quantity), 4) AS qq, round(var_samp(l_quantity) + var_samp(l_discount) + var_samp(l_tax), 4) AS explained FROM lineitem")
def pca_variance(spark, sf):
    d = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    value, _ = models.pca(d, d.columns, 3)
    return d.agg(F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("qd"), F.round(F.var_samp("l_quantity"), 4).alias("qq"), F.lit(round(float(value.sum()), 4)).alias("explained"))


@query()
def linear_models(spark, sf):
    """Coefficients of the iterative linear models on one design."""
    d = table(spark, sf, "orders").select((F.col("o_totalprice") / 100000).alias("x"), (F.col("o_custkey") % 10 / 10).alias("z"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    out = {"lasso": models.elastic_net(d, ["x", "z"], "y", 0.1)[1], "elastic_net": models.elastic_net(d, ["x", "z"], "y", 0.1, 0.5)[1], "logistic": models.logistic(d, ["x", "z"], "y", steps=15)[1:], "linear_svc": models.linear_svc(d, ["x", "z"], "y", steps=15)[1:], "linear_svr": models.linear_svr(d, ["x", "z"], "y", steps=15)[1:]}
    return spark.createDataFrame([(n, float(w[0]), float(w[1])) for n, w in out.items()], "model string, x double, z double")


_X = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query("""WITH x AS (SELECT vec_id, label, k, (x > 0)::INT AS b FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)),
m AS (SELECT label AS c, k, (sum(b) + 1) / (count(*) + 2.0) AS p, count(*) AS n FROM x GROUP BY label, k),
s AS (SELECT vec_id, c, sum(CASE WHEN b = 1 THEN ln(p) ELSE ln(1 - p) END) + ln(any_value(n)::DOUBLE) AS s FROM x JOIN m USING (k) GROUP BY vec_id, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS r, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS p FROM s WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, c AS predicted, round(p, 6) AS p FROM r WHERE r = 1""")
def bernoulli_nb_predict(spark, sf):
    """The likeliest label of every vector by the signs of its components, and its chance."""
    names = [f"f{k}" for k in range(1, 65)]
    d = table(spark, sf, "embeddings").select("vec_id", "label", *[F.element_at("embedding", k).cast("double").alias(n) for k, n in enumerate(names, 1)])
    found = classifiers.BernoulliNB.fit(d, names, "label").predict(d)
    return found.select("vec_id", "predicted", F.round(F.array_max("proba"), 6).alias("p"))


@query(r"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT count(DISTINCT word) AS v FROM c), t AS (SELECT lang, sum(n) AS t FROM c GROUP BY lang), q AS (SELECT coalesce(lang, '') AS lang, count(*) AS d FROM documents GROUP BY 1),
k AS (SELECT doc_id, word, count(*) AS m FROM w GROUP BY ALL),
s AS (SELECT k.doc_id, t.lang, sum(m * ln((coalesce(n, 0) + 1) / (t + v)::DOUBLE)) + ln(any_value(d) / (SELECT sum(d) FROM q)::DOUBLE) AS s FROM k CROSS JOIN t CROSS JOIN v JOIN q ON q.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.word = k.word GROUP BY ALL)
SELECT doc_id, arg_max(lang, s) AS predicted, round(max(s), 4) AS score FROM s GROUP BY doc_id""")
def multinomial_nb_predict(spark, sf):
    """The likeliest language of every text by its words."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    words = docs.select("doc_id", "lang", F.explode(text.tokens(F.lower("text"))).alias("word")).groupBy("doc_id", "lang", "word").agg(F.count(F.lit(1)).alias("n"))
    model = models.multinomial_nb(words, "lang", "word", "n")
    priors = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return classifiers.multinomial_predict(words, model, priors, "doc_id", "lang", "word", "n").withColumn("score", F.round("score", 4))


@query()
def discriminant_predict(spark, sf):
    """The label of every vector by linear discriminant analysis, and its chance."""
    d = _vectors(spark, sf)
    found = classifiers.discriminant_analysis(d, "v", "label").predict(d, "v")
    return found.select("vec_id", "predicted", F.round(F.array_max("proba"), 6).alias("p"))


@query(f"""WITH c AS (SELECT count(*)::DOUBLE AS n FROM embeddings), l AS (SELECT DISTINCT label AS c FROM embeddings), x AS (SELECT vec_id, label, unnest([1.0] || v) AS x, unnest(range(0, 65)) AS k FROM {_X}),
g AS (SELECT c, k, -0.5 * sum((0.1 - (label = c)::INT) * x) / any_value(n) AS w FROM x, l, c GROUP BY c, k)
SELECT vec_id, c AS label, round(sum(x * w), 8) + 0 AS score FROM x JOIN g USING (k) GROUP BY vec_id, c""")
def softmax_step(spark, sf):
    """The scores of all labels after one step of softmax regression from zero."""
    d = _vectors(spark, sf)
    m = classifiers.softmax_regression(d, "v", "label", 1, 0.5)
    v = F.array("v")
    scores = F.array(*[F.struct(F.lit(c).alias("label"), (F.aggregate(F.zip_with(v[0], F.lit(w.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y) + float(b)).alias("score")) for c, w, b in zip(m.classes, m.weights, m.bias)])
    return d.select("vec_id", F.explode(scores).alias("s")).select("vec_id", "s.label", (F.round("s.score", 8) + 0.0).alias("score"))


@query()
def mixture_full(spark, sf):
    """The shares of three parts with full covariances in all lines, and the trace of each covariance."""
    d = table(spark, sf, "lineitem").select(F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_extendedprice") / 100_000).alias("v"))
    (w, _, c), _ = mixtures.full_mixture(d, "v", np.array([[0.2, 0.2, 0.2], [0.5, 0.5, 0.4], [0.8, 0.8, 0.8]]), 5)
    return spark.createDataFrame([(k, round(float(x), 6), round(float(np.trace(m)), 6)) for k, (x, m) in enumerate(zip(w, c))], "part long, share double, spread double")
