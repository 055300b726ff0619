"""Queries of fitted scalers, trees, mixtures, discriminants, factors, tokenizers and metrics of sequences and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fitted, mixtures, quality_metrics, text, tokenizers, trees
from .registry import query, table

_PAST = "(SELECT * FROM orders WHERE o_orderdate < DATE '1997-01-01')"
#: Shift and scale that the past orders' prices give, by kind.
_STATES = {
    "standard": "avg(o_totalprice) AS a, sqrt(greatest(var_pop(o_totalprice), 1e-12)) AS b",
    "minmax": "min(o_totalprice) AS a, max(o_totalprice) - min(o_totalprice) AS b",
    "maxabs": "0.0 AS a, max(abs(o_totalprice)) AS b",
    "robust": "quantile_cont(o_totalprice, 0.5) AS a, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS b",
}


def _orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    return o.where("o_orderdate < DATE '1997-01-01'"), o


def _scaled(kind: str, state: str):
    @query(f"WITH s AS (SELECT {state} FROM {_PAST}) SELECT o_orderkey, round((o_totalprice - a) / b, 6) AS x FROM orders, s", f"fitted_{kind}")
    def run(spark, sf):
        """A state of the past orders, applied to all."""
        past, orders = _orders(spark, sf)
        out = fitted.transform(orders, fitted.fit(past, ["o_totalprice"], kind), ["o_totalprice"])
        return out.select("o_orderkey", F.round("o_totalprice", 6).alias("x"))


for _kind, _state in _STATES.items():
    _scaled(_kind, _state)


@query("SELECT o_orderkey, round(o_totalprice::DOUBLE, 2) AS x FROM orders")
def fitted_inverse(spark, sf):
    """Scaled and brought back."""
    past, orders = _orders(spark, sf)
    state = fitted.fit(past, ["o_totalprice"], "robust")
    out = fitted.inverse(fitted.transform(orders, state, ["o_totalprice"]), state, ["o_totalprice"])
    return out.select("o_orderkey", F.round("o_totalprice", 2).alias("x"))


@query(f"WITH s AS (SELECT {_STATES['standard']} FROM orders) SELECT o_orderkey, round((o_totalprice - a) / b, 5) AS x FROM orders, s")
def fitted_in_parts(spark, sf):
    """A standard state from the sums of two batches."""
    past, orders = _orders(spark, sf)
    sums = fitted.partial(fitted.partial(None, past, ["o_totalprice"]), orders.where("o_orderdate >= DATE '1997-01-01'"), ["o_totalprice"])
    out = fitted.transform(orders, fitted.from_sums(sums, ["o_totalprice"]), ["o_totalprice"])
    return out.select("o_orderkey", F.round("o_totalprice", 5).alias("x"))


_FEATURES = ["l_quantity", "l_discount", "l_tax"]
_LONG = "SELECT node, l_orderkey, l_linenumber, y, unnest([0, 1, 2]) AS f, unnest([l_quantity::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE]) AS x FROM {rows}"


def _level(name: str, rows: str) -> str:
    """CTEs that give (node, f, cut, gain), the best cut of every node of ``rows``."""
    return f"""{name}_c AS (SELECT node, f, x, count(*) AS n, sum(y) AS s FROM ({_LONG.format(rows=rows)}) GROUP BY ALL),
{name}_r AS (SELECT node, f, (x + lead(x) OVER o) / 2 AS cut, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER (PARTITION BY node, f) AS na, sum(s) OVER (PARTITION BY node, f) AS sa FROM {name}_c WINDOW o AS (PARTITION BY node, f ORDER BY x)),
{name}_g AS (SELECT node, f, cut, round(sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) - sa * sa / na, 9) AS gain FROM {name}_r WHERE cut IS NOT NULL),
{name} AS (SELECT * FROM {name}_g QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) = 1)"""


def _side(level: str) -> str:
    return f"2 * node + (CASE f WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END > cut)::INT AS node FROM r JOIN {level} USING (node)"


_ROWS = "SELECT 1 AS node, l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, (l_quantity * (1 - l_discount))::DOUBLE AS y FROM lineitem"
_TREE = f"""WITH r AS ({_ROWS}), {_level('one', 'r')}, t AS (SELECT r.* EXCLUDE (node), {_side('one')}), {_level('two', 't')},
u AS (SELECT t.* EXCLUDE (node), 2 * node + (CASE f WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END > cut)::INT AS node FROM t JOIN two USING (node))"""


def _lines(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *[F.col(c).cast("double").alias(c) for c in _FEATURES])
    return d.withColumn("y", F.col("l_quantity") * (1 - F.col("l_discount")))


@query(_TREE + " SELECT node::INT AS node, count(*) AS n, round(avg(y), 6) AS y FROM u GROUP BY 1")
def tree_leaves(spark, sf):
    """Leaves of a regression tree of two levels."""
    d = _lines(spark, sf)
    tree = trees.regressor(d, _FEATURES, "y", 2, bins=128)
    return d.groupBy(tree.node().alias("node")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("y"))


@query(_TREE + ", m AS (SELECT node, avg(y) AS p FROM u GROUP BY 1) SELECT l_orderkey, l_linenumber, round(p, 6) AS predicted FROM u JOIN m USING (node)")
def tree_predict(spark, sf):
    d = _lines(spark, sf)
    tree = trees.regressor(d, _FEATURES, "y", 2, bins=128)
    return d.select("l_orderkey", "l_linenumber", F.round(tree.value(), 6).alias("predicted"))


@query(f"""WITH b AS ({_ROWS}), mu AS (SELECT avg(y) AS mu FROM b), r AS (SELECT b.* REPLACE (y - mu AS y), mu, y AS goal FROM b, mu), {_level('one', 'r')},
t AS (SELECT r.*, f, cut, (CASE f WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END > cut) AS side FROM r JOIN one USING (node)), m AS (SELECT side, avg(y) AS p FROM t GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(mu + 0.5 * p, 6) AS predicted FROM t JOIN m USING (side)""")
def boosted_round(spark, sf):
    """The mean and one boosting round of stumps."""
    d = _lines(spark, sf)
    return d.select("l_orderkey", "l_linenumber", F.round(trees.boosted(d, _FEATURES, "y", 1, 1, 0.5, bins=128), 6).alias("predicted"))


@query()
def ensembles(spark, sf):
    """Share of right labels on the rows that were fitted.  The label is a rule of two features without noise, so it should come near 1; it says nothing about unseen rows."""
    d = _lines(spark, sf).withColumn("label", ((F.col("l_quantity") > 25) != (F.col("l_discount") > 0.05)).cast("int")).withColumn("key", F.struct("l_orderkey", "l_linenumber"))
    marks = [(F.col("label") == c).cast("double") for c in (0, 1)]
    said = {
        "forest": trees.vote(trees.forest(d, _FEATURES, marks, "key", 5, 4), [0, 1]),
        "boosting": (trees.boosted(d, _FEATURES, "label", 5, 2, 0.5, logistic=True) > 0.5).cast("int"),
        "adaboost": trees.adaboost(d, _FEATURES, "label", 4, 2)[0],
    }
    right = d.agg(*[F.round(F.avg((p == F.col("label")).cast("double")), 6).alias(n) for n, p in said.items()])
    return right.unpivot([], list(said), "model", "accuracy")


@query("""WITH e AS (SELECT (l_returnflag = 'R') AS c, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d FROM lineitem), s AS (SELECT c, avg(q) AS mq, avg(d) AS md, sum(q * q) - count(*) * avg(q) * avg(q) AS qq, sum(d * d) - count(*) * avg(d) * avg(d) AS dd, sum(q * d) - count(*) * avg(q) * avg(d) AS qd FROM e GROUP BY c),
w AS (SELECT sum(qq) AS qq, sum(dd) AS dd, sum(qd) AS qd, sum(CASE WHEN c THEN mq ELSE -mq END) AS q, sum(CASE WHEN c THEN md ELSE -md END) AS d FROM s), v AS (SELECT (dd * q - qd * d) AS a, (qq * d - qd * q) AS b FROM w)
SELECT round(abs(a) / sqrt(a * a + b * b), 4) AS quantity, round(abs(b) / sqrt(a * a + b * b), 4) AS discount FROM v""")
def discriminant_direction(spark, sf):
    d = _lines(spark, sf).withColumn("c", F.col("l_returnflag") == "R")
    _, parts = mixtures.discriminants(d, ["l_quantity", "l_discount"], "c", 1)
    return spark.createDataFrame([tuple(round(abs(float(x)), 4) for x in parts[0])], "quantity double, discount double")


@query("""WITH l AS (SELECT l_quantity::DOUBLE AS x, ln(0.5) - 0.5 * ln(2 * pi() * 100) - (x - 10) * (x - 10) / 200 AS a, ln(0.5) - 0.5 * ln(2 * pi() * 100) - (x - 40) * (x - 40) / 200 AS b FROM lineitem),
r AS (SELECT x, exp(a) / (exp(a) + exp(b)) AS ra FROM l), p AS (SELECT unnest([0, 1]) AS part, unnest([ra, 1 - ra]) AS r, x FROM r)
SELECT part, round(sum(r) / (SELECT count(*) FROM lineitem), 6) AS weight, round(sum(r * x) / sum(r), 5) AS mean, round(sum(r * x * x) / sum(r) - pow(sum(r * x) / sum(r), 2), 3) AS variance FROM p GROUP BY part""")
def mixture_step(spark, sf):
    (w, m, v), _ = mixtures.mixture_step(_lines(spark, sf), ["l_quantity"], ([0.5, 0.5], [[10.0], [40.0]], [[100.0], [100.0]]), 0.0)
    return spark.createDataFrame([(k, round(float(w[k]), 6), round(float(m[k][0]), 5), round(float(v[k][0]), 3)) for k in range(2)], "part int, weight double, mean double, variance double")


@query()
def mini_batch_centres(spark, sf):
    d = _lines(spark, sf).withColumn("key", F.struct("l_orderkey", "l_linenumber"))
    found = mixtures.mini_batch_kmeans(d, ["l_quantity"], "key", [[5.0], [25.0], [45.0]], 10, 0.2)
    return spark.createDataFrame([(k, float(c[0])) for k, c in enumerate(found)], "centre int, quantity double")


@query()
def factor_ratings(spark, sf):
    """Ratings of customers for order priorities, predicted from factors of both sides."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("int").alias("user"), F.substring("o_orderpriority", 1, 1).cast("int").alias("item")).agg(F.avg(F.col("o_totalprice") / 100_000).alias("rating"))
    users, items = mixtures.factors(o, "user", "item", "rating", 4, 5)
    return mixtures.predicted_rating(o, users, items, "user", "item")


_WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"


@query(f"SELECT doc_id, array_to_string({_WORDS}, ' ') AS body FROM documents")
def bpe_round_trip(spark, sf):
    """Whole texts encoded by trained merges and decoded."""
    docs = table(spark, sf, "documents")
    merges = text.bpe_merges(docs, "text", 4)
    coded = docs.select("doc_id", tokenizers.bpe_encode(F.col("text"), merges).alias("ids"))
    return coded.select("doc_id", tokenizers.bpe_decode(F.col("ids")).alias("body"))


@query(f"SELECT doc_id, array_to_string({_WORDS}, ' ') AS body FROM documents")
def unigram_round_trip(spark, sf):
    """Whole texts encoded by a trained unigram vocabulary and decoded."""
    docs = table(spark, sf, "documents")
    logs = tokenizers.unigram_train(docs, "text", 500, 1, 1)
    coded = docs.select("doc_id", tokenizers.unigram_encode(F.col("text"), logs).alias("ids"))
    return coded.select("doc_id", tokenizers.unigram_decode(F.col("ids")).alias("body"))


@query()
def rouge_of_turns(spark, sf):
    """Every turn of a conversation against the one before it."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.split(F.lower("text"), r"\s+").alias("words"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("words").alias("was"))
    both = c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.size("words").alias("said"), F.size("was").alias("meant"), quality_metrics.lcs(F.col("words"), F.col("was")).alias("common"))
    return both.select("conv_id", "turn", "common", F.round(quality_metrics.rouge_l(F.col("common"), F.col("said"), F.col("meant")), 6).alias("rouge_l"))


_TRUE = "(SELECT p_partkey // 5 AS image, p_partkey AS k, p_partkey % 2 AS label, (p_partkey * 7 % 40)::DOUBLE AS x1, (p_partkey * 11 % 40)::DOUBLE AS y1, x1 + 10 + p_size AS x2, y1 + 20 AS y2 FROM part)"
_SAID = "(SELECT p_partkey // 5 AS image, p_partkey AS k, p_partkey % 2 AS label, (p_partkey * 37 % 1000)::DOUBLE AS score, (p_partkey * 7 % 40 + p_partkey % 5)::DOUBLE AS x1, (p_partkey * 11 % 40)::DOUBLE AS y1, x1 + 12 + p_size AS x2, y1 + 18 AS y2 FROM part)"


@query(f"""WITH t AS {_TRUE}, s AS {_SAID}, o AS (SELECT s.k, s.label, s.image, s.score, t.k AS tk, greatest(least(s.x2, t.x2) - greatest(s.x1, t.x1), 0) * greatest(least(s.y2, t.y2) - greatest(s.y1, t.y1), 0) AS i, (s.x2 - s.x1) * (s.y2 - s.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS a FROM s JOIN t ON s.image = t.image AND s.label = t.label),
b AS (SELECT *, i / (a - i + 1e-12) AS iou FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY iou DESC, tk) = 1), h AS (SELECT k FROM b WHERE iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY tk ORDER BY score DESC, k) = 1),
r AS (SELECT label, s.k IN (SELECT k FROM h) AS hit, sum((s.k IN (SELECT k FROM h))::INT) OVER w / (count(*) OVER w + 1e-12) AS p, score, k FROM s WINDOW w AS (PARTITION BY label ORDER BY score DESC, k ROWS UNBOUNDED PRECEDING)),
e AS (SELECT label, hit, max(p) OVER (PARTITION BY label ORDER BY score DESC, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM r)
SELECT label, round(sum(CASE WHEN hit THEN p ELSE 0 END) / (SELECT count(*) FROM t WHERE t.label = e.label), 6) AS ap FROM e GROUP BY label""")
def average_precision(spark, sf):
    k = F.col("p_partkey")
    number = lambda e, name: e.cast("double").alias(name)
    x, y = k * 7 % 40, k * 11 % 40
    truth = F.struct(number(x, "x1"), number(y, "y1"), number(x + 10 + F.col("p_size"), "x2"), number(y + 20, "y2"))
    said = F.struct(number(x + k % 5, "x1"), number(y, "y1"), number(x + k % 5 + 12 + F.col("p_size"), "x2"), number(y + 18, "y2"))
    p = table(spark, sf, "part")
    base = [F.floor(k / 5).alias("image"), k.alias("key"), (k % 2).alias("label")]
    t, s = p.select(*base, truth.alias("box")), p.select(*base, (k * 37 % 1000).cast("double").alias("score"), said.alias("box"))
    return quality_metrics.average_precision(quality_metrics.detections(s, t), t).select("label", F.round("ap", 6).alias("ap"))
