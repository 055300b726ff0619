"""Queries of evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics
from .registry import query, table

#: A made-up prediction of an order's priority, and of an order's price from its key.
_PRED = "SELECT o_orderpriority AS y, CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' WHEN o_orderkey % 5 = 0 THEN '2-HIGH' ELSE o_orderpriority END AS p FROM orders"
_CLASSES = f"""WITH d AS ({_PRED}), c AS (SELECT label, sum((y = label AND p = label)::INT)::BIGINT tp, sum((y <> label AND p = label)::INT)::BIGINT fp,
sum((y = label AND p <> label)::INT)::BIGINT fn, sum((y <> label AND p <> label)::INT)::BIGINT tn FROM d, (SELECT DISTINCT y AS label FROM d UNION SELECT DISTINCT p FROM d) GROUP BY label)"""


def _pred(spark, sf):
    o = table(spark, sf, "orders")
    p = F.when(F.col("o_orderkey") % 3 == 0, "1-URGENT").when(F.col("o_orderkey") % 5 == 0, "2-HIGH").otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_orderpriority").alias("y"), p.alias("p"))


@query(f"SELECT y, p, count(*) AS n FROM ({_PRED}) GROUP BY y, p")
def confusion_matrix(spark, sf):
    return metrics.confusion(_pred(spark, sf), "y", "p")


@query(_CLASSES + " SELECT label, tp, fp, fn, tn, tp + fn AS support FROM c")
def class_counts(spark, sf):
    return metrics.per_class(_pred(spark, sf), "y", "p")


def _prf(average: str, precision: str, recall: str):
    sql = f"{_CLASSES}, m AS (SELECT {precision} AS p, {recall} AS r FROM c) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-12), 6) AS f1 FROM m"

    @query(sql, f"precision_recall_f1_{average}")
    def run(spark, sf):
        out = metrics.precision_recall_f1(_pred(spark, sf), "y", "p", average)
        return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_prf("macro", "avg(tp / (tp + fp + 1e-12))", "avg(tp / (tp + fn + 1e-12))")
_prf("micro", "sum(tp) / (sum(tp) + sum(fp) + 1e-12)", "sum(tp) / (sum(tp) + sum(fn) + 1e-12)")
_prf("weighted", "sum(tp / (tp + fp + 1e-12) * (tp + fn)) / sum(tp + fn)", "sum(tp / (tp + fn + 1e-12) * (tp + fn)) / sum(tp + fn)")


@query(f"SELECT round(avg((y = p)::INT), 6) AS accuracy, count(*) AS n FROM ({_PRED})")
def accuracy(spark, sf):
    return _pred(spark, sf).agg(F.round(metrics.accuracy(None, "y", "p"), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query(_CLASSES + " SELECT label, round(tp / (tp + fp + fn + 1e-12), 6) AS iou, round(2 * tp / (2 * tp + fp + fn + 1e-12), 6) AS dice FROM c")
def iou_dice(spark, sf):
    return metrics.overlap(_pred(spark, sf), "y", "p").select("label", F.round("iou", 6).alias("iou"), F.round("dice", 6).alias("dice"))


_SCORED = "SELECT l.toxic AS y, d.n_chars // 50 AS score FROM labels l JOIN documents d USING (doc_id)"


def _scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.col("n_chars") / 50).alias("score"))
    return table(spark, sf, "labels").join(d, "doc_id").select(F.col("toxic").alias("y"), "score")


@query(f"""WITH s AS ({_SCORED}), t AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY score),
w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t)
SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg) + 1e-12), 6) AS auroc FROM w""")
def auroc(spark, sf):
    return metrics.auroc(_scored(spark, sf), "score", "y").select(F.round("auroc", 6).alias("auroc"))


@query(f"""WITH s AS ({_SCORED}), t AS (SELECT score, sum(y)::DOUBLE AS pos, count(*) AS n FROM s GROUP BY score),
w AS (SELECT score, sum(pos) OVER o AS tp, sum(n) OVER o AS al, sum(pos) OVER () AS p FROM t WINDOW o AS (ORDER BY score DESC)),
c AS (SELECT score, tp / (al + 1e-12) AS pr, tp / (p + 1e-12) AS rc FROM w)
SELECT round(sum(s), 6) AS auprc FROM (SELECT (rc - lag(rc) OVER o) * (pr + lag(pr) OVER o) / 2 AS s FROM c WINDOW o AS (ORDER BY score DESC))""")
def auprc(spark, sf):
    return metrics.auprc(_scored(spark, sf), "score", "y").select(F.round("auprc", 6).alias("auprc"))


@query("""WITH d AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
SELECT round(avg((y - p) * (y - p)), 1) AS mse, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae,
round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*) + 1e-12), 6) AS r2 FROM d""")
def regression_metrics(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    out = metrics.regression(d, "y", "p")
    return out.select(F.round("mse", 1).alias("mse"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), F.round("r2", 6).alias("r2"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM t GROUP BY w), a AS (SELECT sum(n) AS t FROM c)
SELECT round(exp(sum(-ln(n / t) * n) / sum(n)), 4) AS perplexity FROM c, a""")
def unigram_perplexity(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    nll = words.crossJoin(words.agg(F.sum("n").alias("t"))).select((-F.ln(F.col("n") / F.col("t"))).alias("nll"), F.col("n").cast("double").alias("n"))
    return nll.agg(F.round(metrics.perplexity(nll, "nll", "n"), 4).alias("perplexity"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS k FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, k) AS place FROM e)
SELECT round(sum((k = label AND place <= 3)::INT) / count(DISTINCT vec_id), 6) AS top3 FROM r""")
def topk_accuracy(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("embedding").alias("s"), "label")
    return e.agg(F.round(metrics.topk_accuracy(e, "s", "label", 3), 6).alias("top3"))


@query("""WITH b AS (SELECT event_type, event_id // 256 AS batch, avg(value) AS m FROM events GROUP BY ALL)
SELECT event_type, round(avg(m), 6) AS mean_of_means, (SELECT round(avg(value), 6) FROM events e WHERE e.event_type = b.event_type) AS pooled FROM b GROUP BY event_type""")
def batched_mean(spark, sf):
    e = table(spark, sf, "events")
    b = e.groupBy("event_type", F.floor(F.col("event_id") / 256).alias("batch")).agg(F.avg("value").alias("m"), F.sum("value").alias("s"), F.count("value").alias("n"))
    return b.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.sum("s") / F.sum("n"), 6).alias("pooled"))


_LABELS = "(SELECT vec_id, k, x, (label = k % 10)::BIGINT AS y FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings))"


@query(f"""WITH e AS {_LABELS}, t AS (SELECT k, x, sum(y) AS pos, sum(1 - y) AS neg FROM e GROUP BY k, x), u AS (SELECT x, sum(pos) AS pos, sum(neg) AS neg FROM t GROUP BY x),
r AS (SELECT k, sum(pos * (below - neg / 2.0)) / (sum(pos) * sum(neg) + 1e-12) AS a, sum(pos) AS p FROM (SELECT *, sum(neg) OVER (PARTITION BY k ORDER BY x) AS below FROM t) GROUP BY k),
m AS (SELECT sum(pos * (below - neg / 2.0)) / (sum(pos) * sum(neg) + 1e-12) AS micro FROM (SELECT *, sum(neg) OVER (ORDER BY x) AS below FROM u))
SELECT round((SELECT micro FROM m), 8) AS micro, round(avg(a), 8) AS macro, round(sum(a * p) / sum(p), 8) AS weighted, round(max(a), 8) AS best FROM r""")
def multilabel_auroc(spark, sf):
    """Every component as the score of a class, of which a label has every tenth."""
    d = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("s"), F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda k: (k % 10 == F.col("label")).cast("int")).alias("y"))
    found = metrics.multilabel_auroc(d, "s", "y")
    return found.select(*[F.round(c, 8).alias(c) for c in ("micro", "macro", "weighted")], F.round(F.array_max("per_class"), 8).alias("best"))


@query(f"""WITH e AS {_LABELS}, t AS (SELECT k, x, sum(y) AS pos, sum(1 - y) AS neg FROM e GROUP BY k, x),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS n, sum(pos) OVER (PARTITION BY k) AS p FROM t WINDOW w AS (PARTITION BY k ORDER BY x DESC)),
s AS (SELECT k, p, tp / (p + 1e-12) AS r, tp / (n + 1e-12) AS q, lag(tp / (p + 1e-12)) OVER w AS r0, lag(tp / (n + 1e-12)) OVER w AS q0 FROM c WINDOW w AS (PARTITION BY k ORDER BY x DESC)),
a AS (SELECT k, any_value(p) AS p, coalesce(sum((r - r0) * (q + q0) / 2), 0) AS a FROM s GROUP BY k)
SELECT round(avg(a), 8) AS macro, round(sum(a * p) / sum(p), 8) AS weighted, round(max(a), 8) AS best FROM a""")
def multilabel_auprc(spark, sf):
    """Every component as the score of a class, of which a label has every tenth."""
    d = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("s"), F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda k: (k % 10 == F.col("label")).cast("int")).alias("y"))
    found = metrics.multilabel_auprc(d, "s", "y")
    return found.select(*[F.round(c, 8).alias(c) for c in ("macro", "weighted")], F.round(F.array_max("per_class"), 8).alias("best"))
