"""Evaluation metrics as grouped aggregates; what grows is shuffled by class, score or query, never gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running

EPS = 1e-12


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """(y, p, n): how often each class is predicted as each."""
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, tp, fp, fn, tn, support) of every class that is a label or a prediction."""
    cells = confusion(df, y, p)
    sides = cells.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(True).alias("own")), F.struct(F.col("p").alias("label"), F.lit(False).alias("own")))).alias("s"), "n", (F.col("y") == F.col("p")).alias("hit"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    own = F.col("s.own")
    out = sides.groupBy(F.col("s.label").alias("label")).agg(count(own & F.col("hit")).alias("tp"), count(~own & ~F.col("hit")).alias("fp"), count(own & ~F.col("hit")).alias("fn"))
    total = cells.agg(F.sum("n").alias("_all"))
    return out.crossJoin(total).select("label", "tp", "fp", "fn", (F.col("_all") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"), (F.col("tp") + F.col("fn")).alias("support"))


def precision_recall_f1(df: DataFrame, y: str, p: str, average: str = "macro", eps: float = EPS) -> DataFrame:
    """One row: precision, recall and f1, the harmonic mean of the averaged two; average: micro, macro or weighted."""
    c = per_class(df, y, p)
    if average == "micro":
        parts = [F.sum("tp") / (F.sum("tp") + F.sum("fp") + eps), F.sum("tp") / (F.sum("tp") + F.sum("fn") + eps)]
    else:
        each = [F.col("tp") / (F.col("tp") + F.col("fp") + eps), F.col("tp") / (F.col("tp") + F.col("fn") + eps)]
        parts = [F.avg(e) for e in each] if average == "macro" else [F.sum(e * F.col("support")) / (F.sum("support") + eps) for e in each]
    out = c.agg(parts[0].alias("precision"), parts[1].alias("recall"))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))


def accuracy(df: DataFrame, y: str, p: str) -> Column:
    return F.avg((F.col(y) == F.col(p)).cast("double"))


def score_table(df: DataFrame, score: str, y: str) -> DataFrame:
    """(score, pos, neg): counts by distinct score, what rank metrics need of any number of rows."""
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum(1 - F.col(y).cast("bigint")).alias("neg"))


def labels_long(df: DataFrame, scores: str, labels: str) -> DataFrame:
    """(class, score, pos, neg) by distinct score of each class, from arrays of scores and of 0/1 labels."""
    pairs = df.select(F.posexplode(F.arrays_zip(F.col(scores).alias("score"), F.col(labels).alias("y"))).alias("class", "p")).select("class", F.col("p.score").alias("score"), F.col("p.y").cast("bigint").alias("y"))
    return pairs.groupBy("class", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def _averaged(per: DataFrame, micro: DataFrame, name: str, eps: float) -> DataFrame:
    """One row: micro, macro, weighted by positives, and the values of the classes in order."""
    weighted = F.sum(F.col(name) * F.col("p")) / (F.sum("p") + eps)
    each = F.transform(F.array_sort(F.collect_list(F.struct("class", name))), lambda s: s[name])  # a value a class
    out = per.agg(F.avg(name).alias("macro"), weighted.alias("weighted"), each.alias("per_class"))
    return micro.withColumnRenamed(name, "micro").crossJoin(out)


def multilabel_auroc(df: DataFrame, scores: str, labels: str, eps: float = EPS) -> DataFrame:
    """One row ``micro, macro, weighted, per_class``; 0.5 for a class that has only one kind of label."""
    table = labels_long(df, scores, labels)
    per = _auroc_of(running(table, F.col("score"), [], {"below": F.col("neg")}, by="class"), eps, "class")
    micro = table.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return _averaged(per, _auroc_of(running(micro, F.col("score"), [], {"below": F.col("neg")}), eps).select("auroc"), "auroc", eps)


def multilabel_auprc(df: DataFrame, scores: str, labels: str, eps: float = EPS) -> DataFrame:
    """One row ``micro, macro, weighted, per_class``; 0 for a class without positives."""
    table = labels_long(df, scores, labels)
    sums = {"tp": F.col("pos"), "all": F.col("pos") + F.col("neg")}
    per = _auprc_of(running(table, F.col("score"), [], sums, descending=True, by="class"), eps, "class")
    micro = table.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return _averaged(per, _auprc_of(running(micro, F.col("score"), [], sums, descending=True), eps).select("auprc"), "auprc", eps)


def auroc(df: DataFrame, score: str, y: str, eps: float = EPS) -> DataFrame:
    """One row ``auroc`` by the rank sum, equal scores sharing ranks; 0.5 where a class is missing."""
    return _auroc_of(running(score_table(df, score, y), F.col("score"), [], {"below": F.col("neg")}), eps).select("auroc")


def _auroc_of(t: DataFrame, eps: float, *by: str) -> DataFrame:
    won = t.withColumn("won", F.col("pos") * (F.col("below") - F.col("neg") / 2.0))
    out = won.groupBy(*by).agg(F.sum("won").alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(*by, "p", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n") + eps)).otherwise(0.5).alias("auroc"))


def auprc(df: DataFrame, score: str, y: str, eps: float = EPS) -> DataFrame:
    """One row ``auprc``: trapezoids of precision over recall by descending distinct score, no point at recall 0; 0 without positives."""
    return _auprc_of(running(score_table(df, score, y), F.col("score"), [], {"tp": F.col("pos"), "all": F.col("pos") + F.col("neg")}, descending=True), eps).select("auprc")


def _auprc_of(t: DataFrame, eps: float, *by: str) -> DataFrame:
    share = lambda tp, n: tp / (n + eps)
    before, rows_before = F.col("tp") - F.col("pos"), F.col("all") - F.col("pos") - F.col("neg")
    step = share(F.col("tp"), F.col("tp_all")) - share(before, F.col("tp_all"))
    step = F.when(rows_before > 0, step * (share(F.col("tp"), F.col("all")) + share(before, rows_before)) / 2)
    return t.withColumn("step", step).groupBy(*by).agg(F.sum("pos").alias("p"), F.coalesce(F.when(F.max("tp_all") > 0, F.sum("step")), F.lit(0.0)).alias("auprc"))


def regression(df: DataFrame, y: str, p: str, eps: float = EPS) -> DataFrame:
    """One row: mse, rmse, mae, r2."""
    e = F.col(y) - F.col(p)
    out = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_res"), (F.var_pop(y) * F.count(y)).alias("_tot"))
    return out.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.col("_res") / (F.col("_tot") + eps)).alias("r2"))


def perplexity(df: DataFrame, nll: str, weight: str | None = None) -> Column:
    w = F.col(weight) if weight else F.lit(1.0)
    return F.exp(F.sum(F.col(nll) * w) / F.sum(w))


def topk_accuracy(df: DataFrame, scores: str, y: str, k: int) -> Column:
    """Share of rows whose label (a position) is among the k largest scores, ties to the first."""
    from ..functions.vectors import topk

    return F.avg(F.array_contains(topk(F.col(scores), k), F.col(y).cast("int")).cast("double"))


def overlap(df: DataFrame, y: str, p: str, eps: float = EPS) -> DataFrame:
    """(label, iou, dice) of each class as a set of rows."""
    c = per_class(df, y, p)
    both = F.col("tp") + F.col("fp") + F.col("fn")
    return c.select("label", (F.col("tp") / (both + eps)).alias("iou"), (2 * F.col("tp") / (both + F.col("tp") + eps)).alias("dice"))
