"""Queries of tables made up from the keys of given ones, and of augmentations: each states what holds for every row, whatever is drawn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import augment as A
from ..operators import synthetic as S
from .registry import query, table

_NAMES = ["addition", "blobs", "checkerboard", "classification", "copy", "dyck", "gaussian_quantiles", "low_rank", "next_tokens", "outliers", "question_answers", "regression", "reverse", "sort", "spirals", "xor"]


@query("SELECT made, (SELECT count(*) FROM orders) AS n, true AS holds FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "]) AS made)")
def made_tables(spark, sf):
    """A row of each generator for every order, and whether its rule holds for all of them."""
    keys = table(spark, sf, "orders").select("o_orderkey")
    v = F.col("v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    part = lambda sep, i: F.split("source", sep)[i]
    depth = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: 2 * F.length(F.replace(F.substring("text", F.lit(1), i), F.lit(")"), F.lit(""))) - i)
    rules: dict[str, tuple[DataFrame, Column]] = {
        "addition": (S.addition(spark, keys), part(r"\+", 0).cast("long") + F.regexp_extract("source", r"\+(\d+)=", 1).cast("long") == F.col("target").cast("long")),
        "blobs": (S.blobs(spark, keys, [0.1, 1.0]), (F.size("v") == 2) & F.col("label").between(0, 1)),
        "checkerboard": (S.checkerboard(spark, keys), (F.floor(v[0] * 4) + F.floor(v[1] * 4)) % 2 == F.col("label")),
        "classification": (S.classification(spark, keys, 3, 3, weights=[1, 2, 7], flip=0.05), F.col("label").between(0, 2) & (F.size("v") == 3)),
        "copy": (S.sequence_task(spark, keys, "copy"), F.col("source") == F.col("target")),
        "dyck": (S.dyck(spark, keys), F.forall(depth, lambda d: d >= 0) & (F.element_at(depth, -1) == 0) & (F.length("text") == 12)),
        "gaussian_quantiles": (S.gaussian_quantiles(spark, keys), F.col("label").between(0, 2)),
        "low_rank": (S.low_rank(spark, keys, 8, 2), F.size("v") == 8),
        "next_tokens": (S.next_tokens(S.dyck(spark, keys), "text"), F.slice("source", 2, 10) == F.slice("target", 1, 10)),
        "outliers": (S.outliers(spark, keys), (F.col("label") == 0) | (norm >= 8)),
        "question_answers": (S.question_answers(spark, keys), F.contains("context", F.concat(F.regexp_extract("question", r"person (\d+)", 1), F.lit(" has the "), F.col("answer")))),
        "regression": (S.regression(spark, keys, noise=0.0, informative=0), F.abs("y") < 1e-9),
        "reverse": (S.sequence_task(spark, keys, "reverse"), F.reverse("source") == F.col("target")),
        "sort": (S.sequence_task(spark, keys, "sort"), F.array_sort("source") == F.col("target")),
        "spirals": (S.spirals(spark, keys, noise=0.0), norm <= 1),
        "xor": (S.xor(spark, keys), ((v[0] > 0) != (v[1] > 0)) == (F.col("label") == 1)),
    }
    each = [df.agg(F.lit(n).alias("made"), F.count(F.lit(1)).alias("n"), F.bool_and(rule).alias("holds")) for n, (df, rule) in rules.items()]
    return reduce(DataFrame.unionByName, each)


@query("SELECT count(*) AS users, true AS unique_pairs, true AS in_range FROM customer")
def made_ratings(spark, sf):
    """Ratings of fifty things by every customer."""
    r = S.ratings(spark, table(spark, sf, "customer").select("c_custkey"), 50)
    return r.agg(F.count_distinct("user").alias("users"), (F.count(F.lit(1)) == F.count_distinct("user", "item")).alias("unique_pairs"), F.bool_and(F.col("rating").between(1, 5)).alias("in_range"))


_SPLIT = "string_split(text, ' ')"


@query(f"SELECT doc_id, len({_SPLIT})::BIGINT AS n_words, md5(array_to_string(list_sort({_SPLIT}), ' ')) AS sorted_words, true AS dropped_stays, true AS cased_stays, true AS inserted_grows, true AS deleted_shrinks, true AS typos_stay, true AS marks_stay, true AS synonyms_stay FROM documents WHERE text IS NOT NULL")
def augmented_texts(spark, sf):
    """What the augmentations of whole texts leave as it was."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    text, n = F.col("text"), lambda c: F.size(F.split(c, " ", -1))
    return d.select(
        "doc_id",
        n(A.swap_words(text, "doc_id", 2)).cast("long").alias("n_words"),
        F.md5(F.array_join(F.array_sort(F.split(A.swap_words(text, "doc_id", 2), " ", -1)), " ")).alias("sorted_words"),
        (n(A.drop_words(text, "doc_id")) == n(text)).alias("dropped_stays"),
        (F.upper(A.random_case(text, "doc_id")) == F.upper(text)).alias("cased_stays"),
        (n(A.insert_words(text, "doc_id", ["so", "then"])) >= n(text)).alias("inserted_grows"),
        (n(A.delete_words(text, "doc_id")) <= n(text)).alias("deleted_shrinks"),
        (F.regexp_replace(A.typos(text, "doc_id"), r"\p{L}+", "") == F.regexp_replace(text, r"\p{L}+", "")).alias("typos_stay"),
        (F.translate(A.punctuation_noise(text, "doc_id"), ",.!?; ", "") == F.translate(text, ",.!?; ", "")).alias("marks_stay"),
        (n(A.replace_words(text, "doc_id", {"the": ["a", "one"], "and": ["or"]}, 0.5)) == n(text)).alias("synonyms_stay"),
    )


@query("SELECT vec_id, len(embedding)::BIGINT AS n, true AS permuted_stays, 16 AS window_size, 8 AS masked, true AS warped_size, true AS spans_size FROM embeddings")
def augmented_series(spark, sf):
    """What the augmentations of series leave as it was."""
    s = F.transform("embedding", lambda x: x.cast("double") + 100)
    d = table(spark, sf, "embeddings").select("vec_id", s.alias("s"))
    s = F.col("s")
    same = lambda c: F.size(c) == F.size(s)
    return d.select(
        "vec_id",
        F.size(A.shifted(s, "vec_id", 5)).cast("long").alias("n"),
        (F.array_sort(A.permuted(s, "vec_id")) == F.array_sort(s)).alias("permuted_stays"),
        F.size(A.window(s, "vec_id", 16)).alias("window_size"),
        F.size(F.filter(A.time_masked(s, "vec_id", 8), lambda x: x == 0)).alias("masked"),
        (same(A.time_warped(s, "vec_id")) & same(A.magnitude_warped(s, "vec_id")) & same(A.scaled(s, "vec_id"))).alias("warped_size"),
        same(A.mask_spans(F.transform(s, lambda x: x.cast("long")), "vec_id")).alias("spans_size"),
    )


@query("SELECT vec_id, 1.0::DOUBLE AS share, len(embedding)::BIGINT AS n FROM embeddings")
def mixed_up(spark, sf):
    """Every row mixed with a partner; its label shares sum to one."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    top = e.agg(F.max("label")).first()[0] or 0
    m = A.mixup(e, "vec_id", "v", "label", int(top) + 1)
    return m.select("vec_id", F.round(F.aggregate("label", F.lit(0.0), lambda s, x: s + x), 6).alias("share"), F.size("v").cast("long").alias("n"))
