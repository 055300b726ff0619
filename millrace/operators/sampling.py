"""Weighted sampling with replacement: every draw finds the row in whose share of the summed weight it falls.

The rows lie in ranges of their key, and the sum of each range is a row of a small table.  A draw finds its range
there and its row inside the range by one ordered pass over rows and draws together.  A range that attracts many draws
is dealt out in blocks, each with the range's rows, so that a heavy row does not gather all draws in one task.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import in_ranges
from .resample import drawn

#: Draws of a block, about.
BLOCK_DRAWS = 100_000


def draws(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(draw, u): n numbered draws from [0, 1)."""
    return spark.range(n).select(F.col("id").alias("draw"), drawn("id", seed).alias("u"))


def _weight(weight: Column | None) -> Column:
    if weight is None:
        return F.lit(1.0)
    w = weight.cast("double")
    return F.when(w.isNull() | F.isnan(w) | (w < 0), 0.0).otherwise(w)


def pick(rows: DataFrame, key: str, weight: Column | None, asked: DataFrame, block_draws: int = BLOCK_DRAWS) -> DataFrame:
    """(draw, key): for each of ``asked`` (draw, u) the row at ``u`` of the summed weight, rows in the order of a numeric key.

    Null, NaN and negative weights count as 0 and such rows are never drawn; if all are 0, all rows weigh the same.
    No rows, no result.  Rows of one key are drawn by their weights together; rows without a key are not drawn.
    """
    named = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), _weight(weight).alias("w")).groupBy("key").agg(F.sum("w").alias("w"))
    total = named.agg(F.sum("w")).first()[0]
    named = named.withColumn("w", F.lit(1.0)) if total == 0 else named.where("w > 0")
    ranged = in_ranges(named, F.col("key")).persist()
    per = sorted((r["_range"], r["s"]) for r in ranged.groupBy("_range").agg(F.sum("w").alias("s")).collect())  # a row a range
    if not per:
        ranged.unpersist()
        return asked.select("draw", F.lit(None).cast(rows.schema[key].dataType).alias(key)).where("false")
    starts = [0.0, *accumulate(s for _, s in per)]
    total, n = starts.pop(), asked.count()
    blocks = [max(1, round(n * s / total / block_draws)) for _, s in per]
    number, start, block = (F.lit(list(x)) for x in ([r for r, _ in per], starts, blocks))
    at = F.col("u") * total
    place = F.size(F.filter(start, lambda b: b <= at))
    thrown = asked.select("draw", at.alias("at"), place.alias("place")).select(F.element_at(number, F.col("place")).alias("_range"), F.pmod(F.xxhash64("draw"), F.element_at(block, F.col("place"))).cast("int").alias("block"), "at", F.lit(1).alias("kind"), "draw", F.lit(None).cast(rows.schema[key].dataType).alias("key"))
    own = F.array_position(number, F.col("_range")).cast("int")
    inside = Window.partitionBy("_range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.withColumn("at", F.element_at(start, own) + F.coalesce(F.sum("w").over(inside), F.lit(0.0))).withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(block, own) - 1)))
    held = held.select("_range", "block", "at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("draw"), "key")
    line = Window.partitionBy("_range", "block").orderBy("at", "kind", "key").rowsBetween(Window.unboundedPreceding, 0)
    return held.unionByName(thrown).withColumn("found", F.last("key", ignorenulls=True).over(line)).where("kind = 1").select("draw", F.col("found").alias(key))


def weighted_sample(rows: DataFrame, key: str, weight: Column | None, n: int, seed: int = 0) -> DataFrame:
    """(draw, key): n draws with replacement, in proportion to weight."""
    return pick(rows, key, weight, draws(rows.sparkSession, n, seed))


def mixed(tables: list[DataFrame], key: str, weights: list[float], n: int, seed: int = 0) -> DataFrame:
    """(draw, source, key): each draw takes a table by the weights, then one of its rows, all alike."""
    if len(tables) != len(weights) or not tables or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("every table needs a weight, none negative and not all zero")
    ends = [c / sum(weights) for c in accumulate(weights)]
    which = F.least(F.size(F.filter(F.lit(ends), lambda e: e <= F.col("u"))), F.lit(len(ends) - 1))
    thrown = draws(tables[0].sparkSession, n, seed).withColumn("source", which)
    out = None
    for k, table in enumerate(tables):
        own = thrown.where(F.col("source") == k).select("draw", drawn("draw", seed + 1).alias("u"))
        got = pick(table, key, None, own).select("draw", F.lit(k).alias("source"), key)
        out = got if out is None else out.unionByName(got)
    return out


def categorical(probs: Column, key: str, n: int, seed: int = 0) -> Column:
    """n places (from 0) of an array of probabilities, drawn with replacement; an array that does not sum to 1 is softmaxed first."""
    from ..functions.vectors import softmax

    total = F.aggregate(probs, F.lit(0.0), lambda s, x: s + x)
    p = F.when(F.abs(total - 1) <= 1e-5, probs).otherwise(softmax(probs))

    def one(k: Column) -> Column:
        u = drawn(key, seed, k)
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["at"] + (s["sum"] + x <= u).cast("int")).alias("at"))
        return F.least(F.aggregate(p, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at")), step, lambda s: s["at"]), F.size(probs) - 1)

    return F.transform(F.sequence(F.lit(1), F.lit(n)), one)


