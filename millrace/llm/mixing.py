"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Sources get weights and, from them, word targets that stop at a multiple of what a source holds.  Equal
blocks of words are then dealt to sources, and within a source to its shards, by highest quotients
``target / (2k + 1)``; a shard takes its quota as whole passes plus one run of blocks that starts at a
seeded block of its seeded document order.  Only sums per source and per shard are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 22
PASSES = 3
SEED = 20260


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(row_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("null"))))


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def fill_targets(sources: DataFrame, passes: int = PASSES) -> DataFrame:
    """Add ``target`` to (source_rank, weight, source_size).

    All words are shared by weight; a target stops at ``passes`` times its source's size and the excess is
    shared again by weight.  With sources in order of size per weight, the level that this ends at is the
    highest of the levels that any number of stopped sources leaves for the others.
    """
    whole = Window.partitionBy(F.lit(0))
    before = whole.orderBy("ratio", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    cap = (F.col("source_size") * passes).cast("double")
    held = sources.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    free = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    held = held.withColumn("level", free / left)
    level = F.max("level").over(whole)
    return held.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).drop("cap", "ratio", "level")


def apportion(claims: DataFrame, group: list[str], claim: str, order: str, seats: Column, out: str) -> DataFrame:
    """Deal ``seats`` of each group to its rows by highest quotients ``claim / (2k + 1)``, ties by ``order``.

    Quotients that surely win are counted, not listed: with n claims of sum T and S seats, all those of at
    least T / (2S - n) win and none below T / (2S + n) does, so about 2n quotients are left to compare.
    """
    by = Window.partitionBy(*(group or [F.lit(0)]))
    total, n = F.sum(claim).over(by), F.sum(F.when(F.col(claim) > 0, 1).otherwise(0)).over(by)
    known = claims.withColumn("_s", seats.cast("double")).withColumn("_t", total.cast("double")).withColumn("_n", n)
    share = F.col(claim).cast("double") / F.col("_t")
    sure = F.floor((share * (2 * F.col("_s") - F.col("_n")) + 1) / 2)
    open_ = F.floor((share * (2 * F.col("_s") + F.col("_n")) + 1) / 2)
    live = (F.col(claim) > 0) & (F.col("_s") > 0)
    known = known.withColumn("_k0", F.when(live, F.greatest(sure, F.lit(0))).otherwise(0).cast("long"))
    known = known.withColumn("_k1", F.when(live, F.greatest(open_, F.col("_k0"))).otherwise(0).cast("long"))
    known = known.withColumn("_rest", F.col("_s") - F.sum("_k0").over(by))
    each = known.withColumn("_k", F.explode(F.sequence("_k0", "_k1")))
    quotient = F.when(live, F.col(claim).cast("double") / (2 * F.col("_k") + 1)).otherwise(0.0)
    place = F.row_number().over(by.orderBy(F.desc("_q"), F.asc(order)))
    each = each.withColumn("_q", quotient).withColumn("_won", ((F.col("_q") > 0) & (place <= F.col("_rest"))).cast("long"))
    rows = [c for c in claims.columns]
    return each.groupBy(*rows, "_k0").agg((F.col("_k0") + F.sum("_won")).alias(out)).drop("_k0")


def mix(
    docs: DataFrame,
    *,
    row_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Column | None = None,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    passes: int = PASSES,
    seed: int = SEED,
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns one row per document: ``doc_id, size, source_size, target, taken``, the word interval
    ``[start, start + part)`` (circular in the document) that is taken beside ``whole`` full passes, and
    ``row``, which is ``keep`` (default: null).  Sources in code point order, null last, weigh 1, 2, 3, 1, ...
    A null text has size 0 and is never taken; a null source is a source; repeated rows are rows of their
    own, and rows that agree in id and size are interchangeable; an empty table gives an empty result.
    Columns other than the three named are not looked at.
    """
    size = word_count(F.col(text)).alias("size")
    key = _key(F.col(row_id), seed).alias("order_key")
    plain = docs.select(F.col(row_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size, key)
    sizes = cut(plain.select("source", "size", "order_key"), "mix-sizes")

    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source")))
    sources = sources.withColumn("source_rank", rank).withColumn("weight", (F.col("source_rank") - 1) % 3 + 1)
    seats = F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block_words)
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long")
    sources = fill_targets(sources, passes).withColumn("shards", shards).withColumn("all_seats", seats)
    sources = cut(apportion(sources, [], "target", "source_rank", F.col("all_seats"), "seats"), "mix-sources")

    named = sources.withColumnRenamed("source", "named")

    def placed(rows: DataFrame) -> DataFrame:
        shard = _number(F.substring("order_key", 1, 8)) % F.col("shards")
        return rows.join(named, F.col("source").eqNullSafe(F.col("named"))).withColumn("shard", shard)

    cells = placed(sizes).groupBy("source_rank", "shard", "seats").agg(F.sum("size").alias("cell_size"))
    cells = apportion(cells, ["source_rank"], "cell_size", "shard", F.col("seats"), "quota")
    words = F.least(F.col("quota") * block_words, F.col("cell_size") * passes)
    starts = F.greatest(F.ceil(F.col("cell_size") / block_words), F.lit(1)).cast("long")
    pick = _number(F.substring(_key(F.concat_ws(":", "source_rank", "shard"), seed + 1), 1, 8)) % starts
    cells = cells.withColumn("words", words).withColumn("first", pick * block_words)
    cells = cut(cells.select("source_rank", "shard", "cell_size", "words", "first"), "mix-cells")

    tie = F.xxhash64(F.col(text)).alias("tie")
    rows = docs.select(F.col(row_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size, key, tie, (F.lit(None) if keep is None else keep).alias("row"))
    rows = placed(rows).join(cells, ["source_rank", "shard"])
    by = Window.partitionBy("source_rank", "shard").orderBy("order_key", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("size").over(by)).withColumn("begin", F.col("end") - F.col("size"))
    whole = F.when(F.col("cell_size") > 0, F.floor(F.col("words") / F.col("cell_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("whole", whole).withColumn("until", F.col("first") + F.col("words") - F.col("whole") * F.col("cell_size"))

    def common(shift: Column) -> Column:
        low = F.greatest(F.col("begin") + shift, F.col("first"))
        return F.greatest(F.least(F.col("end") + shift, F.col("until")) - low, F.lit(0))

    here, wrapped = common(F.lit(0)), common(F.col("cell_size"))
    rows = rows.withColumn("here", here).withColumn("wrapped", wrapped)
    start = F.when(F.col("here") > 0, F.greatest(F.col("first") - F.col("begin"), F.lit(0))).otherwise(0)
    taken = F.col("whole") * F.col("size") + F.col("here") + F.col("wrapped")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "whole", start.alias("start"), (F.col("here") + F.col("wrapped")).alias("part"), "row")


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it whole, and its taken words if only in part.

    A part is the taken words joined by single spaces.  All columns of ``docs`` return; ``n_chars``, where
    there is one, is set anew.  Documents of which nothing is taken go.
    """
    out = mix(docs, text=text, keep=F.struct(*[F.col(f"`{c}`") for c in docs.columns]), **options)
    words = F.filter(F.split(F.col(f"row.`{text}`"), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    tail = F.slice(words, (F.col("start") + 1).cast("int"), F.greatest(F.least(F.col("part"), F.col("size") - F.col("start")), F.lit(0)).cast("int"))
    over = F.greatest(F.col("part") - (F.col("size") - F.col("start")), F.lit(0)).cast("int")
    part = F.concat_ws(" ", F.concat(tail, F.slice(words, 1, over)))
    whole = F.array_repeat(F.col(f"row.`{text}`"), (F.col("whole") + (F.col("part") == F.col("size")).cast("long")).cast("int"))
    pieces = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.concat(whole, F.array(part))).otherwise(whole)
    out = out.where("taken > 0").select("row", F.explode(pieces).alias("piece"))
    columns = [F.col("piece").alias(c) if c == text else F.length("piece").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns)
