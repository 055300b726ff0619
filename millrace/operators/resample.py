"""Resampling and augmentation; chance is a hash of a row's key, so results do not depend on partitions or reruns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .neighbours import near
from .ranks import ranked


def chance(key: str | Column, seed: int, salt: int | Column = 0) -> Column:
    """A number in [0, 1) that key, seed and salt determine."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt) if isinstance(salt, int) else salt, k), F.lit(1 << 52)) / float(1 << 52)


def drawn(key: str | Column, seed: int, salt: int | str | Column = 0) -> Column:
    """A number in [0, 1) from the MD5 of ``seed:salt:key``, which SQL elsewhere can draw as well."""
    k = F.col(key) if isinstance(key, str) else key
    mark = salt if isinstance(salt, Column) else F.lit(salt)
    text = F.concat_ws(":", F.lit(str(seed)), mark.cast("string"), k.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(1 << 52)


def normal(key: str | Column, seed: int, salt: int = 0) -> Column:
    """A standard normal number from two chances."""
    return F.sqrt(-2 * F.ln(1 - chance(key, seed, salt))) * F.cos(6.283185307179586 * chance(key, seed, salt + 1))


def bootstrap(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Every row as often as a Poisson(1) draw of its key says."""
    u, total, p, counts = chance(key, seed), 0.0, 0.36787944117144233, F.lit(0)
    for k in range(12):
        total += p
        counts = counts + (u >= total).cast("int")
        p /= k + 1
    return df.withColumn("_k", counts).where("_k > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_k"))).drop("_k", "_copy")


def jitter(df: DataFrame, columns: list[str], key: str, sigma: float = 0.05, seed: int = 0) -> DataFrame:
    return df.select(*[(F.col(c) + sigma * normal(key, seed, 10 * k)).alias(c) if c in columns else F.col(c) for k, c in enumerate(df.columns)])


def feature_dropout(df: DataFrame, columns: list[str], key: str, share: float = 0.05, missing: float = 0.0, seed: int = 0) -> DataFrame:
    return df.select(*[F.when(chance(key, seed, k) < share, F.lit(missing)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for k, c in enumerate(df.columns)])


def _between(own: DataFrame, minority: DataFrame, key: str, vector: str, k: int, seed: int, **cells) -> DataFrame:
    """(query, copy, vector) for each of ``own`` (query, copy): a drawn point between the row and one of its k nearest of the minority."""
    found = near(minority, key, vector, k, **cells).select(F.col("query"), F.col(key).alias("_near"), "rank")
    mark = F.concat_ws(":", F.col("query").cast("string"), F.col("copy").cast("string"))
    sizes = found.groupBy("query").agg(F.max("rank").alias("_k"))
    asked = own.join(sizes, "query").withColumn("rank", F.floor(drawn(mark, seed, "near") * F.col("_k")).cast("int") + 1).join(found, ["query", "rank"])
    a = minority.select(F.col(key).alias("query"), F.col(vector).alias("_a"))
    b = minority.select(F.col(key).alias("_near"), F.col(vector).alias("_b"))
    t = drawn(mark, seed, "between")
    made = F.transform(F.arrays_zip("_a", "_b"), lambda p: p["_a"] + F.col("t") * (p["_b"] - p["_a"]))
    return asked.join(a, "query").join(b, "_near").withColumn("t", t).select("query", "copy", made.alias(vector))


def smote(minority: DataFrame, key: str, vector: str, copies: int, k: int = 5, seed: int = 0, **cells) -> DataFrame:
    """New vectors between a minority row and one of its k nearest, ``copies`` a row; a lone row has none."""
    own = minority.select(F.col(key).alias("query"), F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    return _between(own, minority, key, vector, k, seed, **cells)


def foreign_share(df: DataFrame, key: str, vector: str, label: str, value, m: int = 10, **cells) -> DataFrame:
    """(key, foreign, share) of the rows with label ``value``: how many of their m nearest rows of all have another label."""
    found = near(df, key, vector, m, F.col(label) == F.lit(value), **cells)
    other = df.select(F.col(key), (~F.col(label).eqNullSafe(F.lit(value))).cast("long").alias("_other"))
    sums = found.join(other, key).groupBy("query").agg(F.sum("_other").alias("foreign"), F.avg("_other").alias("share"))
    return sums.withColumnRenamed("query", key)


def wanted(df: DataFrame, label: str, value) -> int:
    """How many rows label ``value`` lacks to the most frequent label."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count().agg(F.max("count").alias("most"), F.max(F.when(F.col(label) == F.lit(value), F.col("count"))).alias("own")).first()
    return max(0, (counts["most"] or 0) - (counts["own"] or 0)) if counts["own"] else 0


def shared_out(shares: DataFrame, key: str, share: str, n: int) -> DataFrame:
    """(key, copies): n dealt in proportion to ``share``, whole parts first and what is left to the largest shares (ties to the smaller key).

    If all shares are 0, all rows have the same.
    """
    total = shares.agg(F.sum(share), F.count(F.lit(1))).first()
    part = F.col(share) / F.lit(total[0]) if total[0] else F.lit(1.0 / max(total[1], 1))
    held = shares.withColumn("copies", F.floor(part * n).cast("long"))
    left = n - (held.agg(F.sum("copies")).first()[0] or 0)
    turn = ranked(held, -F.col(share), F.col(key))
    more = F.floor((left - F.col("rank")) / F.col("rank_all")) + 1  # turns after the first only where rounding lost more than a row each
    return turn.select(key, (F.col("copies") + F.greatest(more, F.lit(0))).cast("long").alias("copies"))


def adaptive(df: DataFrame, key: str, vector: str, label: str, value, n: int | None = None, m: int = 10, k: int = 5, seed: int = 0, **cells) -> DataFrame:
    """(query, copy, vector): n new rows of label ``value`` (default: as many as it lacks), more from rows among foreign ones.

    A minority of fewer than two rows gets none.
    """
    minority = df.where(F.col(label) == F.lit(value))
    shares = cut(foreign_share(df, key, vector, label, value, m, **cells), "shares")
    counts = shared_out(shares, key, "foreign", wanted(df, label, value) if n is None else n).where("copies > 0")
    own = counts.select(F.col(key).alias("query"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return _between(own, minority, key, vector, k, seed, **cells)


def borderline(df: DataFrame, key: str, vector: str, label: str, value, n: int | None = None, m: int = 10, k: int = 5, seed: int = 0, **cells) -> DataFrame:
    """(query, copy, vector): n new rows from the rows of label ``value`` with at least half of their m neighbours foreign, drawn alike.

    If there are none, all rows of the label are drawn from.
    """
    n = wanted(df, label, value) if n is None else n
    minority = df.where(F.col(label) == F.lit(value))
    shares = cut(foreign_share(df, key, vector, label, value, m, **cells), "shares")
    edge = shares.where(F.col("foreign") >= m // 2)
    if edge.isEmpty():
        edge = shares
    edge = ranked(edge.select(key), F.col(key)).select(F.col(key).alias("query"), (F.col("rank") - 1).alias("place"))
    size = edge.count()
    own = df.sparkSession.range(1, n + 1).select(F.col("id").alias("copy"), F.least(F.floor(drawn("id", seed, "edge") * size), F.lit(size - 1)).cast("long").alias("place"))
    return _between(own.join(edge, "place").select("query", "copy"), minority, key, vector, k, seed, **cells)


def category_swapped(df: DataFrame, columns: list[str], label: str, key: str, rows: float = 0.3, share: float = 0.5, seed: int = 0) -> DataFrame:
    """``df`` with categories of drawn rows taken from another drawn row of the same label, column by column with a chance of ``share``.

    Donors are found by their place among the rows of their label, so a frequent label is no key of its own.
    """
    placed = ranked(df, F.xxhash64(F.lit(seed), F.col(key)), F.col(key), by=label)
    hit = (drawn(key, seed, "row") < rows) & (F.col("rank_all") > 1)
    asks = F.when(hit, F.least(F.floor(drawn(key, seed, "donor") * F.col("rank_all")) + 1, F.col("rank_all"))).otherwise(F.col("rank"))
    donors = placed.select(F.col(label).alias("_label"), F.col("rank").alias("_rank"), *[F.col(c).alias(f"_from_{c}") for c in columns])
    both = placed.withColumn("_asks", asks).withColumn("_hit", hit).join(donors, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_asks") == F.col("_rank")))
    return both.select(*[F.when(F.col("_hit") & (drawn(key, seed, f"column {c}") < share), F.col(f"_from_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def rare_weights(df: DataFrame, columns: list[str], power: float = 1.0, eps: float = 1e-6, out: str = "weight") -> DataFrame:
    """``df`` with the mean over ``columns`` of 1 / (how often the row's category occurs) ** power."""
    held, total = df, F.lit(0.0)
    for c in columns:
        counts = df.groupBy(F.col(c).alias(f"_{c}")).agg(F.count(F.lit(1)).alias(f"_n_{c}"))
        held = held.join(counts, F.col(c).eqNullSafe(F.col(f"_{c}")))
        total = total + 1 / F.pow(F.col(f"_n_{c}") + eps, F.lit(float(power)))
    return held.select(*df.columns, (total / len(columns) if columns else F.lit(1.0)).alias(out))


def rare_resampled(df: DataFrame, columns: list[str], key: str, n: int | None = None, power: float = 1.0, seed: int = 0) -> DataFrame:
    """(draw, all columns): n rows (default: as many as there are) drawn with replacement, rare categories more often."""
    from .sampling import weighted_sample

    weighed = cut(rare_weights(df, columns, power, out="_weight"), "weights")
    taken = weighted_sample(weighed, key, F.col("_weight"), weighed.count() if n is None else n, seed)
    return taken.join(df, key).select("draw", *df.columns)


def mask_tokens(ids: Column, key: str, share: float, mask: int = 0, seed: int = 0) -> Column:
    """Ids replaced by ``mask`` with a chance of their row and position."""
    return F.transform(ids, lambda x, i: F.when(chance(key, seed, i) < share, F.lit(mask).cast("long")).otherwise(x))
