"""Augmentation of texts, series and labelled rows.  Chance is a hash of a row's key and a position, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import bound
from .resample import chance, normal

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.split(text, " ", -1)


def _at(key: str, seed: int, salt: int, place: Column) -> Column:
    return chance(key, seed, place.cast("int") * 16 + salt)


def delete_words(text: Column, key: str, share: float = 0.1, seed: int = 0) -> Column:
    """Words go with a chance of ``share``; a text that would lose all keeps its first."""
    kept = F.filter(_words(text), lambda w, i: _at(key, seed, 0, i) >= share)
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(_words(text)[0])


def drop_words(text: Column, key: str, share: float = 0.1, mark: str = "<unk>", seed: int = 0) -> Column:
    """Words become ``mark`` with a chance of ``share``."""
    return F.array_join(F.transform(_words(text), lambda w, i: F.when(_at(key, seed, 1, i) < share, F.lit(mark)).otherwise(w)), " ")


def swap_words(text: Column, key: str, swaps: int = 1, seed: int = 0) -> Column:
    """``swaps`` times two drawn words change places."""

    def step(words: Column, k: Column) -> Column:
        n = F.size(words)
        i, j = F.floor(_at(key, seed, 2, k) * n).cast("int"), F.floor(_at(key, seed, 3, k) * n).cast("int")
        return bound(F.struct(F.least(i, j).alias("low"), F.greatest(i, j).alias("high")), lambda at: _exchanged(words, at["low"], at["high"]))

    return F.array_join(F.aggregate(F.sequence(F.lit(1), F.lit(swaps)), _words(text), step), " ")


def _exchanged(words: Column, low: Column, high: Column) -> Column:
    """An array with the elements at two places, from 0, exchanged."""
    parts = F.slice(words, F.lit(1), low), F.array(words[high]), F.slice(words, low + 2, high - low - 1), F.array(words[low]), F.slice(words, high + 2, F.size(words))
    return F.when(low == high, words).otherwise(F.concat(*parts))


def replace_words(text: Column, key: str, synonyms: dict[str, list[str]], share: float = 0.1, seed: int = 0) -> Column:
    """Words that ``synonyms`` lists become one of theirs with a chance of ``share``; the word is looked up in lower case."""
    if not synonyms:
        return text
    known = F.create_map(*[x for w, s in synonyms.items() for x in (F.lit(w), F.lit(list(s)))])

    def turned(w: Column, i: Column) -> Column:
        s = F.element_at(known, F.lower(w))
        return F.when((_at(key, seed, 4, i) < share) & s.isNotNull(), s[F.floor(_at(key, seed, 5, i) * F.size(s)).cast("int")]).otherwise(w)

    return F.array_join(F.transform(_words(text), turned), " ")


def insert_words(text: Column, key: str, words: list[str], share: float = 0.1, seed: int = 0) -> Column:
    """One of ``words`` follows a word with a chance of ``share``."""
    held = F.lit(list(words))
    more = F.transform(_words(text), lambda w, i: F.when(_at(key, seed, 6, i) < share, F.concat(w, F.lit(" "), held[F.floor(_at(key, seed, 7, i) * len(words)).cast("int")])).otherwise(w))
    return F.array_join(more, " ")


def typos(text: Column, key: str, share: float = 0.02, seed: int = 0) -> Column:
    """Letters become others, doubled or nothing, each third of a chance of ``share``; other characters stay."""
    if share <= 0:
        return text
    letters = F.lit(list(LETTERS))

    def turned(c: Column, i: Column) -> Column:
        u, other = _at(key, seed, 8, i), letters[F.floor(_at(key, seed, 9, i) * 26).cast("int")]
        return F.when((u >= share) | ~c.rlike(r"\p{L}"), c).when(u < share / 3, other).when(u < 2 * share / 3, F.concat(c, c)).otherwise(F.lit(""))

    return F.array_join(F.transform(F.split(text, ""), turned), "")


def random_case(text: Column, key: str, share: float = 0.1, seed: int = 0) -> Column:
    """Words change to upper case, lower case or a capital first letter with a chance of ``share``."""
    turned = lambda w, i: F.when(_at(key, seed, 10, i) >= share, w).otherwise(F.element_at(F.array(F.upper(w), F.lower(w), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), F.floor(_at(key, seed, 11, i) * 3).cast("int") + 1))
    return F.array_join(F.transform(_words(text), turned), " ")


def punctuation_noise(text: Column, key: str, share: float = 0.05, seed: int = 0) -> Column:
    """A word is followed by a mark of punctuation or a second blank with a chance of ``share``."""
    marks = F.lit([",", ".", "!", "?", ";", " "])
    return F.array_join(F.transform(_words(text), lambda w, i: F.when(_at(key, seed, 12, i) < share, F.concat(w, marks[F.floor(_at(key, seed, 13, i) * 6).cast("int")])).otherwise(w)), " ")


def mask_spans(ids: Column, key: str, share: float = 0.15, length: int = 3, mask: int = 0, seed: int = 0) -> Column:
    """Spans of ``length`` positions from drawn starts become ``mask``; about ``share`` of all positions."""
    start = lambda p: (p >= 0) & (_at(key, seed, 14, p) < share / length)

    def hit(i: Column) -> Column:
        found = start(i)
        for back in range(1, length):
            found = found | start(i - back)
        return found

    return F.transform(ids, lambda x, i: F.when(hit(i), F.lit(mask).cast("long")).otherwise(x.cast("long")))


def scaled(series: Column, key: str, sigma: float = 0.1, seed: int = 0) -> Column:
    """All values times one draw around 1."""
    return bound(1 + sigma * normal(key, seed), lambda by: F.transform(series, lambda x: x * by))


def shifted(series: Column, key: str, most: int, fill: float = 0.0, seed: int = 0) -> Column:
    """The series moved by at most ``most`` steps either way; ``fill`` takes the place of what is not known."""
    by = F.floor(chance(key, seed) * (2 * most + 1)).cast("int") - most
    moved = lambda d: F.transform(F.sequence(F.lit(0), F.size(series) - 1), lambda i: F.coalesce(F.when(i - d >= 0, F.get(series, i - d)), F.lit(fill)))
    return F.when(F.size(series) > 0, bound(by, moved)).otherwise(series)


def window(series: Column, key: str, length: int, seed: int = 0) -> Column:
    """``length`` neighbouring values from a drawn start; a shorter series is taken whole."""
    room = F.greatest(F.size(series) - length, F.lit(0)) + 1
    return F.slice(series, F.floor(chance(key, seed) * room).cast("int") + 1, F.lit(length))


def permuted(series: Column, key: str, parts: int = 4, seed: int = 0) -> Column:
    """The series cut into ``parts`` pieces, whose order is drawn."""
    cut = lambda k: F.floor(F.size(series) * k / parts).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(chance(key, seed, k).alias("at"), F.slice(series, cut(k) + 1, cut(k + 1) - cut(k)).alias("of")))
    return F.flatten(F.transform(F.array_sort(pieces), lambda p: p["of"]))


def time_masked(series: Column, key: str, length: int, fill: float = 0.0, seed: int = 0) -> Column:
    """``length`` neighbouring values become ``fill``."""
    start = F.floor(chance(key, seed) * (F.greatest(F.size(series) - length, F.lit(0)) + 1))
    return bound(start, lambda s: F.transform(series, lambda x, i: F.when((i >= s) & (i < s + length), F.lit(fill)).otherwise(x)))


def magnitude_warped(series: Column, key: str, sigma: float = 0.2, knots: int = 4, seed: int = 0) -> Column:
    """Values times a piecewise linear curve around 1 through ``knots`` drawn values, which are drawn once a series."""
    values = F.array(*[1 + sigma * normal(key, seed, 2 * k) for k in range(knots)])

    def curve(v: Column, place: Column) -> Column:
        low = F.least(F.floor(place * (knots - 1)).cast("int"), F.lit(knots - 2))
        part = place * (knots - 1) - low
        return v[low] * (1 - part) + v[low + 1] * part

    return bound(values, lambda v: F.transform(series, lambda x, i: x * curve(v, i / F.greatest(F.size(series) - 1, F.lit(1)))))


def time_warped(series: Column, key: str, strength: float = 0.1, seed: int = 0) -> Column:
    """Values read at places moved by a drawn half wave (both ends stay), linearly interpolated."""
    last = F.size(series) - 1
    bend = strength * (2 * chance(key, seed) - 1)

    def read(i: Column) -> Column:
        t = i / F.greatest(last, F.lit(1))
        at = F.least(F.greatest((t + bend * F.sin(3.141592653589793 * t)) * last, F.lit(0.0)), last.cast("double"))
        low = F.floor(at).cast("int")
        return series[low] + (at - low) * (F.get(series, F.least(low + 1, last)) - series[low])

    return F.transform(F.sequence(F.lit(0), last), read)


def mixup(df: DataFrame, key: str, vector: str, label: str, classes: int, seed: int = 0) -> DataFrame:
    """(key, vector, label shares): every row mixed by a uniform share with a partner.

    Rows are ordered by a hash of their key and meet the row one after; the hash's range decides the task, and the first of a range
    is its last one's partner, so no window sees all rows.  A row alone in its range stays as it is.
    """
    from pyspark.sql import Window

    rows = df.select(F.col(key), F.col(vector).alias("_v"), F.col(label).alias("_y"), F.xxhash64(F.lit(seed), key).alias("_h"))
    size = df.count()
    rows = rows.withColumn("_part", F.pmod("_h", F.lit(max(1, size // 4096))))
    order = Window.partitionBy("_part").orderBy("_h", key)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_w": F.coalesce(F.lead("_v").over(order), F.first("_v").over(whole)), "_z": F.coalesce(F.lead("_y").over(order), F.first("_y").over(whole)), "_t": chance(key, seed, 1)})
    shares = F.array(*[F.col("_t") * (F.col("_y") == c).cast("double") + (1 - F.col("_t")) * (F.col("_z") == c).cast("double") for c in range(classes)])
    return rows.select(key, F.zip_with("_v", "_w", lambda a, b: F.col("_t") * a + (1 - F.col("_t")) * b).alias(vector), shares.alias(label))


def composed(*steps):
    """One step that applies all in order."""

    def run(c: Column) -> Column:
        for step in steps:
            c = step(c)
        return c

    return run


def sometimes(step, key: str, share: float = 0.5, seed: int = 0):
    """``step`` with a chance of ``share`` a row."""
    return lambda c: F.when(chance(key, seed, 77) < share, step(c)).otherwise(c)


def one_of(steps: list, key: str, seed: int = 0):
    """One of the steps a row, all alike likely."""
    pick = F.floor(chance(key, seed, 78) * len(steps))
    return lambda c: F.coalesce(*[F.when(pick == k, step(c)) for k, step in enumerate(steps)])
