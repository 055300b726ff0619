"""Text operators: tokens, n-grams, overlap scores, pair statistics and vocabularies; sequence padding and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, discard
from .ranks import ranked

#: Runs of letters, digits and underscores; with PUNCT also single other characters.
WORD = r"[\p{L}\p{N}_]+"
PUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def detokenized(words: Column) -> Column:
    """Tokens joined by spaces, none before punctuation."""
    return F.regexp_replace(F.array_join(words, " "), r" ([^\p{L}\p{N}_\s])", "$1")


def normalized_space(text: Column) -> Column:
    """Blanks collapsed, none around newlines or at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" *\n *", "\n"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array, space-joined; none for a shorter array."""
    held = F.array(words)  # bound once: a lambda would evaluate the words again for every gram
    last = lambda w: F.size(w) - n + 1
    some = lambda w: F.transform(F.sequence(F.lit(1), last(w)), lambda k: F.array_join(F.slice(w, k, n), " "))
    return F.transform(held, lambda w: F.when(last(w) >= 1, some(w)).otherwise(F.array().cast("array<string>")))[0]


def ngram_counts(df: DataFrame, text: str, n: int, by: list[str] | None = None, pattern: str = WORD) -> DataFrame:
    each = df.select(*(by or []), F.explode(ngrams(tokens(F.col(text), pattern), n)).alias("gram"))
    return each.groupBy(*(by or []), "gram").agg(F.count(F.lit(1)).alias("n"))


def clipped_precision(candidates: DataFrame, references: DataFrame, key: str, n: int) -> DataFrame:
    """(key, matched, total): candidate n-grams that their reference has, each at most as often as it has them."""
    c, r = ngram_counts(candidates, "text", n, [key]), ngram_counts(references, "text", n, [key]).withColumnRenamed("n", "m")
    both = c.join(r, [key, "gram"], "left")
    return both.groupBy(key).agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("matched"), F.sum("n").alias("total"))


def corpus_bleu(candidates: DataFrame, references: DataFrame, key: str, most: int = 4, eps: float = 1e-12) -> DataFrame:
    """One row ``bleu`` of pooled counts, with the brevity penalty; an empty precision counts as eps."""
    out = None
    for n in range(1, most + 1):
        p = clipped_precision(candidates, references, key, n).agg(F.coalesce(F.sum("matched"), F.lit(0)).alias(f"m{n}"), F.coalesce(F.sum("total"), F.lit(0)).alias(f"t{n}"))
        out = p if out is None else out.crossJoin(p)
    size = lambda df, name: df.agg(F.sum(F.size(tokens(F.col("text")))).alias(name))
    out = out.crossJoin(size(candidates, "c")).crossJoin(size(references, "r"))
    logs = [F.ln(F.greatest(F.col(f"m{n}") / F.greatest(F.col(f"t{n}"), F.lit(1)), F.lit(eps))) for n in range(1, most + 1)]
    brevity = F.when(F.col("c") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.greatest(F.col("c"), F.lit(1))))
    return out.select((brevity * F.exp(sum(logs[1:], logs[0]) / most)).alias("bleu"))


def word_table(df: DataFrame, text: str, lower: bool = True) -> DataFrame:
    """(word, n): what pair statistics and merges work on, far smaller than the text."""
    body = F.lower(F.col(text)) if lower else F.col(text)
    return df.select(F.explode(tokens(body)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(words: DataFrame, symbols: str = "symbols") -> DataFrame:
    """(a, b, n): how often adjacent symbols occur, weighted by their words' counts."""
    pairs = F.arrays_zip(F.slice(F.col(symbols), F.lit(1), F.size(symbols) - 1).alias("a"), F.slice(F.col(symbols), F.lit(2), F.size(symbols) - 1).alias("b"))
    return words.where(F.size(symbols) > 1).select("n", F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("n"))


def merge_pairs(symbols: Column, pairs: list[tuple[str, str]]) -> Column:
    """Adjacent pairs joined from left to right; the pairs have no symbol in common."""
    partner = F.create_map(*[F.lit(x) for pair in pairs for x in pair])

    def step(acc: Column, x: Column) -> Column:
        return F.when(partner[F.element_at(acc, -1)] == x, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), x)))).otherwise(F.array_append(acc, x))

    return F.when(F.size(symbols) < 2, symbols).otherwise(F.aggregate(F.slice(symbols, F.lit(2), F.size(symbols)), F.slice(symbols, 1, 1), step))


def merge_pair(symbols: Column, a: str, b: str) -> Column:
    return merge_pairs(symbols, [(a, b)])


def surely_next(top: list[tuple[str, str, int]], most: int) -> list[tuple[str, str]]:
    """How many of the most frequent pairs, in order, are the merges that follow one another whatever each merge brings about.

    Merging a, b makes pairs that are no more frequent than those that a or b had with others.  So a pair is next if
    it shares no symbol with those before it and every pair that meets one of them is rarer than it; a list that ends
    in its own count says nothing about the pairs after its end.
    """
    held: list[tuple[str, str]] = []
    for k, (a, b, n) in enumerate(top[:most]):
        used = {x for pair in held for x in pair}
        if held and (a in used or b in used or a == b):
            break
        if held and n == top[-1][2]:
            break
        ahead = [(x, y) for x, y, m in top if m >= n]
        if any((y == c and (x, y) != (c, d)) or (x == d and (x, y) != (c, d)) or (y == c and x == d) for x, y in ahead for c, d in held):
            break
        held.append((a, b))
        if a == b:
            break
    return held


def bpe_merges(df: DataFrame, text: str, merges: int, ahead: int = 256) -> list[tuple[str, str]]:
    """The most frequent pairs in turn (ties to the smaller pair), as merging one after another would find them.

    Pair counts are a table that is kept: a round changes the words that hold the merged pairs and adds what these words
    lose and gain.  A round takes as many of the first pairs as are sure to follow one another; only the ``ahead`` most
    frequent pairs reach the driver.
    """
    words = cut(word_table(df, text).withColumn("symbols", F.split("word", "")).select("n", "symbols"), "bpe-words")
    counts = cut(pair_counts(words), "bpe-pairs")
    found: list[tuple[str, str]] = []
    while len(found) < merges:
        top = [(r["a"], r["b"], r["n"]) for r in counts.orderBy(F.desc("n"), "a", "b").limit(ahead).collect()]
        if not top:
            break
        pairs = surely_next(top if len(top) == ahead else [*top, ("", "", 0)], min(merges - len(found), len(top)))
        found += pairs
        if len(found) == merges:
            break
        partner = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
        holds = F.exists(F.arrays_zip(F.col("symbols").alias("x"), F.slice("symbols", F.lit(2), F.size("symbols")).alias("y")), lambda p: F.coalesce(partner[p["x"]] == p["y"], F.lit(False)))
        marked = words.withColumn("hit", holds).withColumn("new", F.when(F.col("hit"), merge_pairs(F.col("symbols"), pairs)).otherwise(F.col("symbols")))
        marked = cut(marked, "bpe-words")
        hit = marked.where("hit")
        lost = pair_counts(hit).select("a", "b", (-F.col("n")).alias("n"))
        gained = pair_counts(hit.select("n", F.col("new").alias("symbols")))
        after = counts.unionByName(lost).unionByName(gained).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0")
        after = cut(after, "bpe-pairs")
        discard(counts)
        discard(words)
        words, counts = marked.select("n", F.col("new").alias("symbols")), after
    discard(counts)
    discard(words)
    return found


def substrings(words: DataFrame, longest: int) -> DataFrame:
    """(piece, n): substrings of up to ``longest`` characters, weighted by their words' counts."""
    starts = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    ends = starts.select("word", "n", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("at") + 1))).alias("size"))
    return ends.groupBy(F.col("word").substr(F.col("at"), F.col("size")).alias("piece")).agg(F.sum("n").alias("n"))


def padded(ids: Column, size: int, pad: int = 0) -> Column:
    """Cut or padded to ``size`` elements."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), size)), 1, size)


def mask(ids: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: (k <= F.size(ids)).cast("int"))


def batches(df: DataFrame, key: str, size: int, seed: int | None = None, drop_last: bool = False) -> DataFrame:
    """Adds ``batch``: ``size`` rows each, in the order of a numeric key or, with ``seed``, of a hash of it; the last one partial or gone.

    Places come from ranks in ranges, so no window runs over all rows.
    """
    order = [F.col(key)] if seed is None else [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
    out = ranked(df, *order).withColumn("batch", F.floor((F.col("rank") - 1) / size))
    out = out.where((F.col("batch") + 1) * size <= F.col("rank_all")) if drop_last else out
    return out.drop("rank", "rank_all")


def pad_in_batch(df: DataFrame, ids: str, batch: str = "batch") -> DataFrame:
    """Ids padded to the longest of their batch, with masks."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    out = df.withColumn("_long", longest).withColumn("mask", F.transform(F.sequence(F.lit(1), F.greatest("_long", F.lit(1))), lambda k: (k <= F.size(ids)).cast("int")))
    return out.withColumn("length", F.size(ids)).withColumn(ids, F.slice(F.concat(F.col(ids), F.array_repeat(F.lit(0).cast("long"), F.col("_long"))), F.lit(1), F.col("_long"))).drop("_long")
