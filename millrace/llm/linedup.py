"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

A line (trimmed, lower case) is the set of its character shingles: SHINGLE characters from every position; a
shorter line is its only shingle.  Its signature is, for each of q * q masks, the least ``hash XOR mask`` of the
shingles in UTF-16, where a character beyond the first plane counts twice; all else takes whole characters.
Bands are lines of the affine plane of order q: q values a band, any two bands share at most one value, and so
many bands come from few values.

Lines are told apart by two hashes of 64 bits, and each distinct line gets a number of its own.  One
aggregation finds the buckets that several lines share, and only their members go further.  Two or three lines are paired at once; in larger
buckets all are compared with one pivot, the most common line, and only buckets whose lines are then still in
different components need more: small ones are paired, larger ones are dealt out again by the rarest fifth of
each line's shingles, of which two lines of Jaccard 0.8 must share one.  Pairs whose sketches,
parities of shingles at hashed places, differ too often cannot be links; all others are verified by the exact
Jaccard similarity of the whole shingle sets.  Links become components by star contraction; of each component the
first line stays.
"""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import cut, discard, fresh

SHINGLE = 8
THRESHOLD = 0.8
#: Order of the plane (2, 3 or 5; or 4) and how many of its classes of parallel lines are bands.
ORDER = 4
CLASSES = 3
SEED = 7
#: Split buckets of that many lines or fewer are compared in pairs; larger ones are dealt out by rare shingles.
CROWD = 2_000
#: Words of 64 bits of a line's sketch.
WORDS = 16
#: Shingles hashed for each exploded row of the signature pass, and before rows are exploded.
STEP, HEAD = 16, 8
#: What is cut from the ends of a line.
BLANK = " \t\r\x0b\f"
#: Largest size of the bit sets that keep rows out of shuffles, as a power of two.
BITS = 26


def planes(order: int = ORDER, classes: int = CLASSES) -> list[list[int]]:
    """Bands as positions in a signature of order ** 2 values: ``classes`` classes of ``order`` disjoint lines."""
    if order == 4:  # the field of four elements
        times, plus = [[0, 0, 0, 0], [0, 1, 2, 3], [0, 2, 3, 1], [0, 3, 1, 2]], lambda a, b: a ^ b
    else:
        times, plus = [[a * b % order for b in range(order)] for a in range(order)], lambda a, b: (a + b) % order
    slopes = [[[x * order + plus(times[m][x], c) for x in range(order)] for c in range(order)] for m in range(order)]
    slopes.append([[x * order + y for y in range(order)] for x in range(order)])
    return [band for group in slopes[:classes] for band in group]


def _last(code: Column, width: int, size: int) -> Column:
    """The place of the last shingle of an encoded line, ``size`` bytes a place."""
    return F.greatest((F.octet_length(code) / size).cast("int") - width, F.lit(0))


def _hash_at(place: str, width: int) -> Column:
    """The hash of the shingle of ``code`` (UTF-16) at ``place``, or of the last one if that comes first.

    Bits and IF stand for sums and the least of two, which generated code keeps in fields and checks for overflow.
    """
    return F.hash(F.substring("code", F.expr(f"shiftleft(IF({place} < last, {place}, last), 1) | 1"), F.lit(width * 2)))


def _least(masks: list[int], count: int, *before: str) -> list[Column]:
    """For each mask the least ``hash XOR mask`` of h0, h1, ..., and of what the columns ``before`` the mask's number hold."""
    return [F.least(*[F.col(f"{c}{k}") for c in before], *[F.col(f"h{j}").bitwiseXOR(F.lit(m)) for j in range(count)]) for k, m in enumerate(masks)]


def _hashes(line: Column, width: int) -> Column:
    """The shingles of a line from every place, repeated ones too, as hashes of 64 bits."""
    held = F.array(F.encode(line, "UTF-32"))  # encoded once, not at every place
    begins = lambda code: F.sequence(F.lit(1), _last(code, width, 4) * 4 + 1, F.lit(4))
    return F.transform(held, lambda code: F.transform(begins(code), lambda p: F.xxhash64(F.substring(code, p, F.lit(width * 4)))))[0]


def shingle_set(line: Column, width: int = SHINGLE) -> Column:
    """The distinct shingles of a line as hashes of 64 bits."""
    return F.array_distinct(_hashes(line, width))


def _shingles(texts: DataFrame, width: int) -> DataFrame:
    """(id, s): the distinct shingles of lines.  Sets are a column before they are exploded, so that the rows come out of
    generated code; ``explode`` would also put the whole set into a filter for empty ones, of which there are none."""
    return texts.select("id", shingle_set(F.col("line"), width).alias("of")).select("id", F.explode_outer("of").alias("s"))


def numbered_lines(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """(doc_id, text_key, line_no, line): the non-blank lines of all texts, trimmed and in lower case."""
    body = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{row_id}`").alias("doc_id"), F.xxhash64(body).alias("text_key"), F.posexplode(F.split(F.lower(body), "\n", -1)).alias("line_no", "raw"))
    rows = rows.select("doc_id", "text_key", "line_no", F.trim("raw").alias("raw"))
    other = reduce(Column.__or__, [end(F.col("raw"), F.lit(c)) for c in BLANK[1:] for end in (F.startswith, F.endswith)])  # rare, and slow to cut
    return rows.select("doc_id", "text_key", "line_no", F.when(other, F.trim("raw", F.lit(BLANK))).otherwise(F.col("raw")).alias("line")).where("line <> ''")


def _key(line: str = "line") -> Column:
    return F.xxhash64(line)


def _check(seed: int, line: str = "line") -> Column:
    """A second hash, that tells lines of the same key apart."""
    return F.xxhash64(F.lit(seed), F.col(line))


def distinct_lines(lines: DataFrame, order: int, width: int, seed: int) -> DataFrame:
    """(id, key, check, n, v0, v1, ...): one written row per line text, with how often it occurs and its signature.

    Tasks take the least values of their own lines before anything is shuffled.  The high bits of an id fall
    with how often the line occurs (by powers of two), so that the smallest id of a bucket is a common line,
    from which its variants are not far; the other bits number the rows.
    """
    rng = random.Random(seed)
    masks = [rng.getrandbits(32) - (1 << 31) for _ in range(order * order)]
    each = lines.select(_key().alias("key"), _check(seed).alias("check"), F.encode("line", "UTF-16BE").alias("code"))
    each = each.withColumn("last", _last(F.col("code"), width, 2))
    # the least of the first HEAD shingles goes before all others, which are then seldom less: branches that are foreseen cost little
    each = each.select("*", *[_hash_at(str(j), width).alias(f"h{j}") for j in range(HEAD)])
    each = each.select("key", "check", "code", "last", *[v.alias(f"t{k}") for k, v in enumerate(_least(masks, HEAD))])
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("place"))
    each = each.select("*", *[_hash_at(f"(place | {j})", width).alias(f"h{j}") for j in range(STEP)])
    values = [f"v{k}" for k in range(order * order)]
    least = [F.min(v).alias(name) for name, v in zip(values, _least(masks, STEP, "t"))]
    often = F.least(F.floor(F.log2(F.col("n").cast("double"))), F.lit(31)).cast("int")
    number = F.shiftleft((F.lit(31) - often).cast("long"), 58).bitwiseOR(F.monotonically_increasing_id())
    found = each.groupBy("key", "check").agg(F.sum((F.col("place") == 0).cast("long")).alias("n"), *least)
    return cut(found.select(number.alias("id"), "key", "check", "n", *values), "line-distinct")


def _likely(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is one of ``keys`` and a few others: a broadcast set of bits, 64 a row.

    The set grows with the keys, up to 2 ** BITS bits; beyond, it lets more and at last all rows pass.  It
    only keeps rows out of a shuffle that follows, and decides nothing.
    """
    power = min(BITS, max(12, math.ceil(math.log2(16 * (keys.count() + 1)))))
    mixed = F.xxhash64(column)
    place = mixed.bitwiseAND(F.lit((1 << power) - 1))
    word, bit = F.shiftrightunsigned(place, 6), F.expr(f"shiftleft(1L, CAST(xxhash64(`{column}`) & 63 AS INT))")
    bits = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = rows.join(F.broadcast(bits), word == F.col("_word"))
    return held.where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def _sketches(texts: DataFrame, width: int) -> DataFrame:
    """(id, n, p0, p1, ...): how many shingles a line has, and the parity of how many fall on each of 64 * WORDS places."""
    each = _shingles(texts, width).select("id", F.expr("shiftleft(1L, CAST(s & 63 AS INT))").alias("bit"), F.shiftrightunsigned("s", 6).bitwiseAND(F.lit(WORDS - 1)).alias("word"))
    return each.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(WORDS)])


def _may_link(left: str, right: str, threshold: float) -> Column:
    """Whether the sketches allow a link: every place of odd difference needs a shingle that only one line has."""
    at = lambda side, c: F.col(f"{side}{c}")
    odd = reduce(Column.__add__, [F.bit_count(at(left, f"p{k}").bitwiseXOR(at(right, f"p{k}"))) for k in range(WORDS)])
    fewer, more = F.least(at(left, "n"), at(right, "n")), F.greatest(at(left, "n"), at(right, "n"))
    return (odd <= (1 - threshold) / (1 + threshold) * (fewer + more) + 1e-6) & (fewer >= threshold * more - 1e-6)


def _sided(sketches: DataFrame, side: str) -> DataFrame:
    return sketches.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in sketches.columns if c != "id"])


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b): the distinct pairs of ids, with ``total`` shingles in both sets, whose sets reach the Jaccard similarity ``threshold``.

    What the sets share is distinct by itself.  Its size is written before it is compared: as part of the join's
    condition it would be made twice.
    """
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    both = both.select("a", "b", "total", _hashes(F.col("line_a"), width).alias("of_a"), _hashes(F.col("line_b"), width).alias("of_b"))
    both = cut(both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("common"), "total"), "line-common")
    return both.where((1 + threshold) * F.col("common") >= threshold * F.col("total") - 1e-6).select("a", "b")


def _near(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b): the links among distinct pairs."""
    held = pairs.join(_sided(sketches, "a").hint("merge"), "a").join(_sided(sketches, "b").hint("merge"), "b")
    held = held.where(_may_link("a_", "b_", threshold)).select("a", "b", (F.col("a_n") + F.col("b_n")).alias("total"))
    return _verified(cut(held, "line-candidates"), texts, width, threshold)


def _split(members: DataFrame, graph: DataFrame, sketches: DataFrame) -> DataFrame:
    """(bucket, low, id, component, size, sketch): the members of buckets whose lines are in several components."""
    known = members.join(graph.withColumnRenamed("node", "id"), "id", "left")
    known = cut(known.select("bucket", "id", F.coalesce("component", "id").alias("component")), "line-known")
    split = known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    return cut(known.join(split.select("bucket", "low", "size"), "bucket").join(sketches.hint("merge"), "id"), "line-rest")


def _paired(rest: DataFrame, bands: int, threshold: float) -> DataFrame:
    """(a, b): the distinct pairs of a bucket that are in different components and whose sketches allow a link.

    One side holds what is outside of the component ``low`` of a bucket, often a few lines only.  A pair comes
    out of the first bucket that it shares; rows without ``low`` are of groups by shingles.
    """
    a, b = (rest.select(*[F.col(c).alias(f"{side}_{c}") for c in rest.columns]) for side in "ab")
    a = a.where("a_low IS NULL OR a_component <> a_low")
    apart = (F.col("a_component") != F.col("b_component")) & (F.coalesce(F.col("b_component") == F.col("b_low"), F.lit(False)) | (F.col("a_id") < F.col("b_id")))
    first = F.coalesce(*[F.when(F.col(f"a_k{n}") == F.col(f"b_k{n}"), F.col(f"a_k{n}")) for n in range(bands)])
    once = F.col("a_low").isNull() | (F.col("a_bucket") == first)
    met = a.join(b, (F.col("a_bucket") == F.col("b_bucket")) & apart & once & _may_link("a_", "b_", threshold))
    return met.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


def _widened(graph: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) after further links (a, b): only links between different components are contracted."""
    more = more.join(graph.select(F.col("node").alias("a"), F.col("component").alias("of_a")), "a", "left").join(graph.select(F.col("node").alias("b"), F.col("component").alias("of_b")), "b", "left")
    between = components(more.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    old = graph.join(between.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left")
    old = old.select("node", F.coalesce("new", "component").alias("component"))
    return cut(old.unionByName(between.join(graph, "node", "left_anti")), "line-components")


def _by_rare_shingles(ids: DataFrame, texts: DataFrame, sketches: DataFrame, width: int, threshold: float) -> DataFrame:
    """(bucket, id): lines dealt out by the rarest of their shingles.

    With shingles ordered by how many of these lines hold them, two sets of similarity t share one of the
    first ``n - ceil(t * n) + 1`` of each, so no link is lost.  Shingles of one line only come first in this
    order and are counted, not listed.
    """
    each = cut(_shingles(ids.join(texts, "id"), width), "line-shingles")
    holders = each.groupBy("s").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    mine = Window.partitionBy("id")
    ranked = each.join(holders, "s").withColumn("shared", F.count(F.lit(1)).over(mine)).withColumn("place", F.row_number().over(mine.orderBy("holders", "s")))
    ranked = ranked.join(sketches.select("id", "n"), "id")
    return ranked.where(F.col("place") <= F.col("shared") - F.ceil(F.col("n") * threshold - 1e-6) + 1).select(F.col("s").alias("bucket"), "id")


def _met(distinct: DataFrame, bands: list[list[int]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (bucket, pivot, id) of the crowded buckets, the first pairs (a, b) to compare, and (id, key, check, k0, ...) of their lines."""
    keys = [F.xxhash64(F.lit(n), *[F.col(f"v{k}") for k in band]) for n, band in enumerate(bands)]
    banded = distinct.select("id", F.explode(F.array(*keys)).alias("bucket"))
    shared = cut(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket"), "line-shared")
    held = cut(_likely(banded, shared, "bucket").join(shared.hint("merge"), "bucket"), "line-held")
    sizes = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor("id").alias("all"))
    sizes = cut(sizes, "line-buckets")
    middle = F.col("all").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    low, high = F.col("low"), F.col("high")
    three = F.when(F.col("size") == 3, F.array(pair(low, high), pair(low, middle), pair(middle, high))).otherwise(F.array(pair(low, high)))
    direct = sizes.where("size <= 3").select(F.explode(three).alias("p")).select("p.a", "p.b")
    crowded = sizes.where("size > 3").select("bucket", F.col("low").alias("pivot"))
    members = cut(held.join(crowded.hint("merge"), "bucket").select("bucket", "pivot", "id"), "line-members")
    discard(held)
    pairs = cut(direct.unionByName(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))).distinct(), "line-pairs")
    ids = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "line-ids")
    named = _likely(distinct.select("id", "key", "check", *[k.alias(f"k{n}") for n, k in enumerate(keys)]), ids, "id")
    named = cut(named.join(ids.hint("merge"), "id"), "line-names")  # a semi-join would be put before the set of bits
    return members, pairs, named


def _linked(members: DataFrame, pairs: DataFrame, named: DataFrame, lines: DataFrame, bands: list[list[int]], width: int, threshold: float, crowd: int) -> DataFrame:
    """(node, component) of the linked lines' ids; ``lines`` (key, check, line) holds the text of each line of ``named``, once or more."""
    texts = cut(lines.dropDuplicates(["key", "check"]).join(named.select("id", "key", "check").hint("merge"), ["key", "check"]).select("id", "line"), "line-texts")
    sketches = cut(_sketches(texts, width).join(named.drop("key", "check"), "id"), "line-sketches")
    graph = cut(components(_near(pairs, texts, sketches, width, threshold)), "line-components")
    rest = _split(members, graph, sketches)
    groups = rest.where(F.col("size") <= crowd)
    lines_of = ["id", "component", *sketches.columns[1:]]
    groups = groups.select("bucket", "low", *lines_of)
    many = cut(rest.where(F.col("size") > crowd).select(*lines_of).dropDuplicates(["id"]), "line-crowds")
    if not many.isEmpty():
        dealt = _by_rare_shingles(many.select("id"), texts, sketches, width, threshold)
        groups = groups.unionByName(dealt.join(many, "id").select("bucket", F.lit(None).cast("long").alias("low"), *lines_of))
    graph = _widened(graph, _near(_paired(groups, len(bands), threshold), texts, sketches, width, threshold))
    discard(texts)
    return graph


def grouped(distinct: DataFrame, lines: DataFrame, bands: list[list[int]], width: int, threshold: float, crowd: int = CROWD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the linked lines' ids, and (id, key, check) of the lines in shared buckets.

    Lines are linked if they share a bucket, or a rare shingle where buckets are large, and their Jaccard
    similarity reaches ``threshold``.
    """
    members, pairs, named = _met(distinct, bands)
    texts = _likely(lines.select(_key().alias("key"), "line"), named, "key").select("key", _check(seed).alias("check"), "line")
    return _linked(members, pairs, named, texts, bands, width, threshold, crowd), named


def repeated_lines(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    *,
    width: int = SHINGLE,
    threshold: float = THRESHOLD,
    order: int = ORDER,
    classes: int = CLASSES,
    crowd: int = CROWD,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, text_key, line_no): every line but the first of its component, for each row that holds it.

    The line that stays is the first by doc_id (null first) and line number, then by a hash of its text; rows
    that agree in id and text are treated alike.  Equal lines share a component whatever their length.
    """
    lines = numbered_lines(docs, row_id, text)
    distinct = distinct_lines(lines, order, width, seed)
    bands = planes(order, classes)
    members, pairs, named = _met(distinct, bands)
    several = cut(distinct.where("n > 1").select("key").unionByName(named.select("key")).distinct(), "line-several")
    discard(distinct)
    # one more pass over the texts finds the lines to compare and the places of all that may go
    placed = _likely(lines.select("doc_id", "text_key", "line_no", "line", _key().alias("key")), several, "key")
    placed = cut(placed.select("doc_id", "text_key", "line_no", "key", _check(seed).alias("check"), "line"), "line-places")
    graph = _linked(members, pairs, named, _likely(placed.select("key", "check", "line"), named, "key"), bands, width, threshold, crowd)
    graph = cut(graph.withColumnRenamed("node", "id").join(named.select("id", "key", "check"), "id").select("key", "check", "component"), "line-graph")
    # the first place of each line, then of each component: no join meets all places of a common line
    first = placed.groupBy("key", "check").agg(F.min(F.struct("doc_id", "line_no", "text_key")).alias("head"))
    first = cut(first.join(graph, ["key", "check"], "left").select("component", "head"), "line-firsts")
    heads = first.where("component IS NULL").select("head.*").unionByName(first.where("component IS NOT NULL").groupBy("component").agg(F.min("head").alias("head")).select("head.*"))
    heads = heads.select(F.col("doc_id").alias("head_doc"), F.col("line_no").alias("head_line"), F.col("text_key").alias("head_key"))
    same = F.col("doc_id").eqNullSafe(F.col("head_doc")) & (F.col("line_no") == F.col("head_line")) & (F.col("text_key") == F.col("head_key"))
    return placed.select("doc_id", "text_key", "line_no").join(heads, same, "left_anti")


def without_repeats(docs: DataFrame, row_id: str = "doc_id", text: str = "text", lost: str | None = None, **options) -> DataFrame:
    """``docs`` with every repeated line gone but the first of its component; all columns return.

    Blank lines stay.  A text that loses lines is its other lines joined by newlines, possibly the empty
    text; ``n_chars``, where there is one, is set anew.  Null and empty texts return as they are; very long
    texts and lines are taken whole; an empty table gives an empty result; columns of any name may stand
    beside.  A column named ``lost``, if given, says how many lines went.
    """
    gone, doc, key = fresh(docs, "gone", "doc", "key")
    repeats = repeated_lines(docs, row_id, text, **options)
    repeats = repeats.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(F.collect_set("line_no").alias(gone))
    repeats = cut(repeats, "lines-gone")
    body = F.col(f"`{text}`")
    own = F.col(f"`{row_id}`").eqNullSafe(F.col(doc)) & (F.xxhash64(body) == F.col(key))
    found = docs.join(repeats.hint("shuffle_hash"), own, "left")  # texts are dealt, but not sorted
    kept = F.filter(F.split(body, "\n", -1), lambda line, k: ~F.array_contains(F.col(gone), k))
    less = F.when(F.col(gone).isNull(), body).otherwise(F.array_join(kept, "\n"))
    kinds = dict(docs.dtypes)
    columns = [less.alias(c) if c == text else F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(less)).cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*columns, *([F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(lost)] if lost else []))
