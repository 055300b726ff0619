"""SimHash near-duplicates: fingerprints, Golay-code fuzzy hashing, verified links and their components.

A 64-bit fingerprint is cut into three segments.  Two fingerprints that differ in at most two bits agree
wholly in one segment, and in the next segment they differ in at most two bits.  As vectors of the (23, 12)
Golay code, two such segments have a codeword within distance four in common: the one nearest to the vector
halfway between them.  A vector has one or six codewords that near, so a fingerprint gets 3 to 18 keys of an
exact segment and a codeword index, and linked fingerprints share a key.

Keys that few fingerprints share are joined and verified.  Fingerprints of crowded keys are linked without
pairs: two of them differ in at most two bits just if some vector is within one bit of both, so each is
listed under the 65 vectors within one bit and linked to the smallest in each list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .frequent import with_group
from .scratch import cut, fresh

SHINGLE = 3
SEED = 42
#: Low bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The generator polynomial of the binary Golay code, highest power first.
GOLAY = 0b110001110101
#: Fingerprints of a key that are joined in pairs; those of keys with more are linked by lists.
CROWD = 48
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the bits of the shingles' hashes; words of the ASCII-lower-cased whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for low in range(0, n, _CHUNK):
        hashes = np.array([digest(join(words[i : i + shingle]), seed) for i in range(low, min(n, low + _CHUNK))], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, tie, fp): the fingerprint of every row's whole text as a signed long, 0 for no words; tie: a hash of the text."""
    rows = docs.select(F.col(f"`{row_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "tie", "fp"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("tie", T.LongType()), T.StructField("fp", T.LongType())]))


def _remainder(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GOLAY << (bit - 11)
    return v


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of all 23-bit vectors; by remainder, the patterns to the codewords within distance 4 and how many they are."""
    single = [_remainder(1 << b) for b in range(23)]
    remainder = np.zeros(1 << 23, np.uint16)
    for b in range(23):  # remainders add up
        remainder[1 << b : 2 << b] = remainder[: 1 << b] ^ single[b]
    patterns, count = np.zeros((2048, 6), np.int64), np.ones(2048, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            patterns[remainder[error], 0] = error
            count[remainder[error]] = 6 if weight == 3 else 1
    heavy = np.flatnonzero((remainder == 0) & (np.bitwise_count(np.arange(1 << 23, dtype=np.uint32)) == 7))
    used = np.ones(2048, np.int64)
    for word in heavy.tolist():  # codewords at distance 4 from a vector of weight 3 within them
        for bits in combinations([b for b in range(23) if word >> b & 1], 3):
            error = sum(1 << b for b in bits)
            at = remainder[error]
            patterns[at, used[at]] = error ^ word
            used[at] += 1
    return remainder, patterns, count


_TABLES: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of fingerprints (uint64): positions of the fingerprints and keys."""
    if not _TABLES:
        _TABLES.append(golay_tables())
    remainder, patterns, count = _TABLES[0]
    rows, keys = [], []
    parts = [((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    for exact in range(3):
        vague = parts[(exact + 1) % 3]
        at = remainder[vague]
        near = np.arange(6) < count[at][:, None]
        index = (vague[:, None] ^ patterns[at]) >> 11
        row, col = np.nonzero(near)
        rows.append(row)
        keys.append((exact << 36) | (parts[exact][row] << 12) | index[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            row, key = keys_of(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], names=["key", "fp"])

    return fps.mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that join all of the distinct fingerprints ``fp`` within two bits of each other.

    Every pair within two bits is a link or has its ends joined by links; every link is within two bits.
    """
    keyed = cut(_keyed(fps), "golay-keys")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(keyed.join(shared, "key"), "golay-shared")
    few = shared.where(F.col("n") <= crowd).select("key", "fp")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b").distinct()
    many = shared.where(F.col("n") > crowd).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64)])
    balls = many.withColumn("flip", F.explode(flips)).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("ball"), "fp")
    centre = balls.groupBy("ball").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("top > b").drop("top")
    stars = balls.join(centre, "ball").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, tie, fp, component, component_id) per row of ``docs``; component_id: the smallest id reachable by links.

    ``component`` tells components apart, which ids do not where one id has several texts.

    Texts without words have fingerprint 0 and link like any other.  Rows without an id have a component but
    do not name one (it is null where no row of the component has an id).  Repeated rows are rows of their
    own; an empty table gives an empty result; other columns are not looked at.
    """
    rows = cut(fingerprints(docs, row_id, text), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    graph = components(links(distinct.select("fp"), crowd)).withColumnRenamed("node", "fp")
    grouped = distinct.join(graph, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = cut(grouped.join(named, "component").select("fp", "component", "component_id", "rows"), "fingerprint-components")
    return with_group(rows, named, "fp", "rows").select("doc_id", "tie", "fp", "component", "component_id")


def hex_digits(fp: str = "fp"):
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row per group of near duplicates; all columns return.

    The row with the smallest id stays; where that id names several texts of the group, the one whose text has the
    smallest hash, and of rows that repeat id and text the one whose columns have the smallest hash.  Rows without an
    id stay as they are.
    """
    known = docs.where(F.col(f"`{row_id}`").isNotNull())
    found = near_duplicates(known, row_id, text)
    kept_id, kept_tie = fresh(docs, "kept_id", "kept_tie")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    first = cut(first.select(F.col("first.doc_id").alias(kept_id), F.col("first.tie").alias(kept_tie)), "kept-rows")
    own, place = fresh(docs, "own_tie", "place")
    marked = known.withColumn(own, F.xxhash64(F.col(f"`{text}`")))
    turn = F.row_number().over(Window.partitionBy(f"`{row_id}`", own).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    one = marked.withColumn(place, turn).where(F.col(place) == 1)
    kept = one.join(first, (F.col(f"`{row_id}`") == F.col(kept_id)) & (F.col(own) == F.col(kept_tie)), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(F.col(f"`{row_id}`").isNull()))
