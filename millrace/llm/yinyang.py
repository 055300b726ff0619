"""Compression of vectors to codebook indexes, the codebooks found by Lloyd's rounds with Yinyang bounds.

Vectors become integers and are cut into parts; each part has a codebook of its own.  A codebook's entries are
put into groups once.  Every part keeps its entry and one lower bound for each group: how near an entry of the
group, its own left out, can be at most.  When entries move, a bound falls by the largest move in its group, and
only groups whose bound is not above the exact distance to the part's own entry are scanned.  Scans and own
distances are exact integers, and a group is passed over only if it is strictly farther, so ties are settled by
the entries' numbers whatever was scanned.

Rows with their bounds are a written table that each round replaces.  Sums for each entry are made batch by
batch where the rows are; what reaches the driver is one row an entry and part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frequent import with_group
from .scratch import cut, discard

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Groups of entries: as many bounds are kept for every part of a vector.
GROUPS = 16
#: Integers from here on are refused; besides, the squared spread of all components of a vector must fit 64 bits.
LARGEST = 1 << 62
_STATE = "code binary, bounds binary, error long"


def whole_vectors(table: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label_key, v) of the rows whose vector is not null and has finite components only; v: floor(scale * x) as longs."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label_key = F.to_json(F.struct(F.col(f"`{label}`").alias("label")))
    rows = table.select(F.col(f"`{row_id}`").cast("long").alias("vec_id"), label_key.alias("label_key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    limit = F.lit(float(LARGEST))
    fits = lambda x: F.when(F.abs(x * scale) < limit, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component is too large: {scale} times it must stay below {LARGEST}")).cast("long"))
    return rows.withColumn("v", F.transform("v", fits))


def grouped_entries(book: np.ndarray, groups: int) -> list[np.ndarray]:
    """The numbers of the entries of each group, rising: a few rounds of means over the entries, from spread-out ones."""
    if not len(book):
        return []
    points = book.astype(np.float64)
    centres = points[np.linspace(0, len(points) - 1, min(groups, len(points))).astype(int)]
    for _ in range(5):
        own = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([points[own == g].mean(0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return [np.flatnonzero(own == g) for g in range(len(centres)) if (own == g).any()]


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows from integer entries.

    Below 2**23 the products and their sums stay whole in doubles, so the matrix product is exact; beyond, differences are squared as integers.
    """
    top = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if x.shape[1] * int(top) ** 2 < 1 << 50:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def _own(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x - entries) ** 2).sum(1)


def assign(x: np.ndarray, book: np.ndarray, groups: list[np.ndarray], code: np.ndarray | None, bounds: np.ndarray | None, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of integer rows, lower bounds of their groups, exact squared distances, and how many distances were computed.

    ``moves``: how far each entry has moved since ``bounds`` held.  Without ``code`` and ``bounds`` all groups are scanned.
    """
    n = len(x)
    drift = np.array([np.nextafter(moves[g].max(), np.inf) for g in groups])
    if code is None:
        code, best = np.zeros(n, np.int64), _own(x, book[np.zeros(n, np.int64)])
        bounds, need = np.zeros((n, len(groups)), np.float32), np.ones((n, len(groups)), bool)
    else:
        code, best = code.astype(np.int64), _own(x, book[code])
        bounds = np.nextafter((bounds.astype(np.float64) - drift).astype(np.float32), np.float32(-np.inf))
        need = bounds <= np.nextafter(np.sqrt(best.astype(np.float64)), np.inf)[:, None]
    was, was_best = code.copy(), best.copy()
    group_of = np.zeros(len(book), np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
    firsts = np.full((n, len(groups)), -1, np.int64)
    seconds = np.zeros((n, len(groups)), np.int64)
    nearest = np.zeros((n, len(groups)), np.int64)
    scanned = n
    for g, members in enumerate(groups):
        rows = np.flatnonzero(need[:, g])
        if not len(rows):
            continue
        d = _squares(x[rows], book[members])
        scanned += d.size
        at = d.argmin(1)
        near = d[np.arange(len(rows)), at]
        firsts[rows, g], nearest[rows, g] = members[at], near
        if len(members) > 1:
            d[np.arange(len(rows)), at] = np.iinfo(np.int64).max
            seconds[rows, g] = d.min(1)
        else:
            seconds[rows, g] = np.iinfo(np.int64).max
        better = (near < best[rows]) | ((near == best[rows]) & (members[at] < code[rows]))
        code[rows[better]], best[rows[better]] = members[at[better]], near[better]
    # the bound of a scanned group is its nearest entry but the row's own; of another one, what is left of the old bound
    own = firsts == code[:, None]
    low = np.sqrt(np.where(own, seconds, nearest).astype(np.float64)).astype(np.float32)
    bounds = np.where(need, np.nextafter(low, np.float32(-np.inf)), bounds)
    moved = np.flatnonzero((code != was) & ~need[np.arange(n), group_of[was]])
    if len(moved):
        g = group_of[was[moved]]
        old = np.nextafter(np.sqrt(was_best[moved].astype(np.float64)).astype(np.float32), np.float32(-np.inf))
        bounds[moved, g] = np.minimum(bounds[moved, g], old)
    return code, bounds.astype(np.float32), best, scanned


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), width)


def _round(rows: DataFrame, books: list[np.ndarray], groups: list[list[np.ndarray]], moves: list[np.ndarray], width: int, first: bool, last: bool) -> DataFrame:
    """``rows`` (vec_id, label_key, v, state) with the state after one assignment."""
    part = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("v"), width)
            if not len(x):
                continue
            codes = None if first else np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            held = None if first else np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.float32).reshape(len(x), -1)
            code, bounds, error, at = [], [], np.zeros(len(x), np.int64), 0
            for k, book in enumerate(books):
                own = x[:, k * part : (k + 1) * part]
                here = None if first else held[:, at : at + len(groups[k])]
                found = assign(own, book, groups[k], None if first else codes[:, k], here, moves[k])
                at += len(groups[k])
                code.append(found[0].astype(np.uint8))
                bounds.append(found[1])
                error += found[2]
            codes = np.stack(code, 1)
            kept = [None] * len(x) if last else [b.tobytes() for b in np.concatenate(bounds, 1)]
            state = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(kept, pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)] + state, names=["vec_id", "label_key", "v", "code", "bounds", "error"])

    return rows.mapInArrow(run, "vec_id long, label_key string, v binary, " + _STATE)


def _moved(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Codebooks whose entries are the floors of the means of their parts; unused entries stay."""
    part = width // len(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), part), object) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            if not len(batch):
                continue
            x = _vectors(batch.column("v"), width)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            for k, book in enumerate(books):
                here = np.zeros((len(book), part), np.int64)
                np.add.at(here, codes[:, k], x[:, k * part : (k + 1) * part])
                total[k] += here
                count[k] += np.bincount(codes[:, k], minlength=len(book))
        out = [(k, e, p, int(count[k][e]), int(total[k][e, p])) for k in range(len(books)) for e in np.flatnonzero(count[k]).tolist() for p in range(max(part, 1)) if part]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(5)], names=["part", "entry", "place", "n", "total"])

    found = rows.select("v", "code").mapInArrow(sums, "part long, entry long, place long, n long, total long")
    found = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    after = [b.copy() for b in books]
    for r in found.collect():  # at most PARTS codebooks of ENTRIES entries
        after[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return after


def _compressed(rows: DataFrame, width: int, parts: int, entries: int, rounds: int, groups: int) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (vec_id, label_key, v) of one width with their codes and errors, and the final codebooks."""
    padded = -(-width // parts) * parts
    ends = rows.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    if width and padded * (ends["high"] - ends["low"]) ** 2 >= 1 << 63:
        raise ValueError(f"components from {ends['low']} to {ends['high']} are too far apart: sums of their squares leave 64 bits")
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), padded - width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), padded)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in flat], pa.binary())], names=["vec_id", "label_key", "v"])

    rows = cut(rows.select("vec_id", "label_key", filled.alias("v")).mapInArrow(pack, "vec_id long, label_key string, v binary"), "yinyang-rows")
    start = rows.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("vec_id", "v").collect()
    if len(start) < entries:
        start += rows.where("vec_id is null").orderBy("v").limit(entries - len(start)).select("vec_id", "v").collect()
    book = np.array([np.frombuffer(r["v"], np.int64) for r in start]).reshape(len(start), padded)
    part = padded // parts
    books = [book[:, k * part : (k + 1) * part].copy() for k in range(parts)]
    families = [grouped_entries(b, groups) for b in books]
    moves = [np.zeros(len(b)) for b in books]
    held = rows
    for k in range(rounds):
        after = cut(_round(held, books, families, moves, padded, k == 0, False), "yinyang-state")
        discard(held)
        held = after
        fresh = _moved(held, books, padded)
        moves = [np.nextafter(np.sqrt(_own(a, b).astype(np.float64)), np.inf) for a, b in zip(books, fresh)]
        moves = [np.where(_own(a, b) == 0, 0.0, m) for a, b, m in zip(books, fresh, moves)]
        books = fresh
    return cut(_round(held, books, families, moves, padded, rounds == 0, True), "yinyang-codes"), books


def digest(books: list[np.ndarray], width: int) -> str:
    """SHA-256 of all components as decimal integers by part, entry and place within the part, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def hex_code(code: Column) -> Column:
    return F.lower(F.hex(code))


def compress(table: DataFrame, *, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): one row for each vector that is kept.

    Null vectors and those with null or non-finite components go.  Vectors of each length have codebooks of their
    own; a length that does not divide by ``parts`` is filled up with zeros, which no distance sees.  Codebooks
    start from the smallest ids (null last), rows of one id in the order of their bytes; with fewer rows than
    ``entries`` they have as many entries.  Repeated rows count as often as they occur.  Vectors may lie anywhere; if
    components are so far apart that sums of squares would not fit 64 bits, that is an error.  ``label_error`` adds up ``error`` over rows of equal label,
    nulls together.  An empty table gives an empty result; other columns are not looked at.  At most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte, so a codebook has 1 to 256 entries")
    rows = whole_vectors(table, row_id, vector, label, scale)
    widths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    made = []
    for width in widths:
        coded, books = _compressed(rows.where(F.size("v") == width), width, parts, entries, rounds, groups)
        made.append(coded.select("vec_id", "label_key", hex_code(F.col("code")).alias("code"), "error", F.lit(digest(books, width)).alias("codebooks_sha256")))
    if not made:
        return table.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = reduce(DataFrame.unionByName, made)
    labels = cut(coded.groupBy("label_key").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")), "yinyang-labels")
    return with_group(coded, labels, "label_key", "n").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
