"""Quality rules by repetition: suffix arrays over the words of each whole text.

The longest-common-prefix lengths of neighbours in suffix order give, at every word, the longest passage
that begins there and occurs again in the same text.  Their spans are united; a text is rejected where
they cover too much of it or where one passage is too long.  Many texts share one suffix array: a word is
ranked together with its text, so no match crosses texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Base rules.
MIN_WORDS = 50
WINDOW = 3
MAX_WINDOW_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Verdict of the method: passages of at least SPAN_WORDS words count; limits of what they may cover and of the longest.
SPAN_WORDS = 8
MAX_COVERED = 0.5
MAX_LONGEST = 50
#: Words that share one suffix array; a longer text has one of its own.
GROUP_WORDS = 400_000

SPACE = " \t\n\x0b\x0c\r"

RULES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("covered_fraction", T.DoubleType()), T.StructField("longest_repeat", T.LongType())]
)


def longest_repeats(text_of: np.ndarray, word: np.ndarray) -> np.ndarray:
    """At each position the words of the longest passage from there that occurs elsewhere in its text."""
    n = len(word)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    key = text_of.astype(np.int64) * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    head = np.empty(n, bool)
    head[0] = True
    np.not_equal(key[order[1:]], key[order[:-1]], out=head[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    last = np.searchsorted(text_of, text_of, side="right")  # end of each position's text
    levels, step = [rank], 1
    while True:  # double the compared length of the suffixes that are not yet apart
        alone = head.copy()
        alone[:-1] &= head[1:]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        after = at + step
        inside = after < last[at]
        second = np.zeros(len(at), np.int64)
        second[inside] = rank[after[inside]] + 1
        pair = rank[at] * (n + 1) + second
        turn = np.argsort(pair, kind="stable")
        order[slots] = at[turn]
        pair = pair[turn]
        apart = np.ones(len(slots), bool)
        np.not_equal(pair[1:], pair[:-1], out=apart[1:])
        head[slots] = apart
        rank = rank.copy()
        rank[order[slots]] = np.maximum.accumulate(np.where(apart, slots, 0))
        levels.append(rank)
        step *= 2
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[near], order[near + 1]
    common = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        both = (x < n) & (y < n)
        same = np.zeros(len(near), bool)
        same[both] = levels[k][x[both]] == levels[k][y[both]]
        common += same * (1 << k)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def union_of_spans(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any of the spans."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[bytes], span_words: int = SPAN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, repeated 3-word windows' words, words covered by repeats and longest repeat of each text."""
    sizes, words, ids = [], [], {}
    for text in texts:
        own = text.split()
        sizes.append(len(own))
        words += [ids.setdefault(w, len(ids)) for w in own]
    sizes = np.array(sizes, np.int64)
    text_of, n = np.repeat(np.arange(len(texts)), sizes), int(sizes.sum())
    longest = longest_repeats(text_of, np.array(words, np.int64))
    at = np.flatnonzero(longest >= WINDOW)
    windows = union_of_spans(at, np.full(len(at), WINDOW), n)
    at = np.flatnonzero(longest >= span_words)
    covered = union_of_spans(at, longest[at], n)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, text_of, longest)
    return sizes, np.bincount(text_of, windows, len(texts)).astype(np.int64), np.bincount(text_of, covered, len(texts)).astype(np.int64), most


def _lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def rules(texts: list[str | None], span_words: int = SPAN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> dict[str, list]:
    """The columns of RULES for a list of texts."""
    plain = [t or "" for t in texts]
    out: dict[str, list] = {f: [] for f in RULES.names}
    group: list[bytes] = []
    held = 0
    parts = []
    for text in plain:
        raw = text.encode("utf-8", "surrogatepass")
        if group and held + len(raw) > GROUP_WORDS * 6:
            parts.append(measure(group, span_words))
            group, held = [], 0
        group.append(raw)
        held += len(raw)
    if group:
        parts.append(measure(group, span_words))
    words, repeated, covered, longest = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
    fraction = covered / np.maximum(words, 1)
    failed = (words < MIN_WORDS) | (100 * repeated > MAX_WINDOW_PERCENT * words)
    out["n_words"], out["n_repeat_words"], out["longest_repeat"] = words, repeated, longest
    out["word_chars"] = [len(t) - sum(map(t.count, SPACE)) for t in plain]
    out["n_symbols"] = [sum(map(t.count, SYMBOLS)) for t in plain]
    out["n_dup_lines"] = [_lines(t) for t in plain]
    out["base_failed"], out["covered_fraction"] = failed, fraction
    out["kept"] = ~failed & (fraction <= max_covered) & (longest <= max_longest)
    return out


def with_rules(docs: DataFrame, text: str = "text", keep: Column | None = None, **limits) -> DataFrame:
    """One row per row of ``docs``: ``row`` (``keep``; default all columns as a struct) and ``rules`` (RULES).

    A null or empty text has no words and so fails the base rules.  Repeated rows are rows of their own, an
    empty table gives an empty result, and columns other than ``text`` are carried in ``row`` unseen.
    """
    carried = docs.select((F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep is None else keep).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([carried.schema["row"], T.StructField("rules", RULES)])
    arrow = pa.struct([(f.name, {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.dataType.simpleString()]) for f in RULES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = rules(batch.column(1).to_pylist(), **limits)
            columns = [pa.array(found[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(columns, fields=list(arrow))], names=["row", "rules"])

    return carried.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    return with_rules(docs, text, **limits).where("rules.kept").select("row.*")
