"""Byte-pair and unigram tokenizers: training passes are aggregations over distinct words, encoding runs on Arrow batches.

A vocabulary is bounded by its size, a parameter, and goes to tasks with the function; words are cut at blanks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import substrings, word_table

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def merged(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The symbols of a word after all merges, the earliest first, each from left to right."""
    parts = list(word)
    while len(parts) > 1:
        best = min(zip(parts, parts[1:]), key=lambda p: ranks.get(p, len(ranks)))
        if best not in ranks:
            break
        out: list[str] = []
        for p in parts:
            if out and (out[-1], p) == best:
                out[-1] = out[-1] + p
            else:
                out.append(p)
        parts = out
    return parts


def bpe_encode(text: Column, merges: list[tuple[str, str]], mark: str = "</w>") -> Column:
    """The symbols of every whole text, ``mark`` after each word; null stays null."""
    ranks = {pair: k for k, pair in reversed(list(enumerate(merges)))}

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            out = []
            for body in batch:
                if body is None:
                    out.append(None)
                    continue
                row: list[str] = []
                for word in _WORD.findall(body):
                    if word not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[word] = merged(word, ranks)
                    row += known[word] + [mark]
                out.append(row)
            yield pd.Series(out)

    return F.pandas_udf(encode, "array<string>")(text)


def bpe_decode(symbols: Column, mark: str = "</w>") -> Column:
    """The words of a text joined by single blanks."""
    return F.trim(F.replace(F.array_join(symbols, ""), F.lit(mark), F.lit(" ")))


def _paths(word: str, logs: dict[str, float], longest: int, low: float) -> list[list[tuple[str, int, float]]]:
    """For every end in a word the pieces that end there, with their start and log; a character without a piece is unknown."""
    n = len(word)
    ends: list[list[tuple[str, int, float]]] = [[] for _ in range(n + 1)]
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            p = logs.get(word[start:end])
            if p is not None:
                ends[end].append((word[start:end], start, p))
        if word[end - 1] not in logs:
            ends[end].append((word[end - 1], end - 1, low))
    return ends


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def expected(word: str, logs: dict[str, float], longest: int, low: float) -> tuple[float, dict[str, float]]:
    """Log-likelihood of a word over all its segmentations, and the expected counts of its pieces, forward and backward."""
    ends = _paths(word, logs, longest, low)
    n = len(word)
    ahead, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    ahead[0] = back[n] = 0.0
    for end in range(1, n + 1):
        for _, start, p in ends[end]:
            ahead[end] = _add(ahead[end], ahead[start] + p)
    for end in range(n, 0, -1):
        for _, start, p in ends[end]:
            back[start] = _add(back[start], back[end] + p)
    counts: dict[str, float] = {}
    for end in range(1, n + 1):
        for piece, start, p in ends[end]:
            counts[piece] = counts.get(piece, 0.0) + math.exp(ahead[start] + p + back[end] - ahead[n])
    return ahead[n], counts


def best_pieces(word: str, logs: dict[str, float], longest: int, low: float) -> list[str]:
    """The segmentation of the highest sum of logs; of equals the one whose last piece starts first."""
    ends = _paths(word, logs, longest, low)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for _, start, p in ends[end]:
            if best[start][0] + p > best[end][0]:
                best[end] = (best[start][0] + p, start)
    out, end = [], len(word)
    while end:
        start = best[end][1]
        out.append(word[start:end])
        end = start
    return out[::-1]


def _shape(logs: dict[str, float]) -> tuple[int, float]:
    return max((len(p) for p in logs), default=1), min(logs.values(), default=0.0) - 10.0


def unigram_start(words: DataFrame, size: int, longest: int = 8) -> dict[str, float]:
    """Logs of all characters and of the ``size`` substrings of the most characters in all (ties to the smaller piece)."""
    pieces = substrings(words, longest)
    top = pieces.where(F.length("piece") > 1).orderBy((F.col("n") * F.length("piece")).desc(), "piece").limit(size)
    found = {r["piece"]: float(r["n"]) for r in pieces.where(F.length("piece") == 1).unionByName(top).collect()}
    total = math.log(sum(found.values()) or 1.0)
    return {p: math.log(n) - total for p, n in found.items()}


def unigram_step(words: DataFrame, logs: dict[str, float]) -> tuple[dict[str, float], float]:
    """One step of expectation and maximisation over (word, n): the next logs, and the log-likelihood of these."""
    longest, low = _shape(logs)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict[str, float] = {}
            likelihood = 0.0
            for word, n in zip(batch["word"], batch["n"]):
                like, counts = expected(word, logs, longest, low)
                likelihood += n * like
                for piece, c in counts.items():
                    held[piece] = held.get(piece, 0.0) + n * c
            yield pd.DataFrame({"piece": [*held, None], "c": [*held.values(), likelihood]})

    rows = words.select("word", "n").mapInPandas(count, "piece string, c double").groupBy("piece").agg(F.sum("c").alias("c")).collect()
    counts = {r["piece"]: r["c"] for r in rows if r["piece"] in logs and r["c"] > 1e-12}
    total = math.log(sum(counts.values()) or 1.0)
    return {p: math.log(c) - total for p, c in counts.items()}, next((r["c"] for r in rows if r["piece"] is None), 0.0)


def unigram_train(df: DataFrame, text: str, size: int = 1000, rounds: int = 2, steps: int = 2, keep: float = 0.75, longest: int = 8) -> dict[str, float]:
    """A vocabulary by steps of expectation and maximisation, after each round of which the least likely pieces go; single characters stay."""
    words = word_table(df, text).persist()
    logs = unigram_start(words, size, longest)
    for _ in range(rounds):
        for _ in range(steps):
            logs, _ = unigram_step(words, logs)
        logs = pruned(logs, keep)
    words.unpersist()
    return logs


def pruned(logs: dict[str, float], keep: float) -> dict[str, float]:
    """The likeliest share of the pieces (ties to the smaller) and all single characters, made to sum to one."""
    several = sorted((p for p in logs if len(p) > 1), key=lambda p: (-logs[p], p))
    held = {p: logs[p] for p in [*several[: round(keep * len(several))], *(p for p in logs if len(p) == 1)]}
    total = math.log(sum(math.exp(x) for x in held.values()) or 1.0)
    return {p: x - total for p, x in held.items()}


def unigram_encode(text: Column, logs: dict[str, float], mark: str = "▁") -> Column:
    """The likeliest pieces of every whole text, the first of each word after ``mark``; null stays null."""
    longest, low = _shape(logs)

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            out = []
            for body in batch:
                if body is None:
                    out.append(None)
                    continue
                row: list[str] = []
                for word in _WORD.findall(body):
                    if word not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[word] = best_pieces(word, logs, longest, low)
                    row += [mark, *known[word]]
                out.append(row)
            yield pd.Series(out)

    return F.pandas_udf(encode, "array<string>")(text)


def unigram_decode(pieces: Column, mark: str = "▁") -> Column:
    return F.trim(F.replace(F.array_join(pieces, ""), F.lit(mark), F.lit(" ")))


# vocabularies: ids, special tokens, and a table that holds all of it

#: Special tokens in the order of their ids.
SPECIAL = ("<pad>", "<unk>", "<bos>", "<eos>")


@dataclass
class Vocabulary:
    """Tokens by id, special ones first; of a byte-pair vocabulary the merges, of a unigram one the logs."""

    tokens: list[str]
    special: tuple[str, ...] = SPECIAL
    merges: list[tuple[str, str]] = field(default_factory=list)
    logs: dict[str, float] = field(default_factory=dict)

    @classmethod
    def bpe(cls, merges: list[tuple[str, str]], alphabet: list[str], mark: str = "</w>", special: tuple[str, ...] = SPECIAL) -> Vocabulary:
        """The mark of a word's end, the characters in order, then what each merge makes."""
        return cls(list(dict.fromkeys([*special, mark, *sorted(alphabet), *(a + b for a, b in merges)])), special, merges)

    @classmethod
    def unigram(cls, logs: dict[str, float], mark: str = "▁", special: tuple[str, ...] = SPECIAL) -> Vocabulary:
        """The mark of a word's beginning, then pieces by falling log (ties to the smaller)."""
        return cls(list(dict.fromkeys([*special, mark, *sorted(logs, key=lambda p: (-logs[p], p))])), special, [], logs)

    @property
    def ids(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(self.tokens)}

    def encode(self, text: Column, bos: bool = False, eos: bool = False) -> Column:
        """The ids of every whole text, unknown symbols as that of ``<unk>``; null stays null."""
        symbols = bpe_encode(text, self.merges) if self.merges else unigram_encode(text, self.logs)
        return self.to_ids(symbols, bos, eos)

    def to_ids(self, symbols: Column, bos: bool = False, eos: bool = False) -> Column:
        ids = self.ids
        unknown, first, last = ids["<unk>"], [ids["<bos>"]] if bos else [], [ids["<eos>"]] if eos else []

        def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([None if row is None else first + [ids.get(s, unknown) for s in row] + last for row in batch])

        return F.pandas_udf(look_up, "array<int>")(symbols)

    def decode(self, ids: Column) -> Column:
        """The text of ids without its special tokens; ids that are no tokens have none."""
        tokens, special = self.tokens, set(self.special)

        def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([None if row is None else [tokens[k] for k in row if 0 <= k < len(tokens) and tokens[k] not in special] for row in batch])

        symbols = F.pandas_udf(look_up, "array<string>")(ids)
        return bpe_decode(symbols) if self.merges else unigram_decode(symbols)

    def save(self, spark: SparkSession, path: str) -> None:
        """One table of (kind, place, a, b, log): what was there before goes."""
        rows = [("special", k, t, None, None) for k, t in enumerate(self.special)] + [("token", k, t, None, self.logs.get(t)) for k, t in enumerate(self.tokens)]
        rows += [("merge", k, a, b, None) for k, (a, b) in enumerate(self.merges)]
        spark.createDataFrame(rows, "kind string, place int, a string, b string, log double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Vocabulary:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r["kind"], r["place"]))  # as many as the vocabulary has tokens
        of = lambda kind: [r for r in rows if r["kind"] == kind]
        return cls([r["a"] for r in of("token")], tuple(r["a"] for r in of("special")), [(r["a"], r["b"]) for r in of("merge")], {r["a"]: r["log"] for r in of("token") if r["log"] is not None})


def alphabet(words: DataFrame) -> list[str]:
    """All characters of (word, n), in order."""
    return sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())
