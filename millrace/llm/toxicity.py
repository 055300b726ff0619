"""Toxicity by multiple-instance learning: sentence scores, noisy-or, document labels.

A document is toxic if any of its sentences is: with sentence probabilities p_s and a leak p_0 its own is
``1 - (1 - p_0) * product(1 - p_s)``.  A sentence's probability is logistic in its distinct words and in
how they begin, as offending words also come inflected.  Weights are fitted to document labels alone, on a
bounded sample; the sentences that explain a label get them.
Scoring covers every whole text and says which sentences offend.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import FIT_ROWS, sample

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Word beginnings of these lengths have weights of their own.
STEMS = (3, 4, 5)
#: Features in fewer sampled documents have no weight.
MIN_DOCS = 8
STEPS = 90
RATE = 0.15
DECAY = 5e-5
#: Words whose weight a task remembers.
MEMORY = 300_000
#: Sentences from this probability on are reported.
OFFENDING = 0.5

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def features(word: str) -> list[str]:
    """What has a weight in a word: itself and its beginnings, marked by a hyphen."""
    return [word] + [word[:k] + "-" for k in STEMS if len(word) > k]


@dataclass
class NoisyOr:
    """Weights of words and beginnings, the bias of a sentence and the leak of a document."""

    weights: dict[str, float]
    bias: float
    leak: float
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def weight(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            found = sum([self.weights.get(f, 0.0) for f in features(word)])
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[word] = found
        return found

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence that holds a word."""
        bias, found = self.bias, []
        for m in SENTENCE.finditer(text):
            words = set(WORD.findall(m[0].lower()))
            if words:
                z = bias + sum(map(self.weight, words))
                found.append((m.start(), m.end(), 1 / (1 + math.exp(-z)) if z > -700 else 0.0))
        return found

    def score(self, sentences: list[tuple[int, int, float]]) -> float:
        clean = 1 - self.leak
        for _, _, p in sentences:
            clean *= 1 - p
        return 1 - clean


def fit_noisy_or(texts: list[str], labels: np.ndarray, min_docs: int = MIN_DOCS, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> NoisyOr:
    """Full-batch Adam on the negative log-likelihood of the labels; no texts, or none of a class, give the smoothed share of ones as leak."""
    y = np.asarray(labels, float) > 0
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.all() or not y.any():
        return NoisyOr({}, -30.0, float(share))
    sentences = [[w for w in (set(WORD.findall(s.lower())) for s in SENTENCE.findall(t)) if w] for t in texts]
    parts = {w: features(w) for d in sentences for s in d for w in s}
    seen: dict[str, int] = {}
    for doc in sentences:
        for f in {f for w in set().union(*doc) for f in parts[w]}:
            seen[f] = seen.get(f, 0) + 1
    index = {w: k for k, w in enumerate(sorted(w for w, n in seen.items() if n >= min_docs))}
    doc_of = np.repeat(np.arange(len(texts)), [len(d) for d in sentences])
    held = {w: [index[f] for f in fs if f in index] for w, fs in parts.items()}
    words = [[k for w in s for k in held[w]] for d in sentences for s in d]
    del sentences, parts, held
    sentence_of = np.repeat(np.arange(len(words), dtype=np.int32), [len(s) for s in words])
    word = np.fromiter((k for s in words for k in s), np.int32, len(sentence_of))
    n = len(words)
    del words
    p = np.concatenate([np.zeros(len(index)), [-5.0, -4.0]])  # weights, bias, logit of the leak
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        z = np.bincount(sentence_of, p[word], n) + p[-2]
        q, leak = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-p[-1]))
        log_clean = np.bincount(doc_of, np.log1p(-np.minimum(q, 1 - 1e-12)), len(texts)) + math.log1p(-leak)
        clean = np.exp(log_clean)
        pull = np.where(y, -clean / np.maximum(1 - clean, 1e-9), 1.0) / len(texts)
        dz = pull[doc_of] * q
        g = np.concatenate([np.bincount(word, dz[sentence_of], len(index)) + decay * p[:-2], [dz.sum(), pull.sum() * leak]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    kept = {w: float(p[k]) for w, k in index.items() if abs(p[k]) > 1e-3}
    return NoisyOr(kept, float(p[-2]), float(1 / (1 + math.exp(-p[-1]))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, row_id: str = "doc_id", text: str = "text") -> NoisyOr:
    """Fit to at most ``rows`` labelled rows that are not held out."""
    found = sample(docs, labels, label, rows, row_id, text).toArrow()
    return fit_noisy_or(found.column("text").to_pylist(), found.column("label").to_numpy())


def score(docs: DataFrame, model: NoisyOr, row_id: str = "doc_id", text: str = "text", offending: float = OFFENDING) -> DataFrame:
    """(doc_id, score, offending) of every row; offending: spans and probabilities of sentences from ``offending`` on.

    A null or empty text has no sentences and scores the leak.  Repeated rows are rows of their own; an
    empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{row_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("offending", SPANS)])
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = [], []
            for t in batch.column(1):
                sentences = model.sentences(t.as_py() or "")
                scores.append(model.score(sentences))
                found.append([{"start": a, "end": b, "score": p} for a, b, p in sentences if p >= offending])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, spans)], names=schema.names)

    return rows.mapInArrow(run, schema)
