"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word bucket has a sparse random index vector of a few +1 and -1.  A bucket's word vector is the sum of
the index vectors of the words around its occurrences, over all documents: tasks add up whole partitions
before anything is shuffled, and the table of vectors has a fixed size.  A document is the mean and the
spread of its words' vectors; a two-layer network in numpy learns labels of a bounded sample, and a
temperature fitted on rows that it has not seen calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import FIT_ROWS, sample

#: Runs of letters and digits, and runs of other characters that are not white space.
TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 13
SIZE = 48
NONZERO = 4
REACH = 2
SEED = 11
HIDDEN = 32
EPOCHS = 60
RATE = 5e-3
DECAY = 1e-4
#: Share of the sample that the temperature is fitted on.
CALIBRATION = 0.2
MEMORY = 400_000
_BATCH_TOKENS = 500_000


class Buckets:
    """Bucket numbers of tokens, remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, token: str) -> int:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            found = self.known[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS
        return found

    def of(self, text: str) -> np.ndarray:
        return np.fromiter(map(self, TOKEN.findall(text)), np.int64)


def index_vectors(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    at = np.argsort(rng.random((BUCKETS, SIZE)), axis=1)[:, :NONZERO]
    return at, rng.integers(0, 2, (BUCKETS, NONZERO)) * 2 - 1


def add_contexts(total: np.ndarray, tokens: np.ndarray, text_of: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> None:
    """Add to the vectors of ``tokens`` the index vectors of their neighbours within REACH in the same text."""
    at, sign = index
    flat = total.reshape(-1)
    for reach in range(1, REACH + 1):
        same = text_of[reach:] == text_of[:-reach]
        left, right = tokens[:-reach][same], tokens[reach:][same]
        for word, near in ((left, right), (right, left)):
            for k in range(NONZERO):
                flat += np.bincount(word * SIZE + at[near, k], sign[near, k], len(flat))


def word_vectors(docs: DataFrame, text: str = "text", seed: int = SEED) -> np.ndarray:
    """Unit word vectors of all buckets from every whole text; zero where a bucket has no neighbour.

    The result has BUCKETS rows whatever the corpus, so it may go to the driver and to every task.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"))
    names = [f"s{k}" for k in range(SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, index = Buckets(), index_vectors(seed)
        total, held, size = np.zeros((BUCKETS, SIZE)), [], 0

        def flush() -> None:
            if held:
                add_contexts(total, np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held]), index)
                held.clear()

        for batch in batches:
            for t in batch.column(0):
                tokens = bucket.of(t.as_py() or "")
                held.append(tokens)
                size += len(tokens)
                if size > _BATCH_TOKENS:
                    flush()
                    size = 0
        flush()
        used = np.flatnonzero(total.any(axis=1))
        columns = [pa.array(used.astype(np.int32))] + [pa.array(total[used, k].astype(np.int64)) for k in range(SIZE)]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", *names])

    parts = rows.mapInArrow(run, "bucket int, " + ", ".join(f"{n} long" for n in names))
    found = parts.groupBy("bucket").agg(*[F.sum(n).cast("double").alias(n) for n in names]).toArrow()
    vectors = np.zeros((BUCKETS, SIZE))
    vectors[found.column("bucket").to_numpy()] = np.column_stack([found.column(n).to_numpy() for n in names])
    vectors -= vectors.sum(0) / max(1, np.count_nonzero(vectors.any(axis=1))) * vectors.any(axis=1)[:, None]
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(text: str, vectors: np.ndarray, bucket: Buckets) -> np.ndarray:
    """Mean and spread of the word vectors of a whole text; zeros for no words."""
    tokens = bucket.of(text)
    if not len(tokens):
        return np.zeros(2 * SIZE, np.float32)
    kinds, counts = np.unique(tokens, return_counts=True)
    own, share = vectors[kinds], (counts / len(tokens)).astype(np.float32)
    mean = share @ own
    return np.concatenate([mean, np.sqrt(np.maximum(share @ (own * own) - mean * mean, 0))])


def pooled_table(docs: DataFrame, vectors: np.ndarray, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` and ``features`` of every row."""
    rows = docs.select(*carry, F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema[c] for c in carry] + [T.StructField("features", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Buckets()
        for batch in batches:
            found = [pooled(t.as_py() or "", vectors, bucket) for t in batch.column(len(carry))]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(found)), 2 * SIZE).cast(pa.list_(pa.float32())) if found else pa.array([], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], lists], names=schema.names)

    return rows.mapInArrow(run, schema)


@dataclass
class Network:
    """Two layers over standardised features, with a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on the mean log-loss, then a temperature on the share kept aside; one class or none: its smoothed share."""
    d = x.shape[1] if x.ndim == 2 else 2 * SIZE
    share = (y.sum() + 0.5) / (len(y) + 1)
    flat = Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    if len(y) < 10 or y.min() == y.max():
        return flat
    rng = np.random.default_rng(seed)
    turn = rng.permutation(len(y))
    aside, learn = turn[: int(len(y) * CALIBRATION)], turn[int(len(y) * CALIBRATION) :]
    net = Network(x[learn].mean(0), x[learn].std(0) + 1e-3, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), flat.b2)
    p = [net.w1, net.b1, net.w2, np.array(net.b2)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    scaled, step = (x - net.centre) / net.scale, 0
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for low in range(0, len(learn), 128):
            rows = learn[low : low + 128]
            a, h = scaled[rows], np.tanh(scaled[rows] @ p[0] + p[1])
            dz = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - y[rows]) / len(rows)
            dh = np.outer(dz, p[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((a.T @ dh + DECAY * p[0], dh.sum(0), h.T @ dz + DECAY * p[2], dz.sum())):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3])
    z, t = net.logit(x[aside]), y[aside]

    def loss(temperature: float) -> float:
        s = np.clip(z / temperature, -60, 60)
        return float(np.mean(np.logaddexp(0, s) - t * s))

    net.temperature = float(min(np.geomspace(0.5, 10, 61), key=loss)) if len(t) else 1.0
    return net


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality", rows: int = FIT_ROWS, row_id: str = "doc_id", text: str = "text") -> Network:
    """Fit to at most ``rows`` labelled rows that are not held out."""
    found = pooled_table(sample(docs, labels, label, rows, row_id, text), vectors, ["label"]).toArrow()
    x = found.column("features").combine_chunks().flatten().to_numpy().reshape(-1, 2 * SIZE) if found.num_rows else np.zeros((0, 2 * SIZE))
    return fit_network(x.astype(np.float64), found.column("label").to_numpy())


def score(docs: DataFrame, vectors: np.ndarray, net: Network, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null and empty texts pool to zeros and are scored as such.

    Repeated rows are rows of their own, an empty table gives an empty result, other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{row_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Buckets()
        for batch in batches:
            found = np.array([pooled(t.as_py() or "", vectors, bucket) for t in batch.column(1)], np.float64).reshape(-1, 2 * SIZE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.probability(found))], names=["doc_id", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
