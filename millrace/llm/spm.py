"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives one Viterbi pass over a text.

At every end position the automaton's output links give all pieces that end there, longest first; each
relaxes the best score of its end.  Only a strictly better score replaces one, so of equal paths the one
with the longer last piece stays, as in the public tokenizer.  A character without a piece is unknown and
becomes its bytes.  The pass runs on parts between which no piece reaches, which gives the same result as
on the whole text, and a task remembers the parts that it has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import MEMORY, MODEL, SPACE, Vocabulary

_LOW = float("-inf")


def best_path(marked: str, vocabulary: Vocabulary) -> list[int]:
    """Ids of the best path over a text that has its space marks."""
    n = len(marked)
    score, start, piece = [0.0] + [_LOW] * n, [0] * (n + 1), [-1] * (n + 1)
    single = vocabulary.single
    whole = single.issuperset(marked)
    poor = None if whole else vocabulary.unknown_score
    closed = 0
    for last, (length, number, gain) in vocabulary.automaton().iter(marked):
        if not whole:  # unknown characters end before this position
            while closed < last:
                closed += 1
                if marked[closed - 1] not in single and score[closed - 1] + poor > score[closed]:
                    score[closed], start[closed], piece[closed] = score[closed - 1] + poor, closed - 1, -1
        end = last + 1
        total = score[end - length] + gain
        if total > score[end]:
            score[end], start[end], piece[end] = total, end - length, number
    while not whole and closed < n:
        closed += 1
        if marked[closed - 1] not in single and score[closed - 1] + poor > score[closed]:
            score[closed], start[closed], piece[closed] = score[closed - 1] + poor, closed - 1, -1
    ids: list[int] = []
    at = n
    while at:
        if piece[at] >= 0:
            ids.append(piece[at])
        elif vocabulary.bytes_:
            ids += [vocabulary.bytes_[b] for b in reversed(marked[start[at] : at].encode("utf-8", "surrogatepass"))]
        else:
            ids.append(vocabulary.unknown)
        at = start[at]
    return ids[::-1]


class Encoder:
    """Encodes and decodes whole texts, remembering parts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}
        self.spelled: list[bytes] | None = None

    def _part(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            found = np.array(best_path(part, self.vocabulary), np.int32).tobytes()
            if len(part) <= 64:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[part] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._part, self.vocabulary.chunks(text))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if self.spelled is None:
            self.spelled = [b""] * self.vocabulary.size
            for text, number, _ in self.vocabulary.pieces:
                self.spelled[number] = text.replace(SPACE, " ").encode()
            for value, number in enumerate(self.vocabulary.bytes_ or []):
                self.spelled[number] = bytes([value])
        raw = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, row_id: str = "doc_id", text: str = "text", model: str = MODEL, verify: bool = False) -> DataFrame:
    """(doc_id, pieces) of every row: the ids of its whole text; with ``verify`` also whether decoding gives the text back.

    An empty text has no pieces and a null text has null; repeated rows are rows of their own; other columns
    are not looked at.  A text that itself holds the space mark U+2581 decodes with spaces in its place.
    """
    vocabulary = Vocabulary.read(model)
    rows = docs.select(F.col(f"`{row_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("pieces", T.ArrayType(T.IntegerType()))] + [T.StructField("same", T.BooleanType())] * verify)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = part.column(1).to_pylist()
                ids = [encoder.encode(t or "") for t in texts]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)), mask=pa.array([t is None for t in texts]))
                columns = [part.column(0), lists]
                if verify:
                    columns.append(pa.array([encoder.decode(x) == (t or "") for x, t in zip(ids, texts)]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, row_id: str = "doc_id", pieces: str = "pieces", model: str = MODEL) -> DataFrame:
    """(doc_id, text) of every row of ids; null ids give a null text."""
    vocabulary = Vocabulary.read(model)
    rows = encoded.select(F.col(f"`{row_id}`").alias("doc_id"), F.col(f"`{pieces}`").alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = [None if x is None else encoder.decode(np.array(x, np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))
