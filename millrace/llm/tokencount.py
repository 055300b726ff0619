"""Token counts by a Viterbi pass that carries scores and counts only.

The automaton lists the vocabulary's matches by end position, longest first; each position keeps its best
score and the pieces on the path to it, no way back.  Ties go as in the public tokenizer: only a strictly
better score replaces one.  An unknown character counts as its bytes, or as one piece in a vocabulary
without byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import MEMORY, MODEL, Vocabulary


def count_pieces(marked: str, vocabulary: Vocabulary) -> int:
    """Pieces on the best path over a text that has its space marks."""
    n = len(marked)
    score, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
    single = vocabulary.single
    strange = [] if single.issuperset(marked) else [k for k, c in enumerate(marked) if c not in single]
    poor = vocabulary.unknown_score if strange else 0.0
    strange.append(n)
    ahead = iter(strange)
    at = next(ahead)

    def unknown(k: int) -> None:
        if score[k] + poor > score[k + 1]:
            score[k + 1] = score[k] + poor
            count[k + 1] = count[k] + (len(marked[k].encode("utf-8", "surrogatepass")) if vocabulary.bytes_ else 1)

    for last, (length, _, gain) in vocabulary.automaton().iter(marked):
        while at < last:
            unknown(at)
            at = next(ahead)
        total = score[last + 1 - length] + gain
        if total > score[last + 1]:
            score[last + 1], count[last + 1] = total, count[last + 1 - length] + 1
    while at < n:
        unknown(at)
        at = next(ahead)
    return count[n]


def token_counts(docs: DataFrame, row_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens) of every row's whole text; null and empty texts have none.

    Repeated rows are rows of their own, an empty table gives an empty result, other columns are not looked at.
    """
    vocabulary = Vocabulary.read(model)
    rows = docs.select(F.col(f"`{row_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def part(chunk: str) -> int:
            found = known.get(chunk)
            if found is None:
                found = count_pieces(chunk, vocabulary)
                if len(chunk) <= 64:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[chunk] = found
            return found

        for batch in batches:
            counts = [sum(map(part, vocabulary.chunks(t.as_py() or ""))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType())]))
