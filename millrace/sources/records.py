"""Record files and indexed loaders as Python data sources: batches by ranges of records, streams by offsets.

A source is asked for records by number.  As a table it is read in partitions of ``rows`` records; as a stream its
offset is how many records there are, so a restart goes on after the last record that was committed, and records that
are appended later come with the next batch.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Records of a partition.
ROWS = 10_000


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__(low)
        self.low, self.high = low, high


def _ranges(low: int, high: int, rows: int) -> list[Range]:
    return [Range(k, min(high, k + rows)) for k in range(low, high, rows)]


Load = Callable[[dict, int, int], Iterator[tuple]]


def indexed_source(name: str, schema: str, length: Callable[[dict], int], load: Load) -> type[DataSource]:
    """A data source of records that a function loads: ``load(options, low, high)`` yields records low to high - 1 as tuples.

    ``length(options)`` says how many records there are now.  Register it by ``spark.dataSource.register`` and read it
    by ``spark.read.format(name)`` or ``spark.readStream.format(name)``; option ``rows`` sets the size of a partition.
    """

    class Records:
        def __init__(self, options: dict):
            self.options = {k.lower(): v for k, v in options.items()}
            self.rows = int(self.options.get("rows", ROWS))

        def read(self, partition: Range) -> Iterator[tuple]:
            yield from load(self.options, partition.low, partition.high)

    class Reader(Records, DataSourceReader):
        def partitions(self) -> list[Range]:
            return _ranges(0, length(self.options), self.rows)

    class StreamReader(Records, DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"at": 0}

        def latestOffset(self) -> dict:
            return {"at": length(self.options)}

        def partitions(self, start: dict, end: dict) -> list[Range]:
            return _ranges(start["at"], end["at"], self.rows)

        def commit(self, end: dict) -> None:
            """Nothing is held for records that are done with."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader(dict(self.options))

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return StreamReader(dict(self.options))

    return Source


# IDX files: a magic number of two zeros, the kind of value and the number of dimensions, then big-endian sizes

#: Fixed values of the format: kinds of value.
IDX_KINDS = {0x08: ">u1", 0x09: ">i1", 0x0B: ">i2", 0x0C: ">i4", 0x0D: ">f4", 0x0E: ">f8"}


def idx_header(head: bytes) -> tuple[np.dtype, list[int], int]:
    """Kind of value, sizes, and where the records begin."""
    if len(head) < 4 or head[:2] != b"\0\0" or head[2] not in IDX_KINDS:
        raise ValueError("not an IDX file: its first bytes are " + head[:4].hex())
    sizes = [int.from_bytes(head[4 + 4 * k : 8 + 4 * k], "big") for k in range(head[3])]
    return np.dtype(IDX_KINDS[head[2]]), sizes, 4 + 4 * head[3]


def _opened(path: str):
    """A file on any store that Arrow reaches; one that ends in .gz is unpacked as it is read."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return gzip.open(store.open_input_stream(inner, compression=None)) if path.endswith(".gz") else store.open_input_file(inner)


def _idx_shape(path: str) -> tuple[np.dtype, list[int], int]:
    with _opened(path) as f:
        head = f.read(4)
        return idx_header(head + f.read(4 * head[3] if len(head) == 4 else 0))


def _idx_length(options: dict) -> int:
    return _idx_shape(options["path"])[1][0]


def _idx_load(options: dict, low: int, high: int) -> Iterator[tuple]:
    kind, sizes, start = _idx_shape(options["path"])
    step = int(np.prod(sizes[1:], dtype=np.int64)) * kind.itemsize
    with _opened(options["path"]) as f:
        f.seek(start + low * step)  # a packed file is unpacked up to here
        for k in range(low, high):
            record = f.read(step)
            if len(record) != step:
                raise ValueError(f"{options['path']} ends within record {k}")
            yield k, sizes[1:], np.frombuffer(record, kind).astype(float).tolist()


def idx_source() -> type[DataSource]:
    """Format ``idx``: (pos, sizes, values) of the records of one IDX file, ``path``, packed by gzip or not.

    A packed file cannot be entered in the middle: each partition unpacks what lies before it, so ``rows`` should be
    large for such files.
    """
    return indexed_source("idx", "pos long, sizes array<int>, values array<double>", _idx_length, _idx_load)


def unpacked_idx(files: DataFrame, content: str = "content") -> DataFrame:
    """A row for every record of the IDX files in a binary column, packed or not: the other columns, ``pos``, ``sizes``, ``values``.

    Takes what ``binaryFile`` reads, from any store that Spark reaches; a file is one value, so it stays below 2 GB.
    Null contents have no records.
    """
    others = [c for c in files.columns if c != content]
    schema = T.StructType([*[files.schema[c] for c in others], T.StructField("pos", T.LongType()), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(len(others)).to_pylist()):
                if data is None:
                    continue
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                kind, sizes, start = idx_header(data)
                width = int(np.prod(sizes[1:], dtype=np.int64))
                if len(data) - start < sizes[0] * width * kind.itemsize:
                    raise ValueError("an IDX file ends before its last record")
                step = max(1, (1 << 20) // max(width, 1))
                for low in range(0, sizes[0], step):
                    n = min(step, sizes[0] - low)
                    flat = np.frombuffer(data, kind, n * width, start + low * width * kind.itemsize).astype(np.float64)
                    values = pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32), flat)
                    same = [pa.repeat(batch.column(c)[i], n) for c in range(len(others))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(low, low + n)), pa.array([sizes[1:]] * n, pa.list_(pa.int32())), values], names=schema.names)

    return files.select(*others, content).mapInArrow(run, schema)


def read_idx(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, sizes, values) of all IDX files that ``path`` names."""
    return unpacked_idx(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))
