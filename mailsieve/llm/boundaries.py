"""Token-id shards with Elias-Fano document boundaries.

A shard table has one row per chunk: the ids of its documents one after the other (2 bytes an
id where the vocabulary allows, else 4), the documents' ids, and where each document ends, as
an Elias-Fano sequence: about 2 + log2(tokens per document) bits a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mailsieve.functions.shared import ship
from mailsieve.llm.tokens import column, encoder

CHUNK = (
    "part int, chunk int, part_start bigint, n_docs int, n_tokens bigint, width int, "
    "doc_ids array<bigint>, ids binary, low_bits int, low binary, high binary"
)
ROW_GROUP = 32 << 20
BLOCK = 64  # bytes of the high bits under one entry of the select directory
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of non-negative integers; ``select(i)`` gives the i-th."""

    def __init__(self, size: int, low_bits: int, low: bytes, high: bytes):
        self.size, self.low_bits, self.low, self.high = size, low_bits, low, high
        self._low, self._high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        blocks = -(-len(self._high) // BLOCK)
        padded = np.zeros(blocks * BLOCK, np.uint8)
        padded[: len(self._high)] = self._high
        self._bytes = padded.reshape(blocks, BLOCK)
        self._before = np.concatenate([[0], np.cumsum(_ONES[self._bytes].sum(1, dtype=np.uint32), dtype=np.uint32)])

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        size = len(values)
        top = int(values[-1]) if size else 0
        low_bits = max(0, (top // size).bit_length() - 1) if size else 0
        marks = np.zeros(size + (top >> low_bits) + 1 if size else 0, np.uint8)
        marks[(values >> low_bits) + np.arange(size)] = 1
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(size, low_bits, low, np.packbits(marks, bitorder="little").tobytes())

    def select(self, index: np.ndarray) -> np.ndarray:
        index = np.asarray(index, np.int64)
        block = np.searchsorted(self._before, index, "right") - 1
        inside = np.cumsum(_ONES[self._bytes[block]], axis=1, dtype=np.int64)
        rest = index - self._before[block]
        byte = (inside <= rest[:, None]).sum(1)
        rest = rest - np.where(byte > 0, inside[np.arange(len(byte)), np.maximum(byte, 1) - 1], 0)
        bits = np.unpackbits(self._bytes[block, byte][:, None], axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1) <= rest[:, None]).sum(1)
        high = (block * BLOCK + byte) * 8 + bit - index
        places = index[:, None] * self.low_bits + np.arange(self.low_bits)
        low = (self._low[places >> 3] >> (places & 7)).astype(np.int64) & 1
        return (high << self.low_bits) + (low << np.arange(self.low_bits)).sum(1)


def encode(docs: DataFrame, tokenizer: str, end_id: int, byte_level: bool = False) -> DataFrame:
    """Chunks of ``docs(doc_id, text)`` in ascending doc_id order, ties by the text's hash.

    A null text is empty and gets the end id alone; a null doc_id comes first.  Partitions
    are ranges of doc_id, cut to even sizes; chunks are slices of a partition.
    """
    ship(docs.sparkSession)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_slices = encoder(tokenizer, byte_level)
        width = 2 if encode_slices.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        part, number, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            doc_ids = column(batch, "doc_id")
            for first, ids, offsets in encode_slices.encode(column(batch, "text")):
                n = len(offsets) - 1
                ends = offsets[1:].astype(np.int64) + np.arange(1, n + 1)
                packed = np.full(len(ids) + n, end_id, f"<u{width}")
                body = np.ones(len(packed), bool)
                body[ends - 1] = False
                packed[body] = ids
                marks = EliasFano.build(ends)
                row = [part, number, start, n, len(packed), width, doc_ids.slice(first, n).to_pylist(),
                       packed.tobytes(), marks.low_bits, marks.low, marks.high]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], _NAMES)
                number, start = number + 1, start + len(packed)

    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, CHUNK)


_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()),
          pa.binary(), pa.int32(), pa.binary(), pa.binary()]
_NAMES = [field.split(" ")[0] for field in CHUNK.split(", ")]


def write(chunks: DataFrame, path: str) -> None:
    chunks.write.option("parquet.block.size", ROW_GROUP).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ids as little-endian 32-bit integers.

    ``start`` counts the ids of all documents before: the chunk's place in its partition is in
    the file, and one sum per partition gives the rest.
    """
    ship(spark)
    chunks = spark.read.schema(CHUNK).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = chunks.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base"))
    rows = chunks.join(F.broadcast(parts), "part")  # one small row for each partition of the writer

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_docs"]
                marks = EliasFano(n, row["low_bits"], row["low"], row["high"])
                bounds = np.concatenate([[0], marks.select(np.arange(n))])
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                data = pa.Array.from_buffers(
                    pa.large_binary(), n, [None, pa.py_buffer((bounds * 4).tobytes()), pa.py_buffer(ids.tobytes())]
                ).cast(pa.binary())
                starts = bounds[:-1] + row["base"] + row["part_start"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(np.diff(bounds)), data],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return rows.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
