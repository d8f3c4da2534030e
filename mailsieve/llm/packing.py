"""Harmonic packing: pieces in reciprocal-capacity classes, a fixed number of pieces a sequence.

A document is cut into pieces of the capacity, then of half of it, a quarter and so on down to
``least``, as the binary digits of its rest say, and a tail shorter than that.  A piece of
length n is in class ``capacity // n``: so many pieces share a sequence.  A piece's number
within its class fixes its sequence, so workers fill bins without asking each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mailsieve.functions.shared import buckets, cut, numbered, ship
from mailsieve.llm.tokens import column, encoder

CAPACITY = 1024
LEAST = 64
PIECE = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


def piece_lengths(tokens: np.ndarray, capacity: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of all pieces, document by document, and each document's number of pieces."""
    sizes = [capacity >> s for s in range(1, capacity.bit_length()) if capacity >> s >= least]
    rest = tokens % capacity
    columns = [np.where(rest & size, size, 0) for size in sizes] + [rest % (sizes[-1] if sizes else capacity)]
    parts = np.stack(columns, 1)
    whole = tokens // capacity
    counts = whole + (parts > 0).sum(1)
    # columns 0..n-1: the rest; a leading column that is repeated for the whole ones
    table = np.concatenate([np.full((len(tokens), 1), capacity), parts], 1)
    times = np.concatenate([whole[:, None], (parts > 0).astype(np.int64)], 1)
    return np.repeat(table.ravel(), times.ravel()), counts


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, byte_level: bool = True,
                  capacity: int = CAPACITY, least: int = LEAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: every id, the end id included, is in exactly one.

    A null text is empty and has the end id alone; a null doc_id is kept; repeated rows are
    packed each on their own.  Each piece also has its document's columns ``carry``.
    """
    if capacity & (capacity - 1) or least & (least - 1) or not 0 < least <= capacity:
        raise ValueError("capacity and least are powers of two, least not above capacity")
    ship(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = encoder(tokenizer, byte_level)
        for batch in batches:
            doc_ids = column(batch, "doc_id")
            for first, ids, offsets in slices.encode(column(batch, "text")):
                n = len(offsets) - 1
                ends = offsets[1:].astype(np.int64) + np.arange(1, n + 1)
                tokens = np.diff(ends, prepend=0)
                packed = np.full(len(ids) + n, end_id, "<u4")
                body = np.ones(len(packed), bool)
                body[ends - 1] = False
                packed[body] = ids
                lengths, counts = piece_lengths(tokens, capacity, least)
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                starts = bounds[:-1] - np.repeat(ends - tokens, counts)
                row = np.repeat(np.arange(n), counts)
                data = pa.Array.from_buffers(
                    pa.binary(), len(lengths),
                    [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())],
                )
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(first, n).take(pa.array(row)), pa.array(starts), pa.array(lengths),
                     pa.array(tokens[row]), data, *[column(batch, c).slice(first, n).take(pa.array(row)) for c in carry]],
                    ["doc_id", "start", "length", "doc_tokens", "ids", *carry],
                )

    fields = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry).mapInArrow(pieces, PIECE + fields)


def place(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; other columns stay.

    Only the last, incomplete bin of each class is looked at as a whole: there are at most as
    many as classes, so the driver shares them out, the fullest first.

    With columns ``order``, the pieces of each class fill its bins in their order, and a
    sequence's number is the place of its last piece among those that fill a bin; the
    incomplete bins come last.  So the first sequences hold the first pieces, but for those in
    one open bin of each class.  Without, pieces are dealt by hash.  Columns ``class``,
    ``sequence_id``, ``offset``, ``number``, ``_bin``, ``_all``, ``_closed`` and ``_range`` of
    ``pieces`` are replaced or go.
    """
    pieces = pieces.drop("class", "sequence_id", "offset", "number", "_bin", "_all", "_closed", "_range")
    rows = cut(pieces.withColumn("class", (F.lit(capacity) / F.col("length")).cast("int")), "pieces")
    along = [F.col(c) for c in order]
    if order:
        ranges = rows.repartitionByRange(buckets(rows.count()), *along).withColumn("_range", F.spark_partition_id())
        rows, spread, by = cut(ranges, "ranges"), F.col("_range"), along
    else:
        spread = F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets(rows.count()))).cast("int")
        by = [F.col("doc_id"), F.col("start"), F.col("doc_tokens"), F.xxhash64(*pieces.columns)]
    rows = cut(numbered(rows, ["class"], by, spread, "number"), "numbered")
    sizes = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect()}
    base, bins = {}, 0
    for k in sorted(sizes):
        base[k], bins = bins, bins + sizes[k] // k
    whole = {k: n - n % k for k, n in sizes.items()}
    table = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("class"))
    if not sizes:
        return rows.select(*pieces.columns, "class", F.lit(0).cast("bigint").alias("sequence_id"),
                           F.lit(0).cast("bigint").alias("offset"))
    left = F.col("number") >= table(whole)
    rests = rows.where(left).groupBy("class").agg(F.sum("length").alias("n")).collect()
    filled: list[int] = []
    shelf = {}
    for rest in sorted(rests, key=lambda r: (-r["n"], r["class"])):
        at = next((i for i, used in enumerate(filled) if used + rest["n"] <= capacity), len(filled))
        if at == len(filled):
            filled.append(0)
        shelf[rest["class"]] = bins + at
        filled[at] += rest["n"]
    full = (table(base) + F.floor(F.col("number") / F.col("class"))).cast("bigint")
    if order:
        last = rows.where(~left & (F.col("number") % F.col("class") == F.col("class") - 1)).withColumn("_bin", full).withColumn("_all", F.lit(0))
        closed = numbered(last, ["_all"], along, F.col("_range"), "_closed").select("_bin", "_closed")
        rows = rows.withColumn("_bin", F.when(~left, full)).join(closed, "_bin", "left")
        full = F.col("_closed").cast("bigint")
    sequence = F.when(left, table(shelf).cast("bigint")).otherwise(full) if shelf else full
    before = Window.partitionBy("sequence_id").orderBy("class", "number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("sequence_id", sequence).select(
        *pieces.columns, "class", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"),
    )
