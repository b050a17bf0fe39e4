"""Tokenising whole texts into a written table, in ascending doc_id order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import parts, text_or_empty, written
from rankloom.llm.wordids import small_batches, worker_encoder

SCHEMA = "part int, doc_id long, at long, n long, ids binary"


def binary_rows(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each row: the bytes of flat[bounds[i] : bounds[i + 1]]."""
    flat = np.ascontiguousarray(flat)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * flat.itemsize).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def ids_of(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one after the other, and where each row begins (with the end)."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(bounds) or bounds[-1] == bounds[0]:
        return np.empty(0, dtype), np.zeros(len(column) + 1, np.int64)
    flat = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return np.frombuffer(flat.tobytes(), dtype), (bounds - bounds[0]) // np.dtype(dtype).itemsize


def _tokeniser(path: str, end_id: int, dtype: str, special: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, before = worker_encoder(path, special), 0
        part = TaskContext.get().partitionId()
        for batch in small_batches(batches, "text", 8_000_000):
            ids, at = encoder.encode(batch.column("text"))
            rows = batch.num_rows
            out = np.insert(ids.astype(dtype), at[1:], end_id)
            bounds = at + np.arange(rows + 1)
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, part, np.int32)), batch.column("doc_id"), pa.array(before + bounds[:-1]), pa.array(n), binary_rows(out, bounds)],
                ["part", "doc_id", "at", "n", "ids"],
            )
            before += int(bounds[-1])

    return run


def tokenised(docs: DataFrame, path: str, end_id: int, dtype: str = "<u2", encode_special_tokens: bool = False, name: str = "ids") -> DataFrame:
    """Written table (part, doc_id, at, n, ids): ids of the whole text and ``end_id``, as packed integers.

    Parts hold ranges of (doc_id, hash of text) in ascending order; ``at`` counts the ids before the
    document within its part. A null text counts as empty; a row with a null doc_id keeps it and comes first;
    repeated rows stay. ``dtype`` must hold every id of the vocabulary.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(_tokeniser(path, end_id, dtype, encode_special_tokens), SCHEMA), name)


def id_counts(tokens: DataFrame, dtype: str) -> DataFrame:
    """(id, n): how often each id occurs; as many rows as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << (8 * np.dtype(dtype).itemsize) if np.dtype(dtype).itemsize == 2 else 1 << 20, np.int64)
        for batch in batches:
            ids = ids_of(batch.column("ids"), dtype)[0]
            if len(ids):
                total += np.bincount(ids, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
