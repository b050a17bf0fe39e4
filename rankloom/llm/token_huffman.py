"""Token ids in a compact file format: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints.

Counts of all ids (as many as the vocabulary has) give one code for the whole set of files. A block holds
whole documents; its bytes begin with their doc_ids and lengths and with the bit offset of every
``STRIDE``-th id, so a block is read without any other and its strides are decoded side by side from one table.

Block bytes, little-endian: magic ``TIDB``, documents u32, ids u64, checkpoints u32, stream bytes u64;
then ids before the first document in its part u64; doc_ids i64 (null: the smallest i64); ids of each document u64;
checkpoints u64; the bit stream, most significant bit first, padded by four zero bytes.
The head of a set of files is the code length of each id as u8.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import written
from rankloom.llm.tokens import id_counts, ids_of, tokenised

MAGIC, HEAD, STRIDE, LIMIT = b"TIDB", struct.Struct("<4sIQIQQ"), 128, 16
NO_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code length of each symbol, ``limit`` at most, by package-merge; 0 where the count is 0. One symbol alone gets length 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit in codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels, values = [], weight
    item = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(item)
        pairs = values[: len(values) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        by = np.argsort(both, kind="stable")
        values, item = both[by], by < n
    levels.append(item)
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for item in reversed(levels):
        items = int(item[:take].sum())
        length[:items] += 1
        take = 2 * (take - items)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Code of each symbol; for each ``top``-bit prefix the symbol and its length; ``top``, the longest length."""
    top = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = np.int64(1) << (top - lengths[order].astype(np.int64))
    first = np.cumsum(span) - span
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = first >> (top - lengths[order].astype(np.int64))
    symbol, length = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.uint8)
    filled = int(span.sum())
    symbol[:filled], length[:filled] = np.repeat(order, span), np.repeat(lengths[order], span)
    return codes, symbol, length, top


def bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit stream of the ids and the bit offset of every STRIDE-th of them."""
    if not len(ids):
        return bytes(4), np.empty(0, np.uint64)
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    at = end - n
    word, shift = at >> 5, 64 - (at & 31) - n
    both = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    words = int(end[-1] + 31 >> 5) + 1
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    high = np.zeros(words + 1, np.uint64)
    low = np.zeros(words + 1, np.uint64)
    high[word[heads]] = np.add.reduceat(both >> np.uint64(32), heads)
    low[word[heads] + 1] = np.add.reduceat(both & np.uint64(0xFFFFFFFF), heads)
    stream = (high + low).astype(">u4").tobytes()[: int(end[-1] + 7 >> 3)]
    return stream + bytes(4), at[::STRIDE].astype(np.uint64)


@dataclass
class Block:
    """What the bytes of a block say, before the ids are decoded."""

    doc_ids: np.ndarray
    lengths: np.ndarray
    before: int
    checkpoints: np.ndarray
    stream: np.ndarray


def block_bytes(doc_ids: np.ndarray, lengths: np.ndarray, before: int, ids: np.ndarray, codes: np.ndarray, code_len: np.ndarray) -> bytes:
    stream, marks = bits(ids, codes, code_len)
    return HEAD.pack(MAGIC, len(doc_ids), len(ids), len(marks), len(stream), before) + doc_ids.astype("<i8").tobytes() + lengths.astype("<u8").tobytes() + marks.astype("<u8").tobytes() + stream


def parse(raw: bytes) -> Block:
    magic, docs, ids, marks, size, before = HEAD.unpack_from(raw)
    at = HEAD.size
    if magic != MAGIC or len(raw) != at + 16 * docs + 8 * marks + size:
        raise ValueError("not a block of token ids")
    doc_ids, at = np.frombuffer(raw, "<i8", docs, at), at + 8 * docs
    lengths, at = np.frombuffer(raw, "<u8", docs, at).astype(np.int64), at + 8 * docs
    checkpoints = np.frombuffer(raw, "<u8", marks, at).astype(np.int64)
    if int(lengths.sum()) != ids:
        raise ValueError("the lengths of a block's documents don't add up")
    return Block(doc_ids, lengths, before, checkpoints, np.frombuffer(raw, np.uint8, size, at + 8 * marks))


def decode(blocks: list[Block], symbol: np.ndarray, length: np.ndarray, top: int) -> list[np.ndarray]:
    """Ids of each block; the strides of all blocks go forward together, one table look-up for an id of each."""
    data = np.concatenate([b.stream for b in blocks] + [np.zeros(4, np.uint8)]).astype(np.uint32)
    wide = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    base = np.cumsum([0] + [len(b.stream) for b in blocks])[:-1] * 8
    sizes = [int(b.lengths.sum()) for b in blocks]
    at = np.concatenate([b.checkpoints + s for b, s in zip(blocks, base, strict=True)])
    out = np.zeros((len(at), STRIDE), np.uint32)
    left = np.concatenate([np.minimum(STRIDE, n - np.arange(0, n, STRIDE)) if n else np.empty(0, np.int64) for n in sizes]) if len(at) else np.empty(0, np.int64)
    lanes = np.argsort(-left, kind="stable")
    at, alive = at[lanes], np.searchsorted(-left[lanes], -np.arange(STRIDE), "left")
    down = np.uint32(32 - top)
    for step in range(STRIDE):
        n = int(alive[step])
        if not n:
            break
        here = at[:n]
        peek = wide[here >> 3] << (here & 7).astype(np.uint32) >> down
        out[lanes[:n], step] = symbol[peek]
        at[:n] = here + length[peek]
    found, lane = [], 0
    for n in sizes:
        strides = -(-n // STRIDE)
        found.append(out[lane : lane + strides].reshape(-1)[:n])
        lane += strides
    return found


@dataclass
class TokenFiles:
    """A set of files: ``head`` (one row: code lengths) and ``blocks`` (part, n_ids, block)."""

    head: DataFrame
    blocks: DataFrame


def write_tokens(tokens: DataFrame, dtype: str, block_ids: int = 1 << 17) -> TokenFiles:
    """Encode a table of ``tokens.tokenised`` into blocks of about ``block_ids`` ids (a longer document is a block of its own).

    An empty table gives a head without codes and no block.
    """
    rows = id_counts(tokens, dtype).collect()  # one for each id of the vocabulary at most
    counts = np.zeros(max([r.id for r in rows], default=0) + 1, np.int64)
    counts[[r.id for r in rows]] = [r.n for r in rows]
    lengths = code_lengths(counts)
    spark = tokens.sparkSession
    head = written(spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary"), "token-head")
    codes = canonical(lengths)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = ids_of(batch.column("ids"), dtype)
            part, at = np.asarray(batch.column("part")), np.asarray(batch.column("at"))
            doc_ids = np.asarray(batch.column("doc_id").fill_null(NO_ID))
            first, found = 0, []
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + block_ids, "right")) - 1)
                last = min(last, first + int(np.argmax(np.append(part[first:last] != part[first], True))), batch.num_rows)
                some = ids[bounds[first] : bounds[last]]
                found.append((part[first], len(some), block_bytes(doc_ids[first:last], np.diff(bounds[first : last + 1]), int(at[first]), some, codes, lengths)))
                first = last
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary())], ["part", "n_ids", "block"])

    blocks = written(tokens.select("part", "doc_id", "at", "ids").mapInArrow(run, "part int, n_ids long, block binary"), "token-blocks")
    return TokenFiles(head, blocks)


def read_tokens(files: TokenFiles) -> DataFrame:
    """From the files: (doc_id, start, n_tokens, ids_crc32, ids) in whatever order; ``ids`` is array<int>.

    ``start`` counts the ids of all documents before it. Every block is decoded on its own.
    """
    spark = files.blocks.sparkSession
    lengths = np.frombuffer(bytes(files.head.first().lengths), np.uint8)
    _, symbol, length, top = canonical(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("block").to_pylist()
            for i in range(0, len(raw), 64):
                blocks = [parse(x) for x in raw[i : i + 64]]
                all_ids = decode(blocks, symbol, length, top)
                part = np.repeat(np.asarray(batch.column("part"))[i : i + 64], [len(b.doc_ids) for b in blocks])
                doc_ids = np.concatenate([b.doc_ids for b in blocks])
                n = np.concatenate([b.lengths for b in blocks])
                at = np.concatenate([b.before + np.cumsum(b.lengths) - b.lengths for b in blocks])
                ids = np.concatenate(all_ids)
                bounds = np.append(0, np.cumsum(n))
                packed = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(at), pa.array(n), pa.array(crc, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                    ["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
                )

    docs = files.blocks.mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long, ids array<int>")
    totals = sorted((r.part, r.n) for r in files.blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one for each part
    starts, before = [], 0
    for part, n in totals:
        starts.append((part, before))
        before += n
    # as many rows as parts were written: 16 bytes each
    starts = spark.createDataFrame(starts, "part int, part_start long")
    return docs.join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, dtype: str = "<u2") -> TokenFiles:
    """Tokenise whole texts of ``docs`` (doc_id, text) with a tokenizer file and write them.

    Null text: empty, which gives the end id alone. Null doc_ids come first. Repeated rows are documents of their own;
    rows of one doc_id come by a hash of their texts. Other columns are not read.
    """
    return write_tokens(tokenised(docs, tokenizer, end_id, dtype), dtype)
