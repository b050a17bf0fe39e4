"""Packing documents into sequences by lexical retrieval: a sharded BM25 index gives each seed its unused neighbours.

Terms are token ids, so document frequencies over all pieces have as many rows as the vocabulary. A document's full
windows are sequences by themselves; its last piece, shorter than a window, goes to a shard of bounded size. Shards are lexical: a piece's own
term is the one that weighs most in it of those that other pieces have too; terms in order of their ids are dealt over shards by how many pieces they own, and a
term that owns more than a shard holds has shards of its own, over which its pieces are dealt by their place. So whatever shares a rare term meets, however many
pieces there are. A shard's inverted index scores all its unused pieces against a seed, the longest first; the best that fit fill the window,
and the best of the rest is cut to fill it to the end, its remainder staying unused. Only the last window of a shard can fall short: it is cut into
sequences of powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import mixed, names, text_or_empty, written
from rankloom.llm.tokens import binary_rows, ids_of
from rankloom.llm.wordids import ranges, small_batches, worker_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = names(PIECES)


SPLIT = "part int, at long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, counts binary"


def _splitter(path: str, end_id: int, window: int, special: bool):
    """Of each document: its full windows, without their ids, and its last piece, with them; last, how often which id is in how many last pieces.

    The counts' row has ids of -1: pieces, ids of all pieces, then for each id of the vocabulary the pieces that hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, before = worker_encoder(path, special, most_words=150_000), 0
        part = TaskContext.get().partitionId()
        total, pieces, tokens = np.zeros(1 << 16, np.int64), 0, 0
        for batch in small_batches(batches, "text"):
            ids, at = encoder.encode(batch.column("text"))
            ids = np.insert(ids.astype("<u4"), at[1:], end_id)
            bounds = at + np.arange(batch.num_rows + 1)
            n = np.diff(bounds)
            count = n // window + (n % window > 0)
            row = np.repeat(np.arange(len(n)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
            length = np.minimum(n[row] - start, window)
            first = bounds[row] + start
            packed = memoryview(ids).cast("B")
            sums = np.fromiter((zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)), np.int64, len(row))
            rest = length < window
            size = np.where(rest, length, 0)
            own = ids[ranges(first[rest], length[rest])].astype("<u2")
            held = binary_rows(own, np.append(0, np.cumsum(size)))
            held = pc.if_else(pa.array(rest), held, pa.scalar(None, pa.binary()))
            key = np.sort(np.repeat(np.arange(int(rest.sum()), dtype=np.uint64), length[rest]) << np.uint64(16) | own)
            key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
            total += np.bincount((key & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            pieces, tokens = pieces + int(rest.sum()), tokens + len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), part, np.int32)), pa.array(before + first), batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length, sums, n[row])), held, pa.nulls(len(row), pa.binary())],
                names(SPLIT),
            )
            before += int(bounds[-1])
        counts = np.concatenate([[pieces, tokens], total]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_pylist([{"part": part, "length": 0, "counts": counts}], pa.schema([(x, t) for x, t in zip(names(SPLIT), (pa.int32(), *(pa.int64(),) * 6, pa.binary(), pa.binary()), strict=True)]))

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n) of counts' rows: -2 pieces, -1 ids of all pieces."""
    total = np.zeros((1 << 16) + 2, np.int64)
    for batch in batches:
        for raw in batch.column("counts"):
            total += np.frombuffer(raw.as_buffer(), "<i8")
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array((some - 2).astype(np.int32)), pa.array(total[some])], ["id", "n"])


def own_terms(ids: np.ndarray, bounds: np.ndarray, idf: np.ndarray, df: np.ndarray) -> np.ndarray:
    """For each piece the id of the greatest idf x tf / (tf + 1.5), of those that two pieces or more have (``df``); 0 without any. Ties: the least id."""
    n = np.diff(bounds)
    key = np.sort(np.repeat(np.arange(len(n), dtype=np.int64), n) << 16 | ids)
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    tf = np.diff(np.append(heads, len(key)))
    piece, term = key[heads] >> 16, key[heads] & 0xFFFF
    weight = np.where(df[term] > 1, idf[term] * tf / (tf + 1.5), -1.0)
    out = np.zeros(len(n), np.int32)
    if len(piece):
        first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        times = np.diff(np.append(first, len(piece)))
        chosen = np.flatnonzero((weight == np.repeat(np.maximum.reduceat(weight, first), times)) & (weight >= 0))[::-1]
        out[piece[chosen]] = term[chosen]
    return out


def _terms_of(idf: np.ndarray, df: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "ids"):
            terms = own_terms(*ids_of(batch.column("ids"), "<u2"), idf, df)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("at"), pa.array(terms)], ["part", "at", "term"])

    return run


def shard_ranges(owned: dict[int, int], shard_pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each term: a term of more pieces than a shard has shards of its own; others share, in order of ids."""
    first, number = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
    fresh, open_, room = 0, 0, 0
    for term, n in sorted(owned.items()):
        if n > shard_pieces:
            first[term], number[term] = fresh, -(-n // shard_pieces)
            fresh += int(number[term])
            continue
        if n > room:
            open_, fresh, room = fresh, fresh + 1, shard_pieces
        first[term], room = open_, room - n
    return first, number


class Index:
    """BM25 inverted index of a shard's pieces; idf and mean length are those of all pieces of all shards."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, idf: np.ndarray, mean_length: float, k1: float = 1.5, b: float = 0.75):
        n = np.diff(bounds)
        row = np.repeat(np.arange(len(n), dtype=np.int64), n)
        pair, tf = np.unique(row << 16 | ids.astype(np.int64), return_counts=True)
        piece, term = pair >> 16, pair & 0xFFFF
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[piece] / mean_length))
        self.terms, local = np.unique(term, return_inverse=True)
        by = np.argsort(local, kind="stable")
        self.piece, self.weight = piece[by], weight[by]
        self.heads = np.append(0, np.cumsum(np.bincount(local, minlength=len(self.terms))))
        self.query_at = np.searchsorted(piece, np.arange(len(n) + 1))
        self.local, self.tf, self.pieces = local, tf, len(n)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every piece for all terms of the seed, their frequency in it as the query's weight."""
        own = slice(self.query_at[seed], self.query_at[seed + 1])
        terms, tf = self.local[own], self.tf[own]
        length = self.heads[terms + 1] - self.heads[terms]
        at = ranges(self.heads[terms], length)
        return np.bincount(self.piece[at], self.weight[at] * np.repeat(tf, length), minlength=self.pieces)


def pack_shard(index: Index, lengths: np.ndarray, window: int, look: int = 16) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start in it, length); every id in exactly one.

    Each seed takes its best neighbours that fit, passing over at most ``look`` that don't before the best of these is cut.
    """
    start, left = np.zeros(len(lengths), np.int64), lengths.astype(np.int64).copy()
    unused = left > 0
    out: list[list[tuple[int, int, int]]] = []
    order = np.lexsort((np.arange(len(lengths)), -lengths))

    def take(piece: int, n: int, to: list) -> None:
        to.append((piece, int(start[piece]), n))
        start[piece] += n
        left[piece] -= n
        unused[piece] = left[piece] > 0

    for seed in order:
        while unused[seed]:
            room, found = window, []
            n = min(room, int(left[seed]))
            take(seed, n, found)
            room -= n
            if room:
                score = index.scores(seed)
                near = np.flatnonzero(unused)
                near = near[np.argsort(-score[near], kind="stable")]
                passed: list[int] = []
                for k in near.tolist():
                    if left[k] <= room:
                        room -= int(left[k])
                        take(k, int(left[k]), found)
                        if not room:
                            break
                    else:
                        passed.append(k)
                        if len(passed) >= look:
                            break
                if room and passed:
                    take(passed[0], room, found)
                    room = 0
            if not room:
                out.append(found)
                continue
            total = window - room
            while total:  # all pieces are used: what is left goes to sequences of powers of two
                size, part = 1 << (total.bit_length() - 1), []
                total -= size
                while size:
                    piece, at, n = found.pop(0)
                    part.append((piece, at, min(n, size)))
                    if n > size:
                        found.insert(0, (piece, at + size, n - size))
                    size -= min(n, size)
                out.append(part)
    return out


def _packer(window: int, dtype: str, idf: np.ndarray, mean_length: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("part", "ascending"), ("at", "ascending")])
        column = lambda name: table.column(name).combine_chunks()
        ids, bounds = ids_of(column("ids"), dtype)
        shard = int(table.column("shard")[0].as_py())
        sequences = pack_shard(Index(ids, bounds, idf, mean_length), np.diff(bounds), window)
        piece = np.array([p for s in sequences for p, _, _ in s], np.int64)
        at = np.array([a for s in sequences for _, a, _ in s], np.int64)
        n = np.array([m for s in sequences for _, _, m in s], np.int64)
        number = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
        first = np.concatenate([np.cumsum([0, *(m for _, _, m in s)])[:-1] for s in sequences])
        wide = ids.astype("<u4")
        sums = [zlib.crc32(wide[a : a + m].tobytes()) for a, m in zip((bounds[piece] + at).tolist(), n.tolist(), strict=True)]
        return pa.Table.from_arrays(
            [column("doc_id").take(pa.array(piece)), pa.array(np.asarray(column("start"))[piece] + at), pa.array(n), pa.array(sums, pa.int64()), column("doc_tokens").take(pa.array(piece)), pa.array(2 * (np.int64(shard) << 24 | number)), pa.array(first)],
            NAMES,
        )

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024, shard_pieces: int = 1024, encode_special_tokens: bool = False) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text), as PIECES; see the module.

    Null text: empty, which is the end id alone. Repeated rows are packed each; null doc_ids stay null; an empty
    table gives no piece; other columns are not read. The vocabulary must be below 65,536 ids.
    """
    dtype = "<u2"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    split = written(rows.mapInArrow(_splitter(tokenizer, end_id, window, encode_special_tokens), SPLIT), "pieces")
    counts = {r.id: r.n for r in split.filter("counts is not null").select("counts").mapInArrow(_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}  # one for each id of the vocabulary
    pieces, size = counts.pop(-2, 0), counts.pop(-1, 0)
    df = np.zeros(1 << 16)
    df[list(counts)] = list(counts.values())
    idf = np.log1p((pieces - df + 0.5) / (df + 0.5))
    rests = split.filter("ids is not null")
    terms = written(rests.select("part", "at", "ids").mapInArrow(_terms_of(idf, df), "part int, at long, term int"), "piece-terms")
    owned = {r.term: r.n for r in terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each id of the vocabulary at most
    first, number = shard_ranges(owned, shard_pieces)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "ids"):
            term = own_terms(*ids_of(batch.column("ids"), dtype), idf, df)
            place = mixed(np.asarray(batch.column("at")).astype(np.uint64) ^ np.asarray(batch.column("part")).astype(np.uint64) << np.uint64(40))
            shard = first[term] + (place % number[term].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])

    piece = rests.select("part", "at", "doc_id", "start", "doc_tokens", "ids").mapInArrow(dealt, "part int, at long, doc_id long, start long, doc_tokens long, ids binary, shard long")
    packed = piece.groupBy("shard").applyInArrow(_packer(window, dtype, idf, size / max(pieces, 1)), PIECES)
    place = (F.col("part").cast("long") * F.lit(1 << 40) + F.col("at")) * 2 + 1
    whole = split.filter("ids is null and counts is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", place.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(packed)
