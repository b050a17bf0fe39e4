"""Removing long repeated byte strings, found exactly by sharded suffix arrays.

Every window of the least length asked for has one anchor: the leftmost of its GRAM-byte strings with the least hash. Equal
windows have equal anchors, so only windows whose anchor's hash occurs more than once can repeat, and all windows of one hash
can be compared in one shard; a longer string that repeats begins with such a window. A segment is a run of windows of one anchor hash
with the bytes that the longest strings from these places on span; in periodic text
one segment goes on however often the anchor comes again, up to ``MOST_STARTS`` windows. Equal segments are counted first, by the
hash of their bytes, so of thousands of copies one segment goes on, and an anchor with but one distinct segment is done.

A shard's other segments get a suffix array by Larsson-Sadakane refinement, and neighbours' common prefixes by Kasai's bound, in
numpy. Anchors with more than ``hot`` distinct segments are dealt over sub-shards by the segments' hashes. Each sub-shard sends the
digests of its distinct windows, as one sorted run for each cell of digests, to merging tasks; there the sorted runs of all sub-shards are
merged two by two by binary search, which marks the windows that several sub-shards hold.

Hashes of segments have 64 bits beside the anchor's 64, digests of windows 128: equality is by these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import mixed, names, parts, text_or_empty, written
from rankloom.llm.tokens import binary_rows, ids_of
from rankloom.llm.wordids import ranges, small_batches

GRAM = 64
#: Windows of a segment at most; a longer run of one anchor hash (periodic text) is cut.
MOST_STARTS = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of data[i : i + size] for each i, ``size`` a power of two."""
    h = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)[data]
    step, power = 1, int(BASE)
    while step < size:
        h = h[:-step] * np.uint64(power) + h[step:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        step *= 2
    return mixed(h)


def anchors(h: np.ndarray, bounds: np.ndarray, length: int, size: int, block: int = 1 << 21) -> tuple[np.ndarray, ...]:
    """Anchor hash, row, first and last window start (within the row), and whether it has several anchors, of each run of windows of one anchor hash.

    ``h`` has the gram hash of each place of a text of ``size`` bytes whose row i is bounds[i] .. bounds[i + 1]; windows don't leave their row.
    The text is gone through in blocks.
    """
    width, found = length - GRAM + 1, []
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    for first in range(0, size, block):
        part = h[first : first + block + width - 1]
        starts = min(block, size - first - length + 1)
        if starts <= 0:
            break
        mark = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        whole = np.full(-(-len(part) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        whole[: len(part)] = mark
        table = whole.reshape(-1, width)
        before = np.minimum.accumulate(table, 1).reshape(-1)
        after = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].reshape(-1)
        least = np.minimum(after[:starts], before[width - 1 : width - 1 + starts])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        anchor = part[place]
        at = np.arange(first, first + starts)
        ends = row_end[first : first + starts]
        good = at + length <= ends
        fresh = np.append(True, (anchor[1:] != anchor[:-1]) | ~good[:-1] | (ends[1:] != ends[:-1]))
        heads = np.flatnonzero(good & fresh)
        if not len(heads):
            continue
        tails = np.flatnonzero(good & np.append(fresh[1:] | ~good[1:], True))
        # runs longer than MOST_STARTS are cut
        cuts = (tails - heads) // MOST_STARTS + 1
        which = np.repeat(np.arange(len(heads)), cuts)
        start = heads[which] + (np.arange(len(which)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * MOST_STARTS
        stop = np.minimum(start + MOST_STARTS - 1, tails[which])
        row = np.searchsorted(bounds, at[start], "right") - 1
        found.append((anchor[start], row, at[start] - bounds[row], at[stop] - bounds[row], place[stop] != place[start]))
    if not found:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3, np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; zeros follow the end."""
    wide = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    pair = wide[:-1] << np.uint64(8) | wide[1:]
    four = pair[:-2] << np.uint64(16) | pair[2:]
    return (four[:-4] << np.uint64(32) | four[4:])[: len(data)]


def suffix_array(words: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by what follows up to their segment's ``end``, by ``depth`` bytes at least, refining only groups still equal."""
    n = len(words)
    left = end - np.arange(n)
    short = left < 8
    key = words.copy()
    key[short] &= ~((np.uint64(1) << ((8 - left[short]) * 8).astype(np.uint64)) - np.uint64(1))
    if (words >> np.uint64(56) == 0).any():  # a zero byte is not the end, which comes first
        least = np.minimum(left, 8)
        order = np.lexsort((least, key))
        heads = np.append(True, (key[order[1:]] != key[order[:-1]]) | (least[order[1:]] != least[order[:-1]]))
    else:
        order = np.argsort(key, kind="stable")
        heads = np.append(True, key[order[1:]] != key[order[:-1]])
    slot = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank = np.empty(n + 1, np.int32)
    rank[order], rank[n] = slot + 1, 0
    # of a group still equal all have passed their ends, or none has: then they are equal in full
    going = ~(heads & np.append(heads[1:], True)) & (left[order] >= 8)
    slots, place, group = np.flatnonzero(going), order[going].astype(np.int32), slot[going]
    left = left.astype(np.int32)
    rest = left[place]
    h = 8
    while len(place) and h < depth:
        key = group << 32 | rank[np.where(rest > h, place + h, n)]
        by = np.argsort(key, kind="stable")
        key, place, rest = key[by], place[by], rest[by]
        heads = np.append(True, key[1:] != key[:-1])
        group = slots[np.maximum.accumulate(np.where(heads, np.arange(len(key)), 0))]
        rank[place] = group + 1
        order[slots] = place
        h *= 2
        going = ~(heads & np.append(heads[1:], True)) & (rest >= h)
        slots, place, group, rest = slots[going], place[going], group[going], rest[going]
    return order


def common_prefixes(words: np.ndarray, end: np.ndarray, order: np.ndarray, most: int, stride: int = 64) -> np.ndarray:
    """Of each place of ``order`` with the one before it: bytes in common, ``most`` at most, 0 for the first.

    By Kasai's bound: going on by one place loses one byte of the common prefix at most. It holds for the full order alone, of
    places that are equal up to their ends by place. Every ``stride``-th place begins
    anew, and all of these go forward together.
    """
    n = len(words)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    found = np.zeros(n, np.int64)
    held = np.zeros(-(-n // stride), np.int64)
    for step in range(stride):
        i = np.arange(step, n, stride)
        j = before[i]
        have = np.where(j >= 0, np.maximum(held[: len(i)] - 1, 0), 0)
        limit = np.where(j >= 0, np.minimum(np.minimum(end[i] - i, end[j] - j), most), 0)
        going = np.flatnonzero(have < limit)
        while len(going):
            a, b, c = i[going], j[going], have[going]
            differ = words[np.minimum(a + c, n - 1)] ^ words[np.minimum(b + c, n - 1)]
            same = differ == 0
            zero_bytes = np.where(same, 8, 0)
            odd = np.flatnonzero(~same)
            zero_bytes[odd] = 7 - (np.frexp(differ[odd].astype(np.float64))[1] - 1) // 8
            # a float rounds up to the next power of two at times: then one byte too few counts, and the next round finds it
            have[going] = np.minimum(c + zero_bytes, limit[going])
            going = going[(have[going] < limit[going]) & (same | (words[np.minimum(a + have[going], n - 1)] >> np.uint64(56) == words[np.minimum(b + have[going], n - 1)] >> np.uint64(56)))]
        have = np.minimum(have, limit)
        found[i] = have
        held[: len(i)] = have
    return found[order]


def repeated(data: np.ndarray, bounds: np.ndarray, lengths: tuple[int, ...], starts: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For segments data[bounds[i] : bounds[i + 1]], of which the first starts[i] places count (all, if None), and each length: places
    whose ``length`` bytes occur at another place too, and a group number of each place (-1: too short, or not counted)."""
    size = np.diff(bounds)
    end = np.repeat(bounds[1:], size)
    words = eight(data)
    order = suffix_array(words, end, int(size.max(initial=0)))  # in full, which common_prefixes needs
    common = common_prefixes(words, end, order, max(lengths))
    at = np.arange(len(data))
    counts = np.ones(len(data), bool) if starts is None else at - np.repeat(bounds[:-1], size) < np.repeat(starts, size)
    found = []
    for length in lengths:
        some = np.flatnonzero((counts & (end - at >= length))[order])
        group, twice = np.full(len(data), -1, np.int64), np.zeros(len(data), bool)
        if len(some):
            # with the one before it among these: the least of all common prefixes between
            cuts = np.append(some[:1], some[:-1] + 1)
            same = np.minimum.reduceat(common[: some[-1] + 1], cuts) >= length
            same[0] = False
            place = order[some]
            group[place] = np.cumsum(~same)
            twice[place] = same | np.append(same[1:], False)
        found.append((twice, group))
    return found


ROWS = "doc_id long, text_hash long"
SEGMENTS = f"{ROWS}, hash long, own long, first long, last long, size long, again boolean"


def _find_segments(least: int, most: int):
    """For each text the segments: anchor hash, hash of their bytes, first and last window, bytes, whether it holds its anchor's hash twice."""
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2_000_000):
            data, bounds = ids_of(batch.column("text").cast(pa.large_binary()), np.uint8)
            anchor, row, first, last, again = anchors(gram_hashes(data), bounds, least, len(data))
            at, to = bounds[row] + first, np.minimum(bounds[row] + last + most, bounds[row + 1])
            raw = memoryview(data)
            own = np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(at.tolist(), to.tolist(), strict=True)), np.uint64, len(at))
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("text_hash").take(of), *map(pa.array, (anchor.view(np.int64), own.view(np.int64), first, last, to - at, again))], names(SEGMENTS))

    return run


CUT = "shard long, hash long, own long, many boolean, hot boolean, starts long, bytes binary"


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 1_000_000):
        marks = batch.column("marks")
        n = np.asarray(pc.list_value_length(marks))
        flat = marks.flatten()
        shard, hash_, own, first, last, size, n_same, hot = (np.asarray(flat.field(i)) for i in range(8))
        data, bounds = ids_of(batch.column("text").cast(pa.large_binary()), np.uint8)
        row = np.repeat(np.arange(len(n)), n)
        segments = binary_rows(data[ranges(bounds[row] + first, size)], np.append(0, np.cumsum(size)))
        yield pa.RecordBatch.from_arrays([*map(pa.array, (shard, hash_, own, n_same > 1, hot, last - first + 1)), segments], names(CUT))


#: Without ``runs``: windows lo .. hi of a segment that repeat. With it: a sub-shard's digests of distinct windows in a cell, with each its segment and place.
FOUND = "kind int, hash long, own long, lo long, hi long, cell int, sub long, runs binary"
RUN = np.dtype([("high", "<u8"), ("low", "<u8"), ("hash", "<i8"), ("own", "<i8"), ("lo", "<i8")])


def _search_shards(lengths: tuple[int, ...], cells: int = 1, most_bytes: int = 1 << 20):
    """FOUND of segments sorted by shard. Segments that occur more than once are known to repeat, and only tell others."""
    from xxhash import xxh3_128_intdigest

    def search(table: pa.Table) -> pa.RecordBatch:
        column = lambda name: np.asarray(table.column(name).combine_chunks())
        hash_, own, many, hot, shard, starts = map(column, ("hash", "own", "many", "hot", "shard", "starts"))
        data, bounds = ids_of(table.column("bytes").combine_chunks(), np.uint8)
        segment = np.repeat(np.arange(len(hash_)), np.diff(bounds))
        place = np.arange(len(data)) - bounds[segment]
        raw, plain, runs = memoryview(data), [], []
        for kind, (twice, group) in enumerate(repeated(data, bounds, lengths, starts)):
            at = np.flatnonzero(twice & ~many[segment])
            heads = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (segment[at[1:]] != segment[at[:-1]]))) if len(at) else at
            tails = np.append(heads[1:] - 1, len(at) - 1)[: len(heads)]
            of = segment[at[heads]]
            plain.append((np.full(len(heads), kind, np.int32), hash_[of], own[of], place[at[heads]], place[at[tails]]))
            # one digest for each distinct window of hot anchors; a window that is known to repeat needs no place
            windows = np.flatnonzero((group >= 0) & hot[segment])
            _, first = np.unique(group[windows], return_index=True)
            windows = windows[first]
            if not len(windows):
                continue
            digests = [xxh3_128_intdigest(raw[w : w + lengths[kind]], kind) for w in windows.tolist()]
            found = np.empty(len(windows), RUN)
            found["high"], found["low"] = [d >> 64 for d in digests], [d & 0xFFFFFFFFFFFFFFFF for d in digests]
            found["hash"], found["own"] = hash_[segment[windows]], own[segment[windows]]
            found["lo"] = np.where(twice[windows] | many[segment[windows]], -1, place[windows])
            key = shard[segment[windows]], (found["low"] % np.uint64(cells)).astype(np.int64)
            by = np.lexsort((found["high"], *key[::-1]))
            found, sub, cell = found[by], key[0][by], key[1][by]
            cuts = np.append(np.flatnonzero(np.append(True, (sub[1:] != sub[:-1]) | (cell[1:] != cell[:-1]))), len(by))
            runs += [(kind, int(cell[a]), int(sub[a]), found[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        columns = [np.concatenate(x) for x in zip(*plain, strict=True)]
        none, more = len(columns[0]), len(runs)
        whole = [pa.concat_arrays([pa.array(x), pa.nulls(more, pa.array(x).type)]) for x in columns[1:]]
        kinds = pa.array(np.append(columns[0], np.array([r[0] for r in runs], np.int32)).astype(np.int32))
        tail = [pa.concat_arrays([pa.nulls(none, t), pa.array([r[i] for r in runs], t)]) for i, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.binary()))]
        return pa.RecordBatch.from_arrays([kinds, *whole, *tail], names(FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in small_batches(batches, "bytes", most_bytes // 2):
            held.append(batch)
            size += batch.nbytes
            if size < most_bytes:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            shard = np.asarray(table.column("shard").combine_chunks())
            cut = int(np.searchsorted(shard, shard[-1], "left"))  # the last shard may go on
            if cut:
                yield search(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
        if held:
            yield search(pa.Table.from_batches(held).combine_chunks())

    return run


def inside(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which digests of ``one`` the run ``other``, sorted by ``high``, holds: each is looked up by binary search."""
    left, right = (np.searchsorted(other["high"], one["high"], side) for side in ("left", "right"))
    found = np.zeros(len(one), bool)
    for k in range(int((right - left).max(initial=0))):  # one step but for digests that agree in 64 bits
        some = np.flatnonzero(left + k < right)
        found[some] |= other["low"][left[some] + k] == one["low"][some]
    return found


def merged_runs(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The runs as one, sorted by ``high``, and which of its digests two runs or more hold. Runs are merged two by two."""
    level = [(r, np.zeros(len(r), bool)) for r in runs]
    while len(level) > 1:
        pairs = zip(level[::2], level[1::2], strict=False)
        nearer = []
        for (a, in_a), (b, in_b) in pairs:
            rows, shared = np.concatenate([a, b]), np.concatenate([in_a | inside(a, b), in_b | inside(b, a)])
            by = np.argsort(rows["high"], kind="stable")
            nearer.append((rows[by], shared[by]))
        level = nearer + level[len(level) - len(level) % 2 :]
    return level[0]


def _merge_sub_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that several sub-shards hold, of runs sorted by kind and cell."""

    def shared(kind: int, runs: list[bytes]) -> pa.RecordBatch:
        rows, twice = merged_runs([np.frombuffer(r, RUN) for r in runs])
        rows = rows[twice & (rows["lo"] >= 0)]
        lo = pa.array(np.ascontiguousarray(rows["lo"]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), *(pa.array(np.ascontiguousarray(rows[c])) for c in ("hash", "own")), lo, lo], ["kind", "hash", "own", "lo", "hi"])

    key, held = None, []
    for batch in batches:
        for kind, cell, run in zip(*(batch.column(c).to_pylist() for c in ("kind", "cell", "runs")), strict=True):
            if (kind, cell) != key and held:
                yield shared(key[0], held)
                held = []
            key = (kind, cell)
            held.append(run)
    if held:
        yield shared(key[0], held)


def repeat_spans(rows: DataFrame, lengths: tuple[int, ...], hot: int = 512, sub_shard: int = 512, cell_windows: int = 1 << 16) -> DataFrame:
    """Written table (doc_id, text_hash, spans: array of (kind, first, last)) of ``rows`` (doc_id, text_hash, text as bytes) that have any.

    A span says that the windows of lengths[kind] bytes from ``first`` to ``last`` each start anywhere else too. Spans may overlap.
    """
    spark = rows.sparkSession
    least, most = min(lengths), max(lengths)
    runs = written(rows.mapInArrow(_find_segments(least, most), SEGMENTS), "segments")
    counts = written(runs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).filter("n > 1 or again").select("hash"), "anchors")
    live = written(runs.join(counts, "hash", "left_semi"), "live-segments")
    one = [F.first(c).alias(c) for c in ("doc_id", "text_hash", "first", "last", "size")]  # of one and the same row
    distinct = written(live.groupBy("hash", "own").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"), *one), "distinct-segments")
    mixed_anchors = written(distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("d"), F.max("again").alias("again")).filter("d > 1 or again").drop("again"), "mixed-anchors")
    many = mixed_anchors.filter(F.col("d") > hot).agg(F.sum("d")).first()[0] or 0
    shards = -(-many // sub_shard) or 1
    is_hot = F.col("d") > hot
    # sub-shards of hot anchors have numbers that no anchor's hash equals but by chance, which harms nothing
    shard = F.when(is_hot, F.pmod(F.col("own"), F.lit(shards))).otherwise(F.col("hash"))
    marks = distinct.join(mixed_anchors, "hash").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(shard.alias("shard"), "hash", "own", "first", "last", "size", "n", is_hot.alias("hot"))).alias("marks"))
    marks = written(marks, "marks").withColumnsRenamed({"doc_id": "of", "text_hash": "of_hash"})
    texts = rows.join(marks, rows.doc_id.eqNullSafe(marks["of"]) & (rows.text_hash == marks.of_hash)).select("doc_id", "text_hash", "text", "marks")
    # a row that repeats gives its segments again, which occur more than once anyhow
    dealt = texts.mapInArrow(_cut_segments, CUT).repartition(parts(spark), "shard").sortWithinPartitions("shard")
    cells = max(1, many * (most - GRAM) // cell_windows)  # a segment has some half of most - GRAM windows of each of two lengths
    seen = written(dealt.mapInArrow(_search_shards(lengths, cells), FOUND), "repeats")
    found = seen.filter("runs is null").select("kind", "hash", "own", "lo", "hi")
    if many:
        runs_of = seen.filter("runs is not null").select("kind", "cell", "sub", "runs").repartition(max(parts(spark), min(cells, 10_000)), "kind", "cell").sortWithinPartitions("kind", "cell", "sub")
        found = found.unionByName(runs_of.mapInArrow(_merge_sub_shards, "kind int, hash long, own long, lo long, hi long"))
    whole = distinct.filter("n > 1").select(F.explode(F.array(*map(F.lit, range(len(lengths))))).alias("kind"), "hash", "own", F.lit(0).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    found = written(found.unionByName(whole), "repeated-windows")
    ends = F.least("last", F.col("first") + F.col("size") - F.element_at(F.array(*map(F.lit, lengths)), F.col("kind") + 1))  # the last window of this length
    placed = live.join(found, ["hash", "own"]).select("doc_id", "text_hash", "kind", (F.col("first") + F.col("lo")).alias("begin"), F.coalesce(F.col("first") + F.col("hi"), ends).alias("last")).filter("begin <= last")
    return written(placed.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("kind", F.col("begin").alias("first"), "last")).alias("spans")), "spans")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, kept binary"


def covered(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes of windows first .. last, as (start, stop)."""
    out: list[list[int]] = []
    for a, b in sorted(zip(first, last, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def _remove(lengths: tuple[int, ...], passage_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4_000_000):
            found = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                runs = [covered([x["first"] for x in own], [x["last"] for x in own], n) for n, own in ((n, [x for x in spans or () if x["kind"] == k]) for k, n in enumerate(lengths))]
                kept, at = [], 0
                for a, b in runs[0]:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                rest = b"".join(kept) if runs[0] else text
                passages = sum(len(text[a:b].split()) > passage_words for a, b in runs[-1])
                found.append((len(text), len(text) - len(rest), len(runs[0]), hashlib.sha256(rest).hexdigest(), passages, rest))
            columns = list(zip(*found, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names(RESULT))

    return run


def remove_repeats(docs: DataFrame, length: int = 400, passage: int = 250, passage_words: int = 50, hot: int = 512, sub_shard: int = 512) -> DataFrame:
    """RESULT for each row of ``docs`` (doc_id, text): the bytes covered by a ``length``-byte string that starts anywhere else too are removed.

    Texts are UTF-8 bytes, null is empty; matches stay within a text; what repeats is judged on the input. Repeated rows
    are copies of each other, so of ``length`` bytes or more nothing is left. Null doc_ids are kept. ``kept`` holds the
    remaining bytes (which can cut a character); n_spans counts maximal removed runs. ``n_passages`` counts the maximal runs of
    bytes, each covered by a ``passage``-byte string that starts elsewhere too, that have more than ``passage_words`` words: nothing of them is
    removed that ``length`` doesn't cover. Empty table: no rows. Both lengths must be over 64.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_or_empty(), "UTF-8").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    lengths = (length, passage)
    spans = repeat_spans(rows, lengths, hot, sub_shard).withColumnsRenamed({"doc_id": "of", "text_hash": "of_hash"})
    # a plain join, which can be split where rows repeat
    placed = rows.join(spans, rows.doc_id.eqNullSafe(spans["of"]) & (rows.text_hash == spans.of_hash), "left")
    return placed.select("doc_id", "text", "spans").mapInArrow(_remove(lengths, passage_words), RESULT)
