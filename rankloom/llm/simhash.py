"""SimHash near-duplicates: fingerprints of word shingles, and links within a Hamming radius by self-joining binary tries.

Fingerprints that differ in ``radius`` bits or fewer agree in one of radius + 1 blocks of bits at least. Each distinct
fingerprint goes to the bucket of each of its blocks' values; a bucket's sorted fingerprints are a binary trie whose nodes
are ranges. Pairs of nodes go down together bit by bit, adding up the bits in which they differ, and are dropped beyond
the radius. A bucket of more than ``trie_rows`` fingerprints is cut into ranges (sets of its trie's nodes) of about this many;
its pairs of ranges whose common prefixes are within the radius become tasks of their own, none left out.
A task emits a spanning forest of its links, not the links; components of all tasks' forests are those of all links.

Removing near copies (``one_of_each``) is about similarities outside such a radius (at 0.8 some 10 bits differ, seldom over 20), which blocks of one
fingerprint can't tell from chance. So each document has several fingerprints, by other factors of the same hashes; a bucket is a 16-bit block of
any, its members' tries are joined at a wide radius, and every candidate is compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import names, parts, text_or_empty, written
from rankloom.llm.components import components
from rankloom.llm.wordids import give_back, ranges, small_batches

SEED = 42


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words, repeats included; of the whole sequence if it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, split at 0x20 and 0x09-0x0D
    if len(found) <= words:
        return [xxh64_intdigest(b" ".join(found), SEED)] if found else []
    joined = b" ".join(found)
    end = np.cumsum([len(w) + 1 for w in found])
    first = (end - np.fromiter(map(len, found), np.int64, len(found)) - 1).tolist()
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, (end[words - 1 :] - 1).tolist(), strict=False)]


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row, the bits set in over half of hashes[bounds[i] : bounds[i + 1]]; 0 for none."""
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if len(some):
        heads = bounds[:-1][some]
        for bit in range(64):
            ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), heads)
            out[some] |= (2 * ones > n[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): 64-bit fingerprint of each row's whole text as a signed long. Null or empty text: 0. Repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2_000_000):
            found = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
            bounds = np.append(0, np.cumsum([len(x) for x in found]))
            hashes = np.fromiter((h for x in found for h in x), np.uint64, int(bounds[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(majority(hashes, bounds).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(values: np.ndarray, lo1, hi1, lo2, hi2, radius: int, leaf: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j or in different ranges of ``values`` (sorted within each range) that differ in ``radius`` bits or fewer.

    The first ranges are pairs of trie roots; a root paired with itself is self-joined. Pairs of nodes with
    ``leaf`` pairs of rows or fewer are compared outright.
    """
    lo1, hi1, lo2, hi2 = (np.asarray(x, np.int64) for x in (lo1, hi1, lo2, hi2))
    diff = np.zeros(len(lo1), np.int64)
    left, right = [], []

    def compare(a1, b1, a2, b2) -> None:
        n2 = b2 - a2
        i = np.repeat(ranges(a1, b1 - a1), np.repeat(n2, b1 - a1))
        j = ranges(np.repeat(a2, b1 - a1), np.repeat(n2, b1 - a1))
        same = np.repeat(np.repeat(a1 == a2, b1 - a1), np.repeat(n2, b1 - a1))
        near = (np.bitwise_count(values[i] ^ values[j]) <= radius) & (~same | (i < j))
        left.append(i[near])
        right.append(j[near])

    for bit in range(63, -1, -1):
        small = (hi1 - lo1) * (hi2 - lo2) <= leaf
        if small.any():
            compare(lo1[small], hi1[small], lo2[small], hi2[small])
            lo1, hi1, lo2, hi2, diff = (x[~small] for x in (lo1, hi1, lo2, hi2, diff))
        if not len(lo1):
            break
        ones = np.append(0, np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64))
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        other = (lo1 != lo2) | (hi1 != hi2)
        parts_ = [(lo1, mid1, lo2, mid2, diff), (mid1, hi1, mid2, hi2, diff), (lo1, mid1, mid2, hi2, diff + 1), tuple(x[other] for x in (mid1, hi1, lo2, mid2, diff + 1))]
        lo1, hi1, lo2, hi2, diff = (np.concatenate(x) for x in zip(*parts_, strict=True))
        keep = (lo1 < hi1) & (lo2 < hi2) & (diff <= radius)
        lo1, hi1, lo2, hi2, diff = (x[keep] for x in (lo1, hi1, lo2, hi2, diff))
    if len(lo1):
        compare(lo1, hi1, lo2, hi2)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places, the least place in its component of the links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def _join_tasks(radius: int, most_rows: int = 1 << 15):
    def links(task: np.ndarray, side: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        heads = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
        ends = np.append(heads[1:], len(task))
        sides = np.append(0, np.cumsum(side))
        mid = ends - (sides[ends] - sides[heads])
        one = mid == ends
        i, j = trie_pairs(values, heads, mid, np.where(one, heads, mid), ends, radius)
        label = forest(len(values), i, j)
        own = np.flatnonzero(label != np.arange(len(label)))
        a, b = values[own].view(np.int64), values[label[own]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([np.asarray(batch.column(i)) for i in range(3)])
            if sum(len(x[0]) for x in held) < most_rows:
                continue
            task, side, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(task, task[-1], "left"))  # the last task may go on
            if cut:
                yield links(task[:cut], side[:cut], fp[:cut].view(np.uint64))
            held = [[task[cut:], side[cut:], fp[cut:]]]
        if held and len(held[0][0]):
            task, side, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            yield links(task, side, fp.view(np.uint64))

    return run


def _near_ranges(radius: int):
    """Keeps pairs of ranges whose common prefixes differ in ``radius`` bits or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def prefix(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            mask = lo ^ hi
            for shift in (1, 2, 4, 8, 16, 32):
                mask |= mask >> np.uint64(shift)
            return mask

        for batch in batches:
            lo1, hi1, lo2, hi2 = (np.asarray(batch.column(x)).view(np.uint64) for x in ("lo1", "hi1", "lo2", "hi2"))
            free = prefix(lo1, hi1) | prefix(lo2, hi2)
            yield batch.filter(pa.array(np.bitwise_count((lo1 ^ lo2) & ~free) <= radius))

    return run


def links(nodes: DataFrame, radius: int = 3, trie_rows: int = 1024) -> DataFrame:
    """(a, b): edges between distinct fingerprints of ``nodes`` (fp), whose components are those of all pairs within ``radius`` bits."""
    count = radius + 1
    width = 64 // count
    blocks = [(k * width, width if k < count - 1 else 64 - k * width) for k in range(count)]
    value = lambda at, bits: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1))
    rows = nodes.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(k), value(*b)) for k, b in enumerate(blocks)])).alias("bucket"))
    large = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > trie_rows), "large-buckets")
    most = large.agg(F.max("n")).first()[0] or 0
    cold = rows.join(large, "bucket", "left_anti") if most else rows
    tasks = cold.select(F.col("bucket").alias("task"), F.lit(0).alias("side"), "fp")
    if most:
        hot = rows.join(large, "bucket", "left_semi")
        hot = hot.withColumn("key", F.col("fp").bitwiseXOR(F.lit(-(1 << 63))))  # signed order is then that of the bits
        cuts = -(-most // trie_rows)
        marks = hot.groupBy("bucket").agg(F.percentile_approx("key", [i / cuts for i in range(1, cuts)], 20 * cuts).alias("marks"))
        cut = hot.join(marks, "bucket").select("bucket", "fp", "key", F.aggregate("marks", F.lit(0), lambda s, m: s + (m < F.col("key")).cast("int")).alias("range"))
        cut = written(cut, "hot-buckets")
        spans = cut.groupBy("bucket", "range").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        back = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
        one, two = (spans.select("bucket", F.col("range").alias(f"range{k}"), back("lo").alias(f"lo{k}"), back("hi").alias(f"hi{k}")) for k in (1, 2))
        pairs = one.join(two, "bucket").filter("range1 <= range2")
        pairs = pairs.mapInArrow(_near_ranges(radius), pairs.schema).select("bucket", "range1", "range2")
        task = F.xxhash64("bucket", "range1", "range2").alias("task")
        sides = pairs.select("bucket", F.col("range1").alias("range"), task, F.lit(0).alias("side")).unionByName(pairs.filter("range1 < range2").select("bucket", F.col("range2").alias("range"), task, F.lit(1).alias("side")))
        tasks = tasks.unionByName(cut.join(sides, ["bucket", "range"]).select("task", "side", "fp"))
    # unsigned order within a task's side: the trie's order
    dealt = tasks.repartition(parts(nodes.sparkSession), "task").sortWithinPartitions("task", "side", F.col("fp").bitwiseXOR(F.lit(-(1 << 63))))
    return dealt.mapInArrow(_join_tasks(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, trie_rows: int = 1024) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text): the smallest doc_id reachable by links.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows and ties share a fingerprint,
    so a component. Null doc_ids are never the smallest; a component without another has a null id. Empty table: no rows.
    """
    prints = written(fingerprints(docs, words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    labels = components(links(nodes.select("fp"), radius, trie_rows))
    of = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    of = written(of, "labelled")
    lowest = of.groupBy("label").agg(F.min("low").alias("component_id"))
    return prints.join(of.join(lowest, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Per byte, its bits in eight lanes of a byte each: so many sums at once, of up to 255 bytes.
LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def wide_fingerprints(hashes: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """For each row ``count`` independent SimHash fingerprints of the set hashes[bounds[i] : bounds[i + 1]]; 0 for none.

    A bit is 1 if set in over half the set's hashes, each multiplied by the fingerprint's own factor; in exactly half: the first hash's bit.
    """
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    out = np.zeros((len(n), count), np.uint64)
    if not len(some):
        return out
    first, n = bounds[:-1][some], n[some]
    cuts = -(-n // 255)
    heads = np.repeat(first, cuts) + 255 * (np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    rows = np.cumsum(cuts) - cuts
    weights = np.uint8(1) << np.arange(8, dtype=np.uint8)
    for k, factor in enumerate(factors):
        value = hashes * factor
        value ^= value >> np.uint64(32)
        digits = value.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        tops = digits[first]
        for j in range(8):
            sums = np.add.reduceat(LANES[digits[:, j]], heads).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
            ones = 2 * np.add.reduceat(sums, rows, axis=0, dtype=np.int64)
            ties = (tops[:, j, None] >> np.arange(8, dtype=np.uint8)) & 1
            bits = (ones > n[:, None]) | ((ones == n[:, None]) & (ties == 1))
            out[some, k] |= (bits * weights).sum(axis=1).astype(np.uint64) << np.uint64(8 * j)
    return out


def _sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's runs of ``words`` words one text after the other, ascending, and their bounds."""
    found = [np.unique(np.array(shingle_hashes(t, words), np.uint64)) for t in texts]
    return np.concatenate(found) if found else np.empty(0, np.uint64), np.append(0, np.cumsum([len(x) for x in found]))


def _signatures(words: int, count: int):
    """Of each text: a digest of its set of runs, and the set's ``count`` fingerprints; none without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2_000_000):
            flat, bounds = _sets(batch.column("text").to_pylist(), words)
            packed = memoryview(flat).cast("B")
            digests = [hashlib.blake2b(packed[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            some = np.flatnonzero(np.diff(bounds))
            prints = wide_fingerprints(flat, bounds, count)[some]
            cuts = np.append(0, np.cumsum(np.where(np.diff(bounds) > 0, count, 0))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(prints.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), lists], ["doc_id", "digest", "prints"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each 16-bit block of a document's fingerprints, with the first two of these."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            prints = np.asarray(part.column("prints").flatten()).view(np.uint64).reshape(part.num_rows, -1)
            blocks = np.stack([(prints >> np.uint64(k)) & np.uint64(0xFFFF) for k in (0, 16, 32, 48)], axis=2).reshape(part.num_rows, -1)
            bucket = (blocks | np.arange(blocks.shape[1], dtype=np.uint64) << np.uint64(16)).astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), bucket.shape[1])
            one, two = (pa.array(prints[row, k].view(np.int64)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.reshape(-1)), part.column("doc_id").take(pa.array(row)), one, two, part.column("stays").take(pa.array(row))], names(MEMBERS))


MEMBERS = "bucket long, doc_id long, one long, two long, stays boolean"


def near_chunks(bucket: np.ndarray, doc: np.ndarray, one: np.ndarray, two: np.ndarray, place: np.ndarray, radius: int, both: int, hot: int, most_work: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``near_members`` by and by: rows (later, first), sorted, from about ``most_work`` pairs of members at a time (``hot`` squared at least).

    All firsts of a later row come together, so however large a bucket is, what is not wanted of them need not be held.
    """
    size = np.bincount(np.cumsum(place == 0) - 1) if len(bucket) else np.empty(0, np.int64)
    of = np.repeat(np.arange(len(size)), size)
    row = np.flatnonzero(size[of] > 1)
    row = row[np.lexsort((one[row], place[row] // hot, of[row]))]
    if not len(row):
        return
    chunk, of, values = place[row] // hot, of[row], one[row]
    lo = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (chunk[1:] != chunk[:-1])))
    hi = np.append(lo[1:], len(row))
    root = np.maximum.accumulate(np.where(chunk[lo] == 0, np.arange(len(lo)), 0))  # the bucket's first chunk
    work = np.cumsum((hi[root] - lo[root]) * (hi - lo)) // most_work
    edges = np.append(np.flatnonzero(np.append(True, work[1:] != work[:-1])), len(lo))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        used = np.unique(np.append(root[a:b], np.arange(a, b)))  # of a large bucket its first chunk alone, not all between
        rows = row[ranges(lo[used], hi[used] - lo[used])]
        ends = np.cumsum(hi[used] - lo[used])
        begins = ends - (hi[used] - lo[used])
        first, last = np.searchsorted(used, root[a:b]), np.searchsorted(used, np.arange(a, b))
        i, j = trie_pairs(one[rows], begins[first], ends[first], begins[last], ends[last], radius)
        i, j = rows[i], rows[j]
        near = (np.bitwise_count(one[i] ^ one[j]).astype(np.int64) + np.bitwise_count(two[i] ^ two[j]) <= both) & (doc[i] != doc[j])
        later, earlier = np.maximum(i[near], j[near]), np.minimum(i[near], j[near])
        order = np.lexsort((earlier, later))
        yield later[order], earlier[order]


def places(bucket: np.ndarray) -> np.ndarray:
    """Each row's place in its bucket; rows come sorted by bucket."""
    heads = np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]
    return np.arange(len(bucket)) - np.maximum.accumulate(np.where(heads, np.arange(len(bucket)), 0))


def near_members(bucket: np.ndarray, doc: np.ndarray, one: np.ndarray, two: np.ndarray, radius: int, both: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (later, first) of whole buckets that are near, and each row's place in its bucket. Rows come sorted by bucket and doc_id.

    Near are fingerprints ``one`` within ``radius`` bits, found by self-joining tries, that differ in ``both`` bits or fewer with ``two`` added.
    Of a bucket of over ``hot`` members the first ``hot`` are compared with all, the others with these alone.
    """
    place = places(bucket)
    found = list(near_chunks(bucket, doc, one, two, place, radius, both, hot))
    later, first = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
    order = np.lexsort((first, later))
    return later[order], first[order], place


def _near(radius: int, both: int, most: int, hot: int, most_rows: int = 1 << 15):
    """(doc_id, first): the near pairs of buckets' members, at most the ``most`` least of a member in a bucket; without a first, whoever may miss any.

    Where some members stay, all pairs of others with these instead.
    """

    def found(bucket: np.ndarray, doc: np.ndarray, one: np.ndarray, two: np.ndarray, stays: np.ndarray) -> Iterator[pa.RecordBatch]:
        place = places(bucket)
        if most:
            beyond = place >= hot
            yield rows(np.empty(0, np.int64), np.empty(0, np.int64), np.unique(doc[beyond][doc[beyond] != doc[(np.arange(len(doc)) - place)[beyond]]]))
        for later, first in near_chunks(bucket, doc, one.view(np.uint64), two.view(np.uint64), place, radius, both, hot):
            if most:
                new = np.flatnonzero(np.append(True, later[1:] != later[:-1])) if len(later) else later
                nth = np.arange(len(later)) - np.repeat(new, np.diff(np.append(new, len(later))))
                yield rows(doc[later[nth < most]], doc[first[nth < most]], np.unique(doc[later[nth >= most]]))
            else:
                some = stays[first] & ~stays[later]
                yield rows(doc[later[some]], doc[first[some]], np.empty(0, np.int64))
        give_back()

    def rows(later: np.ndarray, first: np.ndarray, missing: np.ndarray) -> pa.RecordBatch:
        firsts = pa.concat_arrays([pa.array(first), pa.nulls(len(missing), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(np.append(later, missing)), firsts], ["doc_id", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            if sum(len(x[0]) for x in held) < most_rows or batch.column(0)[-1].as_py() == held[0][0][0]:
                continue  # one bucket alone so far goes on
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))  # the last bucket may go on
            held = [[x[cut:].copy() for x in columns]]
            columns = [x[:cut] for x in columns]
            yield from found(*columns)
        if held and sum(len(x[0]) for x in held):
            yield from found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Written table of the ``pairs`` (doc_id, first) whose sets of runs of words have a Jaccard similarity of ``similarity`` or more; ``texts`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2_000_000):
            flat, bounds = _sets(batch.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))], ["doc_id", "runs"])

    members = pairs.select(F.explode(F.array("doc_id", "first")).alias("doc_id")).distinct()
    # written, so that both sides of each join are plain shuffles, which adaptive execution can split
    runs = written(texts.join(members, "doc_id", "left_semi").mapInArrow(run, "doc_id long, runs array<long>"), "runs")
    one = written(runs.join(pairs, "doc_id"), "member-runs")
    two = runs.select(F.col("doc_id").alias("first"), F.col("runs").alias("first_runs"))
    common = F.size(F.array_intersect("runs", "first_runs"))
    union = F.size("runs") + F.size("first_runs") - common
    return written(one.join(two, "first").filter(common >= F.lit(similarity) * union).select("doc_id", "first").distinct(), "similar")


def _dropped(left: DataFrame, texts: DataFrame, words: int, similarity: float, most_pairs: int, radius: int = 20, both: int = 34) -> list[DataFrame]:
    """Tables (doc_id) of the rows of ``left`` (doc_id, prints) that are similar to a smaller doc_id that is near and stays.

    Each near pair is compared if no bucket holds more near pairs of a member than ``most_pairs``. Else whoever has no smaller near one
    stays, all near these are compared with them, and those that are left go into the next round: of a large group of copies only its first is
    compared with all. Where that settles less than half of a round's members, the next compares all pairs of members that miss none, and goes as far as these tell.
    """
    spark, dropped, slow = left.sparkSession, [], False
    hot = max(512, left.count() >> 13)

    def near(rows: DataFrame, most: int) -> DataFrame:
        dealt = rows.mapInArrow(_blocks, MEMBERS).repartition(parts(spark), "bucket").sortWithinPartitions("bucket", "doc_id")
        return written(dealt.mapInArrow(_near(radius, both, most, hot), "doc_id long, first long"), "near")

    def tried(pairs: DataFrame) -> DataFrame:
        return _similar(written(pairs.distinct(), "tried"), texts, words, similarity)

    while True:
        found = near(left.select("doc_id", "prints", F.lit(False).alias("stays")), max(1, most_pairs))
        missing = written(found.filter("first is null").select("doc_id").distinct(), "missing")
        whole = missing.isEmpty()
        unsure = found.select("doc_id").distinct()
        if whole or slow:
            edges = tried(found.filter("first is not null").join(missing, "doc_id", "left_anti"))
            while not edges.isEmpty():
                sure = edges.select("first").distinct().join(edges.select(F.col("doc_id").alias("first")).unionByName(missing.select(F.col("doc_id").alias("first"))).distinct(), "first", "left_anti")
                gone = written(edges.join(sure, "first", "left_semi").select("doc_id").distinct(), "gone")
                if gone.isEmpty():
                    break
                dropped.append(gone)
                left = left.join(gone, "doc_id", "left_anti")
                edges = written(edges.join(gone, "doc_id", "left_anti").join(gone.withColumnRenamed("doc_id", "first"), "first", "left_anti").select("doc_id", "first"), "edges")
            if whole:
                return dropped
            unsure = edges.select("doc_id").unionByName(missing).distinct()
        marked = left.join(unsure.withColumn("unsure", F.lit(True)), "doc_id", "left")
        marked = written(marked.select("doc_id", "prints", F.col("unsure").isNull().alias("stays")), "marked")
        gone = written(tried(near(marked, 0)).select("doc_id").distinct(), "gone")
        dropped.append(gone)
        before = marked.filter("not stays").count()
        left = written(marked.filter("not stays").join(gone, "doc_id", "left_anti").select("doc_id", "prints"), "left")
        slow = 2 * left.count() > before


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, prints: int = 16, most_pairs: int = 32) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) without near copies: by growing doc_id, a row goes if the Jaccard similarity
    of its runs of ``words`` words with those of a smaller doc_id that stays is ``similarity`` or more, else it stays.

    Candidates come from ``prints`` SimHash fingerprints (two at least) of each set of runs: documents that share one of their 16-bit blocks meet in a bucket,
    whose tries are self-joined at 20 bits (34 of the first two fingerprints' 128); every candidate is compared exactly. At a similarity of 0.8
    a bit differs with a chance of 0.15, so 64 blocks lose 1 pair in 120, at 0.85 1 in 1,600; the radius loses 1 in 1,000 or fewer.
    Rows of equal fingerprints and equal sets of runs (texts without words too) are one. Of rows that repeat a doc_id and text one stays;
    rows with a null doc_id stay.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter("doc_id is not null")
    signed = texts.mapInArrow(_signatures(words, prints), "doc_id long, digest binary, prints array<long>")
    signed = written(signed.withColumn("print", F.coalesce(F.get("prints", F.lit(0)), F.lit(0).cast("long"))), "signatures")
    equal = written(signed.groupBy("print", "digest").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("print", "digest", "low"), "equal-sets")
    same = written(signed.select("doc_id", "print", "digest").join(equal, ["print", "digest"]).filter("doc_id != low").select("doc_id").distinct(), "same")
    left = written(signed.filter("size(prints) > 0").select("doc_id", "prints").join(same, "doc_id", "left_anti"), "left")
    copies = same
    for gone in _dropped(left, texts, words, similarity, most_pairs):
        copies = copies.unionByName(gone)
    left = docs.join(written(copies.distinct(), "copies"), "doc_id", "left_anti")
    again = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(left.columns))
