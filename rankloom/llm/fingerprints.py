"""Document fingerprints with DataFrame functions alone: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its pieces up to each sentence's mark or line end (many texts are one line, which would be one paragraph however long); their 64-bit
digests, each once, go into three cells of a sketch, one a subtable: a cell has a signed count, the xor of its digests and the xor of
their checks. A subtable has 2^k cells, at least ``CELLS`` for each of the text's digests, so sketches of two texts are of one width or the wider folds onto the
other's. The fingerprint is the sketch as text: of each cell that isn't empty its number, count and xor of digests; checks follow from a digest alone.

Versions are compared at the width of the wider fingerprint: sketches subtract cell by cell, so what they share cancels out. Peeling then takes, subtable after
subtable, the cells that hold one digest, and takes that digest out of its other cells, until nothing is left: the digests in
which the versions differ. Pairs that don't come apart in ``ROUNDS`` steps are tried again ``GROWTH`` times as wide; what fails ``TRIES`` times
more is compared digest by digest, so the likeness is exact for all.

All steps of a pair group by its bucket first, by which its rows are partitioned: texts are shuffled once, digests once for each try.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import parts, text_or_empty, written

ROUNDS, CELLS, GROWTH, TRIES = 12, 2, 4, 3
PIECE_END = r"(?<=[.!?\n])"
CHECK = 97
#: Pairs: a text and its edited version, a text and the next one.
EDITED, NEXT = range(2)


def digests(text: Column) -> Column:
    """Digests of a text's paragraphs, each once; none for the empty text."""
    return F.array_distinct(F.transform(F.filter(F.split(text, PIECE_END), lambda p: p != ""), lambda p: F.xxhash64(p)))


def width_of(size: Column) -> Column:
    """Cells of a subtable for so many digests: the power of two that is CELLS times as many or more, 4 at least."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(size * CELLS, F.lit(4)).cast("double")))).cast("long")


def place(key: Column, table: int, width: Column) -> Column:
    """The digest's cell in a subtable, numbered through all subtables."""
    return F.pmod(F.xxhash64(key, F.lit(table)), width) + width * table


def fingerprint(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with each array of digests of ``names`` as its sketch in text: cells per subtable (hex), then of each cell that isn't empty "cell.count.digests' xor"."""
    for name in names:
        others = [c for c in rows.columns if c != name]
        # generators keep what stands in a lambda from being worked out for each element
        rows = rows.select(*others, name, F.inline(F.array(F.struct(width_of(F.size(name)).alias("_width")))))
        spots = F.flatten(F.transform(name, lambda k: F.array(*[F.struct(place(k, t, F.col("_width")).alias("cell"), k.alias("key")) for t in range(3)])))
        rows = rows.select(*others, F.inline(F.array(F.struct(F.lower(F.hex("_width")).alias("_w"), F.sort_array(spots).alias("_x")))))
        heads = F.filter(F.transform("_x", lambda x, i: F.when((i == 0) | (x["cell"] != F.col("_x")[i - 1]["cell"]), i)), lambda i: i.isNotNull())
        rows = rows.select(*others, "_w", F.inline(F.array(F.struct(F.col("_x"), F.concat(heads, F.array(F.size("_x"))).alias("_h")))))
        ends = F.slice("_h", 1, F.size("_h") - 1)

        def cell(h: Column, j: Column) -> Column:
            run = F.slice("_x", h + 1, F.col("_h")[j + 1] - h)
            return F.concat_ws(".", F.lower(F.hex(F.col("_x")[h]["cell"])), (F.col("_h")[j + 1] - h).cast("string"), F.lower(F.lpad(F.hex(F.aggregate(run, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x["key"]))), 16, "0")))

        rows = rows.select(*others, F.concat_ws("/", "_w", F.array_join(F.transform(ends, cell), "-")).alias(name))
    return rows


def peeled(pairs: DataFrame, wider: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """(bucket, row, pair, size, width, cell, sign, key, check, found) of ``pairs`` (bucket, row, pair, a, b: arrays of digests).

    Rows with cell -1 are recovered digests (sign 1: only in a, -1: only in b), those with cell -2 one for each pair; any other is a cell that was left.
    """
    group = ["bucket", "row", "pair", "size", "width"]
    width = width_of(F.greatest(F.size("a"), F.size("b"))) * F.lit(wider)
    base = pairs.select("bucket", "row", "pair", (F.size("a") + F.size("b")).cast("long").alias("size"), width.alias("width"), "a", "b")
    head = F.struct(F.lit(0).alias("sign"), F.lit(0).cast("long").alias("key"))
    one = lambda sign: lambda k: F.struct(F.lit(sign).alias("sign"), k.alias("key"))
    entries = base.select(*group, F.inline(F.concat(F.array(head), F.transform("a", one(1)), F.transform("b", one(-1)))))
    key, width, is_head = F.col("key"), F.col("width"), F.col("sign") == 0
    spots = F.when(is_head, F.array(F.lit(-2).cast("long"))).otherwise(F.array(*[place(key, t, width) for t in range(3)]))
    table = entries.select(*group, F.explode(spots).alias("cell"), "sign", "key", F.when(is_head, F.lit(0).cast("long")).otherwise(F.xxhash64("key", F.lit(CHECK))).alias("check"), F.lit(0).cast("long").alias("found"))

    def summed(rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*group, "cell", "found").agg(F.sum("sign").alias("sign"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
        return out.filter((F.col("cell") < 0) | (F.col("sign") != 0) | (F.col("key") != 0))

    table = summed(table)
    for step in range(rounds):
        t = step % 3
        pure = (F.col("cell") >= 0) & (F.abs("sign") == 1) & (F.xxhash64("key", F.lit(CHECK)) == F.col("check")) & (F.col("cell") == place(key, t, width))
        same = F.struct("cell", "sign", "key", "check", "found")
        got = F.struct(F.lit(-1).cast("long").alias("cell"), "sign", "key", F.lit(0).cast("long").alias("check"), F.col("key").alias("found"))
        less = [F.struct(place(key, o, width).alias("cell"), (-F.col("sign")).alias("sign"), "key", "check", F.lit(0).cast("long").alias("found")) for o in range(3) if o != t]
        table = summed(table.select(*group, F.inline(F.when(pure, F.array(got, *less)).otherwise(F.array(same)))))
    return table


def jaccard(size: Column, differ: Column) -> Column:
    """Of two sets with ``size`` members together (shared ones twice), ``differ`` of them in one only; 1 for two empty ones."""
    return F.when(size == 0, F.lit(1.0)).otherwise((size - differ) / (size + differ).cast("double"))


def likeness(table: DataFrame) -> DataFrame:
    """(bucket, row, whole, near0, near1) of ``peeled``: the likeness of each pair; ``whole`` if nothing was left of any."""
    per = table.groupBy("bucket", "row", "pair", "size").agg(F.sum((F.col("cell") == -1).cast("long")).alias("differ"), F.sum((F.col("cell") >= 0).cast("long")).alias("left"))
    near = jaccard(F.col("size"), F.col("differ"))
    pick = lambda p: F.max(F.when(F.col("pair") == p, near))
    return per.groupBy("bucket", "row").agg((F.sum("left") == 0).alias("whole"), pick(EDITED).alias("near0"), pick(NEXT).alias("near1"))


def count_over(marks: Column, value: Column, step: int) -> Column:
    """How many of the descending ``marks`` are greater than the value: first by every ``step``-th, then within the stretch found."""
    coarse = F.filter(marks, lambda m, i: (i % step == step - 1) & (m > value))
    whole = F.size(coarse) * step
    return whole + F.size(F.filter(F.slice(marks, whole + 1, F.lit(step)), lambda m: m > value))


def with_next(docs: DataFrame, bucket_rows: int = 512, most_buckets: int = 20_000) -> tuple[DataFrame, int]:
    """(bucket, row, doc_id, text, next_text) by descending doc_id, after the last comes the first; and the number of buckets.

    Equal doc_ids follow by a hash of their texts, null ids come last. Buckets are ranges of that order of about ``bucket_rows`` rows: ids between
    percentiles of all ids, so they are even wherever ids lie; an id that fills several buckets, and null ids, are cut by the hash. The first text of each
    bucket is sent to the one before it too. Beyond ``most_buckets`` buckets, of which each sends one row of three numbers to the task that chains them,
    they are larger.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("hash", F.xxhash64("text"))
    counts = docs.agg(F.count("doc_id").alias("n"), F.count(F.lit(1)).alias("whole")).first()
    known = max(1, min(most_buckets, counts.n // bucket_rows))
    nulls = max(1, min(most_buckets, (counts.whole - counts.n) // bucket_rows))
    # few numbers: one a bucket
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / known for i in range(known - 1, 0, -1)], max(10_000, 20 * known)).alias("m")).first().m if known > 1 else []
    marks = sorted(found or [], reverse=True)
    step = max(1, math.isqrt(len(marks)))
    table = docs.sparkSession.createDataFrame([(marks,)], "marks array<long>")
    part = lambda n: F.least(F.floor((F.lit(0.5) - F.col("hash") / F.lit(float(1 << 64))) * n), n - 1).cast("long")  # noqa: E731  of n stretches of falling hashes
    over = count_over(F.col("marks"), F.col("doc_id"), step).cast("long")
    equal = F.size(F.filter(F.slice("marks", F.col("_over") + 1, F.lit(known)), lambda m: m == F.col("doc_id"))) if len(set(marks)) < len(marks) else F.lit(0)
    placed = rows.crossJoin(F.broadcast(table)).select("doc_id", "text", "hash", "marks", F.inline(F.array(F.struct(over.alias("_over")))))
    bucket = F.when(F.col("doc_id").isNull(), known + part(F.lit(nulls))).otherwise(F.col("_over") + part(equal + 1))
    rows = placed.select("doc_id", "text", "hash", bucket.alias("bucket"))
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "hash")).alias("top")
    chain = W.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(chain), F.last("bucket").over(chain.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    tops = rows.groupBy("bucket").agg(first).select("bucket", "top.*")
    tops = written(tops.select(F.col("bucket").alias("of"), "known", "id", F.col("hash").alias("h"), before.alias("to")), "bucket-tops")
    key = (rows.bucket == tops["of"]) & (rows.doc_id.isNotNull() == tops.known) & (F.coalesce("doc_id", F.lit(0)) == tops["id"]) & (rows["hash"] == tops.h)
    sent = rows.join(F.broadcast(tops), key).select("of", "to", "doc_id", rows["hash"], "text").groupBy("of").agg(*[F.first(c).alias(c) for c in ("to", "doc_id", "hash", "text")])
    every = rows.withColumn("ghost", F.lit(0)).unionByName(sent.select("doc_id", "text", "hash", F.col("to").alias("bucket"), F.lit(1).alias("ghost")))
    w = W.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("hash"))
    tasks = max(parts(docs.sparkSession), known + nulls)
    out = every.repartition(tasks, "bucket").select("bucket", "doc_id", "text", "ghost", F.lead("text").over(w).alias("next_text"), F.row_number().over(w).alias("row"))
    return out.filter("ghost = 0").drop("ghost"), tasks


def versions(docs: DataFrame, rounds: int = ROUNDS, tries: int = TRIES, bucket_rows: int = 512) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs`` (doc_id, text).

    The edited text's last third is the beginning of the next document's (as much as there is). Null text: empty, whose
    fingerprint has no cells; two empty texts have likeness 1. Repeated rows are next to each other. An empty table
    gives no rows.
    """

    rows, tasks = with_next(docs, bucket_rows)
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring("next_text", F.lit(1), cut))
    known = ["bucket", "row", "doc_id"]
    texts = rows.select(*known, F.length("text").cast("long").alias("n_chars"), F.inline(F.array(F.struct("text", "next_text", edited.alias("edited")))))
    found = texts.select(*known, "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("sha"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"), digests(F.col("next_text")).alias("n"))
    found = written(found, "digests")  # some 80 bytes a paragraph; texts are not needed from here on
    pair = lambda p, b: F.struct(F.lit(p).alias("pair"), F.col("a").alias("a"), F.col(b).alias("b"))
    two = F.inline(F.array(pair(EDITED, "e"), pair(NEXT, "n")))
    near, wider, left = None, 1, tries
    todo = found
    while True:
        pairs = todo.select("bucket", "row", "a", "e", "n").repartition(tasks, "bucket").select("bucket", "row", two)
        done = written(likeness(peeled(pairs, wider, rounds)), "likeness")
        whole = done.filter("whole").select("bucket", "row", "near0", "near1")
        near = whole if near is None else near.unionByName(whole)
        failed = done.filter("not whole").select("bucket", "row")
        if failed.isEmpty():
            break
        todo = found.join(failed, ["bucket", "row"], "left_semi")
        if not left:
            differ = lambda b: (F.size(F.array_except("a", b)) + F.size(F.array_except(b, "a"))).cast("long")
            exact = lambda b: jaccard((F.size("a") + F.size(b)).cast("long"), differ(b))
            near = near.unionByName(todo.select("bucket", "row", exact("e").alias("near0"), exact("n").alias("near1")))
            break
        wider, left = wider * GROWTH, left - 1
    both = fingerprint(found.drop("n").join(near, ["bucket", "row"]), "a", "e")
    return both.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.col("a").alias("fingerprint"), F.col("e").alias("edited_fingerprint"), F.col("near0").alias("near_edited"), F.col("near1").alias("near_next"))
