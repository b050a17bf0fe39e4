"""Benchmark decontamination with DataFrame functions alone.

Texts are words in lower case (runs of letters and digits), and runs of five words hashed to 64 bits. A window that is similar enough
to an item lacks few of the item's runs, so it has one at least of the item's rarest: of these alone, whose number the threshold gives, every
document is searched, and runs that many items or documents share are none of them. A document and an item found so are placed on each other by
all runs they share: windows begin where a shared run puts the item's start, and at all places between two such starts that are less than an
item apart. Windows and items get SimHash fingerprints; those within ``radius`` bits agree in one of radius + 1 blocks of bits, which an equi-join of
item and block finds. What it finds is verified by the exact similarity of their runs weighted by how often they occur: the sum of
the lesser weights over the sum of the greater.

A similarity of 0.8 is some ten bits of 64 and up to 23: blocks for that have two or three bits, by which nearly every window would meet every item. So blocks
can't find documents here; they only sort out windows of documents and items that the rarest runs found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import text_or_empty, written

RUN = 5
#: Item runs up to this number are broadcast (some 30 bytes each); beyond, the join shuffles.
MOST_BROADCAST = 1_000_000


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words in lower case."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def run_hashes(words: Column) -> Column:
    """Hashes of all runs of RUN words; of the whole text if it has fewer; none without words."""
    whole = F.array(F.xxhash64(words))
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (RUN - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(RUN)]))
    return F.when(F.size(words) >= RUN, runs).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def simhash(run: Column) -> Column:
    """Aggregate: 64 bits, each set if over half of the group's runs have it."""
    bits = [F.when(2 * F.sum(F.shiftrightunsigned(run, b).bitwiseAND(F.lit(1))) > F.count(run), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def blocks(fp: Column, radius: int) -> Column:
    """The number of each of radius + 1 blocks of bits with its value in ``fp``, as one long."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) * 64 + k for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])


def rarest(items: DataFrame, threshold: float) -> DataFrame:
    """(item_id, run): each item's runs in order of how many items have them, the rarest first, as many as can't all be missing from a similar window.

    A window shares ``threshold`` of the item's weight at least: similarity s of weights a and b needs common >= s (a + b - common), and common <= b.
    """
    weights = items.groupBy("item_id", "run").agg(F.count(F.lit(1)).alias("weight"))
    spread = weights.groupBy("run").agg(F.count(F.lit(1)).alias("in_items"))
    order = W.partitionBy("item_id").orderBy("in_items", "run")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = weights.join(spread, "run").withColumn("before", before).withColumn("whole", F.sum("weight").over(W.partitionBy("item_id")))
    return placed.filter(F.col("before") <= F.col("whole") * F.lit(1 - threshold) + 1e-9).select("item_id", "run")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 23, by_row: bool = False) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): for each document and item, the best window of ``threshold`` or more.

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text). Null and empty texts have no words and match nothing. An item
    of fewer than five words matches a document of just these words. A document shorter than an item is one window.
    Of windows of equal similarity the first is returned; rows that repeat a doc_id and text give one result. At
    similarity 0.8 fingerprints differ in 9.7 bits on average with a deviation of 2.9, so ``radius`` leaves 4.6 deviations.
    Empty tables: no rows. With ``by_row``: (doc_id, text_hash) of the documents found, text_hash being xxhash64 of the text.
    """
    counted = lambda name: bound(word_hashes(text_or_empty()), lambda w: F.struct(F.size(w).alias(name), run_hashes(w).alias("runs")))
    items = benchmark.select("item_id", counted("n_item").alias("x")).select("item_id", "x.*")
    items = written(items.dropDuplicates(["item_id", "n_item", "runs"]).select("item_id", "n_item", F.posexplode("runs").alias("item_at", "run")), "items")
    marks = written(rarest(items, threshold), "rare-runs")
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), counted("n_doc").alias("x"))
    # struct fields of x are read from one column: the generator keeps a later select from repeating its expression
    rows = rows.select("doc_id", "text_hash", F.inline(F.array("x")))
    places = rows.select("doc_id", "text_hash", F.explode("runs").alias("run"))
    small = marks.count() <= MOST_BROADCAST
    pairs = written(places.join(F.broadcast(marks) if small else marks, "run").select("doc_id", "text_hash", "item_id").distinct(), "pairs")
    # the documents that have any are read again
    keys = written(pairs.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash")).distinct(), "pair-documents")
    again = rows.join(keys, rows.doc_id.eqNullSafe(keys["of"]) & (rows.text_hash == keys.of_hash)).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", "n_doc", "runs")
    again = written(again, "pair-texts")
    shared = again.select("doc_id", "text_hash", "n_doc", F.posexplode("runs").alias("at", "run")).join(F.broadcast(items) if small else items, "run")
    asked = pairs.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), F.col("item_id").alias("of_item"))
    shared = shared.join(asked, shared.doc_id.eqNullSafe(asked["of"]) & (shared.text_hash == asked.of_hash) & (shared.item_id == asked.of_item), "left_semi")
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("item_at"), F.col("n_doc") - F.col("n_item"))).alias("start")
    aligned = written(shared.select("doc_id", "text_hash", "item_id", "n_item", start).distinct(), "aligned")
    after = F.lead("start").over(W.partitionBy("doc_id", "text_hash", "item_id", "n_item").orderBy("start"))
    until = F.when(after - F.col("start") <= F.col("n_item"), after - 1).otherwise(F.col("start"))
    windows = written(aligned.withColumn("until", until).select("doc_id", "text_hash", "item_id", "n_item", F.explode(F.sequence("start", F.coalesce("until", "start"))).alias("start")), "windows")
    texts = again.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "runs")
    inside = windows.join(texts, windows.doc_id.eqNullSafe(texts["of"]) & (windows.text_hash == texts.of_hash)).select(
        "doc_id", "text_hash", "item_id", "n_item", "start", F.explode(F.slice("runs", F.col("start") + 1, F.greatest(F.lit(1), F.col("n_item") - (RUN - 1)))).alias("run")
    )
    key = ["doc_id", "text_hash", "item_id", "start"]
    inside = written(inside.groupBy(*key, "n_item", "run").agg(F.count(F.lit(1)).alias("weight")), "window-runs")
    repeated = inside.select(*key, F.explode(F.array_repeat("run", F.col("weight").cast("int"))).alias("run"))
    window_prints = repeated.groupBy(*key).agg(simhash(F.col("run")).alias("fp"), F.count(F.lit(1)).alias("n_runs"))
    item_prints = items.groupBy("item_id").agg(simhash(F.col("run")).alias("item_fp"), F.count(F.lit(1)).alias("item_runs"))
    near = window_prints.withColumn("block", F.explode(blocks(F.col("fp"), radius))).join(item_prints.withColumn("block", F.explode(blocks(F.col("item_fp"), radius))), ["item_id", "block"])
    near = near.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*key, "n_runs", "item_runs").distinct()
    weights = items.groupBy("item_id", "run").agg(F.count(F.lit(1)).alias("item_weight"))
    common = inside.join(weights, ["item_id", "run"]).groupBy(*key, "n_item").agg(F.sum(F.least("weight", "item_weight")).alias("common"))
    pair = common.alias("c").join(near.alias("n"), (F.col("c.text_hash") == F.col("n.text_hash")) & (F.col("c.item_id") == F.col("n.item_id")) & (F.col("c.start") == F.col("n.start")) & F.col("c.doc_id").eqNullSafe(F.col("n.doc_id")))
    found = pair.select("c.doc_id", "c.text_hash", "c.item_id", F.col("c.start").alias("start_word"), F.col("n_item").alias("n_words"), (F.col("common") / (F.col("n_runs") + F.col("item_runs") - F.col("common"))).alias("similarity")).filter(F.col("similarity") >= threshold)
    if by_row:
        return found.select("doc_id", "text_hash").distinct()
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start_word", "n_words", "similarity"), F.struct("similarity", -F.col("start_word"))).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 23) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``, with all their columns."""
    found = written(contaminated(docs, benchmark, threshold, radius, by_row=True), "contaminated").withColumnRenamed("doc_id", "of")
    return docs.join(found, docs.doc_id.eqNullSafe(found["of"]) & (F.xxhash64(text_or_empty()) == found.text_hash), "left_anti")
