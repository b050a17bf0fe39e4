"""Null ids, repeated rows, empty and long texts, empty tables and clashing columns in the operators and in every stage of the pipeline."""

import os
import random

import pytest

from rankloom.llm import decontamination, packing, secrets_scan, simhash, suffix_dedup, token_huffman, toxicity
from rankloom.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
RNG = random.Random(17)
WORDS = ["".join(RNG.choice("bcdefghik") for _ in range(RNG.randint(3, 8))) for _ in range(300)]
LONG = " ".join(RNG.choice(WORDS) for _ in range(12_000))
ITEM = " ".join(RNG.choice(WORDS) for _ in range(30))
ROWS = [(None, None), (None, ""), (None, LONG), (3, LONG), (3, LONG), (-(1 << 62), f"{LONG} {ITEM}"), ((1 << 63) - 1, f"x {ITEM} y token=AbCdEf123456"), (5, "é"), (5, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "k", "h", 0) for i, t in ROWS], "doc_id long, text string, row int, key string, hash string, n_chars long").repartition(3)


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


ALL = sorted((i for i, _ in ROWS), key=str)


def test_every_row_has_its_row(docs):
    assert ids(secrets_scan.scan(docs)) == ids(suffix_dedup.remove_repeats(docs)) == ids(simhash.near_duplicates(docs)) == ids(toxicity.score(docs, None)) == ALL
    files = token_huffman.token_files(docs, tokenizer_file("word_bpe_49k.json"))
    assert ids(token_huffman.read_tokens(files)) == ALL
    packed = packing.pack(docs, tokenizer_file("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in ROWS} and sum(r.length for r in packed if r.start == 0) > 0


def test_secrets_keep_all_rows_and_columns(docs):
    clean = secrets_scan.redacted(docs)
    assert clean.columns == docs.columns and ids(clean) == ALL
    assert [r.text for r in clean.filter("doc_id = 9223372036854775807").collect()] == [f"x {ITEM} y [SECRET]"]
    assert clean.filter("text is null").count() == 2


def test_copies_go_but_null_ids_stay(docs):
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    found = [(r.doc_id, r.text) for r in left.select("doc_id", "text").collect()]
    assert sum(i is None for i, _ in found) == 3
    assert sum(t == LONG or t == f"{LONG} {ITEM}" for i, t in found if i is not None) == 1  # 30 words more of 12,000 are a near copy


def test_benchmark_items_are_found_whatever_the_id(spark, docs):
    bench = spark.createDataFrame([(1, ITEM, "d"), (2, None, "d"), (3, "", "d"), (4, "no such words stand anywhere in these texts", "d")], "item_id long, text string, doc_id string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()) == [(-(1 << 62), 1), ((1 << 63) - 1, 1)]
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns and ids(clean) == sorted((i for i, t in ROWS if ITEM not in (t or "")), key=str)
    assert decontamination.contaminated(docs, bench.limit(0)).count() == decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.clean(docs, bench.limit(0)).count() == len(ROWS)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert simhash.near_duplicates(none).count() == simhash.one_of_each(none).count() == secrets_scan.redacted(none).count() == 0
    assert toxicity.fit(none, labels) is None and toxicity.kept(none, None).count() == 0 and toxicity.kept(docs, toxicity.fit(docs, labels)).count() == len(ROWS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages_of_no_documents(spark):
    import corpus_pipeline as cp

    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)
