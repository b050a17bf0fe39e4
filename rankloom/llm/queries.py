"""The thin queries of the training-data operators over the standard tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import documents
from rankloom.llm.perspectives import SQL as PERSPECTIVES_SQL

WORD_TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm.secrets_scan import scan

    return scan(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm.suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), length=400).drop("kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm.token_huffman import read_tokens, token_files

    return read_tokens(token_files(documents(spark, sf_dir), tokenizer_file(WORD_TOKENIZER), end_id=2)).drop("ids")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm.toxicity import fit, held_out, score

    docs = documents(spark, sf_dir)
    found = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm.warc import read_archives, write_archives

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm.perspectives import mask_string, rotated

    return rotated(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumn("masks", mask_string())


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm.fingerprints import versions

    return versions(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_file(BYTE_TOKENIZER))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm.simhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm.decontamination import contaminated

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_perspectives": op3_perspectives,
    "op4_fingerprints": op4_fingerprints,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_token_files": op8_token_files,
    "op9_simhash": op9_simhash,
    "op10_decontamination": op10_decontamination,
}
ORACLE_SQL: dict[str, str] = {"op3_perspectives": PERSPECTIVES_SQL}
