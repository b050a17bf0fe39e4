"""Readers of raw logs into one schema, and writers. Every reader is a DataFrame plan: files split, columns prune."""

from __future__ import annotations

import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.text import concat_nullsafe

ARTICLES_TSV = "article_id string, category string, subcategory string, title string, abstract string, url string, title_entities string, abstract_entities string"
BEHAVIORS_TSV = "impression_id long, user_id string, time string, history string, impressions string"


def _tsv(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", "false").csv(list(paths))


def first_of_each(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def union_first_wins(key: str, *frames: DataFrame) -> DataFrame:
    """Union of frames; of a key's rows, that of the earliest frame stays."""
    out = frames[0].withColumn("_source", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("_source", F.lit(i)))
    rest = [c for c in frames[0].columns if c != key]
    return first_of_each(out, key, "_source", *rest).drop("_source")


def tsv_articles(spark: SparkSession, *paths: str) -> DataFrame:
    """(article_id, text_lexical, category) of headerless TSV files, the first file's row for an id that repeats."""
    frames = [_tsv(spark, ARTICLES_TSV, p).select("article_id", concat_nullsafe("title", "abstract").alias("text_lexical"), "category") for p in paths]
    return union_first_wins("article_id", *frames)


def parse_history(history: Column) -> Column:
    return F.when(history.isNull() | (history == ""), F.array().cast("array<string>")).otherwise(F.split(history, " "))


def parse_labelled(impressions: Column) -> Column:
    """Array of (candidate_id, label) of "id-label" items, cut at the last hyphen."""
    return F.transform(
        F.split(impressions, " "),
        lambda x: F.struct(F.regexp_extract(x, r"^(.*)-(\d+)$", 1).alias("candidate_id"), F.regexp_extract(x, r"^(.*)-(\d+)$", 2).cast("int").alias("label")),
    )


def parse_time(time: Column) -> Column:
    """Twelve-hour clock times such as 11/15/2019 8:55:22 AM, without a zone."""
    return F.to_timestamp_ntz(time, F.lit("M/d/yyyy h:mm:ss a"))


def tsv_behaviors(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """(impression_id, user_id, timestamp, history_len, candidates, labels); labels are null without labels."""
    raw = _tsv(spark, BEHAVIORS_TSV, path)
    items = parse_labelled(F.col("impressions"))
    candidates = items["candidate_id"] if labelled else F.split("impressions", " ")
    labels = items["label"] if labelled else F.lit(None).cast("array<int>")
    return raw.select("impression_id", "user_id", parse_time(F.col("time")).alias("timestamp"), F.size(parse_history(F.col("history"))).alias("history_len"), candidates.alias("candidates"), labels.alias("labels"))


def tsv_user_history(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, history): each user's first row."""
    raw = _tsv(spark, BEHAVIORS_TSV, path)
    return first_of_each(raw.select("user_id", parse_history(F.col("history")).alias("history"), "impression_id"), "user_id", "impression_id").drop("impression_id")


def row_range(df: DataFrame, key: str, skip: int, rows: int | None = None) -> DataFrame:
    """Rows ``skip`` .. ``skip + rows`` by a stored index column, pushed down to the scan."""
    out = df.filter(F.col(key) >= skip)
    return out if rows is None else out.filter(F.col(key) < skip + rows)


def membership_labels(inview: Column, clicked: Column) -> Column:
    """1 for each id in view that was clicked; a null list of clicks gives zeros."""
    return F.transform(inview, lambda a: F.coalesce(F.array_contains(clicked, a), F.lit(False)).cast("int"))


def parquet_behaviors(spark: SparkSession, behaviors: str, history: str) -> DataFrame:
    """Parquet logs in the same schema, with session_id kept on the row; history lengths by a left join on the user."""
    raw = spark.read.parquet(behaviors).select("impression_id", "user_id", "impression_time", "article_ids_inview", "article_ids_clicked", "session_id")
    lengths = spark.read.parquet(history).select("user_id", F.size("article_id_fixed").alias("history_len"))
    return raw.join(lengths, "user_id", "left").select("impression_id", "user_id", F.col("impression_time").alias("timestamp"), F.coalesce("history_len", F.lit(0)).alias("history_len"), F.col("article_ids_inview").alias("candidates"), membership_labels(F.col("article_ids_inview"), F.col("article_ids_clicked")).alias("labels"), "session_id")


def parquet_engagement(spark: SparkSession, history: str) -> DataFrame:
    """(user_id, idx, article_id, ts, read_time, scroll): four parallel arrays as rows, oldest first."""
    raw = spark.read.parquet(history)
    zipped = F.arrays_zip(F.col("article_id_fixed"), F.col("impression_time_fixed"), F.col("read_time_fixed"), F.col("scroll_percentage_fixed"))
    return raw.select("user_id", F.posexplode(zipped).alias("idx", "x")).select("user_id", "idx", F.col("x.article_id_fixed").alias("article_id"), F.col("x.impression_time_fixed").alias("ts"), F.col("x.read_time_fixed").alias("read_time"), F.col("x.scroll_percentage_fixed").alias("scroll"))


def parquet_publish_times(spark: SparkSession, *paths: str) -> DataFrame:
    return union_first_wins("article_id", *[spark.read.parquet(p).select("article_id", "published_time") for p in paths])


def write_rank_lines(lines: DataFrame, path: str) -> None:
    """Text files, one line an impression."""
    lines.select("line").write.mode("overwrite").text(path)


class _StoreFile:
    """A file of any store that Spark reaches, as a Python stream."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data) -> int:
        self.stream.write(bytearray(data))
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


def write_zip(spark: SparkSession, text_folder: str, zip_path: str, member: str) -> None:
    """One zip with a single member at its root from the text files of a folder, both on any store that Spark reaches; streamed, part by part."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(text_folder), jvm.org.apache.hadoop.fs.Path(zip_path)
    parts = sorted(str(x.getPath()) for x in folder.getFileSystem(conf).listStatus(folder) if x.getPath().getName().startswith("part-"))
    out = target.getFileSystem(conf).create(target, True)
    try:
        with zipfile.ZipFile(_StoreFile(out), "w", zipfile.ZIP_DEFLATED) as archive, archive.open(member, "w", force_zip64=True) as sink:
            for part in parts:
                source = folder.getFileSystem(conf).open(jvm.org.apache.hadoop.fs.Path(part))
                while chunk := bytes(source.readNBytes(1 << 20)):
                    sink.write(chunk)
                source.close()
    finally:
        out.close()


def read_zip(spark: SparkSession, zip_path: str, member: str) -> DataFrame:
    """(line) of a zip's member."""
    import io

    def lines(batches):
        import pandas as pd

        for batch in batches:
            for raw in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as archive, archive.open(member) as source:
                    while some := source.readlines(1 << 20):
                        yield pd.DataFrame({"line": [x.decode().rstrip("\n") for x in some]})

    return spark.read.format("binaryFile").load(zip_path).select("content").mapInPandas(lines, "line string")


def in_chunks(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Adds ``chunk``, the row's number by ``order`` // rows: numbers within ranges of the order, plus the ranges before. No task sorts more than a range."""
    from rankloom.sources.store import written

    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn("chunk", F.floor((F.col("_before") + F.col("_place")) / rows)).drop("_range", "_place", "_before")


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)
