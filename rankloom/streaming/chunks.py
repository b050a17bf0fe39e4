"""Bounded logs as streams: files go by as micro-batches, so what a run holds at once is a few files however long the log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.sources.store import new_path


def _as_files(df: DataFrame, files: int) -> str:
    path = new_path(df.sparkSession, "stream-source")
    df.repartition(files).write.parquet(path)
    return path


def in_batches(spark: SparkSession, df: DataFrame, of_batch: Callable[[DataFrame], DataFrame], files: int = 4) -> DataFrame:
    """What ``of_batch`` makes of each file of ``df``, in one table: a stream of one file a batch, run until all are read.

    A batch's result replaces what an earlier try of the same batch wrote, so each batch counts once even after a failure.
    """
    source, target, state = _as_files(df, files), new_path(spark, "stream-batches"), new_path(spark, "stream-state")

    def write(batch: DataFrame, number: int) -> None:
        of_batch(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(target).drop("batch")


def append_chunks(df: DataFrame, path: str, files: int = 4) -> None:
    """Appends ``df`` to the table at ``path`` file by file. The offsets stand beside the table: what is in already is not appended again."""
    spark = df.sparkSession
    source, state = f"{path}.source", f"{path}.state"
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(source)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        df.repartition(files).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", state).format("parquet").option("path", path).start().awaitTermination()
