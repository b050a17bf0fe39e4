"""Helpers shared by the training-data operators: written tables, null-safe columns, hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.store import shared_dir, written

__all__ = ["documents", "mixed", "names", "parts", "shared_dir", "text_or_empty", "written"]


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over each other, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(spark: SparkSession, at_least: int = 1) -> int:
    """Number of partitions for an explicit repartitioning: what the session is set to."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
