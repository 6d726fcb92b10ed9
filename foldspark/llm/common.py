"""Helpers shared by the operators: tables, intermediate tables in the shared folder, hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.session import ensure_checkpoint_dir


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan; works for any path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table inside the folder named by ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # nothing reads the shuffles of this write again: Spark drops them when it ends
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Most bytes of ids that ``with_text_id`` sends to every task; more are joined by a shuffle, with the same result.
MAX_BROADCAST = 16 << 20


def with_text_id(documents: DataFrame) -> DataFrame:
    """``documents`` with ``__text``: what tells the texts of one doc_id apart, 0 for a doc_id with a single text.

    A place in a text is (doc_id, __text, position), so rows that repeat doc_id and text share their places and rows that
    repeat a doc_id with other texts do not.
    """
    own = F.xxhash64(F.lit("text"), F.col("text"))
    several = documents.filter("doc_id is not null and text is not null").select("doc_id", own.alias("h")) \
        .groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")) \
        .filter("low <> high").select(F.col("doc_id").alias("__several"))
    several = materialise(several, "several-texts")
    size = several.count() * 16
    side = F.broadcast(several) if size <= MAX_BROADCAST else several.hint("merge")
    found = documents.join(side, F.col("doc_id") == F.col("__several"), "left")
    return found.withColumn("__text", F.when(F.col("__several").isNotNull(), own).otherwise(F.lit(0).cast("long"))) \
        .drop("__several")


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 on a uint64 array (wraps modulo 2^64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def expand_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``start .. start + length``."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Smaller batches: a text, its copies and its results are in a worker's memory at once."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
