"""Distributed ranking.

``row_number() OVER (PARTITION BY label ORDER BY ...)`` sorts every class in a
single task: with two classes, half of the table lands on one core.  The two
operators here give the same numbers with the sort spread over the cluster.

* ``hashed_rank`` - order by a uniform md5 hex string.  The leading hex digits
  are a monotone coarsening of that order, so the rank is
  ``rows in earlier buckets + row_number inside the bucket``.  Bucket counts
  are a small aggregate (map-side combined), the offsets a prefix sum over at
  most ``groups * 16**digits`` rows, and the per-bucket window shuffles on
  ``(by, bucket)`` which is balanced by construction.

* ``ordered_rank`` - order by arbitrary columns.  A range-partitioned sort,
  ``monotonically_increasing_id`` (partition index in the upper bits),
  per-partition counts and prefix offsets - the DataFrame form of
  ``zipWithIndex``.  The ids are frozen by a reliable checkpoint so that the
  counting and the numbering pass see the same partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.rand import hash_bucket
from foldspark.session import cut_lineage

BROADCAST_ROW_LIMIT = 2_000_000  # offsets rows; ~48 MB at 24 bytes/row

ROWS_A_TASK = 250_000            # rows that a task sorts or aggregates at a time


def tasks_for(spark, n_rows: int) -> int:
    """Partitions for so many rows: as the session says, more where a task would hold more than ``ROWS_A_TASK``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // ROWS_A_TASK))


def hashed_rank(df: DataFrame, by: list[str], hex_col: str, tie: list[str] | None = None,
                out: str = "rank", digits: int = 4, max_groups: int = 64, partitions: int | None = None) -> DataFrame:
    """1-based rank within ``by`` ordered by ``hex_col`` (then ``tie``).

    ``partitions``: tasks that sort, so that a caller who knows its number of rows bounds what one of them holds.
    """
    tie = tie or []
    b = df.withColumn("_bkt", hash_bucket(F.col(hex_col), digits))
    keys = list(by) + ["_bkt"]
    counts = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    prefix = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(prefix), F.lit(0)).alias("_off"))
    # offsets holds at most max_groups * 16**digits rows: a proven bound.
    if max_groups * 16 ** digits <= BROADCAST_ROW_LIMIT:
        offsets = F.broadcast(offsets)
    local = Window.partitionBy(*keys).orderBy(F.col(hex_col), *[F.col(c) for c in tie])
    dealt = b.repartition(partitions, *keys) if partitions else b
    ranked = dealt.withColumn("_loc", F.row_number().over(local))
    return (ranked.join(offsets, keys, "inner")
            .withColumn(out, (F.col("_off") + F.col("_loc")).cast("bigint"))
            .drop("_bkt", "_loc", "_off"))


def ordered_rank(df: DataFrame, by: list[str], order: list[str], out: str = "rank",
                 partitions: int | None = None) -> DataFrame:
    """1-based rank within ``by`` ordered by ``order`` (ascending, NULLS FIRST)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in list(by) + list(order)]
    sorted_df = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    with_id = cut_lineage(sorted_df.withColumn("_mid", F.monotonically_increasing_id()))
    with_id = with_id.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
    parts = with_id.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*by, "_pid", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (with_id.join(F.broadcast(offsets), list(by) + ["_pid"], "inner")
            .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("bigint"))
            .drop("_mid", "_pid", "_m0", "_off"))
