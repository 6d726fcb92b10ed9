"""Vectors for the two searches: usable rows, shards of candidates and blocks of queries.

A search compares a stated set of queries with all rows.  Candidates lie in shards of about ``shard_rows`` vectors by hash
of the id, queries in blocks of about ``block_rows``; each pair of a shard and a query block is one row of work, so
a task holds one shard and one block whatever the size of the table.  Vectors of different lengths never meet.

Usable are vectors that are not null and hold neither null nor non-finite components.  Rows that repeat an id
count as one, with the smallest of their vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "dim int, part int, ids binary, vectors binary"


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, vector array<double>): rows that take part in a search."""
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.coalesce(bad, F.lit(True)))
    return found.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def packed_parts(vectors: DataFrame, rows: int, transform: Callable[[np.ndarray], np.ndarray] | None = None,
                 schema: str = PACKED) -> DataFrame:
    """One row for each part of about ``rows`` vectors: ids and the matrix (double) as binary, ordered by id."""
    parts = max(1, -(-vectors.count() // rows))

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("vec_id", "ascending")])
        ids = group["vec_id"].to_numpy().astype(np.int64)
        dim = key[0].as_py()
        matrix = group["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        if transform is not None:
            matrix = transform(matrix)
        return pa.table({"dim": pa.array([dim], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()),
                         "ids": pa.array([ids.tobytes()], pa.binary()),
                         "vectors": pa.array([matrix.astype(np.float64).tobytes()], pa.binary())})

    keyed = vectors.withColumn("dim", F.size("vector")) \
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    return keyed.groupBy("dim", "part").applyInArrow(pack, schema)


def matrices(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)


def shard_by_block(shards: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each shard with each query block of the same length: the stated queries against all rows, in blocks."""
    queries = blocks.select("dim", F.col("part").alias("q_part"), F.col("ids").alias("q_ids"),
                            F.col("vectors").alias("q_vectors"))
    names = shards.select("dim", "part")
    # the pairs of names are small rows; contents are joined to them afterwards
    pairs = names.join(queries.select("dim", "q_part"), "dim")
    return pairs.join(shards, ["dim", "part"]).join(queries, ["dim", "q_part"]).repartition("dim", "part", "q_part")


def work_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a row holds two matrices."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
