"""Exact top-k by vector-approximation files (operator 7).

Components are integers, floor(256 * x).  The approximation file of a shard keeps for each component the number of
its cell, one of ``2^bits`` of equal width between the least and the largest value of the shard.  Scanning the cells
bounds the inner product with a query from both sides: the product of two matrices, of the query's positive and
negative parts and the cells' edges.  A vector stays a candidate if its upper bound reaches the k-th lower bound, first of its
shard, then of all shards.  Only candidates' exact vectors are read, best bound first, until the k-th exact score is at
least the next upper bound; so the result is exact.

Sums are exact in double precision while they stay below 2^53; shards or queries with larger components are scored in
integers of any size.  Scores beyond a 64-bit integer are an error.

Cases: null vectors and vectors with null or non-finite components take no part; zero vectors do; ties go to the
smaller id; queries with fewer candidates than k get all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import materialise
from foldspark.llm.vectors import matrices, packed_parts, shard_by_block, usable, work_rows


def integer_components(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vector", F.transform("vector", lambda x: F.floor(x * 256.0).cast("double")))


def approximation_file(ids: bytes, vectors: bytes, dim: int, bits: int) -> dict[str, bytes]:
    """Cells of a shard and the edges of each component: what the scan reads."""
    _, matrix = matrices(ids, vectors, dim)
    low, high = matrix.min(axis=0), matrix.max(axis=0)
    width = np.maximum(np.ceil((high - low + 1) / (1 << bits)), 1)
    cells = np.minimum((matrix - low) // width, (1 << bits) - 1).astype(np.uint8)
    return {"cells": cells.tobytes(), "low": low.tobytes(), "width": width.tobytes()}


def cell_bounds(cells: np.ndarray, low: np.ndarray, width: np.ndarray, queries: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products: (queries, vectors)."""
    floor = low + cells * width
    ceiling = floor + width - 1
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    lower, upper = plus @ floor.T + minus @ ceiling.T, plus @ ceiling.T + minus @ floor.T
    size = np.abs(queries).sum(axis=1, keepdims=True) * max(float(np.abs(floor).max()), float(np.abs(ceiling).max()))
    slack = np.where(size < 2.0 ** 52, 0.0, size * 1e-12)   # beyond exact doubles: room for rounding
    return lower - slack, upper + slack


def exact_products(query: np.ndarray, matrix: np.ndarray) -> list[int]:
    if np.abs(query).sum() * max(float(np.abs(matrix).max()), 1.0) < 2.0 ** 52:
        return [int(x) for x in matrix @ query]
    whole = [int(x) for x in query]
    return [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in matrix]


def top_products(embeddings: DataFrame, is_query: Column | None = None, k: int = 5, bits: int = 6,
                 shard_rows: int = 8192, block_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest integer inner product (operator 7)."""
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    rows = materialise(integer_components(usable(embeddings)), "integers")
    shards = packed_parts(rows, shard_rows)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in work_rows(batches):
            file = approximation_file(row["ids"], row["vectors"], row["dim"], bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["dim"]], pa.int32()), pa.array([row["part"]], pa.int32()),
                 *(pa.array([x], pa.binary()) for x in (row["ids"], file["cells"], file["low"], file["width"]))],
                names=["dim", "part", "ids", "cells", "low", "width"])

    files = materialise(shards.mapInArrow(
        approximate, "dim int, part int, ids binary, cells binary, low binary, width binary"), "approximation-files")
    blocks = packed_parts(rows.filter(is_query), block_rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in work_rows(batches):
            dim, ids = row["dim"], np.frombuffer(row["ids"], np.int64)
            q_ids, queries = matrices(row["q_ids"], row["q_vectors"], dim)
            cells = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), dim)
            low, width = np.frombuffer(row["low"]), np.frombuffer(row["width"])
            for at in range(0, len(q_ids), 128):
                who = q_ids[at:at + 128]
                lower, upper = cell_bounds(cells, low, width, queries[at:at + 128])
                self_ = ids[None, :] == who[:, None]
                lower[self_], upper[self_] = -np.inf, -np.inf
                n = min(k, len(ids))
                kth = np.partition(lower, len(ids) - n, axis=1)[:, len(ids) - n]
                i, j = np.nonzero((upper >= kth[:, None]) & ~self_)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who[i]), pa.array(ids[j]), pa.array(lower[i, j]), pa.array(upper[i, j])],
                    names=["query_id", "vec_id", "lower", "upper"])

    bounds = materialise(shard_by_block(files, blocks).mapInArrow(
        scan, "query_id long, vec_id long, lower double, upper double"), "bounds")
    kth = Window.partitionBy("query_id").orderBy(F.desc("lower"), "vec_id")
    least = bounds.withColumn("r", F.row_number().over(kth)).filter(F.col("r") <= k) \
        .groupBy("query_id").agg(F.when(F.count("*") == k, F.min("lower")).alias("kth"))
    candidates = bounds.join(least, "query_id").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    # only these exact vectors are read
    exact = rows.select("vec_id", "vector")
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q_vector"))
    pairs = candidates.select("query_id", "vec_id", "upper").join(exact, "vec_id").join(queries, "query_id")
    pairs = pairs.repartition("query_id").sortWithinPartitions("query_id", F.desc("upper"), "vec_id") \
        .select("query_id", "vec_id", "upper", "vector", "q_vector")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, best = None, []   # the k best so far as (-score, vec_id), ascending

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([query] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()),
                 pa.array([v for _, v in best], pa.int64()), pa.array([-s for s, _ in best], pa.int64())],
                names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for now, vec_id, upper, vector, q_vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != query:
                    if best:
                        yield told()
                    query, best = now, []
                if len(best) == k and -best[-1][0] > upper:
                    continue   # the k-th result is certain
                score = exact_products(np.array(q_vector), np.array([vector]))[0]
                best = sorted([*best, (-score, vec_id)])[:k]
        if best:
            yield told()

    return pairs.mapInArrow(decide, "query_id long, rank int, vec_id long, score long")
