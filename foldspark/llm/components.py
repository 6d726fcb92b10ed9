"""Connected components of an edge table: stars inside bounded chunks, then alternating large-star and small-star steps
(Kiveris et al. 2014) on what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import materialise

#: Edges that a task turns into stars at once (about 100 bytes each).
CHUNK = 1 << 20


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is connected with) for every node of the edges that is not the smallest one itself."""
    nodes, code = np.unique(np.r_[u, v], return_inverse=True)
    a, b = code[:len(u)], code[len(u):]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        if (low == least[a]).all() and (low == least[b]).all():
            break
        for end in (least[a], least[b], a, b):
            np.minimum.at(least, end, low)
        while (least[least] != least).any():
            least = least[least]
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[moved], nodes[least[moved]]


def _chunk_stars(edges: DataFrame, chunk: int) -> DataFrame:
    """Edges (u, v) with ``u > v`` that connect the same nodes: the stars of every ``chunk`` edges of a partition."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            node, least = contract(*(np.concatenate(side) for side in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= chunk:
                yield close()
                held, size = [], 0
        if size:
            yield close()

    return edges.mapInArrow(stars, "u long, v long")


def connected_components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, component) for every node of ``edges (a, b)``; component is its smallest node.

    Chunks of edges become stars inside their task first, so only paths across chunks are left for the rounds; each round
    halves the depth of what is left.  Minima are aggregated before the shuffle and a node of any degree is a key of
    an ordinary join, never one collected list.  The joins are merge joins at every size: rounds of few edges would
    send a broadcast each through the driver otherwise.
    """
    given = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark = materialise(_chunk_stars(given, chunk), "edges"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        # large star: neighbours above a node go to the smallest node around it
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hub = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").hint("merge").join(hub, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .filter("u <> v")
        # small star: a node and its neighbours below go to the smallest of them
        hub = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.hint("merge").join(hub, "u")
        small = moved.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                              F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))) \
            .filter("u <> v").distinct()
        now = materialise(small, "edges")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
