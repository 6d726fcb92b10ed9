"""Histogram gradient boosting for many groups at once by merged partial sums.

A group is any key (candidate, fold, inner fold, ...): the trees of all groups grow in the same jobs.

* ``bin_edges``: exact interpolated quantiles of every feature on each group's rows.  ``binned`` writes the rows once, one
  byte a feature; nothing is exploded and the table is not rewritten while trees grow.
* A task walks its rows down the trees grown so far, computes gradients and adds them up in dense arrays of
  (node, feature, bin).  Gradients are 24-bit fixed-point numbers, so sums are exact integers: partitions, their order
  and repeated tasks cannot change a tree.
* The partial arrays, cut by feature, are merged where the best split is searched.  Only the smaller child of a split is
  summed; its sibling is the parent, which waits in the table of the level before, minus it.  The shuffle carries
  (tasks x nodes x features x bins) numbers however many rows there are, and is combined by task number first.
* One job per level.  Leaf-wise growth orders the splits by gain on the driver and asks for the children of every
  leaf that could still be split, so a tree takes as many jobs as it has levels, not one for each leaf.
* Where a task can hold the bins of any group (``LOCAL_BYTES``), each is dealt to one task, which adds up the same sums itself: one
  job for all trees.  It adds up only the cells that are not the most frequent of their feature (``_OwnRows``).

Margins are kept with the rows and written anew every ``refresh`` rounds; the trees since then are walked.  The driver
holds the trees and their splits, never rows or histograms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.operators.prep import quantiles_of
from foldspark.session import cut_lineage, delete_path, written

#: Gradients are whole numbers of this unit: sums are exact up to 2^38 rows of a node.
UNIT = 1 << 24
#: Features of a merged array: more partial sums are merged at more places, a place holds a bounded array.
CHUNK = 16
#: Rows of a group that one task may hold, in bytes of bins: the trees of such groups take no jobs of their own.
LOCAL_BYTES = 64 << 20
#: Rows of a group whose quantiles one task may find for a feature: its distinct values, at most 16 bytes each.
EDGE_ROWS = 1 << 23
#: Bytes of counted values that a task holds before it passes them on.
EDGE_BYTES = 32 << 20
#: Rows that are added up at a time: sums of 22-bit hessians and of counts share the 53 bits of a double.
OWN_ROWS = 1 << 14
#: Beyond this many tasks their partial arrays are merged in two levels, so many at a time in the first.
FAN_IN = 64


@dataclass
class Tree:
    """One tree of one group; node 0 is the root, children have larger numbers, feature -1 marks a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])     # summed hessians
    rows: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, bin_: int, gain: float) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.bin[node], self.gain[node] = feature, bin_, gain
        self.left[node], self.right[node] = left, left + 1
        for _ in range(2):
            for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0),
                                  (self.gain, 0.0), (self.cover, 0.0), (self.rows, 0)):
                column.append(empty)
        return left, left + 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.left, np.int32),
                np.array(self.right, np.int32), np.array(self.value))


def walk(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The leaf of every row (``bins``: rows x features)."""
    feature, cut, left, right, _ = tree
    node = np.zeros(len(bins), np.int32)
    rows = np.arange(len(bins))
    while True:
        wanted = feature[node]
        inner = wanted >= 0
        if not inner.any():
            return node
        below = bins[rows, np.maximum(wanted, 0)] <= cut[node]
        node = np.where(inner, np.where(below, left[node], right[node]), node)


def groups_of(df: DataFrame, group: list[str]) -> list[tuple]:
    """The distinct keys, in order: folds and candidates of a plan, a handful."""
    return in_order(tuple(r) for r in df.select(*group).distinct().collect())


def in_order(keys) -> list[tuple]:
    return sorted(keys, key=lambda k: tuple((v is not None, str(type(v)), v) for v in k))


def as_array(df: DataFrame, features: str) -> DataFrame:
    if isinstance(df.schema[features].dataType, T.ArrayType):
        return df
    return df.withColumn(features, vector_to_array(features))


def group_number(df: DataFrame, group: list[str], keys: list[tuple], out: str = "_g") -> DataFrame:
    """Adds the number of each row's key; rows of other keys go."""
    names = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in group)
    numbered = df.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(keys)], f"{names}, {out} int")
    same = [df[g].eqNullSafe(numbered[g]) for g in group]
    return df.join(F.broadcast(numbered), same).select(*[df[c] for c in df.columns], numbered[out])   # one row a group


def bin_edges(rows: DataFrame, n_groups: int, n_bins: int, most: int | None = None) -> list[list[np.ndarray]]:
    """Cut points of every feature of every group: the distinct exact quantiles i / n_bins.

    Values are counted before they are sorted, in the rows of a task first, so a frequent value is one row.  A task sorts the
    values of a feature of a group; where the largest group has more than ``EDGE_ROWS`` (``most``, or not known) they are sorted
    over the cluster.  The result has groups x features x ``n_bins`` numbers, as the model has.
    """
    qs = [i / n_bins for i in range(1, n_bins)]
    if most is None or most > EDGE_ROWS:
        return _sorted_edges(rows, n_groups, qs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (k, f), pieces in held.items():
                values, counts = _counted(pieces)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([f], pa.int32()),
                                                  pa.array([values.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())],
                                                 names=["side", "col_name", "num", "c"])
            held.clear()

        for batch in batches:
            g, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            for k in np.unique(g):
                for f, v in enumerate(x[g == k].T):
                    found = np.unique(v[~np.isnan(v)] + 0.0, return_counts=True)
                    held.setdefault((int(k), f), []).append(found)
                    size += 16 * len(found[0])
            if size > EDGE_BYTES:
                yield from out()
                size = 0
        yield from out()

    def quantiles(part: pa.Table) -> pa.Table:
        values, counts = _counted([(np.frombuffer(v), np.frombuffer(c, np.int64)) for v, c in
                                   zip(part.column("num").to_pylist(), part.column("c").to_pylist(), strict=True)])
        found = np.empty(0)
        if len(values):
            upto = np.cumsum(counts)
            at = np.array(qs) * float(upto[-1] - 1)
            low = np.floor(at)
            below, above = (values[np.searchsorted(upto, r)] for r in (low + 1, np.where(at > low, low + 2, low + 1)))
            found = np.where(at > low, below + (above - below) * (at - low), below)
        return pa.table({"side": part.column("side")[:1], "col_name": part.column("col_name")[:1], "quantiles": pa.array([found.tobytes()], pa.binary())})

    counted = rows.select("_g", "features").mapInArrow(count, "side int, col_name int, num binary, c binary")
    found = counted.groupBy("side", "col_name").applyInArrow(quantiles, "side int, col_name int, quantiles binary").collect()
    width = max((r["col_name"] for r in found), default=-1) + 1          # groups x features rows of ``n_bins`` numbers
    edges = [[np.empty(0)] * width for _ in range(n_groups)]
    for r in found:
        edges[r["side"]][r["col_name"]] = np.unique(np.frombuffer(r["quantiles"]))
    return edges


def _counted(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs, from such pieces."""
    if len(pieces) == 1:
        return pieces[0]
    values, counts = (np.concatenate(c) for c in zip(*pieces, strict=True))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.r_[True, values[1:] > values[:-1]]) if len(values) else np.empty(0, int)
    return values[first], (np.add.reduceat(counts, first) if len(first) else counts)


def _sorted_edges(rows: DataFrame, n_groups: int, qs: list[float]) -> list[list[np.ndarray]]:
    """``bin_edges`` where no task can hold the values of a feature: they are sorted over the cluster."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            for k in np.unique(g) if x.shape[1] else []:
                found = [np.unique(v[~np.isnan(v)], return_counts=True) for v in x[g == k].T]
                sizes = [len(v) for v, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(sum(sizes), k, np.int32)), pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)),
                     pa.array(np.concatenate([v for v, _ in found])), pa.array(np.concatenate([c for _, c in found]))],
                    names=["side", "col_name", "num", "c"])

    counts = rows.select("_g", "features").mapInArrow(count, "side int, col_name int, num double, c long") \
        .groupBy("side", "col_name", "num").agg(F.sum("c").alias("c"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut_lineage(counts.repartitionByRange(parts, "col_name", "num").withColumn("pid", F.spark_partition_id()))
    found = quantiles_of(counts, qs)
    width = rows.agg(F.max(F.size("features"))).first()[0] or 0
    edges = [[np.empty(0)] * width for _ in range(n_groups)]
    for r in found.collect():           # groups x features rows of ``n_bins`` numbers
        edges[r["side"]][r["col_name"]] = np.unique(r["quantiles"])
    return edges


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Number of cut points below each value; missing values lie above all."""
    out = np.zeros(x.shape, np.uint8)
    for f in range(x.shape[1]):
        out[:, f] = np.searchsorted(edges[f], x[:, f], side="left")
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; shorter lists are filled with missing values."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(offsets)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        return values[offsets[0]:offsets[-1]].reshape(len(sizes), width)
    out = np.full((len(sizes), width), np.nan)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, :b - a] = values[a:b]
    return out


def binned(rows: DataFrame, edges: list[list[np.ndarray]]) -> DataFrame:
    """(_g, label, margin, bins, row_key): the training rows as the growers read them, sorted by group."""
    shared = rows.sparkSession.sparkContext.broadcast(edges)
    width = len(edges[0])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            g, x = batch.column(0).to_numpy(), matrix(batch.column(2))
            bins = np.zeros((len(x), width), np.uint8)
            for k in np.unique(g):
                bins[g == k, :x.shape[1]] = to_bins(x[g == k], own[k][:x.shape[1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.zeros(len(g))),
                                              pa.array([b.tobytes() for b in bins], pa.binary()), batch.column(3)],
                                             names=["_g", "label", "margin", "bins", "row_key"])

    table = rows.select("_g", F.col("label").cast("double").alias("label"), "features", "row_key")
    return table.mapInArrow(convert, "_g int, label double, margin double, bins binary, row_key long").sortWithinPartitions("_g")


class TrainingRows:
    """The rows that learners of the same groups share: written once, cut into bins once.

    ``rows``: (_g, label, row_key, features) sorted by group; ``table``: the same in bins.  Rows with a null label take no part;
    ``key`` is the column that keys a bootstrap.  ``same``: the values of the first group column that have the rows of a value
    found in ``df``; their rows are written and cut into bins once.
    """

    def __init__(self, df: DataFrame, group: list[str], label: str, features: str, key: str | None = None, n_bins: int = 32,
                 same: dict | None = None):
        self.group, self.n_bins, self.keyed = list(group), n_bins, key is not None
        given = as_array(df, features).filter(F.col(label).isNotNull())
        sizes = {tuple(r[:-1]): r["_n"] for r in given.groupBy(*self.group).agg(F.count(F.lit(1)).alias("_n")).collect()}   # one row a group
        written = in_order(sizes)
        own = {(v, *k[1:]): i for i, k in enumerate(written) for v in same[k[0]]} if same else {k: i for i, k in enumerate(written)}
        self.keys = in_order(own)
        self._of = [own[k] for k in self.keys]           # the written group of every group
        self.counts = [sizes[written[i]] for i in self._of]
        self.alone = self._of == list(range(len(written)))
        self._edges = self._table = self._cached = None
        if self.keys:
            row_key = F.lit(0).cast("long") if key is None else F.xxhash64(F.col(key).cast("string"))
            rows = group_number(given.select(*group, F.col(label).cast("double").alias("label"), row_key.alias("row_key"),
                                             F.col(features).cast("array<double>").alias("features")), self.group, written)
            self._rows = cut_lineage(rows.select("_g", "label", "row_key", "features").sortWithinPartitions("_g"))
            self.rows = self._spread(self._rows)

    def _spread(self, table: DataFrame) -> DataFrame:
        """The rows of every group from those of the written groups."""
        if self.alone:
            return table
        groups = table.sparkSession.createDataFrame([(d, g) for g, d in enumerate(self._of)], "_d int, _g int")
        return table.withColumnRenamed("_g", "_d").join(F.broadcast(groups), "_d").select(table.columns)        # one row a group

    def edges(self) -> list[list[np.ndarray]]:
        if self._edges is None:
            found = bin_edges(self._rows, max(self._of) + 1, self.n_bins, max(self.counts))
            self._edges = [found[i] for i in self._of]
        return self._edges

    def table(self) -> DataFrame:
        if self._table is None:
            edges = self.edges()
            self._cached = cut_lineage(binned(self._rows, [edges[self._of.index(i)] for i in range(max(self._of) + 1)])).persist()
            self._table = self._spread(self._cached)
        return self._table

    def release(self) -> None:
        if self._table is not None:
            self._cached.unpersist()
            self._table = self._cached = None


def bin_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of bytes, all of one length, as a matrix that reads the column's memory."""
    if isinstance(column, pa.ChunkedArray):
        parts = [bin_matrix(c) for c in column.chunks if len(c)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros((0, 0), np.uint8)
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return raw.reshape(len(column), len(raw) // max(len(column), 1))


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the logistic loss, in units of 1 / UNIT."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.floor((p - label) * UNIT + 0.5), np.floor(np.maximum(p * (1 - p), 1e-16) * UNIT + 0.5)


@dataclass
class Settings:
    lam: float
    min_child_weight: float
    width: int
    n_bins: int


#: Columns of a merged array: 0 at parent = the level before, else partial sums of the smaller child of ``node``.
MERGE_SCHEMA = "_g int, node int, chunk int, part int, sums binary"
LEVEL_SCHEMA = ("_g int, node int, chunk int, sums binary, gain double, feature int, bin int, g_left long, h_left long, "
                "n_left long, g_all long, h_all long, n_all long")


def partial_sums(rows: DataFrame, since: list[list[tuple]], growing: list[tuple | None], slots: list[dict[int, int]],
                 cfg: Settings) -> DataFrame:
    """(_g, node, chunk, part, sums): each task's sums of (gradient, hessian, rows) by feature and bin.

    ``since``: for every group the trees that ``margin`` lacks; ``growing``: the tree that grows; ``slots``: for every group
    its leaves that are summed (leaf -> the name the sums get).
    """
    shared = rows.sparkSession.sparkContext.broadcast((since, growing, slots))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        done, now, wanted = shared.value
        part = TaskContext.get().partitionId()
        sums: dict[tuple[int, int], np.ndarray] = {}
        size = cfg.width * cfg.n_bins
        for batch in batches:
            all_g = batch.column(0).to_numpy()
            # rows come sorted by group: the arrays of a group that is over leave the task
            for name in [n for n in sums if len(all_g) and n[0] < all_g.min()]:
                yield _sum_rows(*name, part, sums.pop(name), cfg)
            for k in np.unique(all_g):
                if not wanted[k]:
                    continue
                own = np.flatnonzero(all_g == k)
                part_of = batch.take(pa.array(own)) if len(own) < len(all_g) else batch
                bins = bin_matrix(part_of.column(3))
                leaf = walk(now[k], bins)
                chosen = np.flatnonzero(np.isin(leaf, list(wanted[k])))
                if not len(chosen):
                    continue
                bins, leaf = bins[chosen], leaf[chosen]
                margin = part_of.column(2).to_numpy()[chosen]
                for tree in done[k]:
                    margin = margin + tree[4][walk(tree, bins)]
                grad, hess = gradients(margin, part_of.column(1).to_numpy()[chosen])
                at = bins.astype(np.int64) + np.arange(cfg.width) * cfg.n_bins
                for node, name in wanted[k].items():
                    here = leaf == node
                    if here.any():
                        flat, n = at[here].ravel(), int(here.sum())
                        held = sums.setdefault((int(k), name), np.zeros((3, size)))
                        held[0] += np.bincount(flat, np.repeat(grad[here], cfg.width), size)
                        held[1] += np.bincount(flat, np.repeat(hess[here], cfg.width), size)
                        held[2] += np.bincount(flat, minlength=size)
        for (g, name), held in sums.items():
            yield _sum_rows(g, name, part, held, cfg)

    return rows.mapInArrow(add, MERGE_SCHEMA)


def _sum_rows(g: int, name: int, part: int, held: np.ndarray, cfg: Settings) -> pa.RecordBatch:
    """A (3, features x bins) array as rows of ``CHUNK`` features."""
    step = CHUNK * cfg.n_bins
    pieces = [held[:, a:a + step].astype(np.int64).tobytes() for a in range(0, held.shape[1], step)]
    n = len(pieces)
    return pa.RecordBatch.from_arrays(
        [pa.array([g] * n, pa.int32()), pa.array([name] * n, pa.int32()), pa.array(range(n), pa.int32()),
         pa.array([part] * n, pa.int32()), pa.array(pieces, pa.binary())], names=["_g", "node", "chunk", "part", "sums"])


def combined(partial: DataFrame) -> DataFrame:
    """Partial arrays added up by groups of ``FAN_IN`` tasks, so that the last merge reads few rows for each key."""
    keys = ["_g", "node", "chunk", "part"]
    dealt = partial.withColumn("part", F.expr(f"part div {FAN_IN}")).repartition(*keys).sortWithinPartitions(*keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, pieces in _runs(batches, 4):
            total = sum(np.frombuffer(p, np.int64) for _, p in pieces)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in key] + [pa.array([total.tobytes()], pa.binary())],
                                             names=[*keys, "sums"])

    return dealt.mapInArrow(merge, MERGE_SCHEMA)


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple[int, bytes]]]]:
    """Runs of rows whose first ``n_keys`` columns are equal, each as a stream of (part, sums): one array is held at a time."""

    def rows():
        for batch in batches:
            keys = zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True)
            column = batch.column(4)
            for i, key in enumerate(keys):
                yield key, column[i].as_py()

    for key, run in groupby(rows(), key=lambda r: r[0][:n_keys]):
        yield key, ((k[3], v) for k, v in run)


def best_split(sums: np.ndarray, first_feature: int, cfg: Settings) -> tuple:
    """(gain, feature, bin, left sums) of the best split of some features; ``sums`` is (3, features, bins) of integers.

    gain = GL^2 / (HL + lam) + GR^2 / (HR + lam) - G^2 / (H + lam); ties: smallest feature, then bin.
    """
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    total = sums.sum(axis=2)[:, :, None]
    right = total - left
    (gl, hl), (gr, hr), (gt, ht) = (x[:2] / UNIT for x in (left, right, total))
    gain = gl * gl / (hl + cfg.lam) + gr * gr / (hr + cfg.lam) - gt * gt / (ht + cfg.lam)
    usable = (left[2] > 0) & (right[2] > 0) & (hl >= cfg.min_child_weight) & (hr >= cfg.min_child_weight)
    gain = np.where(usable, gain, -np.inf)
    f, b = divmod(int(gain.argmax()), gain.shape[1]) if gain.size else (0, 0)
    best = float(gain[f, b]) if gain.size else -np.inf
    return best, first_feature + f, b, (left[:, f, b] if gain.size else np.zeros(3, np.int64))


def merged_level(partial: DataFrame, parents: DataFrame | None, children: list[dict[int, tuple[int, int]]],
                 cfg: Settings, tasks: int) -> DataFrame:
    """The arrays of new nodes and their best split by chunk of features (``LEVEL_SCHEMA``).

    ``children[g]``: parent -> (the child that was summed, its sibling); for the root, parent -1 -> (0, 0).  Sums of a child
    carry the parent's number, so that they meet the parent's array of the level before.
    """
    rows = combined(partial) if tasks > FAN_IN else partial
    if parents is not None:
        needed = sorted({p for own in children for p in own})
        rows = rows.unionByName(parents.filter(F.col("node").isin(needed)).select(
            "_g", "node", "chunk", F.lit(-1).alias("part"), "sums"))
    keys = ["_g", "node", "chunk"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "part")
    shared = partial.sparkSession.sparkContext.broadcast(children)
    names = [c.split()[0] for c in LEVEL_SCHEMA.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for (g, parent, chunk), pieces in _runs(batches, 3):
            if parent not in wanted[g]:
                for _ in pieces:
                    pass
                continue
            small, sibling = wanted[g][parent]
            above, total = None, 0
            for part, piece in pieces:
                array = np.frombuffer(piece, np.int64)
                if part < 0:
                    above = array
                else:
                    total = total + array
            if isinstance(total, int):           # no row fell into the smaller child of any task
                total = np.zeros_like(above)
            found = [(small, total)] if above is None else [(small, total), (sibling, above - total)]
            for node, array in found:
                sums = array.reshape(3, -1, cfg.n_bins)
                gain, feature, cut, left = best_split(sums, chunk * CHUNK, cfg)
                whole = sums[:, 0, :].sum(axis=1)
                values = [g, node, chunk, array.tobytes(), gain, feature, cut, *left.tolist(), *whole.tolist()]
                types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.int32(), pa.int32()] + [pa.int64()] * 6
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    return dealt.select(*keys, "part", "sums").mapInArrow(search, LEVEL_SCHEMA)


class _Growth:
    """The trees of one round, all groups."""

    def __init__(self, n_groups: int, since: list[list[tuple]], rows: DataFrame, cfg: Settings, tasks: int):
        self.rows, self.since, self.cfg, self.tasks = rows, since, cfg, tasks
        self.trees = [Tree() for _ in range(n_groups)]
        self.stats: list[dict[int, tuple]] = [{} for _ in range(n_groups)]     # node -> best split and sums
        self.level_of: list[dict[int, int]] = [{} for _ in range(n_groups)]    # node -> number of the level that holds its sums
        self.held: list[DataFrame] = []
        self.paths: list[str] = []

    def measure(self, split: list[list[int]]) -> None:
        """Sums and best splits of the children of the given nodes of each group (an empty tree: of its root)."""
        slots, children = [], []
        for tree, nodes, known in zip(self.trees, split, self.stats, strict=True):
            own: dict[int, tuple[int, int]] = {}
            if not known:
                own[-1] = (0, 0)
            for node in nodes:
                left, right = tree.left[node], tree.right[node]
                n_left, n_all = known[node][5], known[node][8]
                own[node] = (left, right) if 2 * n_left <= n_all else (right, left)
            children.append(own)
            slots.append({small: parent for parent, (small, _) in own.items()})
        partial = partial_sums(self.rows, self.since, [t.arrays() for t in self.trees], slots, self.cfg)
        wanted = sorted({level[p] for own, level in zip(children, self.level_of, strict=True) for p in own if p >= 0})
        parents = reduce(DataFrame.unionByName, [self.held[i] for i in wanted]) if wanted else None
        level, path = written(merged_level(partial, parents, children, self.cfg, self.tasks), "level")
        self.paths.append(path)
        for r in level.drop("sums").collect():     # nodes x chunks of features
            key = (-r["gain"], r["feature"], r["bin"])
            known = self.stats[r["_g"]]
            if r["node"] not in known or key < known[r["node"]][0]:
                known[r["node"]] = (key, r["feature"], r["bin"], r["g_left"], r["h_left"], r["n_left"], r["g_all"], r["h_all"],
                                    r["n_all"])
            self.level_of[r["_g"]][r["node"]] = len(self.held)
        self.held.append(level)

    def gain(self, g: int, node: int) -> float:
        return -self.stats[g][node][0][0] if node in self.stats[g] else float("-inf")

    def finish(self, rates: list[float]) -> list[tuple]:
        for tree, known, rate in zip(self.trees, self.stats, rates, strict=True):
            for node in range(len(tree.feature)):
                if node in known:
                    g_all, h_all, n_all = known[node][6:9]
                    tree.cover[node], tree.rows[node] = h_all / UNIT, n_all
                    if tree.feature[node] < 0:
                        tree.value[node] = -(g_all / UNIT) / (h_all / UNIT + self.cfg.lam) * rate
        for path in self.paths:
            delete_path(self.rows.sparkSession, path)
        return [t.arrays() for t in self.trees]


#: Smallest gain that splits a node.
LEAST_GAIN = 1e-6


def _grow_depthwise(growth: _Growth, depths: list[int]) -> None:
    """Level by level, each group to its own depth."""
    frontier = [[0] for _ in growth.trees]
    growth.measure([[] for _ in growth.trees])
    for depth in range(max(depths)):
        split, last = [], []
        for g, (tree, nodes) in enumerate(zip(growth.trees, frontier, strict=True)):
            chosen = [n for n in nodes if growth.gain(g, n) > LEAST_GAIN] if depth < depths[g] else []
            for n in chosen:
                _, feature, cut = growth.stats[g][n][:3]
                tree.split(n, feature, cut, growth.gain(g, n))
            deeper = depth + 1 < depths[g]
            split.append(chosen if deeper else [])
            last.append([] if deeper else chosen)
        _children_sums(growth, last)
        if not any(split):
            return
        growth.measure(split)
        frontier = [[c for n in nodes for c in (t.left[n], t.right[n])] for t, nodes in zip(growth.trees, split, strict=True)]


def _children_sums(growth: _Growth, split: list[list[int]]) -> None:
    """Sums of the last children, known from their parents' splits: no job."""
    for tree, nodes, known in zip(growth.trees, split, growth.stats, strict=True):
        for n in nodes:
            _, _, _, gl, hl, nl, g, h, rows = known[n]
            none = (float("inf"), 0, 0)
            known[tree.left[n]] = (none, 0, 0, 0, 0, 0, gl, hl, nl)
            known[tree.right[n]] = (none, 0, 0, 0, 0, 0, g - gl, h - hl, rows - nl)


def _grow_leafwise(growth: _Growth, most: list[int]) -> None:
    """Best-first: the leaf of largest gain is split until a group has its number of leaves; ties: the node made first.

    Splits are played through on what is known; the children met on the way that are not measured are measured in one job,
    then it is played again.  The first unmeasured one is needed for sure, the others most likely.
    """
    growth.measure([[] for _ in growth.trees])
    full = [Tree() for _ in growth.trees]              # all measured splits
    made: list[dict[int, bool]] = [{} for _ in growth.trees]   # split nodes of the full tree; True: children measured
    order: list[list[int]] = [[] for _ in growth.trees]
    while True:
        wanted = []
        for g, tree in enumerate(full):
            leaves, chosen, missing = {0}, [], []
            while len(leaves) < most[g]:
                best = max(leaves, key=lambda n: (growth.gain(g, n) if n in growth.stats[g] else float("-inf"), -n))
                if not growth.gain(g, best) > LEAST_GAIN:
                    break
                leaves.discard(best)
                chosen.append(best)
                if made[g].get(best):
                    leaves |= {tree.left[best], tree.right[best]}
                else:
                    missing.append(best)
                    leaves |= {-2 * best - 1, -2 * best - 2}       # not measured: known to no table
            last = chosen[-1:] if len(leaves) >= most[g] else []
            order[g] = chosen
            wanted.append([n for n in missing if [n] != last or len(missing) > 1])
        if not any(wanted):
            break
        growth.trees, split = full, []
        for g, nodes in enumerate(wanted):
            for n in nodes:
                _, feature, cut = growth.stats[g][n][:3]
                full[g].split(n, feature, cut, growth.gain(g, n))
                made[g][n] = True
            split.append(nodes)
        growth.measure(split)
    # the tree itself: the chosen splits, in their order
    growth.trees = []
    for g, chosen in enumerate(order):
        own, number, stats = Tree(), {0: 0}, {}
        for n in chosen:
            _, feature, cut = growth.stats[g][n][:3]
            a, b = own.split(number[n], feature, cut, growth.gain(g, n))
            stats[number[n]] = growth.stats[g][n]
            _, _, _, gl, hl, nl, gs, hs, rows = growth.stats[g][n]
            none = (float("inf"), 0, 0)
            stats[a], stats[b] = (none, 0, 0, 0, 0, 0, gl, hl, nl), (none, 0, 0, 0, 0, 0, gs - gl, hs - hl, rows - nl)
            if made[g].get(n):
                number[full[g].left[n]], number[full[g].right[n]] = a, b
        stats.setdefault(0, growth.stats[g].get(0, ((float("inf"), 0, 0), 0, 0, 0, 0, 0, 0, 0, 0)))
        growth.stats[g] = stats
        growth.trees.append(own)


class _OwnRows:
    """The rows of one group that are here: bins by feature, and of every row the cells (feature, bin) that are not the most
    frequent of their feature, filled up with a cell that does not count."""

    def __init__(self, bins: np.ndarray, cfg: Settings):
        self.n, width = len(bins), cfg.width
        self.columns, self.cfg, self.size = np.ascontiguousarray(bins.T), cfg, width * cfg.n_bins
        usual = [int(np.bincount(c, minlength=cfg.n_bins).argmax()) for c in self.columns]
        self.usual = np.arange(width), np.array(usual, np.int64)
        pieces = []
        for at in range(0, self.n, OWN_ROWS):
            rows = bins[at:at + OWN_ROWS]
            who, what = np.nonzero(rows != self.usual[1])
            n = np.bincount(who, minlength=len(rows))
            cells = np.full((len(rows), n.max(initial=0)), self.size, np.uint16 if self.size < 1 << 16 else np.uint32)
            cells[who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)] = what * cfg.n_bins + rows[who, what]
            pieces.append(cells)
        self.cells = np.full((self.n, max((c.shape[1] for c in pieces), default=0)), self.size, np.uint16 if self.size < 1 << 16 else np.uint32)
        for i, c in enumerate(pieces):
            self.cells[i * OWN_ROWS:i * OWN_ROWS + len(c), :c.shape[1]] = c

    def sums(self, rows: np.ndarray | None, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        """(3, features x bins): gradients, hessians and numbers of some rows (all if none are named)."""
        total, m, whole = np.zeros((3, self.size + 1)), self.cells.shape[1], np.zeros(3)
        one = float(1 << 38)
        for at in range(0, self.n if rows is None else len(rows), OWN_ROWS):
            part = slice(at, at + OWN_ROWS) if rows is None else rows[at:at + OWN_ROWS]
            flat, g, h = self.cells[part].ravel().astype(np.intp), grad[part], hess[part]
            both = np.bincount(flat, np.repeat(h + one, m), self.size + 1)
            n = np.floor(both / one)
            total[0] += np.bincount(flat, np.repeat(g, m), self.size + 1)
            total[1] += both - n * one
            total[2] += n
            whole += g.sum(), h.sum(), len(g)
        out = total[:, :-1].reshape(3, self.cfg.width, self.cfg.n_bins)
        out[:, *self.usual] = whole[:, None] - out.sum(axis=2)
        return out.reshape(3, -1).astype(np.int64)

    def below(self, rows: np.ndarray | None, feature: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that go left and right."""
        column = self.columns[feature]
        if rows is None:
            left = column <= cut
            return np.flatnonzero(left).astype(np.int32), np.flatnonzero(~left).astype(np.int32)
        left = column[rows] <= cut
        return rows[left], rows[~left]

    def add_values(self, margin: np.ndarray, tree: tuple[np.ndarray, ...]) -> None:
        """Adds the value of each row's leaf."""
        feature, cut, left, right, value = tree
        todo: list[tuple[int, np.ndarray | None]] = [(0, None)]
        while todo:
            node, rows = todo.pop()
            if feature[node] < 0:
                margin[slice(None) if rows is None else rows] += value[node]
            else:
                a, b = self.below(rows, feature[node], cut[node])
                todo += [(left[node], a), (right[node], b)]


class _OwnGrowth(_Growth):
    """The tree of one round of one group whose rows are here, with their ``grad`` and ``hess``."""

    def __init__(self, here: _OwnRows, grad: np.ndarray, hess: np.ndarray, cfg: Settings):
        super().__init__(1, [], None, cfg, 1)
        self.here, self.grad, self.hess = here, grad, hess
        self.sums: dict[int, np.ndarray] = {}
        self.own: dict[int, np.ndarray | None] = {0: None}       # the rows of a node

    def measure(self, split: list[list[int]]) -> None:
        tree, known = self.trees[0], self.stats[0]
        found = {} if known else {0: self.here.sums(None, self.grad, self.hess)}
        for node in split[0]:
            left, right = tree.left[node], tree.right[node]
            self.own[left], self.own[right] = self.here.below(self.own.pop(node), tree.feature[node], tree.bin[node])
            small, sibling = (left, right) if 2 * known[node][5] <= known[node][8] else (right, left)
            found[small] = self.here.sums(self.own[small], self.grad, self.hess)
            found[sibling] = self.sums.pop(node) - found[small]
        self.sums |= found
        for node, array in found.items():
            sums = array.reshape(3, -1, self.cfg.n_bins)
            gain, feature, cut, left = best_split(sums, 0, self.cfg)
            known[node] = ((-gain, feature, cut), feature, cut, *left.tolist(), *sums[:, 0, :].sum(axis=1).tolist())


def _fit_groups(table: DataFrame, cfg: Settings, n_groups: int, n_rounds: int, depths: list[int] | None, leaves: list[int] | None,
                rates: list[float]) -> list[list[Tree]]:
    """``fit_boosted`` where a task can hold any group: the trees by round and group, from one job."""
    sc = table.sparkSession.sparkContext

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        g, here, label = rows.column("_g")[0].as_py(), _OwnRows(bin_matrix(rows.column("bins")), cfg), rows.column("label").to_numpy()
        del rows
        margin, models = np.zeros(len(label)), []
        for _ in range(n_rounds):
            growth = _OwnGrowth(here, *gradients(margin, label), cfg)
            if leaves is None:
                _grow_depthwise(growth, [depths[g]])
            else:
                _grow_leafwise(growth, [leaves[g]])
            here.add_values(margin, growth.finish([rates[g]])[0])
            t = growth.trees[0]
            models.append(np.array([t.feature, t.bin, t.left, t.right, t.rows, t.value, t.gain, t.cover], float).tobytes())
        return pa.table({"_g": pa.array([g] * n_rounds, pa.int32()), "round": pa.array(range(n_rounds), pa.int32()),
                         "model": pa.array(models, pa.binary())})

    parts = max(4 * sc.defaultParallelism, min(2 * n_groups, 4096))     # about a group each
    dealt = table.select("_g", "label", "bins").repartition(parts, "_g")
    trees: list[list[Tree]] = [[Tree() for _ in range(n_groups)] for _ in range(n_rounds)]
    for r in dealt.groupBy("_g").applyInArrow(fit, "_g int, round int, model binary").collect():      # the trees
        model = np.frombuffer(r["model"]).reshape(8, -1)
        feature, cut, left, right, n_rows = (column.astype(int).tolist() for column in model[:5])
        trees[r["round"]][r["_g"]] = Tree(feature, cut, left, right, *(column.tolist() for column in model[5:]), n_rows)
    return trees


@dataclass
class BoostedScorer:
    """What a task needs of a booster; rows come as group numbers and a matrix."""

    edges: list[list[np.ndarray]]
    trees: list[list[tuple]]

    def margins(self, g: np.ndarray, values: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(g))
        for k in np.unique(g):
            own = g == k
            bins = to_bins(values[own], self.edges[k][:values.shape[1]])
            for tree in self.trees[k]:
                margin[own] += tree[4][walk(tree, bins)]
        return margin

    def probabilities(self, g: np.ndarray, values: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margins(g, values)))


class Boosted:
    """A fitted booster: for every group its cut points and trees; probabilities from the sum of leaf values."""

    def __init__(self, group: list[str], keys: list[tuple], edges: list[list[np.ndarray]], trees: list[list[Tree]]):
        self.group, self.keys, self.edges, self.trees = group, keys, edges, trees    # trees[round][group]

    def predict(self, df: DataFrame, keep: list[str], features: str = "features") -> DataFrame:
        """(keep..., margin, proba)."""
        x = group_number(as_array(df, features), self.group, self.keys).select(*keep, "_g", F.col(features).alias("_x"))
        shared = df.sparkSession.sparkContext.broadcast(self.scorer())
        schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_columns
                margin = shared.value.margins(batch.column(n - 2).to_numpy(), matrix(batch.column(n - 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(margin), pa.array(1.0 / (1.0 + np.exp(-margin)))],
                                                 names=[*keep, "margin", "proba"])

        return x.mapInArrow(score, schema + "margin double, proba double")

    def scorer(self) -> BoostedScorer:
        return BoostedScorer(self.edges, [[t.arrays() for t in own] for own in zip(*self.trees, strict=True)] or [[] for _ in self.keys])

    def nodes(self, spark) -> DataFrame:
        """(group..., tree, path, feature, threshold, value, gain, cover, n_rows): the model as a table.

        ``path`` is the way from the root (L and R); ``feature`` -1 marks a leaf; values up to ``threshold`` go left.
        """
        rows = []
        for t, own in enumerate(self.trees):
            for key, edges, tree in zip(self.keys, self.edges, own, strict=True):
                path = {0: ""}
                for i, f in enumerate(tree.feature):      # children have larger numbers
                    if f >= 0:
                        path[tree.left[i]], path[tree.right[i]] = path[i] + "L", path[i] + "R"
                        rows.append((*[str(v) for v in key], t, path[i], f, float(edges[f][tree.bin[i]]), None, tree.gain[i],
                                     tree.cover[i], tree.rows[i]))
                    else:
                        rows.append((*[str(v) for v in key], t, path[i], -1, None, tree.value[i], None, tree.cover[i], tree.rows[i]))
        names = ", ".join(f"{g} string" for g in self.group)
        return spark.createDataFrame(rows, f"{names}, tree int, path string, feature int, threshold double, value double, "
                                           "gain double, cover double, n_rows long")


def by_key(value, keys: list[tuple]) -> list:
    """A setting of every group: one value for all, or a function of the group's key."""
    return [value(k) if callable(value) else value for k in keys]


def fit_boosted(df: DataFrame, group: list[str], label: str = "label", features: str = "features", n_rounds: int = 200,
                max_depth=4, num_leaves=None, rate=0.2, lam: float = 1.0, min_child_weight: float = 1.0, n_bins: int = 32,
                refresh: int = 25, shared: TrainingRows | None = None) -> Boosted:
    """Logistic boosting of every group in the same jobs, from probability one half.

    ``num_leaves`` unset: level by level to ``max_depth`` (G3); set: best leaf first (G4), whatever its depth.  These two and
    ``rate`` may be functions of a group's key.
    Rows with a null label take no part; missing values go right; an empty table gives a model without groups.
    ``shared``: the rows of ``df`` as another learner of the same groups and bins has read them.
    """
    if not 2 <= n_bins <= 256:
        raise ValueError("n_bins: 2 to 256, a bin is a byte")
    group = list(group)
    own = shared or TrainingRows(df, group, label, features, n_bins=n_bins)
    keys = own.keys
    if not keys:
        return Boosted(group, [], [], [])
    edges, table = own.edges(), own.table()
    cfg = Settings(lam, min_child_weight, len(edges[0]), own.n_bins)
    if max(own.counts) * cfg.width <= LOCAL_BYTES:
        depths, leaves = (None, by_key(num_leaves, keys)) if num_leaves is not None else (by_key(max_depth, keys), None)
        trees = _fit_groups(table, cfg, len(keys), n_rounds, depths, leaves, by_key(rate, keys))
        if shared is None:
            own.release()
        return Boosted(group, keys, edges, trees)
    tasks = table.rdd.getNumPartitions()
    trees: list[list[Tree]] = []
    since: list[list[tuple]] = [[] for _ in keys]
    for r in range(n_rounds):
        growth = _Growth(len(keys), since, table, cfg, tasks)
        if num_leaves is None:
            _grow_depthwise(growth, by_key(max_depth, keys))
        else:
            _grow_leafwise(growth, by_key(num_leaves, keys))
        for done, tree in zip(since, growth.finish(by_key(rate, keys)), strict=True):
            done.append(tree)
        trees.append(growth.trees)
        if (r + 1) % refresh == 0 and r + 1 < n_rounds:
            old, table = table, cut_lineage(_with_margins(table, since)).persist()
            if old is not own.table():
                old.unpersist()
            since = [[] for _ in keys]
    if table is not own.table():
        table.unpersist()
    if shared is None:
        own.release()
    return Boosted(group, keys, edges, trees)


def _with_margins(table: DataFrame, since: list[list[tuple]]) -> DataFrame:
    """The rows with the leaf values of some trees added to their margins."""
    shared = table.sparkSession.sparkContext.broadcast(since)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = shared.value
        for batch in batches:
            g, margin = batch.column(0).to_numpy(), batch.column(2).to_numpy().copy()
            bins = bin_matrix(batch.column(3))
            for k in np.unique(g):
                own = g == k
                for tree in done[k]:
                    margin[own] += tree[4][walk(tree, bins[own])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(margin), batch.column(3)],
                                             names=["_g", "label", "margin", "bins"])

    return table.mapInArrow(add, "_g int, label double, margin double, bins binary")
