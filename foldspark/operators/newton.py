"""Logistic regression of many groups at once by Newton steps.

A group is any key (candidate, fold, inner fold, ...).  Each step is one job for all groups: a task adds up its rows'
gradients and cross-products (weighted by ``p (1 - p)``) in dense arrays of one group, the arrays are merged by group,
and the driver solves one small system for each group.  Only (features + 1)^2 numbers a group leave the cluster,
however many rows there are; the rows are read, never rewritten.

The optimum is that of ``C * sum(weight * log loss) + |w|^2 / 2`` with a free intercept.  A step that does not lower the
objective is halved; a group stops when its gradient is ``tol`` times that at the start, or after ``max_iter`` steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.grow import as_array, by_key, group_number, groups_of, matrix
from foldspark.session import cut_lineage

#: Beyond this many tasks their arrays are merged in two levels, so many at a time in the first.
FAN_IN = 64


@dataclass
class LinearScorer:
    """What a task needs of a fitted model; rows come as group numbers and a matrix."""

    weights: list[np.ndarray]

    def probabilities(self, g: np.ndarray, values: np.ndarray) -> np.ndarray:
        z = np.zeros(len(g))
        for k in np.unique(g):
            at, w = g == k, self.weights[k]
            z[at] = w[0] + values[at][:, :len(w) - 1] @ w[1:]
        return _sigmoid(z)


@dataclass
class Fitted:
    """Coefficients of every group: ``weights[g]`` holds the intercept first."""

    group: list[str]
    keys: list[tuple]
    weights: list[np.ndarray]
    steps: list[int]

    def predict(self, df: DataFrame, keep: list[str], features: str = "features") -> DataFrame:
        """(keep..., proba); rows of groups that were not fitted go."""
        x = group_number(as_array(df, features), self.group, self.keys).select(*keep, "_g", F.col(features).alias("_x"))
        shared = df.sparkSession.sparkContext.broadcast(self.scorer())     # (features + 1) numbers a group
        schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_columns
                proba = shared.value.probabilities(batch.column(n - 2).to_numpy(), matrix(batch.column(n - 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(proba)], names=[*keep, "proba"])

        return x.mapInArrow(score, schema + "proba double")

    def scorer(self) -> LinearScorer:
        return LinearScorer(self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _sums(table: DataFrame, weights: list[np.ndarray | None], class_weight: list[np.ndarray], tasks: int) -> DataFrame:
    """(_g, sums): loss, gradient and cross-products at the given coefficients, one row a group that still moves."""
    shared = table.sparkSession.sparkContext.broadcast((weights, class_weight))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, balance = shared.value
        held: dict[int, np.ndarray] = {}
        part = TaskContext.get().partitionId()

        def out(k: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()),
                                               pa.array([held.pop(k).tobytes()], pa.binary())], names=["_g", "part", "sums"])

        for batch in batches:
            for k in [k for k in held if batch.num_rows and k < pc.min(batch.column(0)).as_py()]:
                yield out(k)             # rows come sorted by group
            g, label, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            for k in np.unique(g):
                w = at[k]
                if w is None:
                    continue
                own = g == k
                y = label[own]
                rows = np.column_stack([np.ones(own.sum()), x[own][:, :len(w) - 1]])
                weight = balance[k][y.astype(int)]
                z = rows @ w
                p = _sigmoid(z)
                loss = (weight * (np.logaddexp(0, z) - y * z)).sum()
                grad = rows.T @ (weight * (p - y))
                cross = (rows * (weight * p * (1 - p))[:, None]).T @ rows
                held[int(k)] = held.get(int(k), 0) + np.concatenate([[loss], grad, cross.ravel()])
        for k in list(held):
            yield out(k)

    def merge(keys: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total = None, 0

            def out():
                return pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in now] + [pa.array([total.tobytes()], pa.binary())],
                                                  names=["_g", "part", "sums"])

            for batch in batches:
                columns = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
                for g, part, sums in columns:
                    key = (g, part if "part" in keys else 0)
                    if now is not None and key != now:
                        yield out()
                        total = 0
                    now, total = key, total + np.frombuffer(sums.as_py())
            if now is not None:
                yield out()
        return run

    schema = "_g int, part int, sums binary"
    rows = table.mapInArrow(add, schema)
    if tasks > FAN_IN:
        keys = ["_g", "part"]
        rows = rows.withColumn("part", F.expr(f"part div {FAN_IN}")).repartition(*keys).sortWithinPartitions(*keys) \
            .mapInArrow(merge(keys), schema)
    return rows.repartition("_g").sortWithinPartitions("_g", "part").mapInArrow(merge(["_g"]), schema)


def fit_logistic(df: DataFrame, group: list[str], C=1.0, balanced=False, label: str = "label", features: str = "features",
                 max_iter: int = 100, tol: float = 1e-9) -> Fitted:
    """One model for every group.  ``C`` and ``balanced`` (class weights n / (2 n_class)) may be functions of a group's key.

    Rows with a null label take no part; a group with one class is fitted as it is; an empty table gives no groups.
    """
    group = list(group)
    given = as_array(df, features).filter(F.col(label).isNotNull())
    keys = groups_of(given, group)
    if not keys:
        return Fitted(group, [], [], [])
    table = cut_lineage(group_number(given.select(*group, F.col(label).cast("double").alias("label"),
                                                  F.col(features).cast("array<double>").alias("features")), group, keys)
                        .select("_g", "label", "features").sortWithinPartitions("_g")).persist()
    told = {r["_g"]: r for r in table.groupBy("_g").agg(F.max(F.size("features")).alias("p"), F.count(F.lit(1)).alias("n"),
                                                        F.sum("label").alias("pos")).collect()}      # one row a group
    strength = by_key(C, keys)
    balance = []
    for i, even in enumerate(by_key(balanced, keys)):
        n, pos = told[i]["n"], told[i]["pos"]
        balance.append(np.array([n / (2 * max(n - pos, 1)), n / (2 * max(pos, 1))]) if even else np.ones(2))
    tasks = table.rdd.getNumPartitions()
    at: list[np.ndarray] = [np.zeros(told[i]["p"] + 1) for i in range(len(keys))]
    trial = [w.copy() for w in at]
    best = [np.inf] * len(keys)
    step: list[np.ndarray | None] = [None] * len(keys)
    start, steps, moving = [None] * len(keys), [0] * len(keys), set(range(len(keys)))
    for _ in range(max_iter):
        rows = _sums(table, [trial[i] if i in moving else None for i in range(len(keys))], balance, tasks)
        for r in rows.select("_g", "sums").collect():      # (features + 1)^2 numbers a group
            i, sums = r["_g"], np.frombuffer(r["sums"])
            d = len(trial[i])
            free = np.r_[0.0, np.ones(d - 1)]              # the intercept is not held back
            value = strength[i] * sums[0] + 0.5 * (free * trial[i] ** 2).sum()
            if value > best[i] * (1 + 1e-12) + 1e-12:
                step[i] = step[i] / 2
                trial[i] = at[i] + step[i]
                if np.abs(step[i]).max() < 1e-12:
                    moving.discard(i)
                continue
            best[i], at[i], steps[i] = value, trial[i], steps[i] + 1
            grad = strength[i] * sums[1:d + 1] + free * at[i]
            slope = strength[i] * sums[d + 1:].reshape(d, d) + np.diag(free + np.r_[1e-12, np.zeros(d - 1)])
            start[i] = np.abs(grad).max() if start[i] is None else start[i]
            if np.abs(grad).max() <= tol * max(1.0, start[i]):
                moving.discard(i)
                continue
            step[i] = -np.linalg.solve(slope, grad)
            trial[i] = at[i] + step[i]
        if not moving:
            break
    table.unpersist()
    return Fitted(group, keys, at, steps)
