"""Soft voting, out-of-fold predictions and stacking.

``fit_stack`` is the stack of the plans: the inner fold is one more key of the growers, so the models of all outer folds,
inner folds and the refit on all rows are grown in the same jobs, and a stack is a fixed number of jobs whatever the
number of folds.  Predictions of the base models ride along with the rows as columns: nothing is joined or pivoted by
key, so rows whose key repeats are predicted each.

With MLlib learners (``stack_fit`` and the functions above it) predictions are a long table ``(keys..., model, proba)``;
every fit is an MLlib job, and the independent ones are submitted together (``run_parallel``).
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators import learners as L
from foldspark.operators.forest import fit_forest
from foldspark.operators.grow import TrainingRows, as_array, fit_boosted, group_number, matrix
from foldspark.operators.newton import fit_logistic
from foldspark.operators.split import stratified_kfold
from foldspark.session import cut_lineage


def soft_vote(pred: DataFrame, by: list[str], models: list[str] | None = None, name: str = "SoftVoting") -> DataFrame:
    """Mean probability of the (selected) models per row."""
    p = pred.filter(F.col("model").isin(*models)) if models else pred
    return p.groupBy(*by).agg(F.avg("proba").alias("proba")).withColumn("model", F.lit(name))


def meta_features(oof: DataFrame, keys: list[str], names: list[str], partitions: int | None = None) -> DataFrame:
    """One column per base model from the long OOF table (one aggregate over a fixed name list).

    A row predicted twice by one model means that the key repeats; that is an error, so that no row is lost.
    ``partitions``: tasks that the keys are dealt to, so that a caller who knows their number bounds what one of them holds.
    """
    def once(name: str):
        own = F.when(F.col("model") == name, F.col("proba"))
        return F.when(F.count(own) > 1, F.raise_error(F.lit("a key has several predictions of one model")).cast("double")) \
            .otherwise(F.first(own, ignorenulls=True)).alias(name)

    dealt = oof.repartition(partitions, *keys) if partitions else oof
    return dealt.groupBy(*keys).agg(*[once(n) for n in names])


def _assemble(df: DataFrame, names: list[str], passthrough: str | None, out: str = "meta_x") -> DataFrame:
    parts = [F.array(*[F.col(n).cast("double") for n in names])]
    if passthrough:
        parts.append(vector_to_array(F.col(passthrough)) if dict(df.dtypes).get(passthrough) == "vector"
                     else F.col(passthrough))
    return df.withColumn(out, array_to_vector(F.concat(*parts) if len(parts) > 1 else parts[0]))


def oof_predict(train: DataFrame, bases: list, inner_k: int = 5, key: str = "row_id", label: str = "label",
                features: str = "features", seed: int = 42, parallelism: int = 4) -> DataFrame:
    """Out-of-fold probability of every training row for every base model.

    Inner folds are stratified on the training rows; row ``r`` is scored by the
    model fitted without its inner fold, so each row appears exactly once per model.
    """
    t = stratified_kfold(train.select(key, label, features), k=inner_k, key=key, label=label, seed=seed,
                         out="inner_fold")
    t = cut_lineage(t)
    tasks = []
    for j in range(inner_k):
        fit_rows = t.filter(F.col("inner_fold") != j)
        val_rows = t.filter(F.col("inner_fold") == j)
        for spec in bases:
            tasks.append(lambda s=spec, a=fit_rows, b=val_rows, j=j:
                         L.fit_predict(a, b, s, [key, label], features, label)
                         .withColumn("model", F.lit(s.name)).withColumn("inner_fold", F.lit(j)))
    parts = L.run_parallel(tasks, parallelism)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut_lineage(out)


class StackModel:
    """Fitted stack: base models refitted on all training rows + the meta model on their OOF probabilities."""

    def __init__(self, base_models, names, meta_model, passthrough, features, oof):
        self.base_models, self.names, self.meta_model = base_models, names, meta_model
        self.passthrough, self.features, self.oof = passthrough, features, oof

    def predict(self, score: DataFrame, keep: list[str]) -> DataFrame:
        """(keep..., proba) for the rows of ``score`` (which must hold ``features``)."""
        parts = [L.positive_proba(m.transform(score.select(*keep, self.features))).select(*keep, "proba")
                 .withColumn("model", F.lit(n)) for m, n in zip(self.base_models, self.names)]
        base_pred = parts[0]
        for p in parts[1:]:
            base_pred = base_pred.unionByName(p)
        mscore = meta_features(base_pred, keep, self.names)
        if self.passthrough:
            mscore = mscore.join(score.select(*keep, self.features), keep)
        mscore = _assemble(mscore, self.names, self.features if self.passthrough else None)
        return L.positive_proba(self.meta_model.transform(mscore)).select(*keep, "proba")


def stack_fit(train: DataFrame, bases: list, meta: L.Logistic, inner_k: int = 5, passthrough: bool = False,
              key: str = "row_id", label: str = "label", features: str = "features", seed: int = 42,
              parallelism: int = 4) -> StackModel:
    """Meta logistic model on OOF base probabilities (+ features); bases refitted on all rows."""
    names = [b.name for b in bases]
    oof = oof_predict(train, bases, inner_k, key, label, features, seed, parallelism)
    mtrain = meta_features(oof, [key, label], names)
    if passthrough:
        mtrain = mtrain.join(train.select(key, features), key)
    mtrain = _assemble(mtrain, names, features if passthrough else None)
    fits = [lambda: L.fit(mtrain, meta, "meta_x", label)] + [lambda s=s: L.fit(train, s, features, label) for s in bases]
    models = L.run_parallel(fits, parallelism)
    return StackModel(models[1:], names, models[0], passthrough, features, oof)


def stack_fit_predict(train: DataFrame, score: DataFrame, bases: list, meta: L.Logistic, inner_k: int = 5,
                      passthrough: bool = False, key: str = "row_id", label: str = "label",
                      features: str = "features", keep: list[str] | None = None, seed: int = 42,
                      parallelism: int = 4) -> DataFrame:
    """Fit the stack on ``train`` and score ``score``."""
    keep = keep or [key, label]
    model = stack_fit(train, bases, meta, inner_k, passthrough, key, label, features, seed, parallelism)
    return model.predict(score, keep)


# ---------------------------------------------------------------- all folds in the same jobs
#: The part of a stack that is fitted on all rows of its group.
WHOLE = -1


def fit_grouped(train: DataFrame, spec, group: list[str], key: str = "row_id", label: str = "label",
                features: str = "features", seed: int = L.SEED, shared: TrainingRows | None = None):
    """One learner for every group; the result has ``predict(df, keep)``.

    ``shared``: the rows of ``train`` as tree learners share them.

    ``spec`` may be a dictionary: the learner by the value of the first group column, all of one kind and number of trees.
    """
    own = spec if isinstance(spec, dict) else None
    one = next(iter(own.values())) if own else spec

    def setting(name: str):
        return (lambda k: getattr(own[k[0]], name)) if own else getattr(one, name)

    if isinstance(one, L.ExtraTrees):
        return fit_forest(train, group, label, features, None, one.n_estimators, setting("max_depth"), seed=seed,
                          shared=shared)
    if isinstance(one, L.RandomForest):
        return fit_forest(train, group, label, features, key, one.n_estimators, setting("max_depth"), extra=False, seed=seed,
                          shared=shared)
    if isinstance(one, L.Boosted):
        leaves = setting("num_leaves") if one.growth == "leaf" else None
        return fit_boosted(train, group, label, features, one.n_estimators, setting("max_depth"), leaves, setting("learning_rate"),
                           shared=shared)
    if isinstance(one, L.Logistic):
        return fit_logistic(train, group, setting("C"), (lambda k: own[k[0]].class_weight == "balanced") if own
                            else one.class_weight == "balanced", label, features, one.max_iter)
    raise TypeError(f"unknown learner spec {spec!r}")


@dataclass
class Stack:
    """Base models of every (group, part) and the meta model of every group."""

    group: list[str]
    models: list
    names: list[str]
    meta: object | None
    passthrough: bool | list          # for all groups, or the first group values that pass their features through
    features: str
    oof: DataFrame | None = None
    seconds: dict[str, float] = field(default_factory=dict)

    def _probabilities(self, rows: DataFrame) -> DataFrame:
        """The rows with a column for each base model, all scored by one Python worker of a task.

        The models were fitted on the same parts, so they number them alike.
        """
        keep, first = rows.columns, self.models[0]
        x = group_number(as_array(rows, self.features), first.group, first.keys).select(*keep, "_g", F.col(self.features).alias("_x"))
        shared = rows.sparkSession.sparkContext.broadcast([m.scorer() for m in self.models])
        names = [f"_p{i}" for i in range(len(self.models))]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_columns
                g, values = batch.column(n - 2).to_numpy(), matrix(batch.column(n - 1))
                found = [pa.array(m.probabilities(g, values)) for m in shared.value]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *found], names=[*keep, *names])

        own = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
        return x.mapInArrow(score, ", ".join(own + [f"{c} double" for c in names]))

    def _meta_rows(self, rows: DataFrame) -> DataFrame:
        own = F.array(*[F.col(f"_p{i}") for i in range(len(self.models))])
        through = F.lit(self.passthrough) if isinstance(self.passthrough, bool) else F.col(self.group[0]).isin(self.passthrough)
        return rows.withColumn("_meta", F.when(through, F.concat(own, F.col(self.features))).otherwise(own))

    def predict_all(self, score: DataFrame, keep: list[str]) -> DataFrame:
        """(keep..., one column for each base model by name, proba of the stack if it has a meta model)."""
        rows = as_array(score, self.features)
        rows = rows.select(*dict.fromkeys([*keep, *[g for g in self.group if g in rows.columns], self.features])) \
            .withColumn("_part", F.lit(WHOLE))
        if "_all" in self.group:
            rows = rows.withColumn("_all", F.lit(0))
        rows = self._probabilities(rows)
        bases = [F.col(f"_p{i}").alias(n) for i, n in enumerate(self.names)]
        if self.meta is None:
            return rows.select(*keep, *bases)
        rows = self._meta_rows(rows)
        return self.meta.predict(rows, rows.columns, "_meta").select(*keep, *bases, "proba")

    def predict(self, score: DataFrame, keep: list[str]) -> DataFrame:
        return self.predict_all(score, keep).select(*keep, "proba")


def fit_stack(train: DataFrame, bases: list, meta, inner_k: int = 5, passthrough: bool | list = False,
              group: list[str] | None = None, key: str = "row_id", label: str = "label", features: str = "features",
              seed: int = L.SEED, same: dict | None = None) -> Stack:
    """G7-G9 for every group at once.

    Inner folds are stratified inside each group; part ``j`` of a group is fitted without its inner fold ``j`` and predicts it,
    part ``WHOLE`` is fitted on all its rows and predicts what is scored.  ``oof`` holds every training row once with its
    out-of-fold probabilities ``_p0 ..``.  Without ``meta`` only the base models are fitted, on all rows.  Learners and meta
    model may be dictionaries by the first group value (``fit_grouped``).

    ``same``: first group values that have the rows of a value found in ``train``: such rows are written once, whatever the number
    of groups that are fitted on them; ``oof`` then has no features of its own.
    """
    rows = as_array(train, features)
    group = list(group or [])
    if not group:
        rows, group = rows.withColumn("_all", F.lit(0)), ["_all"]
    rows = rows.select(*group, key, label, features)
    if meta is None:
        parts = cut_lineage(rows.withColumn("_part", F.lit(WHOLE)))
    else:
        rows = cut_lineage(stratified_kfold(rows, k=inner_k, key=key, label=label, seed=seed, by=tuple(group), out="_inner"))
        others = F.filter(F.sequence(F.lit(WHOLE), F.lit(inner_k - 1)), lambda j: j != F.col("_inner"))
        parts = rows.withColumn("_part", F.explode(others))

    def spread(df: DataFrame) -> DataFrame:
        """The rows of every first group value."""
        if not same:
            return df
        kind = df.schema[group[0]].dataType.simpleString()
        values = df.sparkSession.createDataFrame([(a, b) for a, own in same.items() for b in own], f"_a {kind}, _b {kind}")
        return df.join(F.broadcast(values), F.col(group[0]) == F.col("_a")).withColumn(group[0], F.col("_b")).drop("_a", "_b")   # a row a value

    names = [(next(iter(b.values())) if isinstance(b, dict) else b).name for b in bases]
    stack = Stack(group, [], names, None, passthrough, features)
    shared = TrainingRows(parts, [*group, "_part"], label, features, key, same=same)
    for name, spec in zip(names, bases, strict=True):
        begun = time.time()
        stack.models.append(fit_grouped(spread(parts), spec, [*group, "_part"], key, label, features, seed, shared))
        stack.seconds[name] = round(time.time() - begun, 3)
    shared.release()
    if meta is not None:
        begun = time.time()
        oof = stack._meta_rows(stack._probabilities(spread(rows.withColumnRenamed("_inner", "_part"))))
        stack.oof = cut_lineage(oof.drop(features) if same else oof)
        stack.meta = fit_grouped(stack.oof, meta, group, key, label, "_meta")
        stack.seconds["meta"] = round(time.time() - begun, 3)
    return stack
