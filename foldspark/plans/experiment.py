"""Leakage-free cross-validated comparison and hold-out evaluation (step-1 lifecycle).

scan -> clean -> roles -> folds -> expanded folds -> statistics per training
side -> broadcast apply -> SMOTE on training rows -> fits (every learner once,
for all folds and inner folds together) -> long prediction table -> one metrics aggregate.

Preprocessing is fitted once per fold and reused by every model of that fold
(the reference refits it per model); all folds share one plan, fits included.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators import ensemble as G
from foldspark.operators import learners as L
from foldspark.operators import metrics as H
from foldspark.operators.clean import Roles
from foldspark.session import cut_lineage
from foldspark.operators.prep import apply_prep, fit_prep
from foldspark.operators.smote import add_synthetic, nearest_minority, smote
from foldspark.operators.split import expand_folds, stratified_holdout, stratified_kfold

# Model names of the comparison.
BASE_NAMES = ("ExtraTrees", "RandomForest", "XGBoost", "LightGBM")
ALL_MODELS = BASE_NAMES + ("SoftVoting", "OptimizedStacking")


@dataclass
class ExperimentConfig:
    n_estimators: int = 200
    k: int = 5
    inner_k: int = 5
    seed: int = 42
    smote_ratio: float | None = 1.0      # None: no oversampling
    smote_k: int = 5
    test_size: float = 0.2
    strict_default: bool = True          # step 1 predicts class 1 only when proba > 0.5
    parallelism: int = 4
    passthrough: bool = False
    booster: str = "grouped"             # learners: 'grouped' (all folds in the same jobs), 'mllib' (a fit for each fold)
                                         # or 'batched' (relational boosters and extra trees, the rest on MLlib)
    models: tuple[str, ...] = ALL_MODELS
    meta: L.Logistic = field(default_factory=lambda: L.Logistic(C=1.0, max_iter=2000, name="meta"))
    bases: list | None = None

    def base_specs(self):
        return self.bases or L.default_bases(self.n_estimators)


def prepared(df: DataFrame, roles: Roles, fold: str, fold_ids: list[int]) -> DataFrame:
    """(fold_id, role, row_id, label, features array) for every fold id - one plan, persisted."""
    df = cut_lineage(df.select("row_id", "label", fold, *roles.numeric, *roles.categorical))  # read twice
    stats = fit_prep(df, roles, fold, fold_ids)
    k = max(fold_ids) + 1
    ex = expand_folds(df, k, fold)
    ex = ex.filter(F.col("fold_id").isin(*fold_ids))
    x = apply_prep(ex, stats, output="array")
    return cut_lineage(x.select("fold_id", "role", F.col("row_id").cast("string").alias("row_id"), "label", "features"))


def neighbours(x: DataFrame, k_nn: int) -> DataFrame:
    """The nearest minority rows on the training side of every fold, written once: they serve any ratio and up to ``k_nn``."""
    return cut_lineage(nearest_minority(x.filter(F.col("role") == "train").select("fold_id", "row_id", "label", "features"), k_nn))


def training_rows(x: DataFrame, ratio: float | None, k_nn: int, seed: int, knn: DataFrame | None = None) -> DataFrame:
    """Training side of every fold, with SMOTE rows appended when ``ratio`` is set (validation untouched); ``knn``: its
    neighbours, ``k_nn`` or more of every row."""
    train = x.filter(F.col("role") == "train").select("fold_id", "row_id", "label", "features")
    if ratio is None:
        out = train.withColumn("synthetic", F.lit(False))
    else:
        out = add_synthetic(train, smote(train, ratio, k_nn, by=["fold_id"], seed=seed, knn=knn))
    return cut_lineage(out.withColumn("features", array_to_vector("features")))


def _batched_boost(train: DataFrame, val: DataFrame, spec: L.Boosted) -> DataFrame:
    """One fit for every fold: the booster groups by fold id."""
    from pyspark.ml.functions import vector_to_array
    from foldspark.operators.boost import fit_booster
    from foldspark.operators.boost import fit_booster_leafwise
    tr = train.withColumn("features", vector_to_array("features"))
    va = val.withColumn("features", vector_to_array("features"))
    if spec.growth == "leaf":
        m = fit_booster_leafwise(tr, ["fold_id"], n_rounds=spec.n_estimators, num_leaves=spec.num_leaves,
                                 rate=spec.learning_rate)
    else:
        m = fit_booster(tr, ["fold_id"], n_rounds=spec.n_estimators, max_depth=spec.max_depth, rate=spec.learning_rate)
    return m.predict(va, ["fold_id", "row_id", "label"]).select(
        "row_id", "label", "proba", F.lit(spec.name).alias("model"), F.col("fold_id").alias("fold"))


def _batched_extra_trees(train: DataFrame, val: DataFrame, spec: L.ExtraTrees) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    from foldspark.operators.boost import fit_extra_trees
    tr = train.withColumn("features", vector_to_array("features"))
    va = val.withColumn("features", vector_to_array("features"))
    m = fit_extra_trees(tr, ["fold_id"], n_trees=spec.n_estimators, max_depth=spec.max_depth)
    return m.predict(va, ["fold_id", "row_id", "label"]).select(
        "row_id", "label", "proba", F.lit(spec.name).alias("model"), F.col("fold_id").alias("fold"))


def _fold_tasks(train: DataFrame, val: DataFrame, fold_ids, cfg: ExperimentConfig):
    bases = cfg.base_specs()
    want = set(cfg.models)
    tasks = []
    if cfg.booster == "batched":
        for spec in bases:
            if isinstance(spec, L.Boosted) and (spec.name in want or "SoftVoting" in want):
                tasks.append(lambda s=spec: _batched_boost(train, val, s))
            if isinstance(spec, L.ExtraTrees) and (spec.name in want or "SoftVoting" in want):
                tasks.append(lambda s=spec: _batched_extra_trees(train, val, s))
        bases_per_fold = [b for b in bases if not isinstance(b, (L.Boosted, L.ExtraTrees))]
    else:
        bases_per_fold = bases
    for fid in fold_ids:
        tr = train.filter(F.col("fold_id") == fid)
        va = val.filter(F.col("fold_id") == fid)
        need_bases = want & (set(BASE_NAMES) | {"SoftVoting"})
        for spec in bases_per_fold:
            if spec.name in need_bases or "SoftVoting" in want:
                tasks.append(lambda s=spec, tr=tr, va=va, fid=fid:
                             L.fit_predict(tr, va, s, ["row_id", "label"]).withColumn("model", F.lit(s.name))
                             .withColumn("fold", F.lit(fid)))
        if "OptimizedStacking" in want:
            tasks.append(lambda tr=tr, va=va, fid=fid:
                         G.stack_fit_predict(tr, va, bases, cfg.meta, cfg.inner_k, cfg.passthrough, seed=cfg.seed,
                                             parallelism=cfg.parallelism)
                         .withColumn("model", F.lit("OptimizedStacking")).withColumn("fold", F.lit(fid)))
    return tasks


def _timed(task):
    """Driver clock around a fit task (fits are the actions), kept as a literal column."""
    import time

    def run():
        t0 = time.time()
        df = task()
        return df.withColumn("runtime_seconds", F.lit(round(time.time() - t0, 3)))
    return run


def _grouped_predictions(train: DataFrame, val: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """(model, fold, row_id, label, proba, runtime_seconds): every learner is fitted once for all folds.

    The base models of the comparison are the parts of the stack that are fitted on all rows.  H19: the time of a fit is that
    of all folds together; soft voting has the time of its members, the stack that of its members and the meta model.
    """
    bases = cfg.base_specs()
    stacked = "OptimizedStacking" in cfg.models
    stack = G.fit_stack(train, bases, cfg.meta if stacked else None, cfg.inner_k, cfg.passthrough, ["fold_id"], seed=cfg.seed)
    wide = stack.predict_all(val, ["fold_id", "row_id", "label"])
    members = [b.name for b in bases if b.name in BASE_NAMES]
    took = {**stack.seconds, "SoftVoting": sum(stack.seconds[m] for m in members), "OptimizedStacking": sum(stack.seconds.values())}
    proba = {m: F.col(m) for m in members}
    if members:
        proba["SoftVoting"] = sum((F.col(m) for m in members[1:]), F.col(members[0])) / len(members)
    if stacked:
        proba["OptimizedStacking"] = F.col("proba")
    rows = F.array(*[F.struct(F.lit(m).alias("model"), proba[m].alias("proba"), F.lit(round(took[m], 3)).alias("runtime_seconds"))
                     for m in cfg.models if m in proba])
    return cut_lineage(wide.select(F.col("fold_id").cast("int").alias("fold"), "row_id", "label", F.inline(rows)).select(
        "model", "fold", "row_id", "label", "proba", "runtime_seconds"))


def _predictions(train, val, fold_ids, cfg) -> DataFrame:
    if cfg.booster == "grouped":
        return _grouped_predictions(train, val, cfg)
    parts = L.run_parallel([_timed(t) for t in _fold_tasks(train, val, fold_ids, cfg)], cfg.parallelism)
    pred = parts[0]
    for p in parts[1:]:
        pred = pred.unionByName(p)
    pred = cut_lineage(pred.select("model", F.col("fold").cast("int").alias("fold"), "row_id", "label", "proba",
                                   "runtime_seconds"))
    if "SoftVoting" in cfg.models:
        sv = G.soft_vote(pred.filter(F.col("model").isin(*BASE_NAMES)), ["fold", "row_id", "label"])
        pred = pred.unionByName(sv.select("model", "fold", "row_id", "label", "proba",
                                          F.lit(None).cast("double").alias("runtime_seconds")))
    keep = [m for m in cfg.models]
    return pred.filter(F.col("model").isin(*keep))


def cross_validate(df: DataFrame, roles: Roles, cfg: ExperimentConfig) -> DataFrame:
    """Out-of-fold predictions ``(model, fold, row_id, label, proba)`` for every model."""
    f = stratified_kfold(df, k=cfg.k, seed=cfg.seed)
    ids = list(range(cfg.k))
    x = prepared(f, roles, "fold", ids)
    train = training_rows(x, cfg.smote_ratio, cfg.smote_k, cfg.seed)
    val = cut_lineage(x.filter(F.col("role") == "val").withColumn("features", array_to_vector("features")))
    return _predictions(train, val, ids, cfg)


def evaluate_holdout(df: DataFrame, roles: Roles, cfg: ExperimentConfig) -> DataFrame:
    """Hold-out predictions (fold 0 = test split) for every model."""
    h = stratified_holdout(df, cfg.test_size, seed=cfg.seed)
    h = h.withColumn("hfold", F.when(F.col("split") == "test", F.lit(0)).otherwise(F.lit(1)))
    x = prepared(h, roles, "hfold", [0])
    train = training_rows(x, cfg.smote_ratio, cfg.smote_k, cfg.seed)
    val = cut_lineage(x.filter(F.col("role") == "val").withColumn("features", array_to_vector("features")))
    return _predictions(train, val, [0], cfg)


def runtimes(pred: DataFrame) -> DataFrame:
    """Fit seconds per (model, fold); not part of any compare (wall-clock)."""
    return pred.groupBy("model", "fold").agg(F.max("runtime_seconds").alias("runtime_seconds"))


def cv_report(pred: DataFrame, cfg: ExperimentConfig) -> tuple[DataFrame, DataFrame]:
    """Per-fold metrics and mean/std summary (sample std, as step 1)."""
    m = H.metrics(pred, ["model", "fold"], 0.5, strict=cfg.strict_default)
    long = H.fold_scores_long(m.drop("tn", "fp", "fn", "tp"), ["model", "fold"])
    return m, H.summarize(long, ["model", "metric"], ddof=1)
