"""Groups that a task can hold, shared rows and neighbours, and the full sizes of the hold-out queries."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.operators import ensemble as G
from foldspark.operators import forest as FO
from foldspark.operators import grow as GR
from foldspark.operators import learners as L

WIDTH, N = 12, 400


@pytest.fixture(scope="module")
def sparse(spark):
    """Two numbers and ten columns that are mostly zero; some values are missing."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((N, WIDTH)) < 0.1, rng.random((N, WIDTH)).round(2), 0.0)
    x[:, :2] = rng.normal(size=(N, 2)).round(2)
    y = (x[:, 0] + 2 * x[:, 2] + rng.normal(size=N) * 0.4 > 0.2).astype(int)
    rows = [(i % 2, int(y[i]), [None if (i + j) % 97 == 0 else float(v) for j, v in enumerate(x[i])], i) for i in range(N)]
    return spark.createDataFrame(rows, "fold int, label int, features array<double>, row_id long").repartition(4).cache()


@pytest.mark.parametrize("leaves", [None, 9])
def test_boosters_of_groups_whose_bins_fit_are_one_job(sparse, leaves, monkeypatch):
    """A bin is a byte: 200 rows of 12 features are 2400 bytes, not eight times as many."""
    jobs, run = [], GR.merged_level
    monkeypatch.setattr(GR, "merged_level", lambda *a: jobs.append(1) or run(*a))

    def grown(limit: int) -> tuple[set, int]:
        jobs.clear()
        monkeypatch.setattr(GR, "LOCAL_BYTES", limit)
        model = GR.fit_boosted(sparse, ["fold"], n_rounds=3, max_depth=3, num_leaves=leaves)
        return {tuple(r) for r in model.nodes(sparse.sparkSession).collect()}, len(jobs)

    here, none = grown(WIDTH * N // 2)
    levels, many = grown(0)
    assert here == levels and none == 0 and many > 6


def test_extra_trees_hold_only_what_is_not_zero(sparse, monkeypatch):
    jobs, run = [], FO._split_level
    monkeypatch.setattr(FO, "_split_level", lambda *a: jobs.append(1) or run(*a))

    def grown(limit: int) -> tuple[set, int]:
        jobs.clear()
        monkeypatch.setattr(FO, "LOCAL_BYTES", limit)
        model = FO.fit_forest(sparse, ["fold"], n_trees=4, max_depth=7)
        return {tuple(r) for r in model.nodes(sparse.sparkSession).collect()}, len(jobs)

    here, none = grown(3 * 8 * N // 2)          # a quarter of the doubles
    levels, many = grown(0)
    assert here == levels and none == 0 and many > 3


def test_edges_of_a_task_are_those_of_the_cluster(sparse, monkeypatch):
    rows = sparse.select(F.col("fold").alias("_g"), "features")
    monkeypatch.setattr(GR, "EDGE_BYTES", 1000)
    here, sorted_ = GR.bin_edges(rows, 2, 16, N), GR.bin_edges(rows, 2, 16)
    assert all(np.array_equal(a, b) for g, h in zip(here, sorted_, strict=True) for a, b in zip(g, h, strict=True))


def test_candidates_with_the_same_rows_share_them(sparse, monkeypatch):
    """A search wrote and cut the rows of every candidate, though few settings change them."""
    bases = [L.ExtraTrees(2, 3), L.RandomForest(2, 3), L.Boosted(2, 2, name="XGBoost")]
    specs = [{c: b for c in "abc"} for b in bases]
    specs[0]["b"] = L.ExtraTrees(2, 5)
    meta = {c: L.Logistic(name="meta") for c in "abc"}
    one = sparse.withColumn("cand", F.lit("a")).unionByName(sparse.filter("row_id < 300").withColumn("cand", F.lit("c")))
    every = one.unionByName(sparse.withColumn("cand", F.lit("b")))
    written, run = [], GR.binned
    monkeypatch.setattr(GR, "binned", lambda rows, edges: written.append(rows.count()) or run(rows, edges))

    def scored(train, same):
        stack = G.fit_stack(train, specs, meta, 2, False, ["cand", "fold"], same=same)
        return sorted((r.cand, r.row_id, round(r.proba, 9)) for r in stack.predict(every, ["cand", "row_id"]).collect())

    assert scored(one, {"a": ["a", "b"], "c": ["c"]}) == scored(every, None)
    assert written[0] < written[1]


def test_neighbours_serve_fewer_of_them(spark):
    from foldspark.plans.experiment import neighbours, training_rows
    rng = np.random.default_rng(5)
    rows = [(i % 2, "train" if i % 5 else "val", str(i), int(i % 3 == 0), rng.normal(size=3).round(3).tolist()) for i in range(150)]
    x = spark.createDataFrame(rows, "fold_id int, role string, row_id string, label int, features array<double>")
    knn = neighbours(x, 5)
    for ratio, k in ((1.0, 5), (0.8, 3)):
        a, b = (sorted(map(str, training_rows(x, ratio, k, 42, near).collect())) for near in (None, knn))
        assert a == b


@pytest.mark.parametrize("name", ["stacking_holdout", "roc_report"])
def test_holdout_queries_have_full_size(spark, name, monkeypatch):
    """They were registered with five trees and two or three inner folds."""
    from conftest import SF_SMALL
    from foldspark.plans import explanation, queries
    from foldspark.plans.experiment import ExperimentConfig

    class Seen(Exception):
        pass

    def stop(df, roles, *rest):
        raise Seen(rest[-1])

    monkeypatch.setattr(queries.XP, "evaluate_holdout", stop)
    monkeypatch.setattr(explanation, "evaluate_holdout", stop)
    with pytest.raises(Seen) as found:
        queries.REGISTRY[name](spark, SF_SMALL)
    cfg = found.value.args[0]
    assert cfg.inner_k == ExperimentConfig().inner_k == 5
    assert [b.n_estimators for b in cfg.base_specs()] == [ExperimentConfig().n_estimators] * 4 == [200] * 4
