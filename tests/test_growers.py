"""Grouped growers, Newton steps and stacks against loops."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.operators import ensemble as G
from foldspark.operators import forest as FO
from foldspark.operators import grow as GR
from foldspark.operators import learners as L
from foldspark.operators import newton as NE


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n, p = 600, 7
    x = rng.normal(size=(n, p)).round(2)
    x[:, 3], x[:, 4] = rng.integers(0, 2, n), 0
    y = ((x[:, 0] + x[:, 1] * x[:, 3] + rng.normal(size=n) * 0.5) > 0.3).astype(int)
    g = rng.integers(0, 2, n)
    rows = [(int(g[i]), int(y[i]), [float(v) for v in x[i]], i) for i in range(n)]
    df = spark.createDataFrame(rows, "fold int, label int, features array<double>, row_id long").repartition(5).cache()
    return df, x, y, g


def loop_margins(bins, y, rounds, depth, leaves, rate=0.2, lam=1.0, least=1.0, n_bins=32):
    """Boosting by loops: the margin of every training row."""
    margin = np.zeros(len(y))
    for _ in range(rounds):
        grad, hess = GR.gradients(margin, y)

        def best(idx):
            found = (-np.inf, 0, 0)
            g, h = grad[idx].sum(), hess[idx].sum()
            for f in range(bins.shape[1]):
                for b in range(n_bins - 1):
                    left = bins[idx, f] <= b
                    if not 0 < left.sum() < len(idx):
                        continue
                    gl, hl = grad[idx][left].sum() / GR.UNIT, hess[idx][left].sum() / GR.UNIT
                    gr, hr = g / GR.UNIT - gl, h / GR.UNIT - hl
                    if hl < least or hr < least:
                        continue
                    gain = gl * gl / (hl + lam) + gr * gr / (hr + lam) - (g / GR.UNIT) ** 2 / (h / GR.UNIT + lam)
                    if gain > found[0] + 1e-12:
                        found = (gain, f, b)
            return found

        if leaves is None:
            done, level = [], [np.arange(len(y))]
            for _ in range(depth):
                below = []
                for idx in level:
                    gain, f, b = best(idx)
                    if gain > GR.LEAST_GAIN:
                        left = bins[idx, f] <= b
                        below += [idx[left], idx[~left]]
                    else:
                        done.append(idx)
                level = below
            ends = done + level
        else:
            queue = [(best(np.arange(len(y))), np.arange(len(y)))]
            while len(queue) < leaves:
                i = max(range(len(queue)), key=lambda i: queue[i][0][0])
                (gain, f, b), idx = queue.pop(i)
                if not gain > GR.LEAST_GAIN:
                    queue.append(((gain, f, b), idx))
                    break
                left = bins[idx, f] <= b
                queue += [(best(part), part) for part in (idx[left], idx[~left])]
            ends = [idx for _, idx in queue]
        for idx in ends:
            margin[idx] -= grad[idx].sum() / GR.UNIT / (hess[idx].sum() / GR.UNIT + lam) * rate
    return margin


@pytest.mark.parametrize("kind", [dict(n_rounds=3, max_depth=2, refresh=2), dict(n_rounds=2, num_leaves=6)])
def test_boosted_groups_against_loops(data, kind, monkeypatch):
    df, x, y, g = data
    monkeypatch.setattr(GR, "FAN_IN", 2)                     # two levels of merging
    model = GR.fit_boosted(df, ["fold"], **kind)
    got = {r.row_id: r.margin for r in model.predict(df, ["row_id"]).collect()}
    for k in (0, 1):
        own = np.flatnonzero(g == k)
        bins = GR.to_bins(x[own], model.edges[k]).astype(int)
        want = loop_margins(bins, y[own], kind["n_rounds"], kind.get("max_depth"), kind.get("num_leaves"))
        assert np.abs(want - np.array([got[i] for i in own])).max() < 1e-9


def test_boosted_does_not_depend_on_partitions(data):
    df, *_ = data
    one, many = (GR.fit_boosted(df.repartition(n), ["fold"], n_rounds=2, max_depth=3) for n in (1, 7))
    assert [[t.arrays()[0].tolist() for t in own] for own in one.trees] == [[t.arrays()[0].tolist() for t in own] for own in many.trees]
    assert all((a.arrays()[4] == b.arrays()[4]).all() for r, s in zip(one.trees, many.trees) for a, b in zip(r, s))


def test_boosted_odd_rows(spark):
    """Missing values go right, a null label takes no part, a constant column never splits, one class gives one leaf."""
    rows = [(0, i % 2, [float(i % 2), None, 1.0]) for i in range(40)] + [(0, None, [9.0, 9.0, 9.0])] + \
        [(1, 1, [float(i), None, 2.0]) for i in range(10)] + [(None, i % 2, [None if i % 2 else 3.0, 0.0, 0.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, label int, features array<double>")
    model = GR.fit_boosted(df, ["g"], n_rounds=2, max_depth=3)
    assert model.keys == [(None,), (0,), (1,)]
    trees = model.trees[0]
    assert trees[1].feature[0] == 0 and trees[2].feature == [-1] and trees[0].feature[0] == 0
    scored = model.predict(df.filter("label is not null"), ["g", "label"]).collect()
    assert all((r.proba > 0.5) == bool(r.label) for r in scored)
    assert GR.fit_boosted(df.filter("1 = 0"), ["g"], n_rounds=2).keys == []


def loop_tree(x, y, k, t, depth, m):
    """One extremely randomised tree by recursion: the value of every row's leaf."""
    out = np.zeros(len(y))

    def impurity(n, p):
        return n * (1 - (p / n) ** 2 - ((n - p) / n) ** 2)

    def grow(idx, path):
        n, pos = len(idx), y[idx].sum()
        varying = [f for f in range(x.shape[1]) if x[idx, f].max() > x[idx, f].min()]
        if len(path) == depth or pos in (0, n) or not varying:
            out[idx] = pos / n
            return
        best = None
        for f in sorted(sorted(varying, key=lambda f: FO.draw(42, k, t, path, f))[:m]):
            low, high = x[idx, f].min(), x[idx, f].max()
            left = x[idx, f] <= low + FO.uniform(42, "thr", k, t, path, f) * (high - low)
            a, b = left.sum(), y[idx][left].sum()
            gain = impurity(n, pos) - impurity(a, b) - impurity(n - a, pos - b)
            if best is None or gain > best[0]:
                best = (gain, left)
        grow(idx[best[1]], path + "L")
        grow(idx[~best[1]], path + "R")

    grow(np.arange(len(y)), "")
    return out


@pytest.mark.parametrize("depth", [3, None])
def test_extra_trees_against_loops(data, depth):
    df, x, y, g = data
    model = FO.fit_forest(df, ["fold"], n_trees=2, max_depth=depth, block_bytes=20_000)    # several blocks and slices
    got = {r.row_id: r.proba for r in model.predict(df, ["row_id"]).collect()}
    for k in (0, 1):
        own = np.flatnonzero(g == k)
        want = sum(loop_tree(x[own], y[own], k, t, depth, 2) for t in range(2)) / 2
        assert np.abs(want - np.array([got[i] for i in own])).max() < 1e-12
    if depth is None:
        assert max(len(p) for tree in model.trees.values() for p in tree.path) > 10


def test_random_forest_bootstrap_is_replayable(data):
    df, x, y, g = data
    keys = np.arange(100_000, dtype=np.int64) * 7919
    w = FO.poisson_weights(keys, 42, 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and (w == FO.poisson_weights(keys, 42, 3)).all()
    assert abs(np.corrcoef(w, FO.poisson_weights(keys, 42, 4))[0, 1]) < 0.02
    one, two = (FO.fit_forest(d, ["fold"], key="row_id", n_trees=3, max_depth=4, extra=False) for d in (df, df.repartition(3)))
    assert all(one.trees[n].feature == two.trees[n].feature and one.trees[n].value == two.trees[n].value for n in one.trees)
    proba = {r.row_id: r.proba for r in one.predict(df, ["row_id"]).collect()}
    assert np.mean([(proba[i] > 0.5) == y[i] for i in proba]) > 0.75
    with pytest.raises(ValueError):
        FO.fit_forest(df, ["fold"], n_trees=1, extra=False)


def test_newton_gradient_is_zero(data):
    df, x, y, g = data
    model = NE.fit_logistic(df, ["fold"], C=lambda k: (1.0, 0.1)[k[0]], balanced=lambda k: k[0] == 1)
    for k, (C, even) in enumerate(((1.0, False), (0.1, True))):
        own = g == k
        rows, label, w = np.c_[np.ones(own.sum()), x[own]], y[own], model.weights[k]
        n, pos = len(label), label.sum()
        weight = np.where(label == 1, n / (2 * pos), n / (2 * (n - pos))) if even else np.ones(n)
        grad = C * rows.T @ (weight * (1 / (1 + np.exp(-rows @ w)) - label)) + np.r_[0, w[1:]]
        assert np.abs(grad).max() < 1e-5 and model.steps[k] < 20
    assert NE.fit_logistic(df.filter("1 = 0"), ["fold"]).keys == []


def test_stack_of_groups(spark, data):
    """Every training row is predicted once by models that have not seen it; repeated keys are rows of their own."""
    df, x, y, g = data
    again = df.unionByName(df.filter("row_id < 20"))
    bases = [L.ExtraTrees(3, 3), L.Boosted(3, 2, 0.3, "depth", name="XGBoost")]
    stack = G.fit_stack(again, bases, L.Logistic(name="meta"), inner_k=3, passthrough=True, group=["fold"])
    oof = stack.oof.collect()
    assert len(oof) == 620 and {r._part for r in oof} == {0, 1, 2}
    # the part of inner fold 0 does not see its rows: a fit without them gives the same probabilities
    part = stack.oof.filter("_part <> 0").select("fold", "row_id", "label", "features")
    alone = G.fit_grouped(part, bases[1], ["fold"])
    want = sorted((r.row_id, round(r.proba, 9)) for r in alone.predict(stack.oof.filter("_part = 0").drop("_p0", "_p1", "_meta"),
                                                                       ["row_id"]).collect())
    assert want == sorted((r.row_id, round(r._p1, 9)) for r in oof if r._part == 0)
    scored = stack.predict(again, ["row_id", "label"]).collect()
    assert len(scored) == 620 and np.mean([(r.proba > 0.5) == r.label for r in scored]) > 0.8
    plain = G.fit_stack(df, bases, None)
    assert plain.predict_all(df, ["row_id"]).columns == ["row_id", "ExtraTrees", "XGBoost"]


def test_contributions_of_grouped_booster(data):
    from foldspark.operators import contrib
    df, x, y, g = data
    model = GR.fit_boosted(df.withColumn("one", F.lit(1)), ["one"], n_rounds=3, num_leaves=8)
    margin = {r.row_id: r.margin for r in model.predict(df.withColumn("one", F.lit(1)), ["row_id"]).collect()}
    parts = {}
    for r in contrib.tree_contributions(model, df).collect():
        parts.setdefault(r.row_id, []).append(r.contribution)
    assert all(len(p) == 8 and abs(sum(p) - margin[i]) < 1e-9 for i, p in parts.items())
    paths = [p for scale, t in contrib.boosted_trees(model) for p in contrib.leaf_paths(t, scale)]
    slow = [contrib.Path(p.features, p.low, p.high, p.share, p.value) for p in paths]      # without tables
    assert np.abs(contrib.path_contributions(x, paths, 7) - contrib.path_contributions(x, slow, 7)).max() < 1e-12


def test_preparation_with_large_vocabulary(spark, monkeypatch):
    """Beyond the broadcast bound the index table is joined on salted keys, with the same result."""
    from foldspark.operators import prep as E
    from foldspark.operators.clean import Roles
    df = spark.createDataFrame([(i, i % 3, float(i), f"c{i % 40}" if i % 7 else None) for i in range(300)],
                               "row_id int, fold int, a double, b string")
    roles = Roles(numeric=["a"], categorical=["b"])
    x = df.withColumn("fold_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))

    def rows():
        st = E.fit_prep(df, roles, "fold", [0, 1, 2])
        return sorted((r.fold_id, r.row_id, r.features) for r in E.apply_prep(x, st, output="array").collect())

    want = rows()
    monkeypatch.setattr(E, "MAX_BROADCAST_ROWS", 10)
    assert rows() == want


def test_settings_by_group(data):
    """Groups with other settings, grown together, are what each is alone."""
    df, *_ = data
    specs = {0: L.Boosted(2, 1, 0.1, "depth"), 1: L.Boosted(2, 3, 0.3, "depth")}
    leafy = {0: L.Boosted(1, 4, 0.1, "leaf", 3), 1: L.Boosted(1, 4, 0.3, "leaf", 7)}
    trees = {0: L.ExtraTrees(2, 2), 1: L.ExtraTrees(2, None)}
    for both in (specs, leafy, trees, {0: L.Logistic(0.5), 1: L.Logistic(2.0, "balanced")}):
        got = {r.row_id: r.proba for r in G.fit_grouped(df, both, ["fold"]).predict(df, ["row_id"]).collect()}
        for k, spec in both.items():
            alone = df.filter(F.col("fold") == k)
            want = {r.row_id: r.proba for r in G.fit_grouped(alone, spec, ["fold"]).predict(alone, ["row_id"]).collect()}
            assert all(abs(got[i] - p) < 1e-9 for i, p in want.items())


def test_stack_scores_all_base_models_in_one_worker_and_cuts_bins_once(spark, data, monkeypatch):
    """A chain of predictions held a Python worker for each base model; every learner sorted the values anew."""
    df, *_ = data
    calls, edges = [], GR.bin_edges
    monkeypatch.setattr(GR, "bin_edges", lambda *a: calls.append(1) or edges(*a))
    bases = [L.ExtraTrees(2, 3), L.RandomForest(2, 3), L.Boosted(2, 2, name="XGBoost"), L.Boosted(2, 4, 0.2, "leaf", 4, name="LightGBM")]
    stack = G.fit_stack(df, bases, L.Logistic(name="meta"), inner_k=2, group=["fold"])
    assert len(calls) == 1
    rows = df.select("fold", "row_id", "features").withColumn("_part", F.lit(G.WHOLE))
    wide = stack._probabilities(rows)
    assert wide._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r["row_id"]: [r[f"_p{i}"] for i in range(4)] for r in wide.collect()}
    for i, (model, spec) in enumerate(zip(stack.models, bases, strict=True)):
        alone = G.fit_grouped(df.withColumn("_part", F.lit(G.WHOLE)), spec, ["fold", "_part"])
        for m in (model, alone):
            assert all(r["proba"] == got[r["row_id"]][i] for r in m.predict(rows, ["row_id"]).collect())


def test_stack_takes_logistic_base_models(data):
    df, *_ = data
    stack = G.fit_stack(df, [L.Logistic(name="a"), L.Boosted(2, 2, name="XGBoost")], L.Logistic(name="meta"), inner_k=2, group=["fold"])
    got = stack.predict_all(df, ["fold", "row_id"]).collect()
    assert len(got) == 600 and all(0 <= r[c] <= 1 for r in got for c in ("a", "XGBoost", "proba"))


@pytest.mark.parametrize("extra", [True, False])
def test_trees_below_small_nodes_are_grown_by_tasks(data, extra, monkeypatch):
    """The same trees, whether levels are jobs to their end, from some node on one task's work, or all of it."""
    df = data[0]
    jobs, run = [], FO._split_level
    monkeypatch.setattr(FO, "_split_level", lambda *a: jobs.append(1) or run(*a))

    def grown(local_bytes: int, deal_bytes: int) -> tuple[set, int]:
        jobs.clear()
        monkeypatch.setattr(FO, "LOCAL_BYTES", local_bytes)
        monkeypatch.setattr(FO, "DEAL_BYTES", deal_bytes)
        model = FO.fit_forest(df, ["fold"], key="row_id", n_trees=2, max_depth=lambda k: (None, 9)[k[0]], extra=extra, seed=7)
        return {tuple(r) for r in model.nodes(df.sparkSession).collect()}, len(jobs)

    levels, many = grown(0, 0)
    node_bytes = 8 * len(df.first()["features"]) * 25
    mixed, some = grown(node_bytes, 1 << 30)
    assert many > some > 0 and mixed == levels and len(levels) > 50
    assert grown(node_bytes, 0)[0] == levels
    assert grown(1 << 24, 1 << 30) == (levels, 0)


@pytest.mark.parametrize("leaves", [None, 12])
def test_boosters_of_small_groups_are_one_job(data, leaves, monkeypatch):
    df = data[0]
    jobs, run = [], GR.merged_level
    monkeypatch.setattr(GR, "merged_level", lambda *a: jobs.append(1) or run(*a))

    def grown() -> tuple[set, int]:
        jobs.clear()
        model = GR.fit_boosted(df, ["fold"], n_rounds=2, max_depth=4, num_leaves=leaves, refresh=1)
        return {tuple(r) for r in model.nodes(df.sparkSession).collect()}, len(jobs)

    here, none = grown()
    monkeypatch.setattr(GR, "LOCAL_BYTES", 0)
    levels, many = grown()
    assert here == levels and none == 0 and many > 6 and len(levels) > 40


def test_bin_edges_count_in_batches(spark):
    """Missing values count for nothing, short rows are filled, and no row is exploded by feature."""
    rows = [(i % 2, [float(i % 7), None if i % 3 else -0.0, float("nan")][:2 + i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "_g int, features array<double>")
    edges = GR.bin_edges(df, 2, 4)
    for g in (0, 1):
        own = np.array([r[1][0] for r in rows if r[0] == g])
        assert np.allclose(edges[g][0], np.unique(np.quantile(own, [0.25, 0.5, 0.75])))
        assert edges[g][1].tolist() == [0.0] and len(edges[g][2]) == 0
