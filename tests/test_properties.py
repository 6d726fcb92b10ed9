"""Property and hand-computed tests (the reference has none; SURVEY section 5 is the model)."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from foldspark.functions.rand import hash_hex
from foldspark.operators import clean as B
from foldspark.operators import metrics as H
from foldspark.operators import prep as E
from foldspark.operators import roc as R
from foldspark.operators import search as J
from foldspark.operators import smote as S
from foldspark.operators import split as D
from foldspark.operators import stats as I
from foldspark.operators import thresholds as T
from foldspark.operators.rank import hashed_rank, ordered_rank
from foldspark.plans.queries import churn_clean, churn_roles, emb_train
from foldspark.sources import fixtures as X


def test_distributed_ranks_equal_plain_window(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_orderstatus")
    o = o.withColumn("_h", hash_hex(F.lit(7), F.col("o_orderkey")))
    plain = o.withColumn("r0", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("_h", "o_orderkey")))
    a = hashed_rank(o, ["o_orderstatus"], "_h", tie=["o_orderkey"], out="r1", digits=2)
    b = ordered_rank(o, ["o_orderstatus"], ["_h", "o_orderkey"], out="r2", partitions=5)
    j = plain.join(a.select("o_orderkey", "r1"), "o_orderkey").join(b.select("o_orderkey", "r2"), "o_orderkey")
    assert j.filter((F.col("r0") != F.col("r1")) | (F.col("r0") != F.col("r2"))).count() == 0
    assert j.count() == o.count()


def test_fold_sizes_and_every_row_validates_once(spark):
    df = churn_clean(spark, SF_SMALL)
    for shuffle in (True, False):
        f = D.stratified_kfold(df, k=5, shuffle=shuffle)
        sizes = f.groupBy("label", "fold").count().groupBy("label").agg(
            (F.max("count") - F.min("count")).alias("spread")).collect()
        assert all(r["spread"] <= 1 for r in sizes)
        ex = D.expand_folds(f, 5)
        per_row = ex.filter(F.col("role") == "val").groupBy("row_id").count()
        assert per_row.filter(F.col("count") != 1).count() == 0
        assert per_row.count() == df.count()


def test_holdout_exact_sizes(spark):
    df = churn_clean(spark, SF_SMALL)
    h = D.stratified_holdout(df, 0.2)
    for r in h.groupBy("label").agg(F.count_if(F.col("split") == "test").alias("t"), F.count(F.lit(1)).alias("n")).collect():
        assert r["t"] == round(0.2 * r["n"])


def test_leak_free_statistics(spark):
    """Changing the validation rows of fold 0 must not change the statistics of fold 0."""
    df = D.stratified_kfold(churn_clean(spark, SF_SMALL), k=5)
    roles = churn_roles(df)
    st1 = E.fit_prep(df, roles, "fold", [0])
    bad = df.withColumn("tenure", F.when(F.col("fold") == 0, F.lit(99999)).otherwise(F.col("tenure"))) \
            .withColumn("Segment", F.when(F.col("fold") == 0, F.lit("ZZZ")).otherwise(F.col("Segment")))
    st2 = E.fit_prep(bad, roles, "fold", [0])
    a = sorted(map(tuple, st1.numeric.select("col_name", "median", "mean", "std").collect()))
    b = sorted(map(tuple, st2.numeric.select("col_name", "median", "mean", "std").collect()))
    assert a == b
    assert st2.vocab.filter(F.col("category") == "ZZZ").count() == 0


def test_unseen_category_is_all_zero(spark):
    df = D.stratified_kfold(churn_clean(spark, SF_SMALL), k=5)
    roles = B.Roles(numeric=["tenure"], categorical=["Segment"])
    st = E.fit_prep(df, roles, "fold", [0])
    row = spark.createDataFrame([("x", 0, 0, 0, 5, "NEVER_SEEN")], "row_id string, label int, fold int, fold_id int, tenure int, Segment string")
    out = E.apply_prep(row, st, output="array").collect()[0]["features"]
    assert all(v == 0.0 for v in out[1:])


def test_smote_rows_on_segment_and_budget(spark):
    tr = emb_train(spark, SF_SMALL)
    sy = S.smote(tr, ratio=1.0, k=3)
    bud = {r["fold_id"]: r["budget"] for r in S.smote_budget(tr, 1.0).collect()}
    got = {r["fold_id"]: r["count"] for r in sy.groupBy("fold_id").count().collect()}
    assert got == {k: v for k, v in bud.items() if v > 0}
    m = tr.filter("label = 1").select("fold_id", F.col("row_id").alias("base_id"), F.col("features").alias("xb"))
    n = tr.filter("label = 1").select("fold_id", F.col("row_id").alias("nn_id"), F.col("features").alias("xn"))
    chk = sy.join(m, ["fold_id", "base_id"]).join(n, ["fold_id", "nn_id"]).limit(50).collect()
    for r in chk:
        exp = np.array(r["xb"]) + r["gap"] * (np.array(r["xn"]) - np.array(r["xb"]))
        assert np.allclose(exp, np.array(r["features"]))
        assert 0.0 <= r["gap"] < 1.0


def test_knn_equals_brute_force(spark):
    tr = emb_train(spark, SF_SMALL).filter("fold_id = 0")
    knn = S.nearest_minority(tr, k=3, block_rows=4)  # many blocks: exercises the blocked path
    rows = tr.filter("label = 1").collect()
    ids = [r["row_id"] for r in rows]
    xs = np.array([r["features"] for r in rows])
    got = {(r["row_id"], r["nn_rank"]): r["nn_id"] for r in knn.collect()}
    for i, rid in enumerate(ids):
        d = ((xs - xs[i]) ** 2).sum(1)
        order = sorted((d[j], ids[j]) for j in range(len(ids)) if j != i)[:3]
        for rank, (_, nid) in enumerate(order, start=1):
            assert got[(rid, rank)] == nid


def test_auc_properties_and_trapezoid(spark):
    p = X.scored_orders(spark, SF_SMALL).filter("model = 'XGBoost'")
    a = R.roc_auc(p, ["fold"]).collect()
    sq = R.roc_auc(p.withColumn("proba", F.col("proba") * F.col("proba")), ["fold"]).collect()
    flip = R.roc_auc(p.withColumn("label", 1 - F.col("label")), ["fold"]).collect()
    A = {r["fold"]: r["roc_auc"] for r in a}
    assert all(abs(A[r["fold"]] - r["roc_auc"]) < 1e-12 for r in sq)
    assert all(abs(A[r["fold"]] - (1 - r["roc_auc"])) < 1e-12 for r in flip)
    pts = R.roc_points(p, ["fold"], drop_intermediate=True)
    area = {r["fold"]: r["area"] for r in R.trapezoid_area(pts, ["fold"]).collect()}
    assert all(abs(area[f] - A[f]) < 1e-9 for f in A)


def test_one_class_auc_is_null_and_zero_division(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, proba double")
    m = H.metrics(df, [], 0.95).collect()[0]
    assert m["roc_auc"] is None
    assert m["precision"] == 0.0 and m["f1"] == 0.0 and m["mcc"] == 0.0 and m["specificity"] == 0.0
    assert m["balanced_accuracy"] == 0.0


def test_sweep_equals_brute_force(spark):
    p = X.scored_orders(spark, SF_SMALL).filter("model = 'LightGBM'")
    sw = {round(r["threshold"], 2): (r["tp"], r["fp"], r["f1"]) for r in T.threshold_sweep(p, [], with_auc=False).collect()}
    rows = [(r["label"], r["proba"]) for r in p.collect()]
    for j in range(10, 91):
        t = j / 100.0
        tp = sum(1 for y, q in rows if y == 1 and q >= t)
        fp = sum(1 for y, q in rows if y == 0 and q >= t)
        assert sw[round(t, 2)][:2] == (tp, fp)


# fixed test input: candidate scores with gains below min_delta, ties and failures
HISTORY = [(1, 'ok', 0.60), (2, 'ok', 0.60005), (3, 'failed', None), (4, 'ok', 0.61), (5, 'ok', 0.61),
           (6, 'ok', 0.61005), (7, 'failed', None), (8, 'ok', 0.6), (9, 'ok', 0.58), (10, 'ok', 0.59),
           (11, 'ok', 0.61008), (12, 'ok', 0.5), (13, 'ok', 0.7)]


def test_state_machine_against_python_loop(spark):
    h = spark.createDataFrame(HISTORY, "iteration int, status string, score double")
    got = [(r["iteration"], r["status"], r["no_improve_count"]) for r in J.best_so_far(h).orderBy("iteration").collect()]
    best, ni, exp = -math.inf, 0, []
    for it, st, sc in HISTORY:
        if st == "failed":
            exp.append((it, "failed", ni))
            continue
        if sc > best + 1e-4:
            best, ni, s = sc, 0, "best"
        else:
            ni, s = ni + 1, "no_improvement"
        exp.append((it, s, ni))
        if ni >= 6:
            break
    assert got == exp
    assert got[-1][0] == 11


def test_wilcoxon_exact_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for f in range(6):
        rows.append(("T", f, "f1", float(rng.normal())))
        rows.append(("A", f, "f1", float(rng.normal())))
    rows.append(("Z", 0, "f1", rows[0][3]))  # identical to target on fold 0 only
    long = spark.createDataFrame(rows, "model string, fold int, metric string, value double")
    out = {r["Compared_with"]: r for r in I.wilcoxon(long, "T", "f1", "greater").collect()}
    t = {f: v for m, f, _, v in rows if m == "T"}
    a = {f: v for m, f, _, v in rows if m == "A"}
    d = [t[f] - a[f] for f in range(6)]
    ab = sorted(abs(x) for x in d)
    ranks = [ab.index(abs(x)) + 1 for x in d]
    wp = sum(r for r, x in zip(ranks, d) if x > 0)
    cnt = sum(1 for signs in itertools.product([0, 1], repeat=6) if sum(r for r, s in zip(ranks, signs) if s) >= wp)
    assert out["A"]["wilcoxon_stat"] == wp
    assert abs(out["A"]["p_value"] - cnt / 64) < 1e-12
    assert out["Z"]["n"] == 0 and out["Z"]["p_value"] is None


def test_select_models_unknown_raises(spark):
    m = spark.createDataFrame([("XGBoost",), ("LightGBM",)], "model string")
    assert B.select_models(m, "all").count() == 2
    with pytest.raises(ValueError):
        B.select_models(m, "XGBoost, Nope")


def test_logistic_learns_real_signal(spark):
    from pyspark.ml.functions import array_to_vector
    from foldspark.operators import learners as L
    dq = X.doc_quality(spark, SF_MID)
    h = D.stratified_holdout(dq, 0.3)
    feats = F.array(F.col("uniq_ratio"), F.col("alpha_ratio"), F.log1p(F.col("n_words").cast("double")))
    x = h.withColumn("features", array_to_vector(feats))
    pred = L.fit_predict(x.filter("split = 'train'"), x.filter("split = 'test'"), L.Logistic(C=10.0), ["row_id", "label"])
    auc = R.roc_auc(pred, []).collect()[0]["roc_auc"]
    assert auc > 0.7


def test_quantiles_equal_percentile(spark):
    df = D.stratified_kfold(churn_clean(spark, SF_SMALL), k=5)
    cols = churn_roles(df).numeric
    qs = [0.1, 0.5, 0.75]
    counts = E.value_counts(df, cols, [], [F.col("fold") != 0, F.lit(True)])
    got = {(r[0], r[1]): r[2] for r in E.exact_quantiles(counts, qs).collect()}
    for c in cols:
        for side, rows in enumerate((df.filter("fold <> 0"), df)):
            want = rows.agg(F.percentile(F.col(c).cast("double"), qs)).first()[0]
            assert got[side, c] == pytest.approx(want, rel=1e-9, abs=1e-9), (c, side)


def test_prep_of_a_hot_value_and_of_columns_without_values(spark):
    rows = [(i % 2, 0.0 if i % 6 else float(i), None if i % 2 else 1.0, "a" if i % 5 else f"c{i}", None)
            for i in range(300)]
    df = spark.createDataFrame(rows, "fold int, hot double, half double, cat string, none string")
    roles = B.Roles(numeric=["hot", "half"], categorical=["cat", "none"])
    st = E.fit_prep(df, roles, "fold", [0, 1])
    num = {(r["fold_id"], r["col_name"]): r for r in st.numeric.collect()}
    for k in (0, 1):
        side = [r for r in rows if r[0] != k]
        assert num[k, "hot"]["median"] == float(np.median([r[1] for r in side]))
        assert num[k, "hot"]["mean"] == pytest.approx(np.mean([r[1] for r in side]))
        assert num[k, "half"]["all_null"] == (k == 0)      # odd rows have no value: nothing to learn for fold 0
        cats = sorted({r[3] for r in side})
        voc = {r["category"]: r["idx"] for r in st.vocab.filter(f"fold_id = {k} AND col_name = 'cat'").collect()}
        assert voc == {c: i for i, c in enumerate(cats)}
        width = (1 if k == 0 else 2) + len(cats)           # a column without values has no feature
        x = E.apply_prep(df.withColumn("fold_id", F.lit(k)), st, output="array")
        assert [r[0] for r in x.select(F.size("features")).distinct().collect()] == [width]
        names = [r[0] for r in E.feature_names(st).filter(f"fold_id = {k}").orderBy("feature_idx").select("feature_idx").collect()]
        assert names == list(range(width))


def test_tree_shap_sums_to_margin_and_matches_brute_force(spark):
    from itertools import combinations
    from math import factorial
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from foldspark.operators import learners as L
    from foldspark.operators.contrib import gbt_trees, tree_contributions
    rng = np.random.default_rng(1)
    X_ = rng.normal(size=(300, 4))
    y_ = ((X_[:, 0] + 0.5 * X_[:, 1] * X_[:, 2]) > 0).astype(int)
    df = spark.createDataFrame([(i, int(y_[i]), X_[i].tolist()) for i in range(300)], "row_id int, label int, x array<double>")
    df = df.withColumn("features", array_to_vector("x"))
    m = L.fit(df, L.Boosted(4, 3, 0.3, "depth"))
    sub = df.filter("row_id < 12")
    c = tree_contributions(m, sub)
    got = {(r[0], r[1]): r[2] for r in c.collect()}
    margin = {r[0]: r[1] for r in m.transform(sub).select("row_id", vector_to_array("rawPrediction")[1]).collect()}
    for rid, mg in margin.items():
        assert abs(sum(got[(rid, f)] for f in range(-1, 4)) - mg) < 1e-9
    trees = gbt_trees(m)

    def cond_exp(x, S, t, j=0):
        if t["left"][j] < 0:
            return t["value"][j]
        d = t["feature"][j]
        if d in S:
            nxt = t["left"][j] if x[d] <= t["threshold"][j] else t["right"][j]
            return cond_exp(x, S, t, nxt)
        l, r = t["left"][j], t["right"][j]
        return (t["cover"][l] * cond_exp(x, S, t, l) + t["cover"][r] * cond_exp(x, S, t, r)) / t["cover"][j]

    for rid in range(3):
        x = X_[rid]
        for f in range(4):
            others = [g for g in range(4) if g != f]
            phi = 0.0
            for k in range(4):
                for S in combinations(others, k):
                    wgt = factorial(k) * factorial(4 - k - 1) / factorial(4)
                    for w, t in trees:
                        phi += w * wgt * (cond_exp(x, set(S) | {f}, t) - cond_exp(x, set(S), t))
            assert abs(phi - got[(rid, f)]) < 1e-9


def test_batched_booster_equals_separate_and_learns(spark):
    from foldspark.operators.boost import fit_booster
    dq = X.doc_quality(spark, SF_MID)
    ex = D.expand_folds(D.stratified_kfold(dq, k=3), 3).withColumn(
        "features", F.array(F.col("uniq_ratio"), F.col("alpha_ratio"), F.log1p(F.col("n_words").cast("double"))))
    tr = ex.filter("role = 'train'")
    both = fit_booster(tr.filter("fold_id < 2"), ["fold_id"], n_rounds=3, max_depth=2)
    one = fit_booster(tr.filter("fold_id = 0"), ["fold_id"], n_rounds=3, max_depth=2)
    for tb, to in zip(both.trees, one.trees):
        for a, b in zip(tb[(0,)], to[(0,)]):
            assert np.allclose(a, b)
    p = both.predict(ex.filter("role = 'val' AND fold_id < 2"), ["fold_id", "row_id", "label"])
    assert all(r["roc_auc"] > 0.85 for r in R.roc_auc(p, ["fold_id"]).collect())


def test_batched_extra_trees_equal_separate_and_learn(spark):
    from foldspark.operators.boost import fit_extra_trees
    dq = X.doc_quality(spark, SF_MID)
    ex = D.expand_folds(D.stratified_kfold(dq, k=3), 3).withColumn(
        "features", F.array(F.col("uniq_ratio"), F.col("alpha_ratio"), F.log1p(F.col("n_words").cast("double"))))
    tr = ex.filter("role = 'train'")
    both = fit_extra_trees(tr.filter("fold_id < 2"), ["fold_id"], n_trees=3, max_depth=3)
    one = fit_extra_trees(tr.filter("fold_id = 0"), ["fold_id"], n_trees=3, max_depth=3)
    for t in range(3):
        for a, b in zip(both.trees[((0,), t)], one.trees[((0,), t)]):
            assert np.allclose(a, b)
    p = both.predict(ex.filter("role = 'val' AND fold_id < 2"), ["fold_id", "row_id", "label"])
    assert all(r["roc_auc"] > 0.85 for r in R.roc_auc(p, ["fold_id"]).collect())


def test_leafwise_booster_batched_equals_separate_and_loss_falls(spark):
    from foldspark.operators.boost import fit_booster_leafwise
    dq = X.doc_quality(spark, SF_MID)
    ex = D.expand_folds(D.stratified_kfold(dq, k=3), 3).withColumn(
        "features", F.array(F.col("uniq_ratio"), F.col("alpha_ratio"), F.log1p(F.col("n_words").cast("double"))))
    tr = ex.filter("role = 'train'")
    both = fit_booster_leafwise(tr.filter("fold_id < 2"), ["fold_id"], n_rounds=2, num_leaves=4)
    one = fit_booster_leafwise(tr.filter("fold_id = 0"), ["fold_id"], n_rounds=2, num_leaves=4)
    for tb, to in zip(both.trees, one.trees):
        for a, b in zip(tb[(0,)], to[(0,)]):
            assert np.allclose(a, b)
    loss = F.avg(-(F.col("label") * F.log("proba") + (1 - F.col("label")) * F.log(1 - F.col("proba"))))
    p = one.predict(tr.filter("fold_id = 0"), ["fold_id", "row_id", "label"]).agg(loss).first()[0]
    assert p < math.log(2) - 0.05   # below the loss of the 0.5 base score


def test_wilcoxon_absent_target_is_empty(spark):
    long = spark.createDataFrame([("A", 0, "f1", 0.5), ("B", 0, "f1", 0.4)], "model string, fold int, metric string, value double")
    assert I.wilcoxon(long, "T", "f1").count() == 0


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_nearest_minority_ties_by_id(spark, partitions):
    """Tied distances: the smallest ids, whatever the order and number of partitions (one-hot like rows)."""
    import numpy as np
    from foldspark.operators.smote import nearest_minority
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (60, 3)).astype(float)
    x[:40] = x[0]
    rows = [(0, i, [float(v) for v in x[i]], 1) for i in rng.permutation(60).tolist()]
    df = spark.createDataFrame(rows, "fold_id int, row_id int, features array<double>, label int").repartition(partitions)
    got = {(r.row_id, r.nn_rank): r.nn_id for r in nearest_minority(df, k=3, block_rows=17).collect()}
    want = {}
    for i in range(60):
        near = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(60) if j != i)[:3]
        want.update({(i, r + 1): j for r, (_, j) in enumerate(near)})
    assert got == want


def test_wilcoxon_is_exact_for_many_pairs(spark):
    """Fifteen pairs with ties against the listing of all sign vectors."""
    import itertools
    import numpy as np
    from foldspark.operators.stats import wilcoxon
    d = [0.5, -0.25, 1, 1, 2, -3, 4, 0, 5, 6, -6, 7, 8, 9, 10, 0.5]
    rows = [(m, "f1", i, v) for i, x in enumerate(d) for m, v in (("a", float(x)), ("b", 0.0))]
    long = spark.createDataFrame(rows, "model string, metric string, fold int, value double")
    nz = np.array([x for x in d if x])
    size = np.abs(nz)
    rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    plus = rank[nz > 0].sum()
    sums = np.array(list(itertools.product((0, 1), repeat=len(nz)))) @ rank
    r = wilcoxon(long, "a").collect()[0]
    assert r.n == 15 and abs(r.p_value - (sums >= plus).mean()) < 1e-12
    low = min(plus, rank.sum() - plus)
    two = wilcoxon(long, "a", alternative="two-sided").collect()[0]
    assert abs(two.p_value - min(1, 2 * (sums <= low).mean())) < 1e-12


def test_missing_probability_is_an_error(spark):
    from foldspark.operators.metrics import confusion
    from foldspark.operators.roc import roc_auc
    df = spark.createDataFrame([("m", 0.5, 1), ("m", None, 0)], "model string, proba double, label int")
    for out in (confusion, roc_auc):
        with pytest.raises(Exception, match="proba is null"):
            out(df, ["model"]).collect()


def test_small_scale_column_is_not_constant(spark):
    from pyspark.sql import functions as F
    from foldspark.operators.prep import _constant
    df = spark.createDataFrame([(float(i) * 1e-13, 5.0) for i in range(7)], "a double, b double")
    r = df.agg(*[_constant(F.var_pop(c), F.avg(c), F.count(c)).alias(c) for c in "ab"]).first()
    assert r.a is False and r.b is True


def test_extra_trees_without_a_depth_limit_separate_all_rows(spark):
    from foldspark.operators.boost import fit_extra_trees
    rng = np.random.default_rng(5)
    rows = [(0, f"r{i}", int(rng.random() < 0.5), [float(v) for v in rng.random(2)]) for i in range(120)]
    df = spark.createDataFrame(rows, "fold_id int, row_id string, label int, features array<double>")
    m = fit_extra_trees(df, ["fold_id"], n_trees=2, max_depth=None)
    got = m.predict(df, ["fold_id", "row_id", "label"]).collect()
    assert len(got) == 120 and all(abs(r["proba"] - r["label"]) < 1e-9 for r in got)


def test_repeated_keys_and_too_deep_trees_are_errors(spark):
    from foldspark.operators import ensemble as G
    from foldspark.operators import learners as L
    oof = spark.createDataFrame([("a", 0, "M", 0.1), ("a", 0, "M", 0.2)], "row_id string, label int, model string, proba double")
    with pytest.raises(Exception, match="several predictions"):
        G.meta_features(oof, ["row_id", "label"], ["M"]).collect()
    with pytest.raises(ValueError, match="depth 40"):
        L.estimator(L.RandomForest(5, 40))
    assert L.estimator(L.RandomForest(5, None)).getMaxDepth() == 30


def test_nearest_minority_looks_at_near_cells_only(spark):
    """Rows of other categories lie in other cells, none of which holds many rows; two groups of other widths, against loops."""
    import numpy as np
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g, width in ((0, 4), (1, 6)):
        kind = rng.integers(0, 4, 400)
        x = np.column_stack([rng.normal(size=400).round(1), np.eye(4)[kind][:, :width - 1] * 3, np.zeros((400, max(0, width - 5)))])
        rows += [(g, i, [float(v) for v in x[i]], 1) for i in range(400)]
        dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        for i in range(400):
            near = sorted((dist[i, j], j) for j in range(400) if j != i)[:3]
            want |= {(g, i, r + 1): j for r, (_, j) in enumerate(near)}
    df = spark.createDataFrame(rows, "fold_id int, row_id int, features array<double>, label int").repartition(7)
    got = {(r.fold_id, r.row_id, r.nn_rank): r.nn_id for r in S.nearest_minority(df, k=3, block_rows=50).collect()}
    assert got == want
    m = S._in_cells(df.selectExpr("fold_id as _g", "row_id", "features as x"), 800, 400, 50)
    for cells in S._boxes(m).values():
        assert sum(c[1] for c in cells) == 400 and max(c[1] for c in cells) <= 100
        apart = [sum(np.maximum(0, np.maximum(a[2] - b[3], b[2] - a[3])) ** 2) > 1 for a in cells for b in cells]
        assert np.mean(apart) > 0.5


def test_meta_features_tasks_grow_with_the_rows(spark):
    """One dealing of the keys, to as many tasks as the caller says; unnamed models keep their keys; repeated keys raise."""
    from foldspark.operators import ensemble as G
    from foldspark.operators.rank import ROWS_A_TASK, tasks_for
    rows = [(i % 3, i, m, i / 100 + j) for i in range(60) for j, m in enumerate("ab") if (i, m) != (7, "b")] + [(0, 99, "c", 0.5)]
    oof = spark.createDataFrame(rows, "fold int, row_id int, model string, proba double")
    wide = G.meta_features(oof, ["fold", "row_id"], ["a", "b"], partitions=37)
    assert wide.rdd.getNumPartitions() == 37 and wide._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1
    assert {tuple(r) for r in wide.collect()} == {(i % 3, i, i / 100, None if i == 7 else i / 100 + 1) for i in range(60)} | {(0, 99, None, None)}
    with pytest.raises(Exception, match="several predictions"):
        G.meta_features(oof.unionByName(oof.limit(1)), ["fold", "row_id"], ["a", "b"]).collect()
    assert tasks_for(spark, 1) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, 1000 * ROWS_A_TASK + 1) == 1001
