"""Classification metrics as grouped aggregates over a long prediction table.

One ``groupBy(by)`` with four ``count_if`` gives the confusion matrix (H1);
every other metric (H2-H7, H9) is arithmetic on those four counts, with the
zero-division conventions of the reference (0 when undefined).  ROC-AUC (H8)
lives in ``roc.py``; ``metrics`` joins the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.operators.clean import threshold_predict

# Metric names as written by the reference's tables.
METRICS = ("accuracy", "balanced_accuracy", "precision", "recall_sensitivity", "specificity", "f1",
           "roc_auc", "mcc")
# Objective names accepted for threshold tuning / refit, and their column.
OBJECTIVES = {"f1": "f1", "balanced_accuracy": "balanced_accuracy", "mcc": "mcc",
              "recall": "recall_sensitivity", "roc_auc": "roc_auc", "accuracy": "accuracy",
              "precision": "precision", "specificity": "specificity", "recall_sensitivity": "recall_sensitivity"}


def known(proba: str) -> Column:
    """The probability; a row without one is an error, so that no row drops out of a count unseen."""
    return F.coalesce(F.col(proba), F.raise_error(F.lit(f"{proba} is null in a prediction")).cast("double"))


def confusion(pred: DataFrame, by: list[str], threshold: float = 0.5, strict: bool = False,
              proba: str = "proba", label: str = "label") -> DataFrame:
    """H1: tn, fp, fn, tp per group (labels fixed to [0, 1])."""
    p = threshold_predict(known(proba), threshold, strict)
    y = F.col(label)
    return pred.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def metric_columns(tn="tn", fp="fp", fn="fn", tp="tp") -> dict[str, Column]:
    """H2-H7, H9 from confusion counts (column names or Columns)."""
    tn, fp, fn, tp = [F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (tn, fp, fn, tp)]
    n = tn + fp + fn + tp
    pos, neg = tp + fn, tn + fp
    rec = _ratio(tp, pos)
    spec = _ratio(tn, neg)
    # balanced accuracy: mean recall over the classes present in y_true
    bal = F.when((pos > 0) & (neg > 0), (rec + spec) / 2).when(pos > 0, rec).when(neg > 0, spec)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "accuracy": _ratio(tp + tn, n),
        "balanced_accuracy": bal,
        "precision": _ratio(tp, tp + fp),
        "recall_sensitivity": rec,
        "specificity": spec,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(F.lit(0.0)),
    }


def with_metrics(counts: DataFrame) -> DataFrame:
    return counts.select("*", *[c.alias(k) for k, c in metric_columns().items()])


def confusion_counts(sc: DataFrame, by: list[str], threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """H1 from the collapsed (by, score, pos, neg) table: no second pass over the predictions."""
    s = F.col("score")
    p = (s > threshold) if strict else (s >= threshold)
    return sc.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(~p, F.col("neg"))), F.lit(0)).alias("tn"),
        F.coalesce(F.sum(F.when(p, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~p, F.col("pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(p, F.col("pos"))), F.lit(0)).alias("tp"))


def metrics(pred: DataFrame, by: list[str], threshold: float = 0.5, strict: bool = False,
            proba: str = "proba", label: str = "label", auc: bool = True) -> DataFrame:
    """H1-H9 per group: tn fp fn tp + the eight metrics.

    One aggregate collapses the predictions to (group, distinct score) counts; the confusion
    matrix and the AUC both read that small table (its exchange is reused), so the prediction
    table is scanned once.
    """
    from foldspark.operators.roc import roc_auc_counts, score_counts
    sc = score_counts(pred, by, proba, label)
    m = with_metrics(confusion_counts(sc, by, threshold, strict))
    if auc:
        m = attach(m, roc_auc_counts(sc, by), by)
    return m


def attach(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Left join on ``by``.  Without keys both sides are small aggregates (one row per
    threshold / feature on the left, one row on the right): they are stacked and the
    right side's values spread with a window over that tiny union - no join at all."""
    if by:
        return df.join(other, by, "left")
    extra = [c for c in other.columns if c not in df.columns]
    u = df.withColumn("_src", F.lit(0)).unionByName(other.select(*extra).withColumn("_src", F.lit(1)),
                                                    allowMissingColumns=True)
    whole = Window.partitionBy()
    u = u.select(*[c for c in df.columns], *[F.max(F.when(F.col("_src") == 1, F.col(c))).over(whole).alias(c) for c in extra],
                 "_src")
    return u.filter(F.col("_src") == 0).drop("_src")


def one_row(df: DataFrame) -> dict:
    """Collect a one-row aggregate (a scalar result, bounded by construction)."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("expected exactly one row")
    return rows[0].asDict()


def fold_scores_long(m: DataFrame, by: list[str], metrics_: tuple[str, ...] = METRICS) -> DataFrame:
    """One row per (group, metric) via unpivot."""
    return m.unpivot(by, list(metrics_), "metric", "value")


def fold_scores_nested(long: DataFrame, fold: str = "fold", by: str = "model") -> DataFrame:
    """H15, nested form: one row per model with a map metric -> scores in fold order (folds are few)."""
    per = long.groupBy(by, "metric").agg(F.array_sort(F.collect_list(F.struct(fold, "value"))).alias("_s"))
    return per.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("metric", F.col("_s")["value"].alias("scores"))))).alias("scores"))


def confusion_matrix(m: DataFrame, by: list[str]) -> DataFrame:
    """H1, nested form: rows of the matrix for the labels [0, 1], as written to JSON."""
    return m.select(*by, F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("matrix"))


def summarize(long: DataFrame, by: list[str], ddof: int = 1, value: str = "value") -> DataFrame:
    """Mean and std over folds; ``ddof=1`` sample std (0 for one fold), ``ddof=0`` population."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0)) if ddof == 1 else F.stddev_pop(value)
    return long.groupBy(*by).agg(F.avg(value).alias("mean"), sd.alias("std"), F.count(value).alias("n_folds"))


def format_mean_std(summary: DataFrame, row: str, col: str = "metric", digits: int = 4,
                    order: tuple[str, ...] = METRICS) -> DataFrame:
    """H17: 'mean ± std' text, one column per metric (pivot over a fixed metric list)."""
    txt = F.format_string(f"%.{digits}f ± %.{digits}f", F.col("mean"), F.col("std"))
    return summary.groupBy(row).pivot(col, list(order)).agg(F.first(txt))


def leaderboard(m: DataFrame, metric: str, by: str = "model", n: int = 1) -> DataFrame:
    """Best ``n`` rows by ``metric`` (descending, name as tie-break)."""
    return m.orderBy(F.col(metric).desc_nulls_last(), F.col(by).asc()).limit(n)


def objective(m: DataFrame, metric: str) -> Column:
    """The column of an objective name; unknown names raise."""
    if metric not in OBJECTIVES:
        raise ValueError(f"unknown metric {metric!r}; known: {sorted(OBJECTIVES)}")
    return F.col(OBJECTIVES[metric])
