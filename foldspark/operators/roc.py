"""ROC-AUC (H8) and ROC curve points (H10) from probabilities.

Both first collapse the predictions to one row per distinct score with
positive and negative counts (partial aggregation before the shuffle), then
use ``descending_scan`` for the running sums.  Ties count one half, as in the
rank-sum form of the AUC; a group with one class has a NULL AUC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.metrics import known, one_row
from foldspark.operators.scan import descending_scan


def score_counts(pred: DataFrame, by: list[str], proba: str = "proba", label: str = "label") -> DataFrame:
    return (pred.groupBy(*by, known(proba).alias("score"))
            .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))


def roc_auc(pred: DataFrame, by: list[str], proba: str = "proba", label: str = "label",
            buckets: int = 256, max_groups: int = 1024) -> DataFrame:
    """AUC = (P*N - sum(pos * cum_neg) + sum(pos * neg) / 2) / (P*N), cum_neg over scores >= s."""
    return roc_auc_counts(score_counts(pred, by, proba, label), by, buckets, max_groups)


def roc_auc_counts(sc: DataFrame, by: list[str], buckets: int = 256, max_groups: int = 1024) -> DataFrame:
    """AUC from the collapsed (by, score, pos, neg) table."""
    s = descending_scan(sc, by, "score", ["pos", "neg"], buckets=buckets, max_groups=max_groups)
    g = s.groupBy(*by).agg(
        F.sum(F.col("pos").cast("double")).alias("P"), F.sum(F.col("neg").cast("double")).alias("N"),
        F.sum(F.col("pos").cast("double") * F.col("cum_neg")).alias("pc"),
        F.sum(F.col("pos").cast("double") * F.col("neg")).alias("pn"))
    pn = F.col("P") * F.col("N")
    return g.select(*by, F.when(pn > 0, (pn - F.col("pc") + F.col("pn") / 2) / pn).alias("roc_auc"))


def roc_points(pred: DataFrame, by: list[str], proba: str = "proba", label: str = "label",
               drop_intermediate: bool = True, buckets: int = 256, max_groups: int = 1024) -> DataFrame:
    """(fpr, tpr, threshold) at each distinct score, descending, plus the origin.

    With ``drop_intermediate`` a point is kept when it is the first or last one
    or when the second difference of fp or tp there is not zero, i.e. when the
    next lower score has different positive or negative counts.  The origin's
    threshold (+inf in the reference) is NULL.
    """
    s = descending_scan(score_counts(pred, by, proba, label), by, "score", ["pos", "neg"],
                        buckets=buckets, max_groups=max_groups)
    tot = s.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if by:
        pts = s.join(tot, by)
    else:  # one group: its two totals are scalars
        t = one_row(tot)
        pts = s.withColumn("P", F.lit(t["P"]).cast("bigint")).withColumn("N", F.lit(t["N"]).cast("bigint"))
    is_last = F.col("next_pos").isNull()
    keep = F.col("is_first") | is_last | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    if drop_intermediate:
        pts = pts.filter(keep)
    fpr = F.when(F.col("N") > 0, F.col("cum_neg") / F.col("N"))
    tpr = F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P"))
    curve = pts.select(*by, fpr.alias("fpr"), tpr.alias("tpr"), F.col("score").alias("threshold"))
    origin = tot.select(*by, F.when(F.col("N") > 0, F.lit(0.0)).alias("fpr"),
                        F.when(F.col("P") > 0, F.lit(0.0)).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    return curve.unionByName(origin)


def trapezoid_area(points: DataFrame, by: list[str]) -> DataFrame:
    """Area under (fpr, tpr) points by the trapezoid rule (a check of H8 against H10; curve points
    are few per group after dropping collinear ones)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy("fpr", "tpr")
    seg = points.select(*by, "fpr", "tpr", F.lag("fpr").over(w).alias("f0"), F.lag("tpr").over(w).alias("t0"))
    return seg.groupBy(*by).agg(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2).alias("area"))
