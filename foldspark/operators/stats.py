"""Wilcoxon signed-rank test of a target model against each other model over
the same folds (I1-I3, K6).

Zero differences are dropped; |d| gets average ranks for ties; W+ / W- are
the rank sums of positive / negative differences.  The p-value is exact for any
number of pairs: the distribution of the rank sum under random signs (ties
included) is built rank by rank, in n^3 steps.  The pairs of a comparison are
its folds - a bounded list - so the ranks may be gathered per comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wilcoxon(long: DataFrame, target: str, metric: str = "f1", alternative: str = "greater",
             model: str = "model", fold: str = "fold", value: str = "value") -> DataFrame:
    """(Compared_with, metric, n, w_plus, w_minus, wilcoxon_stat, p_value, note).

    alternative='greater': statistic W+, p = P(W+ >= observed).
    alternative='two-sided': statistic min(W+, W-), p = min(1, 2 * P(W+ <= min)).
    An absent target gives an empty table; no non-zero difference gives NULLs and a note.
    """
    lf = long.filter(F.col("metric") == metric)
    # the target's score of each fold next to every model's, read in one pass (no self-join)
    tv = F.max(F.when(F.col(model) == target, F.col(value))).over(Window.partitionBy(fold))
    x = lf.select(F.col(model).alias("Compared_with"), fold, value, tv.alias("_tv"))
    d = x.filter((F.col("Compared_with") != target) & F.col("_tv").isNotNull()).select(
        "Compared_with", fold, (F.col("_tv") - F.col(value)).alias("d"))
    comps = d.select("Compared_with").distinct()      # absent target: no comparison rows
    nz = d.filter(F.col("d") != 0)
    w = Window.partitionBy("Compared_with").orderBy(F.abs("d"))
    ties = Window.partitionBy("Compared_with", F.abs(F.col("d")))
    r = nz.select("Compared_with", fold, "d",
                  (F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0).alias("rk"))
    g = r.groupBy("Compared_with").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("rk")).otherwise(F.lit(0.0))).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("rk")).otherwise(F.lit(0.0))).alias("w_minus"),
        F.sort_array(F.collect_list(F.struct(fold, "rk"))).alias("_ranks"))
    stat = F.col("w_plus") if alternative == "greater" else F.least("w_plus", "w_minus")
    # exact for any n: the distribution of twice the rank sum (mid-ranks become whole numbers), one rank at a time
    ranks = F.transform(F.col("_ranks.rk"), lambda r: (r * 2).cast("int"))
    start = F.transform(F.sequence(F.lit(0), (F.col("n") * (F.col("n") + 1)).cast("int")),
                        lambda s: F.when(s == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    chance = F.aggregate(ranks, start, lambda acc, r: F.transform(
        acc, lambda p, s: (p + F.when(s >= r, F.element_at(acc, s - r + 1)).otherwise(F.lit(0.0))) / 2.0))
    dist = g.select("*", chance.alias("_chance"))
    if alternative == "greater":
        tail = F.slice("_chance", (F.col("w_plus") * 2).cast("int") + 1, F.size("_chance"))
        scale = 1.0
    else:
        tail = F.slice("_chance", F.lit(1), (F.least("w_plus", "w_minus") * 2).cast("int") + 1)
        scale = 2.0
    p_value = F.least(F.lit(1.0), F.aggregate(tail, F.lit(0.0), lambda acc, p: acc + p) * scale)
    out = dist.select("Compared_with", F.lit(metric).alias("metric"), "n", "w_plus", "w_minus",
                      stat.alias("wilcoxon_stat"), p_value.alias("p_value"))
    full = comps.join(out, "Compared_with", "left").select(
        "Compared_with", F.lit(metric).alias("metric"), F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        "w_plus", "w_minus", "wilcoxon_stat", "p_value",
        F.when(F.col("n").isNull(), F.lit("all differences are zero")).alias("note"))
    return full
