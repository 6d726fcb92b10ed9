"""Ordered scans over scores without a one-task-per-group sort.

Input: one row per ``(by, score)`` - already collapsed to distinct scores, so
map-side combine has removed duplicates.  Output adds, in descending score
order within each group, the inclusive running sum of every value column, the
values of the next (lower) score and a flag for the first (highest) score.

A plain ``Window.partitionBy(by).orderBy(score)`` would push all distinct
scores of a group through one task.  Here the score range is cut into
``buckets`` monotone bins; per-bin totals and first rows form a small table
(at most ``groups * (buckets + 2)`` rows) whose prefix sums and ``lead`` give
the cross-bin carry, and the per-row windows are partitioned by
``(by, bin)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.operators.rank import BROADCAST_ROW_LIMIT


def descending_scan(d: DataFrame, by: list[str], score: str, cols: list[str], buckets: int = 256,
                    lo: float = 0.0, hi: float = 1.0, max_groups: int = 1024, adaptive: bool = True) -> DataFrame:
    """``adaptive``: bin edges are approximate quantiles of the distinct scores of each group
    (a mergeable sketch), so a crowded score range is split as finely as a sparse one;
    otherwise fixed-width bins over [lo, hi] (scores outside go to the two end bins)."""
    by = list(by)
    if adaptive:
        qs = [i / buckets for i in range(1, buckets)]
        edges = d.groupBy(*by).agg(F.percentile_approx(F.col(score), qs, 10 * buckets).alias("_edges"))
        edges = F.broadcast(edges) if max_groups * buckets <= BROADCAST_ROW_LIMIT else edges
        if by:
            b = d.join(edges, by)
        else:  # one group: at most ``buckets`` edges, as a literal
            e = edges.first()["_edges"] or []
            b = d.withColumn("_edges", F.array(*[F.lit(float(v)) for v in e]).cast("array<double>"))
        b = b.withColumn("_b", F.size(F.filter("_edges", lambda e: e <= F.col(score))).cast("int")).drop("_edges")
    else:
        width = (hi - lo) / buckets
        bkt = F.least(F.greatest(F.floor((F.col(score) - F.lit(lo)) / F.lit(width)), F.lit(-1)), F.lit(buckets))
        b = d.withColumn("_b", bkt.cast("int"))
    top = F.max_by(F.struct(*[F.col(c).alias(c) for c in cols]), F.col(score))
    t = b.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols], top.alias("_top"))
    wb = Window.partitionBy(*by).orderBy(F.col("_b").desc())
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(*by, "_b",
                 *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols],
                 F.lead("_top", 1).over(wb).alias("_nt"),
                 (F.row_number().over(wb) == 1).alias("_fb"))
    if max_groups * (buckets + 2) <= BROADCAST_ROW_LIMIT:
        t = F.broadcast(t)
    w = Window.partitionBy(*by, "_b").orderBy(F.col(score).desc())
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = b.join(t, by + ["_b"])
    has_next = F.lead(F.col(score), 1).over(w).isNotNull()
    out = x.select(
        *[c for c in d.columns],
        *[(F.col(f"_o_{c}") + F.sum(c).over(upto)).alias(f"cum_{c}") for c in cols],
        *[F.when(has_next, F.lead(c, 1).over(w)).otherwise(F.col("_nt")[c]).alias(f"next_{c}") for c in cols],
        (F.col("_fb") & (F.row_number().over(w) == 1)).alias("is_first"),
    )
    return out
