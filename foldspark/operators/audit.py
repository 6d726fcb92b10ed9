"""Data-set audit (C1-C6): two aggregate passes, no per-column jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.cast import to_number


def audit(df: DataFrame, key: str = "customerID", label: str = "Churn",
          numeric_text: tuple[str, ...] = ("TotalCharges",)) -> DataFrame:
    """C1-C3 in one pass: rows, columns, missing after the lenient cast, duplicate keys.

    Duplicate keys = rows beyond the first of each key, NULL keys equal to each
    other: ``n - count(distinct key) - (any NULL key)``.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(F.col(key)).alias("_nd"),
            F.max(F.col(key).isNull().cast("int")).alias("_anynull")]
    for c in numeric_text:
        aggs.append(F.count_if(to_number(c).isNull()).alias(f"missing_{c}"))
    aggs.append(F.count_if(F.col(label).isNull()).alias("missing_label"))
    a = df.agg(*aggs)
    return a.select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"),
        *[f"missing_{c}" for c in numeric_text], "missing_label",
        (F.col("n_rows") - F.col("_nd") - F.coalesce(F.col("_anynull"), F.lit(0))).alias("duplicate_keys"))


def label_distribution(df: DataFrame, label: str = "Churn", include_null: bool = False,
                       ratio_over: str = "non_null", digits: int = 4) -> DataFrame:
    """Count and ratio per label value.

    ``include_null``: NULL is a value of its own (step 2).  ``ratio_over``:
    'non_null' rows or 'all' rows as the denominator.
    """
    g = df.groupBy(F.col(label).alias("label_value")).agg(F.count(F.lit(1)).alias("n"))
    if not include_null:
        g = g.filter(F.col("label_value").isNotNull())
    whole = Window.partitionBy()  # over the few label rows only
    denom = (F.sum("n").over(whole) if ratio_over == "all"
             else F.sum(F.when(F.col("label_value").isNotNull(), F.col("n"))).over(whole))
    return g.select("label_value", "n", F.round(F.col("n") / denom, digits).alias("ratio"))


def split_shape(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Rows per split and class."""
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
