"""Exact, repeatable stratified splits and folds.

Order inside each class comes from md5(seed|key) (our only random source), so
sizes are exact - unlike ``sampleBy`` which is Bernoulli - and an SQL window
gives the same assignment.  Ranks are computed with ``hashed_rank`` /
``ordered_rank`` so that no class is sorted inside one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions.rand import hash_hex
from foldspark.operators.rank import hashed_rank, ordered_rank

SEED = 42  # fixed value: the reference's random_state


def _seed_col(seed) -> Column:
    return seed if isinstance(seed, Column) else F.lit(seed)


def stratified_kfold(df: DataFrame, k: int = 5, key: str = "row_id", label: str = "label",
                     seed=SEED, shuffle: bool = True, by: tuple[str, ...] = (), out: str = "fold") -> DataFrame:
    """Add ``fold`` in [0, k).

    Shuffled: rank within (by, label) by md5(seed|key); fold = (rank-1) % k.
    Unshuffled: rank by key; contiguous blocks, the first ``n % k`` blocks one
    row larger (per-class fold sizes differ by at most one either way).
    """
    part = list(by) + [label]
    if shuffle:
        h = df.withColumn("_h", hash_hex(_seed_col(seed), F.col(key)))
        r = hashed_rank(h, part, "_h", tie=[key], out="_r", max_groups=64).drop("_h")
        return r.withColumn(out, ((F.col("_r") - 1) % k).cast("int")).drop("_r")
    r = ordered_rank(df, part, [key], out="_r")
    n = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(F.broadcast(n), part)  # one row per (by, class): bounded by the fold/class grid
    q = F.floor(F.col("_n") / k)
    rem = F.col("_n") % k
    i = F.col("_r") - 1
    fold = F.when(i < (q + 1) * rem, F.floor(i / (q + 1))).otherwise(rem + F.floor((i - (q + 1) * rem) / q))
    return r.withColumn(out, fold.cast("int")).drop("_r", "_n")


def stratified_holdout(df: DataFrame, test_size: float = 0.2, key: str = "row_id", label: str = "label",
                       seed=SEED, by: tuple[str, ...] = (), out: str = "split") -> DataFrame:
    """``split`` = 'test' for the first round(test_size * n_class) rows
    of each (by, class) in md5(seed|key) order, else 'train'."""
    part = list(by) + [label]
    h = df.withColumn("_h", hash_hex(_seed_col(seed), F.col(key)))
    r = hashed_rank(h, part, "_h", tie=[key], out="_r", max_groups=64).drop("_h")
    n = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(F.broadcast(n), part)
    n_test = F.round(F.lit(float(test_size)) * F.col("_n"))
    return r.withColumn(out, F.when(F.col("_r") <= n_test, F.lit("test")).otherwise(F.lit("train"))).drop("_r", "_n")


def nested_holdout(df: DataFrame, fold: str = "fold", test_size: float = 0.2, key: str = "row_id",
                   label: str = "label", base_seed: int = SEED, out: str = "inner_split") -> DataFrame:
    """A stratified split inside each training fold; seed = base_seed + fold."""
    seed = (F.lit(base_seed) + F.col(fold)).cast("string")
    return stratified_holdout(df, test_size, key, label, seed=seed, by=(fold,), out=out)


def expand_folds(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Every row once per fold id; role 'val' where it is held out, else 'train'.

    A generator (``explode(sequence)``), not a join: all K folds in one plan.
    """
    return (df.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
              .withColumn("role", F.when(F.col(fold) == F.col("fold_id"), F.lit("val")).otherwise(F.lit("train"))))


def fold_rows(df: DataFrame, k: int, fold: str = "fold", role: str = "val") -> DataFrame:
    """The rows of fold ``k`` (role 'val') or its complement ('train')."""
    return df.filter(F.col(fold) == k) if role == "val" else df.filter(F.col(fold) != k)
