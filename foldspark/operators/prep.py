"""Fit-on-train preprocessing for every fold at once.

``fit_prep`` learns, for each fold id k, the statistics of the rows whose fold is not k - the training side of fold k.
One aggregate over the table counts every distinct value of every column on each training side (``value_counts``,
combined before its shuffle); the counts are sorted over the cluster by (column, value) and written once.  Medians,
means, deviations, modes and vocabularies all come from that table: values are distinct in it, so no value can fill
a partition however often it occurs, and no column is sorted or held in one task.

Statistics of numeric columns are tiny (folds x columns) and are applied by a broadcast join on the fold id.  A column's
index table is counted: up to ``MAX_BROADCAST_ROWS`` rows it is broadcast, so the rows are not shuffled; a larger one is
joined on (fold id, value, salt), so that a frequent value fills no task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.operators.clean import Roles
from foldspark.session import cut_lineage


#: Rows of a column's index table (folds x categories) that are sent to every task at most.
MAX_BROADCAST_ROWS = 500_000
#: Parts into which the rows of one value are dealt where the index table is larger.
SALTS = 16


@dataclass
class PrepStats:
    numeric: DataFrame   # fold_id, column, position, median, mean, std, all_null
    vocab: DataFrame     # fold_id, column, position, category, idx, count, is_mode
    roles: Roles
    fold_ids: list
    _index: DataFrame | None = None
    _sizes: dict | None = None

    def persist(self) -> "PrepStats":
        self.numeric = self.numeric.persist()
        self.vocab = self.vocab.persist()
        return self

    def index(self) -> DataFrame:
        """The vocabulary, written once: every categorical column joins with its part."""
        if self._index is None:
            self._index = cut_lineage(self.vocab.select("fold_id", "col_name", "category", "idx", "is_mode"))
        return self._index

    def index_of(self, column: str) -> tuple[DataFrame, bool]:
        """The index table of one column, and whether it is small enough to be broadcast (counted, not assumed)."""
        if self._sizes is None:
            self._sizes = {r["col_name"]: r["count"] for r in self.index().groupBy("col_name").count().collect()}  # columns
        own = self.index().filter(F.col("col_name") == column)
        return own, self._sizes.get(column, 0) <= MAX_BROADCAST_ROWS


#: Fixed value: distance from 1.0 to the next double.
_EPS = 2.220446049250313e-16


def _constant(variance: Column, mean: Column, n: Column) -> Column:
    """A column counts as constant when its variance is within rounding of its own mean and row count."""
    return variance <= n * _EPS * variance + F.pow(n * _EPS * mean, F.lit(2.0))


def as_number(c: str) -> Column:
    """A numeric cell; NaN is missing."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def value_counts(df: DataFrame, numeric: list[str], categorical: list[str], sides: list[Column]) -> DataFrame:
    """(col_name, position, num, cat, n, pid): every distinct value of every column with its number of rows in each
    side (``n`` array<bigint>, one entry for each condition in ``sides``), sorted by (col_name, value) over partitions
    numbered ``pid``.  Written once: the partition numbers must not change between the passes that read them."""
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    cells = [F.struct(F.lit(c).alias("col_name"), F.lit(i).alias("position"), as_number(c).alias("num"),
                      no_text.alias("cat")) for i, c in enumerate(numeric)]
    cells += [F.struct(F.lit(c).alias("col_name"), F.lit(i).alias("position"), no_number.alias("num"),
                       F.col(c).cast("string").alias("cat")) for i, c in enumerate(categorical)]
    marks = [s.alias(f"_s{i}") for i, s in enumerate(sides)]
    long = df.select(*marks, F.inline(F.array(*cells)))
    counts = long.groupBy("col_name", "position", "num", "cat").agg(
        F.array(*[F.count_if(F.col(f"_s{i}")) for i in range(len(sides))]).alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(counts.repartitionByRange(parts, "col_name", "num", "cat")
                       .withColumn("pid", F.spark_partition_id()))


def _by_side(counts: DataFrame) -> DataFrame:
    """(side, col_name, position, num, cat, pid, c): one row for each side in which a value occurs."""
    return counts.select(F.posexplode("n").alias("side", "c"), "col_name", "position", "num", "cat", "pid") \
        .filter(F.col("c") > 0)


def _earlier():
    return Window.partitionBy("side", "col_name").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)


def _whole():
    return Window.partitionBy("side", "col_name")


def _within(order: str):
    """The rows of one partition up to the current one."""
    return Window.partitionBy("side", "col_name", "pid").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def exact_quantiles(counts: DataFrame, qs: list[float]) -> DataFrame:
    """(side, col_name, quantiles): exact interpolated quantiles of every numeric column that has a value in a side.

    Ranks go from the sums of earlier partitions; only the partitions that hold a wanted rank are looked at.
    """
    return quantiles_of(_by_side(counts).filter("num IS NOT NULL"), qs)


def quantiles_of(rows: DataFrame, qs: list[float]) -> DataFrame:
    """The quantiles of ``rows (side, col_name, num, c, pid)``: ``c`` occurrences of every distinct value of a side, sorted by
    (col_name, num) over the partitions ``pid``."""
    parts = rows.groupBy("side", "col_name", "pid").agg(F.sum("c").alias("here"))
    parts = parts.select("side", "col_name", "pid", "here", F.coalesce(F.sum("here").over(_earlier()), F.lit(0)).alias("before"),
                         F.sum("here").over(_whole()).alias("total"))        # sides x columns x partitions rows
    at = F.col("q") * (F.col("total") - 1)
    ranks = parts.select("*", F.posexplode(F.array(*[F.lit(q) for q in qs])).alias("j", "q")) \
        .withColumn("part", at - F.floor(at)) \
        .select("*", F.explode(F.when(F.col("part") > 0, F.array(F.floor(at) + 1, F.floor(at) + 2))
                               .otherwise(F.array(F.floor(at) + 1))).alias("r")) \
        .filter("r > before AND r <= before + here")
    wanted = ranks.groupBy("side", "col_name", "pid", "before").agg(F.collect_list(F.struct("j", "r", "part")).alias("wanted"))
    x = rows.join(F.broadcast(wanted), ["side", "col_name", "pid"])         # at most two ranks a quantile, side and column
    x = x.withColumn("upto", F.col("before") + F.sum("c").over(_within("num")))
    x = x.select("side", "col_name", "num", "upto", "c", F.inline("wanted")).filter("r <= upto AND r > upto - c")
    between = F.min("num") + (F.max("num") - F.min("num")) * F.max("part")
    x = x.groupBy("side", "col_name", "j").agg(between.alias("value"))
    return x.groupBy("side", "col_name").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("v")) \
        .select("side", "col_name", F.col("v")["value"].alias("quantiles"))


def _numeric_stats(counts: DataFrame, fold_ids: list) -> DataFrame:
    """One row per fold id and column; written once, several readers follow."""
    rows = _by_side(counts)
    key = ["side", "col_name"]
    known, num = F.col("num").isNotNull(), F.col("num")
    sums = rows.groupBy("side", "col_name", "position").agg(
        F.sum("c").alias("n"), F.sum(F.when(known, F.col("c")).otherwise(0)).alias("n_known"),
        F.coalesce(F.sum(num * F.col("c")), F.lit(0.0)).alias("s"))
    mid = exact_quantiles(counts, [0.5]).select(*key, F.col("quantiles")[0].alias("median"))
    filled = F.coalesce("median", F.lit(0.0))
    gap = F.col("n") - F.col("n_known")
    sums = sums.join(F.broadcast(mid), key, "left").withColumn("mean", (F.col("s") + gap * filled) / F.col("n"))
    square = F.pow(F.coalesce(num, "median", "mean") - F.col("mean"), F.lit(2.0))
    stats = rows.join(F.broadcast(sums), [*key, "position"]).groupBy(*key, "position", "median", "mean", "n", "n_known") \
        .agg((F.sum(F.col("c") * square) / F.col("n")).alias("variance"))        # sums: sides x columns rows
    return cut_lineage(stats.select(
        F.array(*[F.lit(k) for k in fold_ids])[F.col("side")].alias("fold_id"), "col_name", "position", "median", "mean",
        F.when(_constant(F.col("variance"), F.col("mean"), F.col("n")), F.lit(1.0)).otherwise(F.sqrt("variance")).alias("std"),
        (F.col("n_known") == 0).alias("all_null")).coalesce(1))


def _vocabulary(counts: DataFrame, fold_ids: list) -> DataFrame:
    """Categories of every training side, numbered in their order; the mode is the most frequent, then the smallest."""
    rows = _by_side(counts).filter("cat IS NOT NULL")
    parts = rows.groupBy("side", "col_name", "pid").agg(
        F.count(F.lit(1)).alias("here"), F.min(F.struct((-F.col("c")).alias("c"), F.col("cat").alias("v"))).alias("top"))
    parts = parts.select("side", "col_name", "pid", F.coalesce(F.sum("here").over(_earlier()), F.lit(0)).alias("before"),
                         F.min("top").over(_whole())["v"].alias("mode"))
    return rows.join(parts, ["side", "col_name", "pid"]).select(
        F.array(*[F.lit(k) for k in fold_ids])[F.col("side")].alias("fold_id"), "col_name", "position",
        F.col("cat").alias("category"),
        (F.col("before") + F.row_number().over(_within("cat")) - 1).cast("int").alias("idx"),
        F.col("c").alias("count"), (F.col("cat") == F.col("mode")).alias("is_mode"))


def fit_prep(df: DataFrame, roles: Roles, fold: str = "fold", fold_ids=(0, 1, 2, 3, 4),
             direct: bool = False) -> PrepStats:
    """Statistics of the training side of each fold id (rows with ``fold != id``).

    ``direct=True``: ``df`` holds only training rows and ``fold`` is the fold id they train.
    """
    fold_ids = list(fold_ids)
    sides = [(F.col(fold) == k) if direct else (F.col(fold) != k) for k in fold_ids]
    counts = value_counts(df, roles.numeric, roles.categorical, sides)
    is_number = F.col("col_name").isin(*roles.numeric) if roles.numeric else F.lit(False)
    return PrepStats(_numeric_stats(counts.filter(is_number), fold_ids) if roles.numeric else None,
                     _vocabulary(counts, fold_ids) if roles.categorical else None, roles, fold_ids)


def _wide_stats(stats: PrepStats) -> DataFrame:
    """One row per fold id: median / mean / std of each numeric column, mode and width of each categorical one."""
    wide = None
    if stats.numeric is not None:
        wide = stats.numeric.groupBy("fold_id").pivot("col_name", stats.roles.numeric).agg(
            F.first("median").alias("med"), F.first("mean").alias("mean"), F.first("std").alias("std"),
            F.first("all_null").alias("gone"))
    if stats.vocab is not None:
        v = stats.index().groupBy("fold_id").pivot("col_name", stats.roles.categorical).agg(
            F.count(F.lit(1)).cast("int").alias("width"),
            F.max(F.when(F.col("is_mode"), F.col("category"))).alias("mode"))
        wide = v if wide is None else wide.join(v, "fold_id", "full")
    return wide


def _one_hot(idx: Column, width: Column) -> Column:
    """``width`` zeros with a one at ``idx``; zeros alone where the value is unknown."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return F.coalesce(F.concat(F.array_repeat(F.lit(0.0), idx), F.array(F.lit(1.0)),
                               F.array_repeat(F.lit(0.0), width - idx - 1)), zeros)


def apply_prep(df: DataFrame, stats: PrepStats, fold_id: str = "fold_id", output: str = "vector",
               out: str = "features") -> DataFrame:
    """Impute, scale and one-hot each row with the statistics of its ``fold_id``.

    A numeric column without any value on the training side of a fold has no feature in that fold.
    output='vector': dense ``features`` vector (numeric block, then one-hot block);
    output='array': the same as array<double>; output='long': (feature index, value) rows.
    """
    x = df.join(F.broadcast(_wide_stats(stats).withColumnRenamed("fold_id", fold_id)), fold_id)  # one row per fold
    blocks = []
    for c in stats.roles.numeric:
        v = (F.coalesce(as_number(c), F.col(f"{c}_med")) - F.col(f"{c}_mean")) / F.col(f"{c}_std")
        blocks.append(F.when(F.col(f"{c}_gone"), F.array().cast("array<double>")).otherwise(F.array(v)))
    for c in stats.roles.categorical:
        index, small = stats.index_of(c)
        index = index.select(F.col("fold_id").alias(fold_id), F.col("category").alias(f"{c}_cat"), F.col("idx").alias(f"{c}_idx"))
        x = x.withColumn(f"{c}_cat", F.coalesce(F.col(c).cast("string"), F.col(f"{c}_mode")))
        if small:
            x = x.join(F.broadcast(index), [fold_id, f"{c}_cat"], "left")
        else:
            index = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            x = x.withColumn("_salt", F.floor(F.rand(17) * SALTS).cast("int")) \
                .join(index.hint("merge"), [fold_id, f"{c}_cat", "_salt"], "left").drop("_salt")
        blocks.append(_one_hot(F.col(f"{c}_idx"), F.coalesce(F.col(f"{c}_width"), F.lit(0))))
    arr = F.concat(*blocks) if len(blocks) > 1 else blocks[0]
    keep = [c for c in df.columns if c not in stats.roles.numeric and c not in stats.roles.categorical]
    y = x.select(*keep, arr.alias("_arr"))
    if output == "array":
        return y.withColumnRenamed("_arr", out)
    if output == "long":
        return y.select(*keep, F.posexplode("_arr").alias("feature_idx", "value"))
    return y.select(*keep, array_to_vector("_arr").alias(out))


def feature_names(stats: PrepStats, prefixed: bool = True) -> DataFrame:
    """(fold_id, feature_idx, name, source_column, category) in vector order."""
    parts = []
    if stats.numeric is not None:
        nm = F.concat(F.lit("num__" if prefixed else ""), F.col("col_name"))
        known = stats.numeric.filter("NOT all_null")
        order = Window.partitionBy("fold_id").orderBy("position")       # one row per column
        parts.append(known.select("fold_id", (F.row_number().over(order) - 1).alias("feature_idx"), nm.alias("name"),
                                  F.col("col_name").alias("source_column"),
                                  F.lit(None).cast("string").alias("category")))
    if stats.vocab is not None:
        # offset of each categorical block = numeric width + sizes of earlier blocks
        sizes = stats.vocab.groupBy("fold_id", "col_name", "position").agg(F.count(F.lit(1)).alias("sz"))
        w = Window.partitionBy("fold_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
        off = sizes.select("fold_id", "col_name", F.coalesce(F.sum("sz").over(w), F.lit(0)).alias("off"))
        if stats.numeric is not None:
            p_num = stats.numeric.groupBy("fold_id").agg(F.count_if(~F.col("all_null")).alias("p"))
            off = off.join(p_num, "fold_id").select("fold_id", "col_name", (F.col("p") + F.col("off")).alias("off"))
        v = stats.vocab.join(off, ["fold_id", "col_name"])
        nm = F.concat(F.lit("cat__" if prefixed else ""), F.col("col_name"), F.lit("_"), F.col("category"))
        parts.append(v.select("fold_id", (F.col("off") + F.col("idx")).cast("int").alias("feature_idx"), nm.alias("name"),
                              F.col("col_name").alias("source_column"), "category"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
