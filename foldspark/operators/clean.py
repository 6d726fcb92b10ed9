"""Cleaning, label encoding, column roles, model selection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.functions.cast import to_number

# The churn data set's target domain and positive class.
LABEL_VALUES = ("No", "Yes")
POSITIVE = "Yes"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def require_columns(df: DataFrame, cols) -> None:
    """A2: schema-only check; raises naming every missing column."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def encode_label(c, positive: str = POSITIVE, negative: str = "No", unknown: str = "drop") -> Column:
    """Yes -> 1, No -> 0.  ``unknown`` = 'drop' (NULL, filter later), 'error' or 'cast'."""
    c = F.col(c) if isinstance(c, str) else c
    known = F.when(c == positive, F.lit(1)).when(c == negative, F.lit(0))
    if unknown == "drop":
        return known
    if unknown == "error":
        return F.when(c.isNull(), F.lit(None).cast("int")).otherwise(
            F.coalesce(known, F.raise_error(F.concat(F.lit("unknown label value: "), c.cast("string"))).cast("int")))
    if unknown == "cast":
        return F.coalesce(known, c.try_cast("int"))
    raise ValueError(f"unknown policy {unknown!r}")


def clean(df: DataFrame, label: str = "Churn", key: str | None = "customerID",
          allowed: tuple[str, ...] | None = LABEL_VALUES, positive: str = POSITIVE, negative: str = "No",
          unknown: str = "drop", numeric_text: tuple[str, ...] = ("TotalCharges",),
          drop: tuple[str, ...] = (), keep_key_as: str | None = "row_id") -> DataFrame:
    """B1-B5 in one projection + filter.

    The key is kept (renamed ``row_id``) because Spark has no positional index;
    every split, fold and join needs it.  The raw label is replaced by an int
    ``label``.
    """
    require_columns(df, [label] + ([key] if key else []))
    out = df
    for c in numeric_text:
        if c in out.columns:
            out = out.withColumn(c, to_number(c))
    if allowed is not None:
        out = out.filter(F.col(label).isin(*allowed))               # B2 (also drops NULL)
    else:
        out = out.filter(F.col(label).isNotNull())                  # B3
    out = out.withColumn("__label", encode_label(label, positive, negative, unknown))
    if unknown == "drop":
        out = out.filter(F.col("__label").isNotNull())
    cols = [c for c in out.columns if c not in (label, "__label", key) and c not in drop]
    sel = ([F.col(key).alias(keep_key_as)] if key and keep_key_as else []) + [F.col("__label").alias("label")]
    return out.select(*sel, *cols)


@dataclass
class Roles:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)


def infer_roles(df: DataFrame, exclude=("row_id", "label"), bool_as: str = "categorical",
                other: str = "categorical") -> Roles:
    """Numeric / categorical lists from the schema (no job).

    ``bool_as``: 'categorical' (steps 1-3) or 'numeric' (steps 4-5);
    ``other``: 'categorical' (complement, steps 2-5) or 'drop' (step 1, strings only).
    """
    roles = Roles()
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        t = f.dataType
        if isinstance(t, NUMERIC_TYPES):
            roles.numeric.append(f.name)
        elif isinstance(t, T.BooleanType):
            (roles.numeric if bool_as == "numeric" else roles.categorical).append(f.name)
        elif isinstance(t, T.StringType) or other == "categorical":
            roles.categorical.append(f.name)
        else:
            roles.dropped.append(f.name)
    return roles


#: Rows of one content that a task writes out at most.
COPIES = 100_000


def with_row_id(df: DataFrame, columns: list[str] | None = None, out: str = "row_id") -> DataFrame:
    """A key for a table that has none, or one that repeats: md5 of the row's content and the number of its occurrence.

    Rows of equal content are interchangeable, so they are counted (combined before the shuffle) and written out again with
    the numbers 1 .. n, ``COPIES`` at a time: no content is sorted or held in one task, and no row is lost, multiplied or
    refused.  The id depends on the values only, not on partitions or their order.  ``columns``: the columns that make
    up the content, all of them by default; rows that differ in the others only are told apart by a hash of those.
    """
    columns = list(columns or df.columns)
    rest = [c for c in df.columns if c not in columns]
    content = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]))
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    parts = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {COPIES}"))).alias("__part"))
    first, last = F.col("__part") * COPIES + 1, F.least(F.col("__n"), (F.col("__part") + 1) * COPIES)
    numbered = parts.repartition(*[F.col(c) for c in columns], "__part").select(
        *df.columns, F.explode(F.sequence(first, last)).alias("__number"))
    mark = F.concat(F.lit("-"), F.hex(F.xxhash64(*rest))) if rest else F.lit("")
    return numbered.select(F.concat(content, mark, F.lit("-"), F.col("__number").cast("string")).alias(out), *df.columns)


def select_models(models: DataFrame, names: str, col: str = "model") -> DataFrame:
    """B7: 'all' / '*' or a comma list (trimmed, blanks ignored).  Unknown names raise.

    Selection is a semi join; the unknown-name check an anti join whose result
    is bounded by the length of ``names``.
    """
    if names.strip().lower() in ("all", "*"):
        return models
    spark = models.sparkSession
    wanted = (spark.range(1).select(F.explode(F.split(F.lit(names), ",")).alias("w"))
              .select(F.trim("w").alias(col)).filter(F.col(col) != ""))
    unknown = [r[0] for r in wanted.join(models.select(col).distinct(), col, "left_anti").collect()]
    if unknown:
        raise ValueError(f"unknown model names: {unknown}")
    return models.join(F.broadcast(wanted.distinct()), col, "left_semi")


def threshold_predict(proba, threshold: float, strict: bool = False) -> Column:
    """``proba >= thr`` (or ``>`` for the step-1 default rule) as int."""
    p = F.col(proba) if isinstance(proba, str) else proba
    return ((p > threshold) if strict else (p >= threshold)).cast("int")
