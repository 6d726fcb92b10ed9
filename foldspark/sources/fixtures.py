"""Test inputs derived from the driver tables (see FIXTURES.md).

Each builder reads the parquet tables of one scale folder and returns a lazy
DataFrame, so its work grows with the tables.  The SQL twins of these builders
(used by the DuckDB oracle) live in ``oracle_sql.py`` at the repository root.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.functions.rand import hash_hex, uniform
from foldspark.operators.rank import hashed_rank, tasks_for
from foldspark.sources.tables import table

# Fixture constants.
CHURN_CUTOFF = dt.datetime(2000, 9, 15)
SCORED_MODELS = (("ExtraTrees", 0.20), ("RandomForest", 0.22), ("XGBoost", 0.25), ("LightGBM", 0.25))
SCORED_SEED = 42
SCORED_FOLDS = 5


def customer_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: features from orders before the cut-off, label from after it.

    A single aggregate over orders (partial aggregation absorbs a hot customer);
    nation and region are fixed-size dimension tables and are broadcast.
    """
    cut = F.lit(CHURN_CUTOFF).cast("timestamp")
    o = table(spark, sf_dir, "orders")
    before = F.col("o_orderdate") < cut
    agg = o.groupBy("o_custkey").agg(
        F.count_if(before).alias("n_hist"),
        F.sum(F.when(before, F.col("o_totalprice"))).alias("total"),
        F.avg(F.when(before, F.col("o_totalprice"))).alias("avg_order"),
        F.min(F.when(before, F.col("o_orderdate"))).alias("first_ts"),
        F.max_by(F.when(before, F.col("o_orderpriority")),
                 F.when(before, F.struct("o_orderdate", "o_orderkey"))).alias("last_priority"),
        F.max((F.col("o_orderdate") >= cut).cast("int")).alias("has_future"),
    )
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    region = F.broadcast(table(spark, sf_dir, "region"))
    c = (table(spark, sf_dir, "customer")
         .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
         .join(agg, F.col("o_custkey") == F.col("c_custkey"), "left"))
    has_hist = F.coalesce(F.col("n_hist"), F.lit(0)) > 0
    return c.select(
        F.col("c_name").alias("customerID"),
        F.col("c_mktsegment").alias("Segment"),
        F.col("n_name").alias("Nation"),
        F.col("r_name").alias("Region"),
        ((F.col("c_custkey") % 6) == 0).cast("int").alias("SeniorFlag"),
        F.when(~has_hist, F.lit(0)).otherwise(
            F.lit(2000 * 12 + 9) - (F.year("first_ts") * 12 + F.month("first_ts"))).cast("int").alias("tenure"),
        F.coalesce(F.col("n_hist"), F.lit(0)).cast("bigint").alias("n_orders"),
        F.col("c_acctbal").alias("AcctBal"),
        F.when(has_hist, F.col("avg_order")).alias("AvgOrder"),
        F.when(~has_hist, F.lit(" ")).otherwise(
            F.col("total").cast("decimal(18,2)").cast("string")).alias("TotalCharges"),
        F.when(has_hist, F.col("last_priority")).alias("LastPriority"),
        F.when(F.coalesce(F.col("has_future"), F.lit(0)) == 1, F.lit("No")).otherwise(F.lit("Yes")).alias("Churn"),
    )


def customer_churn_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty variant: junk numbers, NULL/unknown targets and repeated keys."""
    base = customer_churn(spark, sf_dir)
    num = F.substring("customerID", 10, 100).cast("int")
    dirty = base.select(
        *[c for c in base.columns if c not in ("TotalCharges", "LastPriority", "Churn")],
        F.when(num % 50 == 1, F.lit("12d")).when(num % 50 == 2, F.lit("NaN"))
         .when(num % 50 == 3, F.lit("1,000")).otherwise(F.col("TotalCharges")).alias("TotalCharges"),
        "LastPriority",
        F.when(num % 40 == 5, F.lit(None).cast("string")).when(num % 40 == 6, F.lit("Maybe"))
         .otherwise(F.col("Churn")).alias("Churn"),
    )
    dupes = base.filter(num % 30 == 7)
    return dirty.unionByName(dupes)


def scored_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for one row an order (counted from the file's footer)."""
    return tasks_for(spark, table(spark, sf_dir, "orders").count())


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long prediction table (model, fold, row_id, label, proba) over all orders."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    o = o.withColumn("_h", hash_hex(SCORED_SEED, F.col("row_id")))
    ranked = hashed_rank(o, ["label"], "_h", tie=["row_id"], out="_r", max_groups=3, partitions=scored_tasks(spark, sf_dir))
    b = ranked.select("row_id", "label", ((F.col("_r") - 1) % SCORED_FOLDS).cast("int").alias("fold"))
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).cast("double").alias("w"))
                       for m, w in SCORED_MODELS])
    x = b.select("*", F.inline(models))
    proba = F.round(F.col("w") * F.col("label")
                    + (1 - F.col("w")) * uniform(F.col("model"), F.col("row_id")), 3)
    return x.select("model", "fold", "row_id", "label", proba.alias("proba"))


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with three text features that carry real signal."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    n_words = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("row_id"), "lang", "source", "n_chars",
        n_words.cast("bigint").alias("n_words"),
        (F.size(F.array_distinct(F.split("text", " "))).cast("double") / n_words).alias("uniq_ratio"),
        (F.length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("double")
         / F.greatest(F.length("text"), F.lit(1))).alias("alpha_ratio"),
        (1 - F.col("quality")).alias("label"), "toxic")


def embedding_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors with a ~10 % minority class."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), "embedding", (F.col("label") == 0).cast("int").alias("label"))


def _row(feature, original: str, value):
    return F.struct(feature.cast("string").alias("feature"), F.lit(original).cast("string").alias("original_feature"),
                    value.cast("double").alias("contribution"))


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive contributions of a known linear score, in long form."""
    c = customer_churn(spark, sf_dir)
    rows = F.array(
        _row(F.lit("num__AcctBal"), "AcctBal", F.lit(0.0001) * F.col("AcctBal")),
        _row(F.lit("num__tenure"), "tenure", F.lit(-0.02) * F.col("tenure")),
        _row(F.concat(F.lit("cat__Segment_"), F.col("Segment")), "Segment", F.lit(0.3)),
        _row(F.concat(F.lit("cat__Region_"), F.col("Region")), "Region",
             F.when(F.col("SeniorFlag") == 1, F.lit(0.1)).otherwise(F.lit(-0.05))),
    )
    return c.select(F.col("customerID").alias("row_id"), F.inline(rows))
