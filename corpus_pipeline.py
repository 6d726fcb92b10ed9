"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, substring dedup, best-fit packing.

Every stage takes the documents that its predecessor kept, written as Parquet and read again; all but the last return
the columns of ``documents``.  A text from which lines or passages go stays as a document, even when nothing is left
of it; documents go only where a stage is there to drop them (no language; not the first of a group of near copies).

Null and empty texts have no language and go in the first stage; an empty table passes through every stage.  Rows that
repeat doc_id and text are rows of their own until the near copies go by doc_id; rows that repeat a doc_id with another
text keep what occurs in one of them only.  All columns of ``documents`` are carried on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm.common import delete_table, materialise, shared_path, table
from foldspark.llm.language_id import keep_identified
from foldspark.llm.line_dedup import dedup_lines
from foldspark.llm.packing import pack_documents
from foldspark.llm.sentence_spans import remove_repeats
from foldspark.llm.setjoin import jaccard_components


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line equals within the edit bound."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id.  Rows without shingles or doc_id stay."""
    gone = jaccard_components(docs.select("doc_id", "text")).filter("component_id <> doc_id") \
        .select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their sequence and offset."""
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("substring_dedup", substring_dedup), ("packing", packing)]

#: Byte models and tokenizers are beyond SQL: the stages are held against brute force in tests/llm instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        docs = materialise(stage(spark, docs, sf_dir), name, path)
        if read:
            delete_table(spark, read)     # the stage just written was the last to read it
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)
