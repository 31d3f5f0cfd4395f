"""A corpus from raw documents to packed sequences, in stages that each write what the next one reads.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents. A row is
kept or changed by what an operator says of its doc_id and text, so rows that are equal in both share their fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.lineage import new_folder, remove_folder
from quotelens.llm import language, neardup, packing, quality, suffixdedup
from quotelens.llm.frames import small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (null text, or none of its characters a letter) go; the others have the language found as lang."""
    small_batches(spark)
    docs = _columns(docs)
    return language.label(docs).where(F.col("lang_pred") != "und").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or that the classifier takes for bad, go."""
    small_batches(spark)
    return quality.keep(_columns(docs), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays, that with the smallest doc_id; of equal rows, one. A document is a row's doc_id and text together, so rows that
    share an id but not a text, or have none, are documents of their own. A null id comes last; ties go to the smaller hash of (doc_id, text).
    """
    small_batches(spark)
    rows = _columns(docs).withColumn("row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    linked = neardup.link(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = linked.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(order)["row"].alias("row"))
    kept = rows.join(first.select("row"), "row", "left_semi").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("kept"))
    return kept.select("kept.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; documents of which nothing is left go. What a cut leaves of a character of several bytes is left out."""
    small_batches(spark)
    return suffixdedup.cleaned(_columns(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place there."""
    small_batches(spark)
    return packing.pack(_columns(docs))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, hashing and suffix sorting are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again. What a stage has read is taken away once its own rows are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
