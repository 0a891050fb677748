"""A training corpus from documents: STAGES in order, each over all that the one before kept.

Quality rules drop rejected documents, the n-gram join keeps the smallest id of
every class, substring dedup takes repeated words out, the secret scan replaces
secrets, and packing gives the pieces of training sequences. All but the last
return the columns of documents; n_chars, where there is such a column, follows
the text. Each stage's table replaces the one before in the shared folder.

Null and empty texts fail the quality rules and go. Of rows that repeat an id,
all stay whose id stays; rows with a null id are one id. An empty table gives
no pieces. Other columns are carried along as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopesift.llm import ngram_join, packing, quality, secret_scan, substring_dedup
from scopesift.llm._spark import drop, saved


def _sized(df: DataFrame) -> DataFrame:
    if "n_chars" not in df.columns:
        return df
    kind = df.schema["n_chars"].dataType
    return df.withColumn("n_chars", F.length("text").cast(kind))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the row is carried as one value, so that its columns may have the measures' names
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("t"))
    return quality.quality_rules(rows, "t").where("kept").select("row.*")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = ngram_join.jaccard_classes(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(substring_dedup.without_repeats(docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(secret_scan.redact(docs, model=secret_scan.train(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, with_ids=False)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copies_stage),
    ("substring_dedup", substring_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't express tokenizing; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
