"""The corpus pipeline: language identification, near-duplicate removal, personal data, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; ``run`` writes each result as
Parquet in the shared folder and reads it back as the next one's ``docs``. All but the last return the columns of
``documents``; the last returns one row for each piece of a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import op1_jaccard, op3_pii, op4_language, op7_mixing, op9_packing
from lodestone.llm.common import materialise, used_up

#: No SQL: the first stage learns its model from the rows.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars after the text has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language identification rejects: null texts, texts without a letter, texts near no language."""
    own = docs.select(*(F.col(c).alias(f"__{k}") if c.startswith("lang_") else c for k, c in enumerate(docs.columns)))
    kept = op4_language.identify(spark, own, op4_language.fit(spark, docs)).where(~F.col("lang_rejected"))
    return kept.select(*(F.col(f"__{k}").alias(c) if c.startswith("lang_") else c for k, c in enumerate(docs.columns)))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return op1_jaccard.keep_one(spark, docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, in the texts."""
    return _measured(op3_pii.sanitise(spark, docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes sources to their targets: a row for each turn of a document, the last one of a source cut to the budget."""
    return _measured(op7_mixing.mixture(spark, docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of the permitted lengths."""
    return op9_packing.pack(spark, docs)


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("pii", pii), ("mixing", mixing), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialise(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
        used_up(spark, before)
    return docs
