"""The corpus pipeline: stages over ``documents``, each on all that the one before has kept.

Null and empty texts have no words: the classifier judges them, they have no near-duplicates and no contamination, and
packing gives them their end token. Decisions are about rows, so ids may be repeated or null; equal rows count as copies
of each other. Columns beyond those of ``documents`` are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, neardup, packing, quality
from quarry.llm._io import save


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels that op2 learns from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(f"not {quality.HELD_OUT}")
    model = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each class stays."""
    return neardup.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of full windows."""
    return packing.pack_texts(docs)


STAGES = [("quality classifier", quality_classifier), ("near-dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]
#: Learned scores, samples and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, name.replace(" ", "_"))
    return docs
