"""The training-data pipeline over documents: five stages, each written as Parquet before the next one reads it.

A stage takes (spark, docs, sf_dir) and works on every row it is given; all but the last return the columns of
documents. Each stage's rules for nulls, empty texts, ties and repeated rows are those of its operator's module.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.llm import bpe, decontaminate, lines, near, quality
from inkgrid.session import materialise

#: The vocabulary that the last stage encodes with.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines; n_chars follows the text."""
    out = lines.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash links, verified, and the rest of the pairs of a Jaccard similarity of 0.8 or more over five-word shingles."""
    return near.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with n_tokens, ids (packed little-endian) and the text that the ids decode to."""
    out = bpe.encode(docs, VOCABULARY, decoded="decoded")
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: The last stages are not SQL; tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
