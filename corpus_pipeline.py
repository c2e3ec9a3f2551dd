"""A corpus pipeline: each stage works on what the one before it kept, written as Parquet between them.

In every stage but the last a row of an empty or null text, of a null id or of a null in any other
column is judged as the stage's operator says of it, rows repeated as a whole are judged alike, columns
beside those of documents stay as they are, whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fonoteca.llm import decontaminate, near_dup, packing, quality, secrets
from fonoteca.llm.common import read, settled


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 go; empty texts have a score as well."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the least id; five-word shingles, similarity 0.8."""
    return near_dup.one_of_each(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item contaminates go; empty texts never do."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mask, in a text whose length is then counted anew."""
    return secrets.redacted(docs)


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents; those of an empty text are its end id."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", mixture_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained scores and tokens have no SQL; tests compare the stages with brute force instead.
ORACLE_SQL: str | None = None
