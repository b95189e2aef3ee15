"""From raw documents to packed training sequences: five stages, each a table between them.

``STAGES`` lists them in order; a stage takes ``(spark, docs, sf_dir)`` and returns the rows it keeps with the columns of
documents, the last one the packed pieces.  A stage judges all rows it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontam, minhash, packing, rules, secrets
from spanloom.llm.words import restore_id, source
from spanloom.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep; the trees learn from the labelled ones among ``docs``."""
    return rules.accepted(docs, rules.fit(source(docs), rules.quality_labels(spark, sf_dir)))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    return minhash.one_of_each(docs, k=5, least=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked."""
    return secrets.masked(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return restore_id(packing.pack(packing.cut(source(docs))))


STAGES = [
    ("quality_rules", quality_rules), ("minhash_near_dedup", minhash_near_dedup), ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: The trees, the tokens and the packing have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
