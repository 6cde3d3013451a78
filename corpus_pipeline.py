"""From raw documents to a training mix: five stages, each working on all the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm import decontaminate as benchmark
from loanloom.llm import jaccard, lines, mixing, quality
from loanloom.llm.queries import domains_of
from loanloom.llm.texts import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur before, within two edits or (if short) exactly, go; so do documents that
    lose every line."""
    return lines.keep_lines(docs, short=True)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles, from similarity 0.8 on, the one with the least
    id stays."""
    return jaccard.keep_one(docs, size=5, parts=(100, 80))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word passage of a benchmark item go."""
    return benchmark.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go, and the others fill their room; no other document loses a copy.

    Junk has been judged by the quality stage, so what it left is not weighed against clean
    documents again: every document that is not most likely toxic gets a rate of one or more.

    Adds ``n_tokens``, ``rate`` and ``copies``; a column of the documents with such a name stays
    and the added one is left out.
    """
    labels = domains_of(table(spark, sf_dir, "labels"))
    domain = F.when(F.col("domain") == "toxic", "toxic").otherwise("kept")
    found = mixing.mix(
        docs, labels.withColumn("domain", domain), {"kept": 1.0, "toxic": 0.0}, kept=("kept",)
    )
    added = [c for c in ("n_tokens", "rate", "copies") if c not in docs.columns]
    return found.where("copies > 0").select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *added
    )


STAGES = [
    ("quality", good_quality),
    ("lines", new_lines),
    ("near_duplicates", one_of_each),
    ("decontaminate", not_in_benchmark),
    ("mix", mixed),
]

#: Classifiers and edit distances are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
