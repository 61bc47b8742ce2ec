"""The corpus pipeline: five filtering and rewriting stages over ``documents``.

Each stage works on everything its predecessor kept: quality classification drops pages of poor quality,
near-duplicate removal keeps one document of each class, benchmark decontamination cuts leaked passages
(and drops documents that are mostly benchmark), the secret scan blanks out what it finds, and byte-pair
encoding returns the token ids of what is left, their number, the decoded text and digests of both. All but
the last return the columns of ``documents``, whatever others there are and however they are named.

Defined results: null texts stay null until they are encoded as empty ones; null and empty texts are no
copies of each other; a null doc_id is a document like any other; equal rows leave one; without labels all
documents are kept, without a benchmark nothing is cut; empty tables give empty ones. What happens to a row in
a stage is stated with that stage's operator.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.functions.durable import shared_folder
from driftline.llm import bpe, decontam, neardup, quality, secrets
from driftline.sources.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", bpe_encoding),
]

#: Classifiers, sketches and ranked merges have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
