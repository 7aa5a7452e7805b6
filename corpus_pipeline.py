"""A corpus pipeline: stages over the documents, each written and read again.

Documents in no labelled language go, one document of each near-duplicate group stays, documents
with test items go, secrets are blotted out of the texts, and what is left is encoded. Each stage
works on all rows that the one before it kept. Rows without an id pass the two stages that compare
documents; an empty table passes all. Input columns beyond those of the documents stay to the end.

The first stage bounds the session's Arrow batches by bytes, if the session has no bound of its own:
whole texts in batches of 10,000 rows take much of an executor's memory on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillhouse.llm import byte_bpe, decontaminate, language_id, ngram_join, secret_scan
from rillhouse.llm.arrow import small_batches
from rillhouse.llm.sieve import without
from rillhouse.llm.tables import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a labelled language; those without a letter or spelled like none of them go."""
    small_batches(spark)
    return language_id.keep_known(docs, *language_id.fit_known(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item, exact or edited."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, written(found.select("doc_id").distinct(), "contaminated"), "doc_id")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a mark in place of each secret; ``n_chars`` follows the text."""
    clean = secret_scan.redact(docs, secret_scan.fit(docs))
    size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.coalesce(size, "n_chars"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text (little-endian unsigned 32-bit integers) and their number."""
    found = byte_bpe.encode(docs)
    return found.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("ngram_join", one_of_each),
    ("decontaminate", without_test_items),
    ("secret_scan", without_secrets),
    ("byte_bpe", encoded),
]

#: SQL can express neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, one table after another."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
