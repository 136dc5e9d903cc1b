"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. language: documents without a letter, or whose most probable language the conditional random field gives less than
   ``MIN_SCORE``, go.
2. near_duplicates: of each group of documents that Jaccard links of at least ``NEAR_PERCENT`` / 100 over shingles of
   ``NEAR_WORDS`` words join, the one with the least doc_id stays.
3. decontamination: documents that hold a window of ten benchmark words go.
4. secrets: spans of secrets in the texts are replaced by ``MASK``; all documents stay.
5. mixing: the rest is mixed to the target weights of its sources; documents that the mix takes are returned with the
   number of times it takes them (``times``; ``_times`` where documents have such a column).

Rows are judged by their own text in every stage: ids may repeat or be null. Null and empty texts have no letter and go
in the first stage; of equal rows one stays in the second; an empty table gives an empty table; further columns of the
documents are handed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfarer.llm import decontaminate, jaccard_join, langid, mixing, secret_scan
from wayfarer.llm.common import Tables

#: Least mean probability of a document's language, and what stands for a secret.
MIN_SCORE, MASK = 0.35, "[secret]"
#: Words of a shingle and least Jaccard similarity of near duplicates (op8's own query has 3 words and 90).
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. One pass labels and filters, so rows are judged by their own text even where ids repeat."""
    return langid.in_language(docs, langid.train(docs), MIN_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, MASK)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of the documents that the mix takes, with ``times``."""
    return mixing.taken(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixed)]

#: The language model, the hash order of the mix and spans by entropy are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. Each result is written to the shared folder and removed when the next one is there."""
    tables = Tables(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = tables.write(name, stage(spark, docs, sf_dir))
        if before:
            tables.drop(before)
        before = name
    return docs
