"""From raw documents to token ids: quality rules, near-duplicates, secrets, source mix, byte-pair encoding.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of ``documents``. Between stages rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoria.llm import bpe, mixing, quality, secrets, simhash
from evoria.llm._common import remove, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a fence of their language and source go.

    Null and empty texts fail the base rule; a null language or source is a group of its own; equal rows share their fate.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8 or more) the document with the smallest id stays.

    Null ids come last, ties go to the text with the least hash, equal rows are one document. Texts without a word are
    copies of each other.
    """
    return simhash.keep_one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span becomes a mask; ``n_chars`` follows the text. All rows stay; a null text stays null."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: some not at all, some up to three times.

    Texts without a word have size 0 and go; a null source is the last source; equal rows are separate documents.
    """
    return mixing.mix(docs)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids`` for every row of the mix; a null text has no token."""
    return bpe.encode_digests(docs, with_ids=True)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("source_mix", source_mix), ("byte_pairs", byte_pairs)]

#: Fingerprints, randomness tests and merges have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's rows are removed once those of the next are written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/evoria/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
