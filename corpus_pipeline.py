"""The corpus pipeline: toxic documents go, repeated lines go, near-duplicates go, sources are mixed, texts are encoded.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; its
result is written as Parquet and read again as the next one's ``docs``. All stages but the
last return the columns of ``documents``. Missing tables, nulls, repeats and extra columns are
treated as the operators' docstrings say. ``n_chars`` is brought up to date with the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import bpe, line_dedup, mixing, simhash, toxicity
from tracewarden.llm.common import checkpoint_folder
from tracewarden.llm.queries import vocabulary_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go. It learns from ``labels`` as op9 does."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that many documents hold stay only in the document with the largest id. No document goes."""
    cleaned = line_dedup.drop_repeated_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: ``doc_id, n_tokens, ids_sha256, decoded_sha256, ids``."""
    return bpe.encode_documents(docs, vocabulary_file(), keep_decoded=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Neither the classifier, SimHash nor BPE can be told in SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Results between stages go to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
