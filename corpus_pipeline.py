"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

What goes: documents whose language is not told, repeated lines, all but one of each
group of near duplicates, documents with benchmark passages. What is left is encoded.
The stages before the last return the columns of ``documents``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from prosemill.llm import dart_minhash, fuzzy_lines, language_id, nbest_pieces, qgram_leaks


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fuzzy_lines.without_duplicate_lines(docs, count_col="n_chars")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return qgram_leaks.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nbest_pieces.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("piece_encoding", encode),
]

#: Compression, edit distances and search over piece lattices are beyond SQL.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share; a local one only for one local process."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return f"{at.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="pipeline-")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), _folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
