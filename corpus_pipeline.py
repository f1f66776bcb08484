"""A corpus pipeline of five operators.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlwork.llm import langid, packing, quality, secrets, simhash
from marlwork.llm.common import shared_folder, table, without

#: A classifier and a hierarchical index can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters (`und`) go, and those that are surely in another language than they are labelled with.

    The model learns from the documents that come in.
    """
    return langid.keep_identified(docs, langid.train(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return without(docs, quality.judge(docs).where(~F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays. Rows without an id stay.

    Near copies share eight tenths of their five-word shingles or more; several fingerprints of each document find them.
    """
    return simhash.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token pieces in sequences of 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("quality", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the table documents; what lies between them is written to the shared folder."""
    docs, here, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{here}/{name}")
        docs = spark.read.parquet(f"{here}/{name}")
        if before is not None:
            remove(spark, before)  # nothing reads it any more; the last one is read when the result is
        before = f"{here}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder wherever Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
