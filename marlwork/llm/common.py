"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and \x09-\x0D. Fixed value.
WHITE = " \t\n\x0b\x0c\r"
#: The 26 letters that contracts lower-case. Fixed values.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spark's bound on what passes to and from Python at once.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of an input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which becomes its checkpoint folder.

    Where that is unset, a session on this machine alone (tests) gets a local one; on a cluster that is an error, as its
    machines share no local folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="marlwork-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, most_bytes: int = 2 << 20) -> Iterator[None]:
    """What is computed within passes to and from Python in batches of about `most_bytes` instead of the session's bytes.

    Spark's default, 64 MB or 10,000 rows, makes one batch of a whole partition of texts, which the JVM (twice, as its
    vectors double) and the worker hold for each core. A smaller setting of the session holds; it is back afterwards.
    """
    kept = spark.conf.get(BATCH_BYTES)
    own = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(kept)
    spark.conf.set(BATCH_BYTES, str(min(own, most_bytes) if own > 0 else most_bytes))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, kept)


def texts_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[str | None]:
    """The values of the column text, of which only `step` are Python objects at a time."""
    column = batch.column(batch.schema.get_field_index("text"))
    for lo in range(0, len(column), step):
        yield from column.slice(lo, step).to_pylist()


def small(df: DataFrame, most: int = 200_000, weight: Column | None = None) -> DataFrame:
    """`df`, computed, and marked for broadcast if its rows, each counted as 1 and `weight`, are few; a plain join side otherwise."""
    df = durable(df)
    rows = df.agg(F.count("*").alias("n"), F.sum(F.lit(0) if weight is None else weight).alias("w")).first()
    return F.broadcast(df) if rows["n"] + (rows["w"] or 0) <= most else df


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text (as text_hash) are not among those of `gone`; rows stay where they are if `gone` is small."""
    gone = small(gone.select(F.col("doc_id").alias("marlwork_id"), F.col("text_hash").alias("marlwork_hash")).distinct())
    same = docs["doc_id"].cast("long").eqNullSafe(gone["marlwork_id"]) & (text_hash() == gone["marlwork_hash"])
    return docs.join(gone, same, "left_anti")


def text_hash() -> Column:
    """A hash of the column text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def white_words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+", -1), "")
