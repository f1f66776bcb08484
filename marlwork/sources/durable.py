"""Results kept in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which becomes the session's checkpoint folder.

    Where that is unset, a session on this machine alone gets a local folder; on a cluster that is an error, as its
    machines share no local folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="marlwork-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once, with its lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """`df` kept, and marked for broadcast if it has at most `most` rows; a plain join side otherwise."""
    df = kept(df)
    return F.broadcast(df) if df.count() <= most else df
