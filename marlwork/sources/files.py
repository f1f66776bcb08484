"""Readers with the bad-line policies of the sources, and provenance of files."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Rows of JSON lines; bad lines are left out, or stop the job if `strict`."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_with_keys(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...]) -> DataFrame:
    """Rows of JSON lines that have all `required` keys, with null values too; bad lines are left out."""
    lines = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    keys = F.json_object_keys("value")
    held = F.forall(F.array(*map(F.lit, required)), lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False)))
    return lines.where(held).select(F.from_json("value", schema).alias("x")).select("x.*")


def read_json_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines or of one JSON array, whichever the file begins with."""
    first = spark.read.text(path).select(F.ltrim("value").alias("v")).where("v <> ''").limit(1).collect()
    whole = bool(first) and first[0]["v"].startswith("[")
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def read_labels(spark: SparkSession, path: str, flags: tuple[str, str]) -> DataFrame:
    """Rows of a CSV file whose two flags both are 0 or 1."""
    rows = spark.read.option("header", True).csv(path)
    return rows.where(F.col(flags[0]).isin("0", "1") & F.col(flags[1]).isin("0", "1"))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modification time and sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def up_to_date(inputs: DataFrame, outputs: DataFrame, wanted: int) -> DataFrame:
    """One row: whether all `wanted` outputs exist and the oldest is younger than the newest input; so without inputs."""
    newest, oldest = inputs.agg(F.max("modified").alias("newest")), outputs.agg(F.min("modified").alias("oldest"), F.count("*").alias("n"))
    return newest.crossJoin(oldest).select((F.col("newest").isNull() | ((F.col("n") >= wanted) & (F.col("oldest") > F.col("newest")))).alias("up_to_date"))


def config_hash(config: dict) -> str:
    """The sha256 of a configuration, whatever the order of its keys: 16 digits."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def stage_metadata(spark: SparkSession, stage: str, config: dict, inputs: list[str], outputs: list[str]) -> DataFrame:
    """One row about a stage of a pipeline: its name, time, configuration and its hash, and path, length, time and sha256 of its files."""

    def files(paths: list[str], name: str) -> DataFrame:
        every = reduce(DataFrame.unionByName, (provenance(spark, p) for p in paths))
        return every.agg(F.array_sort(F.collect_list(F.struct("path", "length", "modified", "sha256"))).alias(name))

    row = spark.range(1).select(F.lit(stage).alias("stage"), F.current_timestamp().alias("at"), F.lit(json.dumps(config, sort_keys=True)).alias("config"), F.lit(config_hash(config)).alias("config_hash"))
    return row.crossJoin(files(inputs, "input_files")).crossJoin(files(outputs, "output_files"))  # one row each
