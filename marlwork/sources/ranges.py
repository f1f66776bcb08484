"""Rows numbered in an order, over ranges of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlwork.sources.durable import few, kept


#: Rows of a range: what a task holds of a log doesn't grow with the log.
RANGE = 200_000


def dealt(rows: DataFrame) -> DataFrame:
    """rows over all cores in even shares: a file of narrow rows may come in one piece however many it has."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)


def in_ranges(rows: DataFrame, order: list[str], most: int = RANGE) -> DataFrame:
    """rows in ranges of `order` of about `most` rows, kept: block (ascending with the order) and idx (from 0 in each block, in order)."""
    least = rows.sparkSession.sparkContext.defaultParallelism

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for pdf in batches:
            yield pdf.assign(idx=np.arange(n, n + len(pdf)))
            n += len(pdf)

    ranged = rows.repartitionByRange(max(least, -(-rows.count() // most)), *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields) + ", idx long"
    return kept(ranged.mapInPandas(numbered, schema))


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `place` in `order`, from 0."""
    ranged = in_ranges(rows, order)
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = few(ranged.groupBy("block").agg(F.count("*").alias("n")).select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")))
    return ranged.join(offsets, "block").select(*rows.columns, (F.col("offset") + F.col("idx")).alias("place"))
