"""An inverted file of vectors: cells around centroids, of which a query reads the nearest."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlwork.operators.search import dense, in_folders, normalised_vector
from marlwork.sources.durable import few

#: Below so many vectors a search reads all of them. Fixed value.
LEAST = 10_000


def cells_for(n: int) -> int:
    """How many cells n vectors have: a hundredth of them, between 10 and 100; one if there are fewer than LEAST."""
    return 1 if n < LEAST else min(100, max(10, n // 100))


def unit(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """key and value, at length 1, without rows that have no direction."""
    return vectors.select(F.col(key).cast("long").alias(key), normalised_vector(F.col(value)).alias(value)).where(F.col(value).isNotNull() & F.col(key).isNotNull())


def centroids(vectors: DataFrame, cells: int, sample: int = 25_600, seed: int = 42) -> list[np.ndarray]:
    """Centres of `cells` cells of vectors (doc_id, v), by dimension of the vectors: k-means over at most about `sample` of them, by a hash of their ids.

    The bound is 256 vectors a cell for the most cells there are; every vector is put into a cell, see placed().
    """
    own = unit(vectors, "doc_id", "v").withColumn("dim", F.size("v"))
    found = []
    for row in own.groupBy("dim").count().orderBy("dim").collect():  # as many rows as there are sizes of vectors
        same = own.where(F.col("dim") == row["dim"])
        share = min(1.0, sample / row["count"])
        some = same.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(array_to_vector("v").alias("features"))
        if cells == 1 or some.isEmpty():
            found.append(np.zeros((1, row["dim"])))
            continue
        found.append(np.array(KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(some).clusterCenters()))
    return found


def placed(rows: DataFrame, value: str, centres: list[np.ndarray], probes: int = 1) -> DataFrame:
    """rows with `cell`: a row for each of the `probes` cells whose centres have the largest inner product with `value`.

    Vectors of another size than all centres go to cell 0. What the tasks get is bounded: 100 centres at most of a size.
    """
    shared = rows.sparkSession.sparkContext.broadcast({c.shape[1]: c for c in centres})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near: list = [[0]] * len(pdf)
            for dim, part in pdf.assign(at=np.arange(len(pdf))).groupby(pdf[value].map(len)):
                if dim in shared.value:
                    scores = np.stack(part[value].to_list()).astype(np.float64) @ shared.value[dim].T
                    for i, order in zip(part["at"], np.argsort(-scores, axis=1, kind="stable")[:, :probes], strict=True):
                        near[i] = order.tolist()
            yield pdf.assign(cell=near)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, cell array<int>").withColumn("cell", F.explode("cell"))


def write_cells(vectors: DataFrame, path: str, cells: int | None = None) -> int:
    """Stores vectors (doc_id, v) in a folder a cell, with their centres, and returns the number of cells: cells_for() if none is given."""
    n = cells or cells_for(unit(vectors, "doc_id", "v").count())
    centres = centroids(vectors, n)
    spark = vectors.sparkSession
    placed(unit(vectors, "doc_id", "v"), "v", centres).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    rows = [(n, json.dumps(c.tolist())) for c in centres]
    spark.createDataFrame(rows or [(n, "[]")], "cells int, centres string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return n


def search_cells(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 8, block: int = 2048) -> DataFrame:
    """query_id, rank, doc_id, score (cosine) of the k nearest vectors of each query (query_id, q) in its `probes` nearest cells.

    Only the cells' folders that a query asks for are read. With as many probes as cells the search is exact.
    """
    centres = [np.array(json.loads(r["centres"])) for r in spark.read.parquet(f"{path}/centres").collect()]  # 100 centres of a size at most
    asked = few(placed(unit(queries, "query_id", "q"), "q", [c for c in centres if c.size], probes))
    cells = spark.read.schema("doc_id long, v array<double>, cell int").parquet(f"{path}/cells")
    return dense(in_folders(cells, "cell", asked), asked, k, block)
