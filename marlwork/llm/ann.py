"""Approximate nearest neighbours with randomly rotated one-bit codes.

A unit vector is rotated at random and keeps only the signs of its components, packed into bytes, and one correction
scalar, its inner product with the normalised sign vector. From a code and a query, an estimate of the cosine and a
bound on its error follow; only candidates whose upper bound reaches the fifth best lower bound are reranked by the
exact cosine of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlwork.llm.common import durable


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random rotation of `dim` dimensions, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, and each vector's inner product with its normalised signs."""
    turned = unit @ turn.T
    signs = turned >= 0
    return np.packbits(signs, axis=1), np.where(signs, turned, -turned).sum(1) / np.sqrt(unit.shape[1])


def estimates(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosine of each (rotated unit query, code), and its error bound at `width` standard deviations."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    estimate = (queries.astype(np.float32) @ signs.T) / (np.sqrt(dim) * scalars).astype(np.float32)
    error = width * np.sqrt(np.maximum(0, 1 - scalars**2) / (scalars**2 * max(1, dim - 1)))
    return estimate, error.astype(np.float32)


#: Queries estimated at once against a block, and (query, candidate) pairs reranked at once; both bound a task's memory.
QUERY_STEP, PAIR_STEP = 128, 1 << 15


def directions(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1. Each is divided by its largest component first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the unit rows a[i] and b[j]."""
    out = np.empty(len(i))
    for lo in range(0, len(i), PAIR_STEP):
        at = slice(lo, lo + PAIR_STEP)
        out[at] = np.einsum("ij,ij->i", a[i[at]], b[j[at]])
    return out


def nearest(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scalars: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, width: float) -> Iterator[pd.DataFrame]:
    """Each query's k nearest in one block: estimates first, then the exact cosines of those whose bound allows it."""
    unit = directions(vectors)
    turn = rotation(queries.shape[1]).T
    for lo in range(0, len(queries), QUERY_STEP):
        own_ids, some = query_ids[lo : lo + QUERY_STEP], directions(queries[lo : lo + QUERY_STEP])
        estimate, error = estimates(codes, scalars, some @ turn, width)
        estimate[ids[None, :] == own_ids[:, None]] = -np.inf
        # The k best estimates, reranked, give a score that the k nearest reach at least.
        best = min(k, len(ids))
        first = np.argpartition(estimate, len(ids) - best, axis=1)[:, len(ids) - best :]
        known = cosines(some, unit, np.repeat(np.arange(len(some)), best), first.ravel()).reshape(-1, best)
        known[np.take_along_axis(estimate, first, axis=1) == -np.inf] = -np.inf
        q, c = np.nonzero((estimate + error >= known.min(axis=1, keepdims=True)) & (estimate > -np.inf))
        exact = cosines(some, unit, q, c)
        order = np.lexsort((ids[c], -exact, q))
        q, c, exact = q[order], c[order], exact[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        yield pd.DataFrame({"query_id": own_ids[q[top]], "vec_id": ids[c[top]], "score": exact[top]})


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: not null, not zero, all components finite. Floats stay floats."""
    v = F.col("embedding")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kept = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if single else "array<double>"))
    return kept.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def search(vectors: DataFrame, is_query, k: int = 5, width: float = 3.0, block: int = 1024, query_block: int = 1024, shards: int | None = None, most_query_bytes: int = 32 << 20) -> DataFrame:
    """The k nearest rows of each query: query_id, rank (from 1), vec_id, score (the exact cosine).

    Every row of `vectors` (vec_id, embedding) is indexed and compared with every query block; a block of `block` codes
    meets a block of at most `query_block` queries in one step, so that no step holds more than these. Query blocks of
    `most_query_bytes` in all are broadcast and the index stays where it is; more of them go to `shards` shards of the
    index. Ties go to the smaller vec_id. Rows whose vector is null, zero or holds null or non-finite components, or
    whose vec_id is null, take no part, and vectors are compared with those of as many dimensions only. Of repeated rows
    of one vec_id each is a candidate and a query of its own id never finds that id. Other columns are ignored; empty
    tables give an empty result.
    """
    kept = usable(vectors)
    kind = np.float32 if dict(kept.dtypes)["embedding"] == "array<float>" else np.float64

    def stacked(pdf: pd.DataFrame, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(dimensions, ids, vectors) of blocks of `step` rows."""
        for dim, part in pdf.groupby(pdf["embedding"].map(len)):
            for lo in range(0, len(part), step):
                some = part.iloc[lo : lo + step]
                yield dim, some["vec_id"].to_numpy(np.int64), np.stack(some["embedding"].to_list()).astype(kind)

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, ids, v in stacked(pdf, block):
                codes, scalars = encode(directions(v.astype(np.float64)), rotation(dim))
                yield pd.DataFrame({"dim": [dim], "ids": [ids.tobytes()], "vectors": [v.tobytes()], "codes": [codes.tobytes()], "scalars": [scalars.tobytes()]})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, ids, v in stacked(pdf, query_block):
                yield pd.DataFrame({"dim": [dim], "query_ids": [ids.tobytes()], "queries": [v.tobytes()]})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids, scalars = np.frombuffer(r.ids, np.int64), np.frombuffer(r.scalars)
                codes = np.frombuffer(r.codes, np.uint8).reshape(len(ids), -1)
                query_ids = np.frombuffer(r.query_ids, np.int64)
                v, q = (np.frombuffer(x, kind).reshape(n, -1).astype(np.float64) for x, n in ((r.vectors, len(ids)), (r.queries, len(query_ids))))
                yield from nearest(ids, v, codes, scalars, query_ids, q, k, width)

    context = vectors.sparkSession.sparkContext
    index = kept.mapInPandas(indexed, "dim int, ids binary, vectors binary, codes binary, scalars binary")
    # Query rows come together first, so that blocks are full.
    queries = kept.where(is_query(F.col("vec_id"))).repartition(F.pmod(F.xxhash64("vec_id"), F.lit(4)))
    queries = durable(queries.mapInPandas(packed, "dim int, query_ids binary, queries binary"))
    size = queries.agg(F.coalesce(F.sum(F.octet_length("queries") + F.octet_length("query_ids")), F.lit(0)).alias("n")).first()["n"]
    if size <= most_query_bytes:
        # Blocks of codes are dealt out evenly where the table has fewer splits than there are cores.
        index = index.repartition(3 * context.defaultParallelism) if kept.rdd.getNumPartitions() < context.defaultParallelism else index
        pairs = index.join(F.broadcast(queries), "dim")
    else:
        shards = shards or 2 * context.defaultParallelism
        index = index.withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int"))
        pairs = index.join(queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))), ["dim", "shard"]).drop("shard")
    found = pairs.drop("dim").mapInPandas(met, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
