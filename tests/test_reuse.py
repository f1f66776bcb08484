"""Reuse distances and the cache that drops the least recently used entry, against loops."""

import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlwork.streaming import reuse


def test_count_before():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 64, 300):
        values = rng.integers(-5, 40, n)
        upto, below = rng.integers(0, n + 1, 90), rng.integers(-6, 42, 90)
        want = [(values[:u] < b).sum() for u, b in zip(upto, below, strict=True)]
        assert reuse.count_before(values, upto, below).tolist() == want


def replay(rows, capacity, ttl, shards):
    """event_id to hit, by ordered dictionaries. rows: event_id, at (seconds), key, shard."""
    servers, hits = [OrderedDict() for _ in range(shards)], {}
    for i, at, key, shard in sorted(rows, key=lambda r: (r[1], r[0])):
        own = servers[shard]
        hits[i] = key in own and at - own[key] <= ttl
        if not hits[i]:
            own[key] = at
        own.move_to_end(key)
        if len(own) > capacity:
            own.popitem(last=False)
    return hits


def log(spark, n, keys, seed, step=2):
    rng = random.Random(seed)
    # A key that holds a third of the log, some that come often and many that come once; ties in time.
    key = lambda: "hot" if rng.random() < 0.33 else rng.choice(keys) if rng.random() < 0.8 else f"once{rng.random()}"
    rows = [(i, rng.randrange(n * step), key()) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, s long, k string").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    return df.drop("s").repartition(5), rows


@pytest.mark.parametrize(("capacity", "ttl", "shards", "keys"), [(3, 30, 1, 8), (1, 10**9, 1, 4), (20, 400, 1, 60), (5, 100, 3, 20), (10**6, 50, 1, 9)])
def test_lru_cache_matches_a_loop(spark, capacity, ttl, shards, keys):
    df, rows = log(spark, 900, [f"k{i}" for i in range(keys)], capacity)
    shard = {r.k: r.s for r in df.select("k", F.pmod(F.xxhash64("k"), F.lit(shards)).alias("s")).distinct().collect()}
    got = {r.event_id: r.hit for r in reuse.lru_cache(df, "k", capacity, ttl, shards).collect()}
    assert got == replay([(*r, shard[r[2]]) for r in rows], capacity, ttl, shards)


def test_distances_of_many_ranges(spark):
    df, rows = log(spark, 600, ["a", "b", "c", "d", "e", "f"], 11)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = reuse.distances(df.select("event_id", F.col("k").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), ["at", "event_id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want, last = {}, {}
    for n, (i, _, k) in enumerate(order):
        want[i] = len({x[2] for x in order[last[k] + 1 : n]}) if k in last else None
        last[k] = n
    assert {r.event_id: r.distance for r in found} == want
    assert len({r.block for r in found}) > 15


def test_lru_cache_of_nothing_and_of_nulls(spark):
    df, _ = log(spark, 20, ["a"], 1)
    assert reuse.lru_cache(df.limit(0), "k", 3, 10).count() == 0
    rows = [(0, None, "x"), (1, None, "x"), (2, None, None), (3, None, None), (4, "y", "x")]
    df = spark.createDataFrame(rows, "event_id long, k string, extra string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert [r.hit for r in reuse.lru_cache(df, "k", 1, 10).orderBy("event_id").collect()] == [False, True, True, True, False]
