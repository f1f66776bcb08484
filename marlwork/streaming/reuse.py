"""Reuse distances: how many distinct keys came between two requests for the same key.

A cache of `capacity` entries that drops the least recently used one holds a key exactly if fewer than `capacity`
distinct others came since the key's last request. Between requests p and i those are the requests j whose own last
request stands before p: a count of points (j, last request of j) in a rectangle. The log is cut into ranges of time;
a rectangle is then what lies in the first range, in the last one, and in whole ranges between, which are counts of a
small matrix. No task holds more than a range, and a key is one row a range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlwork.sources.durable import few, kept
from marlwork.sources.ranges import in_ranges


def count_before(values: np.ndarray, upto: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each pair (u, b): how many of the first u values are less than b.

    The first u values are made of aligned blocks whose sizes are the bits of u; each size is sorted once.
    """
    found = np.zeros(len(upto), np.int64)
    if not len(values) or not len(upto):
        return found
    distinct, ranks = np.unique(values, return_inverse=True)
    wanted, span = np.searchsorted(distinct, below, "left"), len(distinct) + 1
    place = np.arange(len(values))
    for bit in range(int(upto.max()).bit_length()):
        block = place >> bit
        some = np.flatnonzero(upto >> bit & 1)
        if not len(some):
            continue
        mine = (upto[some] >> bit) - 1  # the block that ends where the higher bits of u and this one say
        keys = np.sort(block * span + ranks)
        found[some] += np.searchsorted(keys, mine * span + wanted[some], "left") - (mine << bit)
    return found


def _local(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """What a range knows of each of its requests.

    distance: distinct keys since the key's last request, if that is in this range; else those in this range before the
    request (prev_block tells where the rest is). beyond: of the key's last request here, those in this range after it,
    and those before it whose next request comes in a range before next_block.
    """
    rows = rows.sort_values("idx", ignore_index=True)
    n, code = len(rows), pd.factorize(rows["key"])[0]
    at = np.arange(n)
    by = np.lexsort((at, code))
    same = np.concatenate([[False], code[by][1:] == code[by][:-1]])
    prev = np.full(n, -1, np.int64)
    prev[by[1:][same[1:]]] = by[:-1][same[1:]]
    last = np.ones(n, bool)
    last[prev[prev >= 0]] = False
    linked = rows[["key"]].merge(links, on="key", how="left")
    distance = np.full(n, -1, np.int64)
    inside = np.flatnonzero(prev >= 0)
    # All of the first p + 1 requests have their last one before p; the others that do lie between p and i.
    distance[inside] = count_before(prev, inside, prev[inside]) - (prev[inside] + 1)
    first = np.flatnonzero(prev < 0)
    before = linked["prev"].to_numpy(np.int64)  # block and idx as one number; -1 where the key was never seen
    seen = before[first] >= 0
    inner = count_before(before[first], np.flatnonzero(seen), before[first][seen])
    distance[first[seen]] = inner
    ends = np.flatnonzero(last)
    after = linked["next_block"].to_numpy(np.int64)
    goes = after[ends] < np.iinfo(np.int64).max
    beyond = np.full(n, -1, np.int64)
    p = ends[goes]
    beyond[p] = np.searchsorted(np.sort(prev), p, "left") - (p + 1) + count_before(after[ends], np.flatnonzero(goes), after[p])
    time = rows["at"].to_numpy(np.int64)
    gap = np.where(prev >= 0, time - time[prev], time - linked["prev_at"].to_numpy(np.int64))
    return pd.DataFrame({"event_id": rows["event_id"], "key": rows["key"], "at": time, "gap": gap, "idx": rows["idx"], "block": rows["block"].astype(np.int64), "distance": distance, "prev_block": np.where((prev < 0) & (before >= 0), before >> 32, -1), "next_block": np.where(beyond >= 0, after, -1), "beyond": beyond})


def distances(rows: DataFrame, order: list[str]) -> DataFrame:
    """event_id, key, at, gap, block, idx and `distance` of rows (event_id, key, at, and the columns of `order`).

    distance counts the distinct keys between a request and the last one for its key in `order`, gap is the time since
    then; distance is null for the first one. block and idx are the place in `order`.
    """
    ranged = in_ranges(rows, order)
    edges = ranged.groupBy("block", "key").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.max_by("at", "idx").alias("last_at"))
    steps = Window.partitionBy("key").orderBy("block")
    place = F.lag("block").over(steps).cast("long") * F.lit(1 << 32) + F.lag("last").over(steps)
    links = kept(edges.select("block", "key", F.coalesce(place, F.lit(-1)).alias("prev"), F.coalesce(F.lead("block").over(steps).cast("long"), F.lit((1 << 63) - 1)).alias("next_block"), F.coalesce(F.lag("last_at").over(steps), F.lit(0)).alias("prev_at")))
    local = ranged.groupBy("block").cogroup(links.groupBy("block")).applyInPandas(lambda r, e: _local(r, e.drop(columns="block")), "event_id long, key string, at long, gap long, idx long, block long, distance long, prev_block long, next_block long, beyond long")
    local = kept(local)
    # Whole ranges between: of the keys that a range sees first, those last seen before a given range.
    own_first = links.select(F.col("block").cast("long").alias("b"), F.shiftright("prev", 32).alias("c"))
    matrix = own_first.groupBy("b", "c").agg(F.count("*").alias("n"))
    blocks = ranged.select(F.col("block").cast("long").alias("b")).distinct()
    grid = blocks.join(blocks.withColumnRenamed("b", "x"), F.col("x") < F.col("b"))  # half the square of the number of ranges
    # A key that was never seen counts as last seen in range -1.
    upto = Window.partitionBy("b").orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = matrix.withColumn("n", F.sum("n").over(upto)).withColumn("until", F.lead("c").over(Window.partitionBy("b").orderBy("c")))
    seen = grid.join(sums.withColumnRenamed("b", "own"), (F.col("b") == F.col("own")) & (F.col("c") < F.col("x")) & (F.coalesce("until", F.lit(1 << 62)) >= F.col("x")), "left").select("b", "x", F.coalesce("n", F.lit(0)).alias("n"))
    earlier = Window.partitionBy("x").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    between = seen.select(F.col("b").alias("block"), F.col("x").alias("prev_block"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("middle"))
    ends = local.where("beyond >= 0").select("key", F.col("block").alias("prev_block"), F.col("next_block").alias("block"), "beyond")
    far = local.where("prev_block >= 0").drop("next_block", "beyond").join(ends, ["key", "block", "prev_block"]).join(few(between), ["block", "prev_block"])
    columns = ("event_id", "key", "at", "gap", "block", "idx")
    far = far.select(*columns, (F.col("distance") + F.col("beyond") + F.col("middle")).alias("distance"))
    near = local.where("prev_block < 0").select(*columns, F.when(F.col("distance") >= 0, F.col("distance")).alias("distance"))
    return near.unionByName(far)


def lru_cache(events: DataFrame, key: str, capacity: int, ttl_seconds: int, shards: int = 1) -> DataFrame:
    """event_id and hit of events (event_id, ts, key) before a cache of `shards` servers, `capacity` entries each.

    A key belongs to the server that its hash names. A full server drops the entry that was used least recently; a hit
    makes an entry the latest but doesn't renew its time to live of `ttl_seconds`. A null key is the empty one, a null
    time 1970; requests at one time go by event_id.
    """
    from marlwork.streaming.serving import folded, ordered_fold

    rows = folded(events, key).withColumnRenamed(key, "key").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    found = kept(distances(rows, ["shard", "at", "event_id"]))
    held = F.coalesce(F.col("distance") < capacity, F.lit(False))
    # A key's requests fall into spans: where it isn't held, or was last asked for too long ago, it is put in anew. They
    # are numbered within ranges, then over a key's ranges.
    live = ttl_seconds * 1_000_000
    marked = found.select("event_id", "key", "at", "block", "idx", (~held | (F.col("gap") > live)).alias("fresh"))
    starts = marked.groupBy("key", "block").agg(F.sum(F.col("fresh").cast("long")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.sum(F.col("fresh").cast("long")).over(Window.partitionBy("key", "block").orderBy("idx"))
    spans = marked.withColumn("inner", inner).join(starts.select("key", "block", before.alias("before")), ["key", "block"]).withColumn("span", F.col("before") + F.col("inner"))

    def step(since: int | None, at: int, fresh: bool) -> tuple[int, bool]:
        hit = not fresh and since is not None and at - since <= live
        return since if hit else at, hit

    return ordered_fold(spans, ["key", "span"], ["fresh"], step, lambda: None, "hit", "boolean").select("event_id", "hit")
