"""Serving telemetry: limits, caches, circuit breakers and request counts.

What depends on the order of a key's rows is a fold: batches are sorted by Spark; on streams a row waits until the
watermark has passed it, so that rows that come in any order within it give the result of a batch.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column, read without a time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def rate_limited(events: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """events (event_id, ts, key) with `allowed`: the first `limit` requests of a key in each clock minute pass.

    On a stream (see ordered_stream()) a key is forgotten five minutes after its last request.
    """
    minute = F.date_trunc("minute", "ts")
    if events.isStreaming:
        length = 60_000_000

        def step(state: tuple[int, int], at: int) -> tuple[tuple[int, int], bool]:
            own, n = state if state[0] == at // length else (at // length, 0)
            return (own, n + (n < limit)), n < limit

        found = ordered_fold(folded(events, key), [key], [], step, lambda: (-1, 0), "allowed", "boolean", forget=300)
        return found.select("event_id", key, "allowed")
    order = Window.partitionBy(key, minute).orderBy("ts", "event_id")
    return events.select("event_id", key, minute.alias("minute"), (F.row_number().over(order) <= limit).alias("allowed"))


def sliding_limited(events: DataFrame, key: str, limit: int = 10, seconds: int = 60) -> DataFrame:
    """event_id, key and allowed of events (event_id, ts, key): a request passes if fewer than `limit` passed in the `seconds` before it. Rejected ones don't count."""
    span = seconds * 1_000_000

    def step(passed: tuple[int, ...], at: int) -> tuple[tuple[int, ...], bool]:
        passed = tuple(x for x in passed if at - x < span)
        return ((*passed, at), True) if len(passed) < limit else (passed, False)

    return ordered_fold(folded(events, key), [key], [], step, tuple, "allowed", "boolean", forget=seconds)


def minute_counts(events: DataFrame, key: str, late: str = "5 minutes") -> DataFrame:
    """minute, key, n and total value; on a stream, rows later than `late` are dropped."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = marked.withWatermark("ts", late) if events.isStreaming else marked
    counted = marked.groupBy(F.window("ts", "1 minute").alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("minute"), key, "n", "total")


def ordered_fold(rows: DataFrame, keys: list[str], values: list[str], step: Callable, start: Callable, result: str, kind: str, forget: int | None = None) -> DataFrame:
    """event_id, `keys` and `result` of rows in the order of (at, event_id) within each key.

    `step(state, at, *values)` returns the next state and the row's result. Rows are sorted by Spark and pass by in
    batches, so that a task holds the state of one key, however many rows the key has. Streams: ordered_stream().
    """
    if rows.isStreaming:
        return ordered_stream(rows, keys, values, step, start, result, kind, forget)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            out = []
            for key, *row in zip(zip(*(pdf[k] for k in keys), strict=True), pdf["at"], *(pdf[v] for v in values), strict=True):
                if key != last:
                    last, state = key, start()
                state, found = step(state, *row)
                out.append(found)
            yield pd.DataFrame({"event_id": pdf["event_id"], **{k: pdf[k] for k in keys}, result: out})

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "at", "event_id")
    return ordered.mapInPandas(run, f"event_id long, {types_of(rows, keys)}, {result} {kind}")


def types_of(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)


def ordered_stream(rows: DataFrame, keys: list[str], values: list[str], step: Callable, start: Callable, result: str, kind: str, forget: int | None = None) -> DataFrame:
    """ordered_fold() of a stream, rows having `ts` with a watermark.

    A key's state has the fold's and the rows that the watermark hasn't passed; these are told once it has, in order.
    Rows that come later than the watermark are dropped, see late_rows(). `forget` seconds after a key's last row its
    state goes; what `step` remembers must not matter any more by then. Without it states stay.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, own = map(pickle.loads, state.get) if state.exists else ([], start())
        for pdf in batches:
            waiting += [(int(at), int(i), *x) for at, i, *x in zip(pdf["at"], pdf["event_id"], *(pdf[v] for v in values), strict=True)]
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda r: r[:2])
        n = bisect_right(waiting, passed, key=lambda r: r[0])
        ids, found, last = [], [], passed
        for at, i, *row in waiting[:n]:
            own, x = step(own, at, *row)
            ids.append(i)
            found.append(x)
            last = at
        waiting = waiting[n:]
        if not waiting and not n and state.hasTimedOut:
            state.remove()
        else:
            state.update((pickle.dumps(waiting), pickle.dumps(own)))
            if waiting or forget is not None:
                at = waiting[0][0] if waiting else last + forget * 1_000_000
                state.setTimeoutTimestamp(max(at // 1000 + 1, passed // 1000 + 1))
        if ids:
            yield pd.DataFrame({"event_id": ids, **{k: [x] * len(ids) for k, x in zip(keys, key, strict=True)}, result: found})

    grouped = rows.groupBy(*keys)
    return grouped.applyInPandasWithState(run, f"event_id long, {types_of(rows, keys)}, {result} {kind}", "waiting binary, own binary", "append", GroupStateTimeout.EventTimeTimeout)


def watched(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream whose rows may come up to `late` after others, by their ts."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def late_rows(query: StreamingQuery) -> int:
    """How many rows a running or ended stream has dropped as too late, as far as its progress reports go back."""
    return sum(x["numRowsDroppedByWatermark"] for p in query.recentProgress for x in p["stateOperators"])


def folded(events: DataFrame, key: str, *more: Column) -> DataFrame:
    """What folds read: event_id, key as text (null: empty), at and more; on a stream ts too, which has the watermark."""
    time = [F.col("ts")] if events.isStreaming else []
    return events.select(F.col("event_id").cast("long"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key), F.coalesce(micros("ts"), F.lit(0)).alias("at"), *more, *time)


def ttl_cache(events: DataFrame, key: str, ttl_seconds: int) -> DataFrame:
    """events (event_id, ts, key) with `hit`: a key is in the cache for `ttl_seconds` from the request that put it there.

    A hit doesn't renew an entry. A null key is the empty one.
    """

    def step(since: int | None, at: int) -> tuple[int, bool]:
        hit = since is not None and at - since <= ttl_seconds * 1_000_000
        return since if hit else at, hit

    return ordered_fold(folded(events, key), [key], [], step, lambda: None, "hit", "boolean", forget=ttl_seconds)


def tiered_cache(events: DataFrame, key: str, ttl_seconds: int, first_ttl_seconds: int) -> DataFrame:
    """events (event_id, ts, key) with `tier`: the tier that answers (1 or 2), 0 for none.

    A miss puts the key into both tiers for `ttl_seconds`; what only the second has goes back to the first for
    `first_ttl_seconds`, which is the first tier's default. Hits of the first tier renew nothing.
    """

    def step(ends: tuple[int, int], at: int) -> tuple[tuple[int, int], int]:
        first, second = ends
        if at <= first:
            return ends, 1
        if at <= second:
            return (at + first_ttl_seconds * 1_000_000, second), 2
        return (at + ttl_seconds * 1_000_000,) * 2, 0

    return ordered_fold(folded(events, key), [key], [], step, lambda: (-1 << 62, -1 << 62), "tier", "int", forget=max(ttl_seconds, first_ttl_seconds))


def circuit_breaker(calls: DataFrame, key: str, most_failures: int = 5, reset_seconds: int = 60) -> DataFrame:
    """event_id, key and state (closed, open, half_open) in which each of calls (event_id, ts, key, ok) finds its service.

    `most_failures` failures in a row open the circuit; calls then are rejected and don't count until `reset_seconds`
    later one is let through, which closes or opens it.
    """

    def step(state: tuple, at: int, ok: bool) -> tuple[tuple, str]:
        failures, opened = state
        if opened is not None and at - opened < reset_seconds * 1_000_000:
            return state, "open"
        failures = 0 if ok else failures + 1
        again = not ok and (opened is not None or failures >= most_failures)
        return (failures, at if again else None), "closed" if opened is None else "half_open"

    rows = folded(calls, key, F.coalesce("ok", F.lit(False)).alias("ok"))
    return ordered_fold(rows, [key], ["ok"], step, lambda: (0, None), "state", "string")


def changed(rows: DataFrame, by: str, order: tuple[str, ...], value: str) -> DataFrame:
    """rows without those whose value is that of the row before, as a log leaves repeated lines out."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1
    return rows.withColumn("marlwork_kept", first | ~F.col(value).eqNullSafe(before)).where("marlwork_kept").drop("marlwork_kept")


def token_stream(requests: DataFrame) -> DataFrame:
    """request_id, seq, chunk_type and content of what is sent for requests (request_id, tokens, failed).

    Metadata, the tokens, then usage and status, or error and status, and the end mark. Null tokens are none.
    """
    piece = lambda kind, content: F.struct(F.lit(kind).alias("chunk_type"), content.alias("content"))
    tokens = F.coalesce("tokens", F.array().cast("array<string>"))
    usage = piece("usage", F.size(tokens).cast("string"))
    failed = F.coalesce("failed", F.lit(False))
    middle = F.when(failed, F.array(piece("error", F.lit("error")), piece("status", F.lit("error")))).otherwise(F.array(usage, piece("status", F.lit("completed"))))
    whole = F.concat(F.array(piece("metadata", F.lit(""))), F.transform(tokens, lambda t: piece("token", t)), middle, F.array(piece("done", F.lit("[DONE]"))))
    return requests.select("request_id", F.posexplode(whole).alias("seq", "c")).select("request_id", "seq", "c.chunk_type", "c.content")


def answers_of(chunks: DataFrame) -> DataFrame:
    """request_id, answer (the tokens in order, joined by spaces), n_tokens, status and complete of chunks (request_id, seq, chunk_type, content), as token_stream() sends them.

    `complete` tells whether every chunk up to the end mark is there; status is `error` where it isn't. Chunks may come
    in any order and more than once. A request's chunks are one row of the result.
    """
    once_each = chunks.dropDuplicates(["request_id", "seq"])
    one = F.struct("seq", "chunk_type", "content")
    whole = once_each.groupBy("request_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    done = F.exists("c", lambda x: x["chunk_type"] == "done") & (F.element_at("c", -1)["seq"] == F.size("c") - 1)
    told = F.get(F.transform(F.filter("c", lambda x: x["chunk_type"] == "status"), lambda x: x["content"]), F.lit(0))
    tokens = F.transform(F.filter("c", lambda x: x["chunk_type"] == "token"), lambda x: x["content"])
    return whole.select("request_id", F.array_join(tokens, " ").alias("answer"), F.size(tokens).alias("n_tokens"), F.when(done, F.coalesce(told, F.lit("error"))).otherwise(F.lit("error")).alias("status"), done.alias("complete"))


def answers_of_stream(chunks: DataFrame, idle: int = 60) -> DataFrame:
    """answers_of() on a stream of chunks that have ts with a watermark.

    A request is told when its end mark and all before it have come, or as an error when the watermark is `idle` seconds
    past its last chunk. Chunks that come for a request that was told begin it anew.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, last = (pickle.loads(state.get[0]), state.get[1]) if state.exists else ({}, 0)
        for pdf in batches:
            own |= {int(n): (kind, content) for n, kind, content in zip(pdf["seq"], pdf["chunk_type"], pdf["content"], strict=True)}
            last = max([last, *(int(x.timestamp() * 1000) for x in pdf["ts"])])
        row = [own[n] for n in sorted(own)]
        complete = bool(row) and any(kind == "done" for kind, _ in row) and max(own) == len(row) - 1
        if complete or state.hasTimedOut:
            tokens = [content for kind, content in row if kind == "token"]
            status = next((content for kind, content in row if kind == "status"), "error") if complete else "error"
            yield pd.DataFrame({"request_id": [key[0]], "answer": [" ".join(tokens)], "n_tokens": [len(tokens)], "status": [status], "complete": [complete]})
            state.remove()
        else:
            state.update((pickle.dumps(own), last))
            state.setTimeoutTimestamp(max(last + idle * 1000, state.getCurrentWatermarkMs() + 1))

    return chunks.groupBy("request_id").applyInPandasWithState(run, "request_id long, answer string, n_tokens int, status string, complete boolean", "own binary, last long", "append", GroupStateTimeout.EventTimeTimeout)


def active_requests(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """event_id and how many requests of its key are open when it begins, if each lasts `seconds`."""
    order = Window.partitionBy(key).orderBy(micros("ts")).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.select("event_id", F.count("*").over(order).alias("active"))
