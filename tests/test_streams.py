"""Folds on streams: rows that come in any order within the watermark, and over restarts, give the result of a batch."""

import random
import time

import pytest
from pyspark.sql import functions as F

from marlwork.streaming import serving

HOUR = 3600


@pytest.fixture(scope="module")
def log():
    """Files of rows (event_id, s, k, ok): each is out of order, and up to eight minutes behind the one before."""
    rng = random.Random(17)
    rows = [(i, rng.randrange(3 * HOUR), rng.choice("aaab"), rng.random() < 0.3) for i in range(500)]
    files = [[] for _ in range(7)]
    for r in rows:
        files[min(5, (r[1] + rng.randrange(480)) // (HOUR // 2))].append(r)
    files[6] = [(9000 + n, 30 * HOUR, k, True) for n, k in enumerate("ab")]  # moves the watermark past all others
    for f in files:
        rng.shuffle(f)
    return rows, files


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, s long, k string, ok boolean").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000).cast("timestamp_ntz")).drop("s")


CASES = {
    "minutes": lambda e: serving.rate_limited(e, "k", 1).select("event_id", "allowed"),
    "sliding": lambda e: serving.sliding_limited(e, "k", 2, 300).select("event_id", "allowed"),
    "ttl": lambda e: serving.ttl_cache(e, "k", 200).select("event_id", "hit"),
    "tiers": lambda e: serving.tiered_cache(e, "k", 400, 30).select("event_id", "tier"),
    "breaker": lambda e: serving.circuit_breaker(e, "k", 3, 120).select("event_id", "state"),
}


@pytest.mark.parametrize("case", CASES)
def test_stream_equals_batch(spark, tmp_path, log, case):
    rows, files = log
    schema = frame(spark, rows[:1]).schema

    def run(name):
        stream = serving.watched(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
        query = CASES[case](stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination(300)
        return query

    def arrive(numbers):
        for n in numbers:
            frame(spark, files[n]).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
            time.sleep(0.02)

    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        arrive(range(3))
        run(f"{case}_first")
        arrive(range(3, 7))
        assert serving.late_rows(run(f"{case}_again")) == 0  # goes on from the checkpoint
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("event_id < 9000").collect()]
    want = [tuple(r) for r in CASES[case](frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want)
    assert len({x for _, x in want}) > 1


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    schema = frame(spark, [(1, 1, "a", True)]).schema
    for n, rows in enumerate(([(1, HOUR, "a", True)], [(2, 5 * HOUR, "a", True)], [(3, 60, "a", True), (4, 70, "b", True)], [(5, 9 * HOUR, "a", True)])):
        frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        time.sleep(0.02)
    stream = serving.watched(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
    query = serving.ttl_cache(stream, "k", 60).writeStream.format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert serving.late_rows(query) == 2
    assert {r.event_id for r in spark.table("late").collect()} >= {1, 2}
    assert not {r.event_id for r in spark.table("late").collect()} & {3, 4}


def test_answers_are_put_together_again(spark, tmp_path):
    rng = random.Random(4)
    requests = spark.createDataFrame([(i, ["w%d" % j for j in range(rng.randrange(6))], i % 4 == 0) for i in range(30)], "request_id long, tokens array<string>, failed boolean")
    sent = serving.token_stream(requests).where("not (request_id % 7 = 2 and seq = 1)")
    want = sorted(tuple(r) for r in serving.answers_of(sent.unionByName(sent)).collect())
    assert {r[3] for r in want} == {"completed", "error"}
    assert [r[4] for r in want] == [i % 7 != 2 for i in range(30)]
    rows = [(*r, 1_700_000_000 + rng.randrange(100)) for r in sent.collect()]
    rng.shuffle(rows)
    end = [(999, 0, "metadata", "", 1_700_090_000)]
    for n, part in enumerate((rows[:40], rows[40:90], rows[90:], end)):
        df = spark.createDataFrame(part, "request_id long, seq int, chunk_type string, content string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        time.sleep(0.02)
    stream = serving.watched(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), "5 minutes")
    query = serving.answers_of_stream(stream).writeStream.format("memory").queryName("put_together").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert sorted(tuple(r) for r in spark.table("put_together").where("request_id <> 999").collect()) == want
