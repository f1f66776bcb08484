"""An index that follows a folder: as one built anew after each change, and files that stay aren't read."""

import os
import pathlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlwork.functions.text import tokens
from marlwork.operators import search, segments


def write(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(str(folder))


def spoil(folder):
    """Fills the files of a folder with zeros; path, size and time stay."""
    for f in pathlib.Path(folder).glob("*.parquet"):
        seen = f.stat()
        f.write_bytes(b"\0" * seen.st_size)
        os.utime(f, ns=(seen.st_atime_ns, seen.st_mtime_ns))


def rows_of(df):
    return [tuple(r) for r in df.orderBy("query_id", "rank").collect()]


def test_updates_equal_a_new_index(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("the of and".split()) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(1, 40)))
    files = {k: [(100 * k + i, text()) for i in range(60)] for k in range(3)}
    files[0] += [(97, None), (98, ""), (None, "without an id")]
    for k, rows in files.items():
        write(spark, rows, tmp_path / f"in/{k}")
    path = str(tmp_path / "index")
    queries = spark.createDataFrame([(1, "the w1"), (2, "w2 w3 w5"), (3, "w1 w4 zebra"), (4, "nowhere"), (5, files[1][7][1])], "query_id long, query string")

    def same():
        every = spark.createDataFrame([r for rows in files.values() for r in rows if r[0] is not None], "doc_id long, text string")
        want = rows_of(search.bm25(every, queries, 5))
        assert want and rows_of(search.found(segments.read(spark, path), queries, 5)) == want

    assert segments.update(spark, str(tmp_path / "in"), path, 8) == 1
    same()
    assert segments.update(spark, str(tmp_path / "in"), path) == 1  # nothing changed
    spoil(tmp_path / "in/0")  # were it read, that would fail
    spoil(tmp_path / "in/2")
    files[1] = [(i, t) for i, t in files[1][10:]] + [(901, "zebra w1"), (902, "zebra zebra the")]
    files[1][3] = (files[1][3][0], "w4 " + files[1][3][1])
    write(spark, files[1], tmp_path / "in/1")
    assert segments.update(spark, str(tmp_path / "in"), path) == 2
    same()
    made = {r["doc_id"]: r["made"] for r in segments.of_version(spark, path, "manifest", 2).collect()}
    assert {k for k, v in made.items() if v == 2} == {901, 902, files[1][3][0]}  # other texts keep their place
    write(spark, [], tmp_path / "in/2")
    files[2] = []
    segments.update(spark, str(tmp_path / "in"), path)
    same()
    assert segments.merge(spark, path) == 4
    assert segments.of_version(spark, path, "dead", 4).isEmpty()
    same()


def test_ids_that_stand_twice_and_an_empty_folder(spark, tmp_path):
    write(spark, [(1, "a"), (1, "b")], tmp_path / "twice/0")
    with pytest.raises(ValueError, match="more than once"):
        segments.update(spark, str(tmp_path / "twice"), str(tmp_path / "i"))
    with pytest.raises(ValueError, match="no index"):
        segments.read(spark, str(tmp_path / "i"))
    write(spark, [], tmp_path / "none/0")
    segments.update(spark, str(tmp_path / "none"), str(tmp_path / "j"))
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert search.found(segments.read(spark, str(tmp_path / "j")), asked).collect() == []


def test_dead_rows_leave_blocks_whole(spark, tmp_path):
    write(spark, [(i, f"a w{i % 7}") for i in range(50)], tmp_path / "in/0")
    path = str(tmp_path / "index")
    segments.update(spark, str(tmp_path / "in"), path, 4)
    write(spark, [(i, f"a w{i % 7}" if i % 5 else "b") for i in range(45)], tmp_path / "in/0")
    segments.update(spark, str(tmp_path / "in"), path)
    blocks = segments.read(spark, path).blocks
    assert "Generate" not in blocks._jdf.queryExecution().executedPlan().toString()  # no row for each posting
    held = sorted(d.doc_id for r in blocks.where("term = 'a'").collect() for d in r.docs)
    assert held == [i for i in range(45) if i % 5]
    assert blocks.where("term = 'a'").count() <= 4  # one a shelf


def test_the_dead_leave_where_the_words_of_queries_are_left(spark, tmp_path):
    texts = {i: f"a w{i % 7} v{i}" for i in range(50)}
    write(spark, list(texts.items()), tmp_path / "in/0")
    path = str(tmp_path / "index")
    segments.update(spark, str(tmp_path / "in"), path, 4)
    texts = {i: t if i % 5 else f"w{i % 7} b" for i, t in texts.items() if i < 45}
    write(spark, list(texts.items()), tmp_path / "in/0")
    segments.update(spark, str(tmp_path / "in"), path)
    own, asked = segments.read(spark, path), spark.createDataFrame([(1, "v7 w0"), (2, texts[10]), (3, "a w1 w2 w3"), (4, "v49 v40")], "query_id long, query string")
    text = search.planned(own, asked, 5).read._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in text  # no block is looked through for the dead before it meets the words
    every = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert rows_of(search.found(own, asked, 5)) == rows_of(search.bm25(every, asked, 5)) != []


def test_words_are_split_as_by_spark(spark):
    spaces = [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x180E, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
    texts = ["", " ", "Ab  \tcD", " İÀ ß ", *(f"x{chr(c)}Y{chr(c)}" for c in spaces)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("text", F.lower("text").alias("low"), tokens(F.col("text")).alias("w")).collect()
    for some in (rows, [r for r in rows if not set(r.text) & set("\x1c\x1d\x1e\x1f")]):  # both ways to split
        assert search.words_of(pa.array([r.low for r in some])).to_pylist() == [r.w for r in some]


def test_queries_of_many_candidates_read_their_blocks(spark, tmp_path):
    texts = {i: "x y" if i < 150 else "x" if i < 160 else f"z w{i}" for i in range(500)}
    write(spark, list(texts.items()), tmp_path / "in/0")
    segments.update(spark, str(tmp_path / "in"), str(tmp_path / "index"), 4)
    own, asked = segments.read(spark, str(tmp_path / "index")), spark.createDataFrame([(1, "x y"), (2, "w170")], "query_id long, query string")
    plan = search.planned(own, asked, 1)
    assert plan.thresholds.where("threshold > 0").count() == 2
    assert {r.query_id for r in plan.candidates.collect()} == {2}  # no text of 150 equal ones is split for the other
    every = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert rows_of(search.found(own, asked, 1)) == rows_of(search.bm25(every, asked, 1)) != []
