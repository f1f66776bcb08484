"""What tasks hold and read follows fixed sizes, not the tables."""

import pytest
from pyspark.sql import functions as F

from marlwork.operators import citations, keywords, training
from marlwork.plans import registry
from marlwork.sources import ranges

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keywords_are_looked_for_in_distinct_words(spark, monkeypatch):
    seen, real = [], keywords.held_by_grams
    monkeypatch.setattr(keywords, "held_by_grams", lambda texts, *x: seen.append(texts.count()) or real(texts, *x))
    texts = spark.createDataFrame([(i, "Unfairly dismissed, un dismissed annual leave") for i in range(50)] + [(99, None), (98, "")], "id long, text string")
    words = spark.createDataFrame([("dismissed",), ("fair",), ("annual leave",), ("un dis",), ("none",), ("",), (None,)], "keyword string")
    found = sorted((r.id, r.keyword) for r in keywords.held(texts, ["id"], "text", words).collect())
    assert found == sorted((i, w) for i in range(50) for w in ("dismissed", "fair", "annual leave", "un dis"))
    assert seen[0] == 6


def test_listed_sections_equal_a_column(spark):
    own = [*citations.DEFAULT_SECTIONS, "odd one"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([*own, None, "EA-2022-99", "ea-2022-60f", "x"])], "k long, s string")
    both = rows.select(*(citations.different_section(v, F.col("s"), F.col("k")).alias(f"d{i}") for i, v in enumerate((own, citations.literal(own)))), *(citations.of_family(v, citations.family(F.col("s"))).alias(f"f{i}") for i, v in enumerate((own, citations.literal(own)))))
    assert all(r.d0 == r.d1 and r.f0 == r.f1 for r in both.collect())
    assert citations.different_section([], F.lit("a"), F.lit(1)) is not None


@pytest.mark.parametrize("name", ["different_section", "enhanced_win_rate", "flawed_drafts", "answer_repair"])
def test_narrow_rows_are_dealt_to_all_cores(spark, name):
    assert "RoundRobinPartitioning" in plan(registry.queries()[name](spark, FOLDER))


def test_a_response_is_grounded_once_for_two_targets(spark):
    text = registry.queries()["enhanced_win_rate"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all(") == 1


def test_repeats_of_few_instructions_are_broadcast(spark):
    rows = spark.range(1000).select("id", F.lit("Same?").alias("q"), F.lit("s").alias("s"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = training.told_apart(rows, "id", "q", "s")
        assert "SortMergeJoin" not in plan(df)
        assert sorted(r.q for r in df.collect())[:2] == ["Same?", "Same? [s]"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ranges_stay_small(spark):
    got = ranges.in_ranges(spark.range(3000).select("id"), ["id"], 100).groupBy("block").count()
    assert got.agg(F.sum("count")).first()[0] == 3000
    assert got.agg(F.max("count")).first()[0] <= 400
