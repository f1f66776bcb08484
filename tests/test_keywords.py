"""Keywords by a join against looking for each of them."""

import random

from marlwork.operators import citations, governance, keywords


def as_rows(df, key):
    return {tuple(r[k] for k in key): {k: v for k, v in r.asDict().items() if k not in key} for r in df.collect()}


def test_held_equals_a_search_for_each(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdé😀 ", k=rng.randint(1, 9))) for _ in range(300)]
    texts = [(i, "".join(rng.choices("abcdéABÉ😀 \n", k=rng.randint(0, 60)))) for i in range(200)] + [(900, None), (901, ""), (None, "xx abc xx"), (1, "aaaa")]
    # Keywords across the ends of pieces of a long text.
    texts.append((902, "y" * (keywords.PIECE - 3) + "needle" + "z" * (2 * keywords.PIECE - 10) + "thread"))
    known = [(w,) for w in words] + [("needle",), ("thread",), ("A",), ("",), (None,), ("abc",), ("zz",)]
    got = keywords.held(spark.createDataFrame(texts, "id long, t string"), ["id"], "t", spark.createDataFrame(known, "keyword string")).collect()
    want = {(i, w) for i, t in texts for (w,) in known if w and w in (t or "").lower()}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {(902, "needle"), (902, "thread"), (902, "zz")} <= want


def test_no_keywords_and_no_texts(spark):
    texts = spark.createDataFrame([(1, "abc")], "id long, t string")
    none = spark.createDataFrame([("",)], "keyword string")
    assert keywords.held(texts, ["id"], "t", none).collect() == []
    found = keywords.collected(texts, ["id"], "t", none.selectExpr("keyword", "1 as tag"), ["tag"]).collect()
    assert [(r["id"], r["found"]) for r in found] == [(1, [])]
    assert keywords.families_found(texts.limit(0), ["id"], "t", keywords.family_table(spark)).collect() == []


def test_tables_equal_the_expressions(spark):
    texts = ["Is it a guarantee? Ask a lawyer", "overtime on a rest day", "nothing", None, "LAWYER advance of wages", "lawyer"]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(None, "overtime")], "id long, t string")
    got = as_rows(keywords.classified(rows, ["id"], "t", keywords.policy_table(spark)), ["id"])
    want = as_rows(rows.select("id", governance.policy_category(rows["t"]).alias("category"), governance.policy_rules(rows["t"]).alias("rules")), ["id"])
    assert got == {k: {"category": v["category"], "rules": v["rules"] or []} for k, v in want.items()}
    got = as_rows(keywords.families_found(rows, ["id"], "t", keywords.family_table(spark)), ["id"])
    want = as_rows(rows.select("id", citations.families_of(rows["t"]).alias("families")), ["id"])
    assert got == {k: {"families": v["families"] or []} for k, v in want.items()}


def test_ten_thousand_keywords_are_one_join(spark):
    known = spark.range(10_000).selectExpr("concat('key', lpad(cast(id as string), 5, '0'), 'end') as keyword")
    texts = spark.range(500).selectExpr("id", "concat('some key', lpad(cast(id * 40 as string), 5, '0'), 'end here') as t")
    found = keywords.held(texts, ["id"], "t", known)
    assert found.count() == 250
    assert "contains" in found._jdf.queryExecution().executedPlan().toString().lower()
