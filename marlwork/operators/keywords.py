"""Keywords in texts by a join, for tables of many keywords.

A keyword is looked for under the rarest of its letter-grams: texts are cut into pieces, the distinct grams of a piece
meet the keywords that they stand for, and only these are compared with the piece. So thousands of keywords cost two
passes over the texts, one that counts grams and one that finds keywords, and no expression grows with their number.
A keyword without white space lies within a word: such keywords are looked for in the distinct words of all texts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlwork.functions.text import once, tokens
from marlwork.operators.citations import KEYWORDS
from marlwork.operators.governance import POLICIES
from marlwork.operators.search import spread
from marlwork.sources.durable import few, kept

#: Letters of a gram; a shorter keyword is its own gram.
GRAM = 3
#: Letters of a piece of a text, which overlaps the next by the longest keyword.
PIECE = 4096


def grams(text: Column, width: int) -> Column:
    """Every `width` letters in a row, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))


def pieces(text: Column, size: int, overlap: int) -> Column:
    """`text` in pieces of `size` letters, each followed by the next one's first `overlap` letters."""
    after = lambda cut, i: F.coalesce(F.substring(F.get(cut, i + 1), 1, overlap), F.lit(""))
    return once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), lambda cut: F.transform(cut, lambda x, i: F.concat(x, after(cut, i))))


def held(texts: DataFrame, key: list[str], text: str, keywords: DataFrame) -> DataFrame:
    """The columns `key` and keyword: which of keywords (keyword) the lower-case texts hold, also inside words, each once a key.

    Keywords are compared as they are given: one with capitals is in no text. Null and empty keywords are left out; null
    and empty texts hold none. Rows of one key, null or not, count as one text. No column of `key` may be named keyword.
    """
    known = kept(keywords.select(F.col("keyword").alias("marlwork_word")).where("marlwork_word <> ''").distinct())
    spaced = F.col("marlwork_word").rlike(r"(?U)\s")
    words = spread(texts.select(*dict.fromkeys([*key, text]))).select(*key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("marlwork_token"))
    vocabulary = kept(words.select("marlwork_token").distinct())
    inside = held_by_grams(vocabulary, ["marlwork_token"], "marlwork_token", kept(known.where(~spaced)))
    inside = F.broadcast(inside) if inside.count() <= 200_000 else inside
    found = words.join(inside, "marlwork_token").select(*key, "keyword")
    return found.unionByName(held_by_grams(texts, key, text, kept(known.where(spaced)))).distinct()


def held_by_grams(texts: DataFrame, key: list[str], text: str, known: DataFrame) -> DataFrame:
    """As held(), of known (marlwork_word), under grams of the whole texts."""
    size = F.length("marlwork_word")
    shape = known.agg(F.max(size).alias("longest"), F.collect_set(F.least(size, F.lit(GRAM))).alias("widths")).first()  # GRAM widths at most
    if shape["longest"] is None:
        return texts.select(*key, F.lit("").alias("keyword")).where("false")
    widths = sorted(shape["widths"])
    own = F.coalesce(*(F.when(F.least(size, F.lit(GRAM)) == w, grams(F.col("marlwork_word"), w)) for w in widths))
    parts = kept(known.select("marlwork_word", F.explode(F.array_distinct(own)).alias("marlwork_gram")))
    cut = spread(texts.select(*dict.fromkeys([*key, text]))).select(*key, F.explode(pieces(F.lower(F.col(text)), max(PIECE, shape["longest"]), shape["longest"] - 1)).alias("marlwork_piece"))
    every = F.array_distinct(F.concat(*(grams(F.col("marlwork_piece"), w) for w in widths)))
    counted = cut.select(F.explode(every).alias("marlwork_gram")).join(few(parts.select("marlwork_gram").distinct()), "marlwork_gram", "left_semi")
    counts = counted.groupBy("marlwork_gram").agg(F.count("*").alias("n"))
    # A keyword with a gram that no text holds is in no text.
    rated = parts.join(counts, "marlwork_gram", "left").groupBy("marlwork_word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "marlwork_gram")).alias("rarest"))
    sought = few(rated.where("rarest.n > 0").select("marlwork_word", "rarest.marlwork_gram"))
    met = cut.select(*key, "marlwork_piece", F.explode(every).alias("marlwork_gram")).join(sought, "marlwork_gram").where(F.contains("marlwork_piece", "marlwork_word"))
    return met.select(*key, F.col("marlwork_word").alias("keyword")).distinct()


def collected(texts: DataFrame, key: list[str], text: str, keywords: DataFrame, what: list[str]) -> DataFrame:
    """The columns `key` and found: for each key of texts, the distinct values of the columns `what` of the keywords (keyword, what) that its text holds, sorted; empty without a hit."""
    named = keywords.select(F.col("keyword").alias("marlwork_key"), F.struct(*what).alias("marlwork_what"))
    hits = held(texts, key, text, keywords)
    hits = hits.join(few(named), hits["keyword"] == F.col("marlwork_key")).select(*key, "marlwork_what")
    # Keys without hits come in as rows of their own, so that null keys need no join.
    every = hits.unionByName(texts.select(*key), allowMissingColumns=True)
    return every.groupBy(*key).agg(F.array_sort(F.collect_set("marlwork_what")).alias("found"))


def policy_table(spark: SparkSession, policies: dict[str, list[str]] = POLICIES) -> DataFrame:
    """keyword, category, and the places of the category and of the keyword in it."""
    rows = [(word, name, i, j) for i, (name, words) in enumerate(policies.items()) for j, word in enumerate(words)]
    return spark.createDataFrame(rows, "keyword string, category string, category_place int, place int")


def classified(texts: DataFrame, key: list[str], text: str, policies: DataFrame) -> DataFrame:
    """The columns `key`, category (of the first policy with a hit; null without one) and rules, as policy_category() and policy_rules() have them, by a table as policy_table() gives it."""
    found = collected(texts, key, text, policies, ["category_place", "place", "category", "keyword"])
    rule = lambda x: F.concat(F.lit("policy_"), x["category"], F.lit("_"), F.replace(x["keyword"], F.lit(" "), F.lit("_")))
    return found.select(*key, F.get("found", F.lit(0))["category"].alias("category"), F.transform("found", rule).alias("rules"))


def family_table(spark: SparkSession, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """keyword and family, a row for each family of a keyword."""
    return spark.createDataFrame([(word, x) for word, xs in keywords.items() for x in xs], "keyword string, family string")


def families_found(texts: DataFrame, key: list[str], text: str, keywords: DataFrame) -> DataFrame:
    """The columns `key` and families, sorted, of the keywords in the text, as families_of() has them, by a table (keyword, family)."""
    return collected(texts, key, text, keywords, ["family"]).select(*key, F.col("found.family").alias("families"))
