"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; for each host the distinct documents that hold a line are counted, lines above the
limit are removed, and documents of which too little remains are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlwork.llm.common import WHITE, durable, let, small, text_hash, white_words

#: Characters that count as symbols. Fixed value of the contract.
SYMBOLS = "#*$%&|<>"
#: The contract's base rule: fewest words, and most repeated words in per cent.
LEAST_WORDS, MOST_REPEATED = 20, 30


def words_in_repeats(hashes: Column, width: int = 8) -> Column:
    """Words inside windows of `width` words that stand in the text more than once, the first ones included."""

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(s: Column) -> Column:
            same = lambda x, i, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            again = F.filter(s, lambda x, i: same(x, i, i - 1) | same(x, i, i + 1))
            places = F.array_sort(F.transform(again, lambda x: x["i"]))
            steps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
            return let(places, lambda p: F.aggregate(steps(p), F.lit(0), lambda a, b: a + b))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, of))

    return covered(hashes)


def window_hashes(words: Column, width: int = 8) -> Column:
    """Hashes of the windows of `width` words; one of all words in shorter texts."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) <= width, F.array(F.xxhash64(words))).otherwise(windows)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, name and lines (hash, words) of each row.

    name is the hash of all normalised lines in their order: only copies share it, up to case and white space.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("host"), F.col("text").cast("string"))
    bare = F.translate(text, WHITE, "")
    full_lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, WHITE, "") != "")
    by_words = let(
        white_words(text),
        lambda w: let(window_hashes(w), lambda h: F.struct(F.size(w).cast("long").alias("n_words"), words_in_repeats(h).cast("long").alias("n_repeat_words"))),
    )
    normal = lambda x: F.regexp_replace(F.lower(x), "[\\x20\\x09-\\x0D]+", " ")
    line = lambda x: F.struct(F.xxhash64(F.trim(normal(x))).alias("h"), F.size(white_words(x)).alias("n"))
    by_lines = let(
        full_lines,
        lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.transform(x, line).alias("lines")),
    )
    return plain.select(
        "doc_id",
        text_hash().alias("text_hash"),
        "host",
        by_words.alias("w"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        by_lines.alias("l"),
    ).select("doc_id", "text_hash", "host", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", F.xxhash64("l.lines.h").alias("name"), "l.lines")


def judge(docs: DataFrame, limit: int = 20, share: float = 0.05, left: float = 0.2, enough: int = 200) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, the measures, base_failed, kept, removed_words and text_hash.

    A line of a host is removed if more than `limit` distinct documents of the host, and more than `share` of them or
    more than `enough`, hold it. A document and its copies count as one: what is counted is their names. kept is false if the base rule fails or if less than `left` of the words remain.
    Null is an empty text, which fails; a null source is a host of its own. Repeated rows stay repeated, null ids stay
    null, other columns are ignored, an empty table gives an empty result.
    """
    docs = durable(measures(docs).withColumn("uid", F.monotonically_increasing_id()).withColumn("host", F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))))
    lines = docs.select("uid", "host", "name", F.explode("lines").alias("line"))
    named = lines.select("host", F.col("line.h").alias("h"), "name").distinct()
    counts = named.groupBy("host", "h").agg(F.count("*").alias("holders")).where(F.col("holders") > limit)
    sizes = docs.select("host", "name").distinct().groupBy("host").agg(F.count("*").alias("size"))
    common = counts.join(sizes, "host").where(F.col("holders") > F.least(share * F.col("size"), F.lit(float(enough)))).select(F.col("host").alias("c_host"), F.col("h").alias("c_h"))
    # Common lines are hot keys, so they go to the lines while they are few, as they mostly are.
    common = small(common)
    held = lines.join(common, (F.col("host") == F.col("c_host")) & (F.col("line.h") == F.col("c_h")))
    removed = held.groupBy("uid").agg(F.sum("line.n").alias("removed_words"))
    out = docs.drop("lines", "host", "name").join(removed, "uid", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    remains = F.col("n_words") - F.col("removed_words") >= left * F.col("n_words")
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & remains).alias("kept"),
        "removed_words",
        "text_hash",
    )
