"""Collocations: phrases whose words stand together more often than their parts would by chance.

All n-grams are counted per language, frequent ones become rows, and the rest is joins over these rows: a phrase meets
the counts of its first and last words, is scored in exact decimals, goes if a phrase of one more word stands for it, and
is ranked in its language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlwork.llm import grams
from marlwork.llm.common import LOWER, UPPER, durable, small

KINDS = grams.kinds_of(" \t", ".,;:!?\n\x0b\x0c\r")
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
FOUND = "lang string, phrase string, size int, f long"


class Phrases:
    """The words of a unit's pieces and their n-grams, those of a language apart from those of others."""

    def __init__(self, rows: pa.Table, most: int):
        lead = [x.encode("utf-8", "replace") for x in rows.column("lead").to_pylist()]
        own = [x.encode("utf-8", "replace") for x in rows.column("own").to_pylist()]
        self.langs = rows.column("lang").to_pylist()
        self.words = grams.words_of([a + b" " + b for a, b in zip(lead, own, strict=True)], KINDS)
        w = self.words
        self.own = w.start >= w.begins[w.text] + np.array([len(x) for x in lead], np.int64)[w.text] + 1 if len(w.text) else np.zeros(0, bool)
        self.most, fresh = most, np.ones(len(w.text), bool)
        fresh[1:] = (w.gap[1:] != w.gap[:-1]) | (w.text[1:] != w.text[:-1])
        begins = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0)) if len(fresh) else np.zeros(0, np.int64)
        self.place = (np.arange(len(fresh)) - begins).astype(np.int32)

    def levels(self) -> Iterator[grams.Level]:
        """The n-grams of 0 words, which are the languages, to `most`."""
        names = sorted(set(self.langs))
        codes = np.array([np.frombuffer(hashlib.blake2b(x.encode(), digest_size=16).digest(), np.uint64) for x in names], np.uint64).reshape(-1, 2).T
        seeds = codes[:, np.searchsorted(names, self.langs)[self.words.text]] if len(self.words.text) else np.zeros((2, 0), np.uint64)
        yield grams.level(seeds, np.ones(len(self.place), bool))
        yield from grams.levels(seeds, self.words.hashes, self.place, self.most)

    def rows(self, answers: grams.Answers) -> pa.Table:
        """Rows of FOUND: the n-grams whose count isn't 0."""
        w, lang, phrase, size, f = self.words, [], [], [], []
        folded = w.raw.translate(FOLD)
        for n, level in enumerate(self.levels()):
            counts = answers.of(n, level.hashes)
            for g in np.flatnonzero(counts):
                last = level.first[g]
                lang.append(self.langs[w.text[last]])
                phrase.append(b" ".join(folded[w.start[last - n + 1] : w.end[last]].split()).decode("utf-8", "replace") if n else "")
                size.append(n)
                f.append(int(counts[g]))
        return pa.table({"lang": pa.array(lang, pa.string()), "phrase": pa.array(phrase, pa.string()), "size": pa.array(size, pa.int32()), "f": pa.array(f, pa.int64())})


def counted(docs: DataFrame, most: int = 3, least: int = 10, unit_bytes: int = 4 << 20, longest: int = 1 << 20) -> DataFrame:
    """lang, phrase, size and f of every n-gram of 1 to `most` words that stands at least `least` times in its language.

    A row of size 0 and an empty phrase has the number of a language's words. docs has doc_id, text and lang.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    sizes = grams.sizes_of(own, unit_bytes)
    cut = F.explode(grams.pieces(F.col("text"), "[\\x20\\x09]+", most - 1, longest)).alias("p")
    parts = own.select("doc_id", F.xxhash64("text").alias("text_hash"), "lang", cut).select("doc_id", "text_hash", "lang", "p.*")
    rows = grams.in_units(parts, sizes.units, "doc_id", "text_hash", "piece").select("unit", "lang", "lead", "own")

    def ask(unit: pa.Table) -> pa.Table:
        found = Phrases(unit, most)
        return grams.requests(unit.column("unit")[0].as_py(), ((n, x.hashes, x.counts(found.own)) for n, x in enumerate(found.levels())), sizes.buckets)

    def answer(request: pa.Table) -> pa.Table:
        """The total of a frequent n-gram to one of the units that have it, 0 to the others."""
        columns: dict[str, list] = {x: [] for x in ("unit", "bucket", "size", "counts")}
        for size in sorted(set(request.column("size").to_pylist())):
            units, begins, inverse, _, total = grams.summed(request, size)
            total = np.where(total >= (least if size else 1), total, 0)
            _, first = np.unique(inverse, return_index=True)
            said = np.zeros(len(inverse), np.int64)
            said[first] = total
            for i, unit in enumerate(units):
                for name, value in zip(columns, (unit, request.column("bucket")[0].as_py(), size, grams.packed(said[begins[i] : begins[i + 1]])), strict=True):
                    columns[name].append(value)
        return pa.table({x: pa.array(y, kind) for (x, y), kind in zip(columns.items(), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)})

    def give(unit: pa.Table, answers: pa.Table) -> pa.Table:
        return Phrases(unit, most).rows(grams.Answers(answers, sizes.buckets))

    answers = grams.met(rows, ask, answer, "unit long, bucket long, size int, counts binary")
    return rows.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(give, FOUND)


def mine(docs: DataFrame, most: int = 3, least: int = 10, share: int = 50, top: int = 2000, unit_bytes: int = 4 << 20, longest: int = 1 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the `top` phrases of 2 to `most` words of each language.

    A phrase that stands a times (`least` or more) is cut where floor(1000000 a a / (l r)) is lowest, l and r being how
    often its two parts stand; ties go to the shorter first part. Phrases go whose words lie in a longer one that stands
    at least `share` percent as often: if any does, one of a single word more does. n is the number of the language's
    words. Ties in rank go to the larger a, then to the phrase that comes first by its bytes. A null text is empty, a null
    lang `und`; repeated rows count each; an empty table has no phrases; other columns are ignored.
    """
    found = durable(counted(docs, most, least, unit_bytes, longest))
    words = small(found.where("size = 0").select("lang", F.col("f").alias("n")))
    longer = found.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    parts = found.where(F.col("size").between(1, most - 1))
    side = lambda part, f: parts.select(F.col("lang"), F.col("phrase").alias(part), F.col("f").alias(f))
    w = F.split("phrase", " ", -1)
    cuts = longer.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), w.alias("w"), "size")
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    exact = lambda x: F.col(x).cast("decimal(15,0)")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", (exact("a") * exact("a")).alias("aa"), (exact("l") * exact("r")).alias("lr"))
    cuts = cuts.withColumn("score", F.expr("(aa * cast(1000000 as decimal(7,0))) div lr"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("size") - 1), " ")))
    covers = longer.where("size >= 3").select("lang", inner.alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    covered = (scored["lang"] == covers["lang"]) & (scored["phrase"] == covers["phrase"]) & (100 * covers["f"] >= share * scored["a"])
    left = scored.join(covers, covered, "left_anti")
    # A language's best are among the best of its parts, so that the last ranking reads 64 times `top` rows at most.
    best = (F.desc("cut.score"), F.desc("a"), "phrase")
    inside = Window.partitionBy("lang", "part").orderBy(*best)
    left = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
