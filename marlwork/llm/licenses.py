"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of all texts are joined, by hash, to their positions in license templates. Matches of one text
and template are counted by diagonal (position in the text less position in the template); neighbouring diagonals are
merged, which bridges small insertions and deletions. A merged span that covers enough of the template is a candidate;
it counts if its words, compared one by one with the template's, are much the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlwork.llm.common import durable, let, lower_ascii, small, text_hash

#: The contract's phrases and labels. Fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: What separates words. Fixed value of the contract.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Notices that are looked for, by label. Common public license notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("gpl", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), BETWEEN, -1), "")


def rolling(words: Column, k: int) -> Column:
    """Hashes of all windows of k words; none for shorter texts."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(F.size(words) >= k, windows).otherwise(F.array().cast("array<bigint>"))


def known_templates(spark: SparkSession) -> DataFrame:
    """label and text of the notices of this library."""
    return spark.createDataFrame(TEMPLATES, "label string, text string")


def coded(words: Column, among: Column) -> Column:
    """Words as a string of one character each, by their first places in `among`; all others are the same character."""
    place = lambda w: F.lpad(F.hex(F.coalesce(F.array_position(among, w), F.lit(0)) + 0x4E00), 4, "0")
    return F.decode(F.unhex(F.array_join(F.transform(words, place), "")), "UTF-16BE")


def base_places(words: Column) -> Column:
    """(start, label) of the contract's phrases, in order of the text."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    empty = F.array().cast("array<struct<start:int,label:string>>")

    def of(phrase: str, label: str) -> Column:
        parts = phrase.split()
        starts = lambda i: F.get(words, i) == parts[0]

        def whole(i: Column) -> Column:
            ok = F.lit(True)
            for j, word in enumerate(parts):
                ok = ok & (F.coalesce(F.get(words, i + j), F.lit("")) == word)
            return ok

        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: starts(i) & whole(i))
        return F.transform(places, lambda i: F.struct(i.cast("int").alias("start"), F.lit(label).alias("label")))

    holds = {p: F.contains(line, F.lit(f" {p} ")) for p in PHRASES}
    found = F.concat(*(F.when(holds[p], of(p, label)).otherwise(empty) for p, label in PHRASES.items()))
    return F.when(F.size(words) > 0, F.array_sort(found)).otherwise(empty)


def verified(docs: DataFrame, spans: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Those of spans (doc_id, text_hash, template, start, end) whose words are at least `least` like the template's.

    The likeness is 1 less the edit distance in words by the longer side's words. Only texts with spans are cut again.
    """
    asked = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("template", "start", "end")).alias("asked"))
    asked = small(asked.select(F.col("doc_id").alias("marlwork_id"), F.col("text_hash").alias("marlwork_hash"), "asked"), weight=F.size("asked"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("marlwork_id")) & (text_hash() == F.col("marlwork_hash"))
    part = lambda w: F.transform("asked", lambda s: F.struct(s.alias("span"), F.slice(w, s["start"] + 1, s["end"] - s["start"]).alias("words")))
    texts = docs.select("doc_id", "text").join(asked, same).select("marlwork_id", "marlwork_hash", let(words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))), part).alias("parts"))
    parts = texts.select(F.col("marlwork_id").alias("doc_id"), F.col("marlwork_hash").alias("text_hash"), F.explode("parts").alias("x")).select("doc_id", "text_hash", "x.span.*", "x.words")
    parts = parts.join(known.select("template", F.col("words").alias("own")), "template")
    likeness = 1 - F.levenshtein(coded(F.col("words"), F.col("own")), coded(F.col("own"), F.col("own"))) / F.greatest(F.size("words"), F.size("own"))
    return parts.where(likeness >= least).select("doc_id", "text_hash", "template", "start", "end").distinct()


def scan(docs: DataFrame, k: int = 4, shift: int = 3, least: float = 0.75, notices: DataFrame | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, base (start, label), found (label, cover, start, end).

    k: words in a gram; shift: most words between neighbouring diagonals that are merged; least: share of a template's
    words that a span has to cover, within at most as many words as the template and as many again as may be left out,
    and how like the template its words have to be; notices: label and text of the templates, those of this library by
    default. start and end count words from 0, end exclusive. Null is an empty text; texts without findings have empty
    arrays. Repeated rows stay repeated, null ids stay null, other columns are ignored.
    """
    known = (known_templates(docs.sparkSession) if notices is None else notices).select("label", words_of(F.col("text")).alias("words"))
    known = small(known.withColumn("template", F.monotonically_increasing_id()), weight=F.size("words"))
    places = known.select("template", "label", F.size("words").alias("size"), F.posexplode(rolling(F.col("words"), k)).alias("tpos", "hash"))
    places = small(places)
    plain = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = plain.select(
        "doc_id", "text_hash", let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), base_places(w).alias("base"), rolling(w, k).alias("grams"))).alias("x")
    )
    rows = rows.select("doc_id", "text_hash", F.monotonically_increasing_id().alias("uid"), "x.*")
    # Every gram of every text meets the templates' grams; a text keeps only what matched, next to its other columns.
    grams = rows.select("doc_id", "text_hash", "uid", "n_words", "base", F.posexplode_outer("grams").alias("pos", "hash"))
    hits = grams.join(places, "hash", "left")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0  # keeps each text once, matched or not
    hits = durable(
        hits.where(first | F.col("template").isNotNull()).select(
            "uid", "doc_id", "text_hash", "n_words", F.when(first, F.col("base")).alias("base"), first.alias("first"), "pos", "template", "label", "size", "tpos"
        )
    )
    key = ["uid", "doc_id", "text_hash", "template", "label", "size"]
    votes = hits.where(F.col("template").isNotNull()).withColumn("diagonal", F.col("pos") - F.col("tpos"))
    by_diagonal = votes.groupBy(*key, "diagonal").agg(F.collect_set("tpos").alias("tposes"), F.min("pos").alias("start"), F.max("pos").alias("end"))
    by_text = Window.partitionBy("uid", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_text) > shift, F.lit(True)).cast("int")
    merged = by_diagonal.withColumn("far", far).withColumn("span", F.sum("far").over(by_text))
    merged = merged.groupBy(*key, "span").agg(
        F.array_distinct(F.flatten(F.collect_list("tposes"))).alias("tposes"), F.min("start").alias("start"), (F.max("end") + k).alias("end")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("tposes", lambda t: F.sequence(t, t + k - 1)))))
    spans = merged.withColumn("cover", covered / F.col("size"))
    spans = durable(spans.where((F.col("cover") >= least) & (F.col("end") - F.col("start") <= F.ceil(F.col("size") * (2 - least)))))
    good = verified(docs, spans, known, least).alias("g")
    alike = F.col("s.doc_id").eqNullSafe(F.col("g.doc_id"))
    for x in ("text_hash", "template", "start", "end"):
        alike = alike & (F.col(f"s.{x}") == F.col(f"g.{x}"))
    spans = spans.alias("s").join(good, alike, "left_semi")
    found = spans.groupBy("uid").agg(F.collect_list(F.struct("label", "cover", "start", "end")).alias("found"))
    texts = hits.where("first").dropDuplicates(["uid"]).select("uid", "doc_id", "n_words", "base")
    none = F.array().cast("array<struct<label:string,cover:double,start:int,end:int>>")
    return texts.join(found, "uid", "left").select("doc_id", "n_words", "base", F.coalesce("found", none).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of what scan() returns."""
    base = F.transform("base", lambda x: x["label"])
    every = F.concat(base, F.transform("found", lambda x: x["label"]))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    starts = F.transform("base", lambda x: x["start"])
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["cover"])), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(every).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
