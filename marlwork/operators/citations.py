"""Canonical section ids: extraction, families, grounding of texts in sections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlwork.functions.text import holds_any, once, word_f1
from marlwork.operators.governance import canonical

#: A canonical section id in upper-case text, and its number and letters. Fixed values.
CANONICAL = r"\b(EA-\d{4}-\d+[A-Z]*(?:\(\d+\))?)\b"
FAMILY = r"(?i)^EA-\d{4}-(\d+[A-Z]*)"
#: Sections that count as known where a corpus names none. Fixed values.
DEFAULT_SECTIONS = [
    "EA-2022-37", "EA-2022-40", "EA-2022-41", "EA-2022-42",
    "EA-2022-60A", "EA-2022-60B", "EA-2022-60C", "EA-2022-60D",
    "EA-2022-60E", "EA-2022-60F", "EA-2022-60G",
    "EA-2022-60E(1)", "EA-2022-60F(1)", "EA-2022-60G(1)",
    "EA-2022-13", "EA-2022-14", "EA-2022-20",
    "EA-2022-13(1)", "EA-2022-14(1)", "EA-2022-20(1)",
    "EA-2022-69", "EA-2022-69(1)",
]
#: Words that anchor a text in the law. Fixed values.
LEGAL_TERMS = ["employment act", "according to section", "under section", "the law", "provision", "legislation", "malaysia employment act"]
#: Section families by keyword. Fixed values.
KEYWORDS = {
    "annual leave": ["60E", "60F", "60G"],
    "vacation": ["60E", "60F", "60G"],
    "sick leave": ["60F"],
    "medical leave": ["60F"],
    "maternity": ["37", "40", "41", "42"],
    "pregnancy": ["37", "40", "41", "42"],
    "female employee": ["37", "40", "41", "42"],
    "overtime": ["60A", "13"],
    "working hours": ["60A", "13"],
    "hours of work": ["60A", "13"],
    "rest day": ["60C", "60D"],
    "public holiday": ["60C", "60D"],
    "holiday": ["60C", "60D"],
    "termination": ["13", "14", "20"],
    "dismiss": ["13", "14", "20"],
    "dismissal": ["13", "14", "20"],
    "terminate": ["13", "14", "20"],
    "notice": ["13", "14", "20"],
    "complaint": ["69"],
    "file complaint": ["69"],
    "grievance": ["69"],
}


def literal(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def section_universe(chunks: DataFrame) -> DataFrame:
    """section: the distinct canonical ids of chunks (section_id); the default ones where there is none."""
    found = chunks.where("section_id <> 'unknown'").select(canonical(F.col("section_id")).alias("section")).where("section is not null").distinct()
    number = found.agg(F.count("*").alias("n"))  # one row
    default = number.where("n = 0").select(F.explode(literal(DEFAULT_SECTIONS)).alias("section"))
    return found.unionByName(default)


def extracted(text: Column) -> Column:
    """The distinct canonical ids in a text of any case."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(CANONICAL), F.lit(1)))


def family(section: Column) -> Column:
    """Number and letters of a canonical id; null if it isn't one."""
    return F.nullif(F.regexp_extract(section, FAMILY, 1), F.lit(""))


def families(chunks: DataFrame) -> DataFrame:
    """chunks with canonical `section` (the id itself if it has no canonical form) and `family`; rows without an id go."""
    named = chunks.where(F.coalesce(F.col("section_id"), F.lit("")) != "").withColumn("section", F.coalesce(canonical(F.col("section_id")), F.col("section_id")))
    return named.withColumn("family", family(F.col("section")))


def of_family(valid: Column | list[str], wanted: Column) -> Column:
    if isinstance(valid, Column):
        return once(wanted, lambda own: F.filter(valid, lambda s: family(s) == own))
    return once(wanted, lambda own: F.transform(F.filter(with_families(valid), lambda s: s["family"] == own), lambda s: s["section"]))


def families_of(prompt: Column) -> Column:
    """Families of the keywords that a prompt holds, distinct and sorted."""
    low = F.lower(prompt)
    every = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(k)), literal(v)) for k, v in KEYWORDS.items())))
    return F.array_sort(F.array_distinct(F.flatten(every)))


def picked(values: Column, key: Column, what: str) -> Column:
    """One item of an array by the md5 of key and purpose, the stand-in for a random choice; null for an empty array."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(what))), 1, 8), 16, 10).cast("long")
    return F.when(F.size(values) > 0, F.get(values, (number % F.greatest(F.size(values), F.lit(1))).cast("int")))


def with_families(valid: Column | list[str]) -> Column:
    """The sections and their families, sorted by section: a constant for a list, whose families aren't looked for in each row."""
    if isinstance(valid, Column):
        return F.array_sort(F.transform(valid, lambda s: F.struct(s.alias("section"), family(s).alias("family"))))
    own = {s: re.match(FAMILY, s, re.ASCII) for s in valid}
    pairs = [F.struct(F.lit(s).alias("section"), F.lit(own[s] and own[s][1]).cast("string").alias("family")) for s in sorted(valid, key=str.encode)]
    return F.array(*pairs) if pairs else F.array().cast("array<struct<section:string,family:string>>")


def different_section(valid: Column | list[str], section: Column, key: Column) -> Column:
    """A known section other than `section`, of another family if there is one; null if no other is known."""

    def of(others: Column) -> Column:
        far = once(family(section), lambda own: F.when(own.isNotNull(), F.filter(others, lambda s: ~s["family"].eqNullSafe(own))).otherwise(F.slice(others, 1, 0)))
        return once(far, lambda f: picked(F.when(F.size(f) > 0, f).otherwise(others), key, "different"))

    return once(F.filter(with_families(valid), lambda s: s["section"] != section), of)["section"]


def citation_metrics(predicted: Column, gold: Column, valid: Column) -> Column:
    """em (1 if a known gold section is predicted) and iou (0 where neither side has a known section)."""
    known = lambda xs: F.array_intersect(F.array_compact(F.transform(xs, lambda x: canonical(x))), valid)

    def scored(p: Column, g: Column) -> Column:
        common, union = F.size(F.array_intersect(p, g)), F.size(F.array_union(p, g))
        return F.struct((common > 0).cast("double").alias("em"), F.when(union == 0, F.lit(0.0)).otherwise(common / union).alias("iou"))

    return once(known(predicted), lambda p: once(known(gold), lambda g: scored(p, g)))


def groundedness(response: Column, gold: Column, valid: Column) -> Column:
    """citation_em, citation_iou, legal_anchoring, predicted and valid_predicted of a response."""

    def of(found: Column) -> Column:
        metrics = citation_metrics(found, gold, valid)
        anchored = holds_any(F.lower(response), LEGAL_TERMS).cast("double")
        return F.struct(metrics["em"].alias("citation_em"), metrics["iou"].alias("citation_iou"), anchored.alias("legal_anchoring"), found.alias("predicted"), F.array_intersect(found, valid).alias("valid_predicted"))

    return once(extracted(response), of)


def grounding(response: Column, section: Column, valid: Column) -> Column:
    """How a response is grounded in the section that it comes from."""
    gold = F.array(F.coalesce(canonical(section), section))
    return once(
        groundedness(response, gold, valid),
        lambda g: F.struct(
            section.alias("gold_section_id"),
            g["predicted"].alias("predicted_section_ids"),
            (g["citation_em"] > 0).alias("correctly_grounded"),
            (F.size(g["valid_predicted"]) > 0).alias("valid_sections_mentioned"),
            g["citation_iou"].alias("grounding_score"),
            g["citation_em"].alias("citation_em"),
            g["citation_iou"].alias("citation_iou"),
        ),
    )


def enhanced_similarity(response: Column, target: Column, gold: Column, valid: Column) -> Column:
    """Half the exact match of citations, three tenths of their overlap and two of the words' F1."""
    return once(groundedness(response, gold, valid), lambda g: similarity_of(g, response, target))


def similarity_of(grounded: Column, response: Column, target: Column) -> Column:
    """enhanced_similarity() of a response whose groundedness() is known, as for several targets."""
    return 0.5 * grounded["citation_em"] + 0.3 * grounded["citation_iou"] + 0.2 * word_f1(response, target)
