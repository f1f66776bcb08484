"""Screening of inputs and outputs: policies, personal data, citations, numbers, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlwork.functions.text import first_group, hits, holds_any, matches, once, stripped

#: Keywords by policy, in the order of precedence; they also count inside words. Fixed values.
POLICIES = {
    "legal_advice": ["give me legal advice", "give legal advice", "provide legal advice", "legal counsel", "sue", "lawsuit", "court case", "litigation", "attorney", "lawyer recommendation", "legal representation", "hire a lawyer", "should i hire", "fight my case"],
    "guarantees": ["guarantee", "promise", "ensure", "definitely will", "absolutely", "certainly will happen", "guaranteed outcome"],
    "out_of_scope": ["criminal law", "family law", "property law", "contract law", "immigration law", "tax law", "company registration", "business license", "visa", "passport"],
    "financial_advice": ["invest", "investment advice", "stock market", "trading", "financial planning", "insurance policy", "loan advice"],
}
#: What a refusal says, by policy. Fixed values.
POLICY_TEMPLATES = {
    "legal_advice": "I understand you're asking about legal advice, but I can only provide \ngeneral information about Malaysia's Employment Act provisions. \nFor specific legal advice, please consult with a qualified legal professional.\n",
    "guarantees": "I understand you're asking about guarantees, but I can only provide \ngeneral information about Malaysia's Employment Act provisions. \nOutcomes depend on specific circumstances and current law.\n",
    "out_of_scope": "I understand you're asking about {topic}, but I can only provide \ninformation about Malaysia's Employment Act provisions. \nFor other legal matters, please consult with relevant authorities.\n",
    "financial_advice": "I can only provide information about employment compensation under \nMalaysia's Employment Act. For financial advice, please consult \nwith qualified financial advisors.\n",
}
#: What a refusal says where its policy has no template, and where personal data is refused. Fixed values.
DEFAULT_TEMPLATE = "I can only provide general information about Malaysia's Employment Act provisions. For specific legal matters, please consult with qualified professionals."
PII_REFUSAL = "I notice your message contains personal information. For your privacy and security, \nplease avoid sharing personal details like phone numbers, email addresses, or ID numbers. \nI can help with general Employment Act questions without needing personal information.\n"
#: The older, shorter lists: policies with their templates, kinds of personal data, its refusal. Fixed values.
LEGACY_POLICIES = {
    "legal_advice": ["give me legal advice", "give legal advice", "provide legal advice", "legal counsel", "sue", "lawsuit", "court case", "litigation", "attorney", "lawyer recommendation", "legal representation", "hire a lawyer", "should i hire", "fight my case"],
    "guarantees": ["guarantee", "promise", "ensure", "definitely will", "absolutely"],
    "out_of_scope": ["criminal law", "family law", "property law", "visa", "passport", "company registration"],
}
LEGACY_TEMPLATES = {
    "legal_advice": "I understand you're asking about legal advice, but I can only provide general information about Malaysia's Employment Act provisions.",
    "guarantees": "I understand you're asking about guarantees, but I can only provide general information about Malaysia's Employment Act provisions.",
    "out_of_scope": "I understand you're asking about this matter, but I can only provide general information about Malaysia's Employment Act provisions.",
}
LEGACY_REFUSAL = "I notice your message contains personal information. For your privacy and security, please avoid sharing personal details. I can help with general Employment Act questions."
#: Personal data: name, pattern, what replaces it, in order. Fixed values.
PII = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    ("phone_malaysia", r"\b(?:\+?60|0)(?:1[0-46-9]|[3-9])\d{7,8}\b|(?:01[0-9])[- ]?\d{3,4}[- ]?\d{4}\b", "[PHONE_REDACTED]"),
    ("ic_number", r"\b\d{6}-\d{2}-\d{4}\b", "[IC_NUMBER_REDACTED]"),
    ("nric", r"\b[STFG]\d{7}[A-Z]\b", "[NRIC_REDACTED]"),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CARD_NUMBER_REDACTED]"),
    ("passport", r"\b[A-Z]\d{8}\b", "[PASSPORT_REDACTED]"),
]
#: Patterns of section citations, in order. Fixed values.
CITATIONS = [r"Section EA-(\d+[A-Z]*)", r"Employment Act Section (\d+[A-Z]*)", r"Section (\d+[A-Z]*)", r"EA-(\d+[A-Z]*)"]
#: Words of a query that call for the large model. Fixed values.
ESCALATION = ["review", "escalate", "complex", "detailed analysis", "legal opinion", "comprehensive", "thorough review", "expert analysis", "detailed explanation"]
#: Bounds of numeric claims: category, least, most, unit. Fixed values.
BOUNDS = [
    ("annual_leave", 8, 60, "day"),
    ("sick_leave", 14, 365, "day"),
    ("maternity_leave", 60, 98, "day"),
    ("notice_period", 1, 16, "week"),
    ("notice_days", 7, 112, "day"),
    ("daily_hours", 1, 12, "hour"),
    ("weekly_hours", 1, 72, "hour"),
    ("overtime_rate", 1, 3, "multiplier"),
    ("service_years", 0, 60, "year"),
    ("severance_multiplier", 10, 30, "day"),
]
#: Words around a number that tell its category, in the order of precedence. Fixed values.
CATEGORY_WORDS = [
    ("annual_leave", ["annual", "vacation"]),
    ("sick_leave", ["sick", "medical"]),
    ("maternity_leave", ["maternity", "pregnancy"]),
    ("notice_period", ["notice", "resignation", "termination"]),
    ("overtime_rate", ["overtime", "extra"]),
    ("service_years", ["service", "employment", "work"]),
    ("daily_hours", ["hour", "daily", "per day"]),
    ("weekly_hours", ["week", "weekly"]),
    ("severance_multiplier", ["severance", "retrenchment"]),
]
#: A number with a unit, and the longer forms of claims, all in lower-case text. Fixed values.
NUMBER = r"(\d+(?:\.\d+)?)\s+(day|week|month|year|hour)s?"
CLAIMS = [
    r"(\d+)\s+(day)s?\s+(?:of\s+)?(?:annual\s+leave|sick\s+leave|maternity\s+leave|leave)",
    r"(\d+)\s+(week)s?\s+(?:of\s+)?notice",
    r"(\d+)\s+(hour)s?\s+per\s+(?:day|week)",
    r"(\d+)\s+(year)s?\s+(?:of\s+)?service",
    NUMBER,
]
#: Characters on each side of a number that tell its category. Fixed value.
AROUND = 50
#: Days in a unit. Fixed values.
DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
#: Phrases that call for the large model. Fixed values.
COMPLEX = ["interpretation", "cross-reference", "exception", "provision", "notwithstanding", "subject to", "in accordance with", "comparative analysis", "precedent", "jurisprudence"]
SAFETY_FLAGS = ["legal_advice", "guarantees", "inappropriate_advice", "escalation_required"]


def policy_rules(text: Column, policies: dict[str, list[str]] = POLICIES) -> Column:
    """policy_category_keyword for each keyword that the text holds."""
    low = F.lower(text)

    def named(name: str, words: list[str]) -> Column:
        return F.transform(hits(low, words), lambda x: F.concat(F.lit(f"policy_{name}_"), F.replace(x, F.lit(" "), F.lit("_"))))

    return F.concat(*(named(name, words) for name, words in policies.items()))


def policy_category(text: Column, policies: dict[str, list[str]] = POLICIES) -> Column:
    """The first policy with a hit; null without one."""
    low = F.lower(text)
    return F.coalesce(*(F.when(holds_any(low, words), F.lit(name)) for name, words in policies.items()))


def policy_message(category: Column, templates: dict[str, str] = POLICY_TEMPLATES) -> Column:
    """What the refusal of a policy says; null without a policy."""
    return F.coalesce(*(F.when(category == k, F.lit(v)) for k, v in templates.items()), F.when(category.isNotNull(), F.lit(DEFAULT_TEMPLATE)))


def pii_free(text: Column) -> Column:
    """Whether a text can hold no personal data: each kind needs a digit or an @."""
    return ~text.rlike("[0-9@]")


def pii_kinds(text: Column, pii: list[tuple[str, str, str]] = PII) -> Column:
    """The kinds of personal data in a text."""
    none = F.array().cast("array<string>")
    return F.when(pii_free(text), none).otherwise(F.array_compact(F.array(*(F.when(guarded(text, name) & text.rlike(p), F.lit(name)) for name, p, _ in pii))))


def guarded(text: Column, name: str) -> Column:
    """Whether a kind is worth looking for: addresses need an @."""
    return F.contains(text, F.lit("@")) if name == "email" else F.lit(True)


def pii_masked(text: Column, pii: list[tuple[str, str, str]] = PII) -> Column:
    """`text` with personal data replaced, one kind after the other; texts that can hold none stay as they are."""
    out = text
    for name, pattern, mark in pii:
        replaced = F.regexp_replace(out, pattern, mark)
        out = F.when(guarded(out, name), replaced).otherwise(out) if name == "email" else replaced
    return F.when(pii_free(text), text).otherwise(out)


def input_report(text: Column, mode: str = "mask", policies=POLICIES, templates=POLICY_TEMPLATES, pii=PII, pii_refusal: str = PII_REFUSAL) -> Column:
    """flags, rules, decision, confidence and processed text of an input.

    A policy hit refuses it with the template of its first policy; personal data is masked, or refused (mode refuse).
    """
    how = "refused" if mode == "refuse" else "masked"
    policy, kinds = policy_category(text, policies), pii_kinds(text, pii)
    kinds = F.slice(kinds, 1, 1) if mode == "refuse" else kinds  # refusal stops at the first kind
    personal = F.size(kinds) > 0
    refused = policy.isNotNull() | (personal if mode == "refuse" else F.lit(False))
    flags = F.array_compact(F.array(F.when(policy.isNotNull(), F.lit("policy_violation")), F.when(personal, F.lit("pii_refusal" if mode == "refuse" else "pii_masked"))))
    left = F.when(personal, F.lit(pii_refusal)).otherwise(text) if mode == "refuse" else pii_masked(text, pii)
    return F.struct(
        flags.alias("flags"),
        F.concat(policy_rules(text, policies), F.transform(kinds, lambda k: F.concat(F.lit("pii_"), k, F.lit(f"_{how}")))).alias("rules"),
        F.when(refused, F.lit("refused")).otherwise(F.lit("allowed")).alias("decision"),
        F.when(refused, F.lit(0.9)).otherwise(F.lit(1.0)).alias("confidence"),
        F.coalesce(policy_message(policy, templates), left).alias("processed"),
    )


def legacy_input(text: Column, mode: str = "mask") -> Column:
    """passed, processed, confidence and rules of an input by the older lists: policies first, then personal data."""
    policy, kinds = policy_category(text, LEGACY_POLICIES), pii_kinds(text, PII[:3])
    kinds = F.slice(kinds, 1, 1) if mode == "refuse" else kinds
    names = F.transform(kinds, lambda k: F.when(k == "phone_malaysia", F.lit("phone_my")).otherwise(k))
    rules = F.transform(names, lambda k: F.concat(F.lit("pii_"), k, F.lit("_refused" if mode == "refuse" else "_masked")))
    personal = F.size(kinds) > 0
    stopped = personal if mode == "refuse" else F.lit(False)
    return F.struct(
        (policy.isNull() & ~stopped).alias("passed"),
        F.coalesce(policy_message(policy, LEGACY_TEMPLATES), F.when(stopped, F.lit(LEGACY_REFUSAL)).otherwise(pii_masked(text, PII[:3]))).alias("processed"),
        F.when(policy.isNotNull(), F.lit(0.9)).when(stopped, F.lit(0.95)).when(personal, F.lit(0.9)).otherwise(F.lit(1.0)).alias("confidence"),
        F.when(policy.isNotNull(), policy_rules(text, LEGACY_POLICIES)).otherwise(rules).alias("rules"),
    )


def guardrail_stats(reports: DataFrame) -> DataFrame:
    """One row about reports (policy, personal and refused as flags): counts and rates; personal data counts where no policy refused."""
    count = lambda ok: F.coalesce(F.sum(F.when(ok, 1).otherwise(0)), F.lit(0))
    own = F.col("personal") & ~F.col("policy")
    out = reports.agg(F.count("*").alias("total_processed"), count(F.col("policy")).alias("policy_violations"), count(own).alias("pii_detections"), count(F.col("refused")).alias("refusals"), count(own & ~F.col("refused")).alias("maskings"))
    rate = lambda x: F.coalesce(F.try_divide(F.col(x), F.col("total_processed")), F.lit(0.0))
    return out.select("*", rate("refusals").alias("refusal_rate"), rate("pii_detections").alias("pii_detection_rate"))


def answer_problems(body: Column) -> Column:
    """What is wrong with an answer's JSON text: its object, answer, citations, confidence or escalation."""
    found = F.from_json(json_object(body), "answer string, citations array<struct<section_id:string,snippet:string>>, confidence string, should_escalate boolean")
    size = F.size(found["citations"])
    return F.array_compact(
        F.array(
            F.when(json_object(body).isNull(), F.lit("no_object")),
            F.when(F.coalesce(F.length(found["answer"]), F.lit(0)) == 0, F.lit("answer")),
            F.when(~F.coalesce(size.between(1, 5), F.lit(False)), F.lit("citations")),
            F.when(~F.coalesce(found["confidence"].isin("high", "medium", "low"), F.lit(False)), F.lit("confidence")),
            F.when(found["should_escalate"].isNull(), F.lit("should_escalate")),
        )
    )


def citations(text: Column) -> Column:
    """Cited sections as EA-..., each once, in the order of the patterns."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)) for p in CITATIONS))
    return F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("EA-"), x)))


def split_citations(text: Column, known: Column) -> tuple[Column, Column]:
    """The text's citations that are known, and those that aren't."""
    found = citations(text)
    return F.array_intersect(found, known), F.array_except(found, known)


def canonical(section: Column, year: str = "2022") -> Column:
    """A section id as EA-year-number; null if it is of neither form."""
    whole = F.upper(stripped(section))
    full = F.regexp_extract(whole, r"^(EA-\d{4}-\d+[A-Z]*(?:\(\d+\))?)\b", 1)
    old = r"^EA-(\d+)([A-Z]*)(?:\((\d+)\))?$"
    number, letters, part = (F.regexp_extract(whole, old, i) for i in (1, 2, 3))
    made = F.concat(F.lit(f"EA-{year}-"), number, letters, F.when(part != "", F.concat(F.lit("("), part, F.lit(")"))).otherwise(F.lit("")))
    return F.when(full != "", full).when(number != "", made)


def category(context: Column) -> Column:
    """What a number means, from the lower-case text around it."""
    return F.coalesce(*(F.when(holds_any(context, words), F.lit(name)) for name, words in CATEGORY_WORDS), F.lit("general"))


def within_bounds(name: Column, number: Column, unit: Column, bounds: list[tuple[str, float, float, str]] = BOUNDS) -> Column:
    """Whether a number is inside its category's bounds; null where there are none or the unit can't be converted."""
    out = F.lit(None).cast("boolean")
    for wanted, least, most, own in bounds:
        same = F.when(unit == own, number)
        if own in DAYS:
            per = F.coalesce(*(F.when(unit == u, F.lit(float(d))) for u, d in DAYS.items()))
            same = F.coalesce(same, number * per / DAYS[own])
        out = F.when(name == wanted, same.between(least, most)).otherwise(out)
    return out


def numeric_claim(text: Column, bounds: list[tuple[str, float, float, str]] = BOUNDS) -> Column:
    """Number, unit, category and verdict of the first number with a unit in a text; number, unit and verdict are null without one."""
    none = F.struct(F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("unit"), category(F.lower(text)).alias("category"), F.lit(None).cast("boolean").alias("ok"))
    return F.coalesce(F.get(numeric_claims(text, [NUMBER], bounds), F.lit(0)), none)


def numeric_claims(text: Column, rules: list[str] = CLAIMS, bounds: list[tuple[str, float, float, str]] = BOUNDS) -> Column:
    """Number, unit, category and verdict of every match of the rules in a text, rule by rule; a number may match several.

    The category comes from the match and the AROUND characters on each side of it.
    """

    def judged(low: Column, m: Column, rule: str) -> Column:
        start = F.greatest(m["start"] - AROUND, F.lit(0))
        around = F.substring(low, start + 1, m["end"] + AROUND - start)
        number = F.regexp_extract(m["match"], rule, 1).try_cast("double")
        claim = F.struct(number.alias("number"), F.regexp_extract(m["match"], rule, 2).alias("unit"), once(around, category).alias("category"))
        return once(claim, lambda c: F.struct(c["number"], c["unit"], c["category"], within_bounds(c["category"], c["number"], c["unit"], bounds).alias("ok")))

    of = lambda low, rule: F.transform(matches(low, rule), lambda m: judged(low, m, rule))
    return once(F.lower(text), lambda low: F.concat(*(of(low, rule) for rule in rules)))


def json_object(text: Column) -> Column:
    """From the first { to the last }; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


#: What an answer's confidence is multiplied by for each of its flags. Fixed values.
PENALTIES = {"insufficient_context": 0.6, "complex_legal": 0.7}


def confidence(scores: Column, any_section: Column, escalates: Column | None = None, flags: Column | None = None) -> Column:
    """Of an answer, from the scores of its chunks, best first; less if it escalates or has flags of PENALTIES (no escalation, no flags if left out)."""
    good = F.least(F.size(F.filter(scores, lambda x: x > 0.5)) / 5, F.lit(0.2))
    value = F.get(scores, F.lit(0)) + good + F.when(any_section, F.lit(0.1)).otherwise(F.lit(0.0))
    value = F.least(value, F.lit(0.95))
    if escalates is not None:
        value = value * F.when(escalates, F.lit(0.8)).otherwise(F.lit(1.0))
    for flag, factor in PENALTIES.items() if flags is not None else ():
        value = value * F.when(F.array_contains(flags, flag), F.lit(factor)).otherwise(F.lit(1.0))
    return F.when(F.size(scores) == 0, F.lit(0.1)).otherwise(F.greatest(F.lit(0.1), value))


#: Signals of routing and what a model has to reach, large and small. Fixed values.
LEAST_SCORE, MANY_SECTIONS, THRESHOLDS = 0.25, 3, (0.8, 0.7)


def routing(query: Column, scores: Column, sections: Column, flags: Column, asked: Column) -> Column:
    """tier, threshold, signals and reasoning of a query with the scores and sections of its hits.

    `asked` tells whether the user asks for a review; null or empty sections don't count, nor do repeated ones.
    """
    low = F.lower(query)
    best = F.coalesce(F.array_max(scores), F.lit(0.0))
    n = F.size(F.array_distinct(F.filter(sections, lambda s: F.coalesce(s, F.lit("")) != "")))
    safety = F.filter(flags, lambda x: x.isin(SAFETY_FLAGS))
    words, legal = hits(low, ESCALATION), hits(low, COMPLEX)
    said = lambda before, xs: F.concat(F.lit(before), F.array_join(xs, ", "))
    rules = [
        (F.coalesce(asked, F.lit(False)), "explicit_user_request", F.lit("User explicitly requested review/escalation")),
        (F.size(words) > 0, "escalation_keywords", said("Query contains escalation keywords: ", words)),
        (best < LEAST_SCORE, "low_retrieval_confidence", F.concat(F.lit("Low retrieval confidence: top_score="), F.format_string("%.3f", best), F.lit(f" < {LEAST_SCORE}"))),
        (n >= MANY_SECTIONS, "multi_section_synthesis", F.concat(F.lit("Multi-section synthesis required: "), n.cast("string"), F.lit(f" sections >= {MANY_SECTIONS}"))),
        (F.size(safety) > 0, "safety_policy_hits", said("Safety/policy flags triggered: ", safety)),
        (F.size(legal) > 0, "complex_legal_language", said("Complex legal language detected: ", legal)),
    ]
    signals = F.array_compact(F.array(*(F.when(ok, F.lit(name)) for ok, name, _ in rules)))
    reasons = F.array_compact(F.array(*(F.when(ok, why) for ok, _, why in rules)))

    def decided(x: Column) -> Column:
        large = F.size(x) > 0
        first = F.when(large, F.lit("ESCALATED to large model")).otherwise(F.lit("Using default small model"))
        return F.struct(
            F.when(large, F.lit("large")).otherwise(F.lit("small")).alias("tier"),
            F.when(large, F.lit(THRESHOLDS[0])).otherwise(F.lit(THRESHOLDS[1])).alias("threshold"),
            x.alias("signals"),
            F.concat(F.array(first), reasons).alias("reasoning"),
        )

    return once(signals, decided)


def first_citation(text: Column) -> Column:
    return first_group(text, CITATIONS, "(?i)")
