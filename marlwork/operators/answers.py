"""Checks, flags and repair of generated answers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlwork.functions.text import holds_any, once, stripped
from marlwork.operators import governance

#: Patterns of invented facts and of advice that isn't due, in lower-case text. Fixed values.
HALLUCINATIONS = ["section ea-999", "section ea-0", "triple compensation", "365 days leave", "unlimited overtime", "section ea-[a-z]+\\d{3,}"]
ADVICE = ["you should sue", "definitely file a lawsuit", "guaranteed to win", "i promise", "i guarantee", "this will definitely"]
#: Words of a query that mark a complex case. Fixed values.
COMPLEX_CASE = ["lawsuit", "legal action", "court", "damages", "compensation claim"]
#: Messages of refusal: for a policy, for personal data, for a complex case, else. Fixed values.
REFUSALS = {
    "policy_violation": "I can only provide general information about Malaysia's Employment Act provisions. For specific legal advice, please consult with a qualified legal professional.",
    "privacy_concern": "I notice your message contains personal information. For your privacy and security, please avoid sharing personal details. I can help with general Employment Act questions.",
    "complex_legal": "This appears to be a complex legal matter. While I can provide general information about Employment Act provisions, I recommend consulting with a qualified legal professional for specific guidance on your situation.",
    "other": "I cannot provide guidance on this matter. Please consult with a qualified legal professional or relevant authority.",
}
#: What repair puts where something is missing. Fixed values.
NO_ANSWER, NO_SECTION = "Based on the Employment Act provisions, further clarification is needed.", "EA-General"
NO_SNIPPET, NO_CONTEXT = "Employment Act provision applies.", "Employment Act 1955 provisions apply."
ANSWER = "answer string, citations array<struct<section_id:string,snippet:string>>, confidence string, should_escalate boolean"


#: What is sent instead of an answer that fails. Fixed value.
FILTERED = "I apologize, but I cannot provide that response. Please ask about specific Employment Act provisions and I'll help with accurate information."
#: Older patterns of invented facts, in lower-case text. Fixed values.
LEGACY_HALLUCINATIONS = ["section ea-999", "triple compensation", "365 days leave", "section ea-0", "unlimited overtime"]
#: Which flags escalate, and as what. Fixed values.
ESCALATES = {"invalid_citations": "invalid_citations", "numeric_out_of_bounds": "numeric_bounds"}


@dataclass(frozen=True)
class Checks:
    """What answers are checked for: whether their citations are known, bounds of numbers, patterns of inventions and of advice."""

    citations: bool = True
    bounds: list[tuple[str, float, float, str]] = field(default_factory=lambda: governance.BOUNDS)
    hallucinations: list[str] = field(default_factory=lambda: HALLUCINATIONS)
    advice: list[str] = field(default_factory=lambda: ADVICE)


def output_report(text: Column, known: Column, checks: Checks | None = None, pii: list[tuple[str, str, str]] | None = None) -> Column:
    """flags, decision, confidence, escalation reasons, rules and the text to send of an answer.

    Unknown citations and numbers out of bounds escalate, other flags refuse; an answer with a flag is replaced. The
    library's own checks and patterns of personal data are used where none are given.
    """
    checks = checks or Checks()
    low = F.lower(text)
    none = F.array().cast("array<string>")
    unknown = F.array_except(governance.citations(text), known) if checks.citations else none
    outside = F.transform(F.filter(governance.numeric_claims(text, bounds=checks.bounds), lambda c: ~F.coalesce(c["ok"], F.lit(True))), lambda c: c["category"])
    first = lambda patterns: F.coalesce(*(F.when(low.rlike(p), F.lit(p[:20])) for p in patterns), F.lit(None).cast("string"))
    parts = F.struct(
        F.coalesce(unknown, none).alias("unknown"), F.coalesce(outside, none).alias("outside"), first(checks.hallucinations).alias("invented"), first(checks.advice).alias("advice"), F.coalesce(governance.pii_kinds(text, *([pii] if pii is not None else [])), none).alias("personal")
    )

    def judged(x: Column) -> Column:
        found = {
            "invalid_citations": F.size(x["unknown"]) > 0,
            "numeric_out_of_bounds": F.size(x["outside"]) > 0,
            "hallucination_pattern": x["invented"].isNotNull(),
            "inappropriate_advice": x["advice"].isNotNull(),
            "output_pii_detected": F.size(x["personal"]) > 0,
        }
        flags = F.array_compact(F.array(*(F.when(ok, F.lit(name)) for name, ok in found.items())))
        reasons = F.array_compact(F.array(*(F.when(found[name], F.lit(why)) for name, why in ESCALATES.items())))
        named = lambda xs, before: F.transform(xs, lambda v: F.concat(F.lit(before), v))
        one = lambda v, before: F.when(v.isNull(), none).otherwise(F.array(F.concat(F.lit(before), v)))
        rules = F.concat(named(x["unknown"], "citation_invalid_"), named(x["outside"], "numeric_invalid_"), one(x["invented"], "hallucination_"), one(x["advice"], "inappropriate_"), named(x["personal"], "output_pii_"))
        bad = F.size(flags) > 0
        return F.struct(
            flags.alias("flags"),
            F.when(F.size(reasons) > 0, F.lit("escalated")).when(bad, F.lit("refused")).otherwise(F.lit("allowed")).alias("decision"),
            F.when(bad, F.lit(0.8)).otherwise(F.lit(1.0)).alias("confidence"),
            reasons.alias("escalation_reasons"),
            rules.alias("rules"),
            F.when(bad, F.lit(FILTERED)).otherwise(text).alias("processed"),
        )

    return once(parts, judged)


def legacy_output(text: Column) -> Column:
    """passed, processed, confidence and rules of an answer by the older lists; personal data fails it, masked or not."""
    low = F.lower(text)
    rules = F.array_compact(F.array(F.when(holds_any(low, LEGACY_HALLUCINATIONS), F.lit("output_hallucination")), F.when(holds_any(low, ADVICE), F.lit("output_inappropriate_advice"))))
    kinds = F.transform(governance.pii_kinds(text, governance.PII[:3]), lambda k: F.concat(F.lit("pii_"), F.when(k == "phone_malaysia", F.lit("phone_my")).otherwise(k), F.lit("_masked")))
    return once(
        F.concat(rules, kinds),
        lambda r: F.struct((F.size(r) == 0).alias("passed"), F.when(F.size(r) == 0, text).otherwise(F.lit(FILTERED)).alias("processed"), F.when(F.size(r) == 0, F.lit(1.0)).otherwise(F.lit(0.8)).alias("confidence"), r.alias("rules")),
    )


def query_flags(query: Column, n_chunks: Column, mode: str = "mask", *lists) -> Column:
    """flags and refusal (a key of REFUSALS, or null) of a query that found `n_chunks` chunks. `lists`: policies, templates and patterns, as input_report() takes them."""
    report = governance.input_report(query, mode, *lists)
    more = (
        F.when(F.size(governance.pii_kinds(query, *lists[2:3])) > 0, F.lit("pii_detected")),
        F.when(n_chunks == 0, F.lit("insufficient_context")).when(n_chunks < 2, F.lit("limited_context")),
        F.when(holds_any(F.lower(query), COMPLEX_CASE), F.lit("complex_legal")),
    )
    refused = report["decision"] == "refused"
    why = F.when(F.array_contains(report["flags"], "policy_violation"), F.lit("policy_violation")).otherwise(F.lit("privacy_concern"))
    return F.struct(F.concat(report["flags"], F.array_compact(F.array(*more))).alias("flags"), F.when(refused, why).alias("refusal"))


def refusal_message(refusal: Column, flags: Column) -> Column:
    """The message for a refusal; by the flags where its reason is null."""
    key = F.coalesce(refusal, F.when(F.array_contains(flags, "complex_legal"), F.lit("complex_legal")), F.lit("other"))
    return F.coalesce(*(F.when(key == k, F.lit(text)) for k, text in REFUSALS.items()))


def shortened(text: Column, most: int, kept: int) -> Column:
    """`text`; its first `kept` characters and an ellipsis if it has more than `most`."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, kept), F.lit("..."))).otherwise(text)


def repaired(body: Column, context: Column) -> Column:
    """An answer's JSON text as a struct that breaks no rule; null if there is no JSON object.

    `context` is an array of (section_id, text), best first. Missing citations are taken from its first three chunks;
    a missing snippet from the first chunk of its section; what else is missing gets a careful value.
    """
    named = lambda section, snippet: F.struct(section.alias("section_id"), snippet.alias("snippet"))
    usable = F.filter(F.slice(context, 1, 3), lambda c: (F.coalesce(c["section_id"], F.lit("")) != "") & (F.coalesce(c["text"], F.lit("")) != ""))
    filled = F.transform(usable, lambda c: named(c["section_id"], shortened(c["text"], 150, 150)))
    filled = F.when(F.size(filled) > 0, filled).otherwise(F.array(named(F.lit(NO_SECTION), F.lit(NO_CONTEXT))))

    def mended(c: Column) -> Column:
        section = F.coalesce(F.nullif(c["section_id"], F.lit("")), F.lit(NO_SECTION))
        near = F.get(F.filter(context, lambda x: x["section_id"] == section), F.lit(0))["text"]
        quoted = F.concat(F.substring(near, 1, 150), F.lit("..."))
        return named(section, shortened(F.coalesce(F.nullif(c["snippet"], F.lit("")), quoted, F.lit(NO_SNIPPET)), 200, 197))

    def of(found: Column) -> Column:
        own = F.transform(F.filter(found["citations"], lambda c: c.isNotNull()), mended)
        return F.struct(
            F.coalesce(F.nullif(found["answer"], F.lit("")), F.lit(NO_ANSWER)).alias("answer"),
            once(own, lambda some: F.when(F.size(some) > 0, some).otherwise(filled)).alias("citations"),
            F.when(found["confidence"].isin("high", "medium", "low"), found["confidence"]).otherwise(F.lit("low")).alias("confidence"),
            F.coalesce(found["should_escalate"], F.lit(True)).alias("should_escalate"),
        )

    return once(governance.json_object(body), lambda text: F.when(text.isNotNull(), once(F.from_json(text, ANSWER), of)))


def usable_section(section: Column) -> Column:
    """Whether a context chunk names a section."""
    return (F.coalesce(section, F.lit("")) != "") & (section != "N/A")


def sections_of(context: Column) -> Column:
    """The sections that the chunks of a context (section_id, text) name, each once, in order of appearance."""
    return F.array_distinct(F.transform(F.filter(context, lambda c: usable_section(c["section_id"])), lambda c: c["section_id"]))


def backfilled(body: Column, context: Column, most: int = 3) -> Column:
    """A plain answer's JSON text as a struct; one without citations takes those of its first `most` chunks that name a section.

    Such an answer has 0.2 less confidence, 0.1 at least, and the flag citations_backfilled. Null if the text isn't a JSON object.
    """
    found = F.from_json(body, "answer string, citations array<struct<section_id:string,snippet:string>>, confidence double, should_escalate boolean, safety_flags array<string>")
    some = F.filter(F.slice(context, 1, most), lambda c: usable_section(c["section_id"]))
    made = F.transform(some, lambda c: F.struct(c["section_id"].alias("section_id"), shortened(F.coalesce(c["text"], F.lit("")), 150, 150).alias("snippet")))
    bare = F.coalesce(F.size(found["citations"]) <= 0, F.lit(True))
    filled = bare & (F.size(made) > 0)
    flags = F.coalesce(found["safety_flags"], F.array().cast("array<string>"))
    mark = F.array(F.lit("citations_backfilled"))
    out = F.struct(
        found["answer"].alias("answer"),
        F.when(bare, made).otherwise(found["citations"]).alias("citations"),
        F.when(filled, F.greatest(F.lit(0.1), found["confidence"] - 0.2)).otherwise(found["confidence"]).alias("confidence"),
        found["should_escalate"].alias("should_escalate"),
        F.when(filled, F.array_union(flags, mark)).otherwise(flags).alias("safety_flags"),
    )
    return F.when(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), out)


def against_context(cited: Column, context: Column) -> Column:
    """valid, invalid and accuracy (0 without citations) of an answer's citations (section_id, snippet)."""
    known = sections_of(context)
    good = F.filter(cited, lambda c: F.coalesce(F.array_contains(known, c["section_id"]), F.lit(False)))
    bad = F.filter(cited, lambda c: ~F.coalesce(F.array_contains(known, c["section_id"]), F.lit(False)))
    return F.struct(good.alias("valid"), bad.alias("invalid"), F.when(F.size(cited) > 0, F.size(good) / F.greatest(F.size(cited), F.lit(1))).otherwise(F.lit(0.0)).alias("accuracy"))


def displayed(section: Column, snippet: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(section, F.lit("Unknown")), F.lit("] "), shortened(F.coalesce(snippet, F.lit("")), 100, 97))


def plain_body(text: Column) -> Column:
    """The text from its first { on."""
    bare = stripped(text)
    at = F.instr(bare, "{")
    return F.when(at > 0, F.substring(bare, at, F.length(bare))).otherwise(bare)


def plain_format(text: Column) -> Column:
    """Whether a text is JSON with answer (text), citations (of section_id and snippet), confidence (0 to 1) and should_escalate (boolean)."""
    whole = F.try_parse_json(text)
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(whole, f"$.{name}", "variant")), F.lit(""))
    cited = F.try_variant_get(whole, "$.citations", "array<variant>")
    named = lambda c: F.schema_of_variant(c).rlike(r"^OBJECT<(.*, )?section_id: ") & F.schema_of_variant(c).rlike(r"[<,] ?snippet: ")
    number = kind("confidence").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    share = F.try_variant_get(whole, "$.confidence", "double").between(0, 1)
    ok = (kind("answer") == "STRING") & kind("citations").startswith("ARRAY") & number & (kind("should_escalate") == "BOOLEAN") & share & F.forall(cited, named)
    return F.coalesce(ok, F.lit(False))
