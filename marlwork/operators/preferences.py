"""Preference pairs: prompts, grounded and flawed answers, quality filters, feedback and splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlwork.functions.text import stripped, tokens
from marlwork.operators import citations
from marlwork.operators.governance import canonical
from marlwork.operators.training import at_places, drawn
from marlwork.sources.durable import few, kept
from marlwork.sources.ranges import in_order

#: Kinds of prompts and of flaws, in the order in which they go round. Fixed values.
KINDS = ["entitlement", "procedure", "rights", "consequences"]
FLAWS = ["missing_citation", "wrong_section", "hallucinated_details", "vague_response"]
#: Invented details. Fixed values.
DETAILS = ["14 days", "30 calendar days", "6 months notice", "triple compensation"]
#: How an answer begins, by what the prompt holds, and its other sentences. Fixed values.
LEADS = [
    (["entitled", "how many"], "According to Section {} of the Employment Act Malaysia, you have specific entitlements outlined in the legislation. "),
    (["procedure", "how do i"], "Under Section {} of the Employment Act, the proper procedure requires following specific steps. "),
    (["rights"], "Your rights under Section {} of the Employment Act provide important protections. "),
]
LEAD = "Based on Section {} of the Employment Act Malaysia, "
STATES, SOURCE = 'The relevant provision states: "{}"', " (Source: Employment Act Section {})"
UNCITED = 'You are entitled to specific benefits under the Employment Act. The law provides: "{}"'
WRONG = 'According to Section {} of the Employment Act, you have certain entitlements. The provision states: "{}..."'
INVENTED = 'Under the Employment Act, you are entitled to {} as specified in the legislation. The relevant section mentions: "{}..."'
VAGUE = "The Employment Act contains various provisions related to your question. You should check the relevant sections or consult with legal counsel for specific details. Different situations may have different requirements."
#: What flaws put into drafted answers. Fixed values.
DRAFT_DETAILS = ["exactly 14 days", "triple compensation", "immediate termination rights"]
#: A few prompts of each kind and what fills them in; callers hand in their own.
PROMPTS = {
    "entitlement": ["How much {benefit} am I entitled to?", "How many days of {benefit} are due?"],
    "procedure": ["How do I {action}?", "Which steps does it take to {action}?"],
    "rights": ["Which rights do I have about {topic}?", "Does the law protect me in matters of {topic}?"],
    "consequences": ["What follows if I {action}?", "Is there a penalty if I {action}?"],
}
FILLS = {"benefit": ["annual leave", "sick leave", "overtime pay"], "action": ["resign without notice", "file a complaint", "ask for more pay"], "topic": ["pregnancy", "termination", "rest days"]}


def filled(sentence: str, *values: Column) -> Column:
    """`sentence` with its {} filled in."""
    parts = sentence.split("{}")
    return F.concat(F.lit(parts[0]), *(x for value, part in zip(values, parts[1:], strict=True) for x in (value, F.lit(part))))


def prompt(kind: Column, key: Column, prompts: dict[str, list[str]] | None = None, fills: dict[str, list[str]] | None = None) -> Column:
    """A prompt of the kind, by the md5 of key."""
    out = F.coalesce(*(F.when(kind == k, citations.picked(citations.literal(v), key, "prompt")) for k, v in (prompts or PROMPTS).items()))
    for name, values in (fills or FILLS).items():
        out = F.replace(out, F.lit("{" + name + "}"), citations.picked(citations.literal(values), key, name))
    return out


def chosen(prompt: Column, section: Column, text: Column) -> Column:
    """A grounded answer that quotes 300 characters of the section."""
    low = F.lower(prompt)
    lead = F.coalesce(*(F.when(F.greatest(*(F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) == 1, filled(s, section)) for words, s in LEADS), filled(LEAD, section))
    return F.concat(lead, filled(STATES, stripped(F.substring(text, 1, 300))), filled(SOURCE, section))


def rejected(flaw: Column, section: Column, text: Column, key: Column, valid: Column) -> Column:
    """An answer with one of FLAWS; without another known section the wrong one becomes a missing citation."""
    quote = lambda n: stripped(F.substring(text, 1, n))
    other = citations.different_section(valid, section, key)
    uncited = filled(UNCITED, quote(300))
    return (
        F.when(flaw == FLAWS[0], uncited)
        .when(flaw == FLAWS[1], F.coalesce(F.concat(filled(WRONG, other, quote(200)), filled(SOURCE, other)), uncited))
        .when(flaw == FLAWS[2], F.concat(filled(INVENTED, citations.picked(citations.literal(DETAILS), key, "detail"), quote(150)), filled(SOURCE, section)))
        .otherwise(F.lit(VAGUE))
    )


def flawed(response: Column, section: Column, key: Column, valid: Column | list[str]) -> Column:
    """A drafted response with a subtle flaw: another section, no citation or an invented detail, by the md5 of key."""
    flaw = citations.picked(citations.literal(["wrong_section", "remove_citation", "add_hallucination"]), key, "flaw")
    own = F.coalesce(canonical(section), section)
    named = F.when(F.contains(response, own), own).when(F.contains(response, section), section)
    other = citations.different_section(valid, own, key)
    bare = F.replace(F.regexp_replace(response, "(?i)" + citations.CANONICAL, "the relevant section"), F.lit("(Source: Employment Act Section"), F.lit("(Source: the relevant section"))
    detail = citations.picked(citations.literal(DRAFT_DETAILS), key, "draft")
    return (
        F.when(flaw == "wrong_section", F.coalesce(F.replace(response, named, other), response))
        .when(flaw == "remove_citation", bare)
        .otherwise(F.concat(response, F.lit(" Additionally, you are entitled to "), detail, F.lit(" in such cases.")))
    )


def with_citation(response: Column, section: Column) -> Column:
    """A drafted response that cites its section: behind the first sentence or line, else at 200 characters at most."""
    cited = F.array_contains(citations.extracted(response), section)
    stops = F.array(F.instr(response, ". "), F.instr(response, "\n"))
    first = F.coalesce(F.array_min(F.filter(stops, lambda x: x > 0)) - 1, F.least(F.lit(200), F.length(response)))
    at = first + F.when(first >= F.length(response), 0).otherwise(1)
    put = F.concat(F.substring(response, F.lit(1), at), F.lit(" ("), section, F.lit(")"), F.substring(response, at + 1, F.length(response)))
    end = F.concat(stripped(response), F.lit(" ("), section, F.lit(")"))
    return F.when((F.coalesce(section, F.lit("")) == "") | cited, response).when((at <= 0) | (at > F.length(response)), end).otherwise(put)


def nearest_chunk(prompts: DataFrame, chunks: DataFrame, first: int = 50) -> DataFrame:
    """pair_id and chunk_id: the one of the `first` chunks (by chunk_id) whose words are most like the prompt's; ties go to the earlier.

    Likeness is intersection over union of the sets of words; prompts that share no word with a chunk have no row.
    """
    few = chunks.orderBy("chunk_id").limit(first).select("chunk_id", F.array_distinct(tokens(F.col("text"))).alias("w"))
    own = prompts.select("pair_id", F.array_distinct(tokens(F.col("prompt"))).alias("p"))
    pairs = own.crossJoin(F.broadcast(few))  # a stated query set against `first` rows
    scored = pairs.select("pair_id", "chunk_id", (F.size(F.array_intersect("p", "w")) / F.size(F.array_union("p", "w"))).alias("score")).where("score > 0")
    return scored.groupBy("pair_id").agg(F.min_by("chunk_id", F.struct(-F.col("score"), F.col("chunk_id"))).alias("chunk_id"))


def numbered(key: Column, what: str, below: Column) -> Column:
    """A number below `below` by the md5 of key and purpose."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(what))), 1, 8), 16, 10).cast("long") % below).cast("int")


def pairs(chunks: DataFrame, valid: Column, target: int = 60, seed: int = 42, prompts: dict | None = None, fills: dict | None = None) -> DataFrame:
    """pair_id, prompt, chosen, rejected, source_section, template_type, chunk_id and both groundings of `target` pairs.

    chunks has chunk_id, section_id and text. First each section gives one pair, as long as there are sections, in a
    stable random order; the others ask for a chunk that suits their prompt: of a family that its keywords name, else
    the most similar of the first chunks, else any. A random choice is among all chunks of a family, or of the table.
    """
    spark = chunks.sparkSession
    named = citations.families(chunks).select("chunk_id", "section_id", "family", "text")
    one = kept(named.groupBy("section_id").agg(F.min(F.struct(drawn(F.col("chunk_id"), seed).alias("r"), "chunk_id")).alias("x")).select("section_id", "x.chunk_id"))  # a row a section
    order = Window.orderBy(drawn(F.col("section_id"), seed), "section_id")
    first = one.withColumn("i", F.row_number().over(order) - 1).where(F.col("i") < target).select(F.col("i").cast("long").alias("pair_id"), "chunk_id")
    done = first.count()
    ids = spark.range(done, target).withColumnRenamed("id", "pair_id")
    asked = first.select("pair_id").unionByName(ids.select("pair_id"))
    turn = F.when(F.col("pair_id") < done, F.col("pair_id")).otherwise(2 * F.col("pair_id") - done)
    asked = asked.withColumn("template_type", F.get(citations.literal(KINDS), (turn % len(KINDS)).cast("int")))
    asked = asked.withColumn("prompt", prompt(F.col("template_type"), F.col("pair_id"), prompts, fills))
    wanted = asked.where(F.col("pair_id") >= done)
    # Of the families that are asked for and exist, one is taken; then one of its chunks, by its place in a random order.
    grouped = named.where("family is not null").select("chunk_id", "family")
    held = few(grouped.groupBy("family").agg(F.count("*").alias("held")))
    each = wanted.select("pair_id", F.explode(citations.families_of(F.col("prompt"))).alias("family")).join(held, "family")
    taken = each.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("family", "held"))).alias("xs"))
    taken = taken.select("pair_id", F.get("xs", numbered(F.col("pair_id"), "family", F.size("xs"))).alias("x")).select("pair_id", "x.family", numbered(F.col("pair_id"), "chunk", F.col("x.held")).alias("place"))
    by_family = kept(at_places(grouped, "family", "chunk_id", taken, seed).select("pair_id", "chunk_id"))
    left = wanted.join(by_family, "pair_id", "left_anti")
    by_words = kept(nearest_chunk(left, named))
    every = named.select("chunk_id", F.lit(0).alias("every"))
    lost = left.join(by_words, "pair_id", "left_anti").select("pair_id").crossJoin(F.broadcast(every.agg(F.count("*").alias("n")))).where("n > 0")
    by_chance = at_places(every, "every", "chunk_id", lost.select("pair_id", F.lit(0).alias("every"), numbered(F.col("pair_id"), "any", F.col("n")).alias("place")), seed).select("pair_id", "chunk_id")
    placed = few(first.unionByName(by_family).unionByName(by_words).unionByName(by_chance).join(asked, "pair_id"))
    rows = named.select("chunk_id", "section_id", "text").join(placed, "chunk_id")
    own = F.coalesce(canonical(F.col("section_id")), F.col("section_id"))
    flaw = F.get(citations.literal(FLAWS), (F.col("pair_id") % len(FLAWS)).cast("int"))
    rows = rows.withColumn("chosen", chosen(F.col("prompt"), own, F.col("text"))).withColumn("rejected", rejected(flaw, own, F.col("text"), F.col("pair_id"), valid))
    return rows.select(
        "pair_id",
        "prompt",
        "chosen",
        "rejected",
        F.col("section_id").alias("source_section"),
        "template_type",
        "chunk_id",
        citations.grounding(F.col("chosen"), F.col("section_id"), valid).alias("chosen_grounding"),
        citations.grounding(F.col("rejected"), F.col("section_id"), valid).alias("rejected_grounding"),
    )


def grounded_ratio(made: DataFrame) -> DataFrame:
    """n, grounded, ratio (0 without pairs) and whether the ratio reaches `0.6`."""
    total = made.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("chosen_grounding.correctly_grounded").cast("int")), F.lit(0)).alias("grounded"))
    ratio = F.coalesce(F.try_divide(F.col("grounded"), F.col("n")), F.lit(0.0))
    return total.select("n", "grounded", ratio.alias("ratio"), (ratio >= 0.6).alias("enough"))


def topped_up(chunks: DataFrame, valid: Column, target: int = 60, rounds: int = 3, **options) -> DataFrame:
    """pairs(), and while fewer than six in ten are grounded, up to 10 more a round, to half as many again at most."""
    size, most, batch = target, int(target * 1.5), min(10, target // 3 or 1)
    made = pairs(chunks, valid, size, **options)
    for _ in range(rounds):
        if size >= most or grounded_ratio(made).first()["enough"]:
            break
        size += batch
        made = pairs(chunks, valid, size, **options)
    return made


def quality_issues(chosen: Column, rejected: Column, section: Column) -> Column:
    """What is wrong with a pair: the chosen answer cites nothing, or the rejected one cites the source section."""
    return F.array_compact(
        F.array(
            F.when(F.size(citations.extracted(chosen)) == 0, F.lit("chosen_no_citations")),
            F.when(F.array_contains(citations.extracted(rejected), F.upper(section)), F.lit("rejected_has_gold_section")),
        )
    )


def with_feedback(made: DataFrame, feedback: DataFrame, strict: bool = False) -> DataFrame:
    """made without the pairs that feedback (pair_id, ok_chosen, ok_rejected as text) marks as bad; label_verified tells which were judged.

    Only feedback whose both marks are 0 or 1 counts. `strict` drops pairs with quality issues too.
    """
    flags = [F.trim(x).isin("0", "1") for x in ("ok_chosen", "ok_rejected")]
    judged = feedback.where(flags[0] & flags[1]).select("pair_id", (F.trim("ok_chosen") == "1").alias("marlwork_ok_a"), (F.trim("ok_rejected") == "1").alias("marlwork_ok_b"))
    kept = made.where(F.size(quality_issues(F.col("chosen"), F.col("rejected"), F.col("source_section"))) == 0) if strict else made
    joined = kept.join(judged, "pair_id", "left")
    good = F.coalesce(F.col("marlwork_ok_a") & F.col("marlwork_ok_b"), F.lit(True))
    return joined.where(good).withColumn("label_verified", F.col("marlwork_ok_a").isNotNull()).select(*made.columns, "label_verified")


def split_by_section(made: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """made with `split`: the first `share` of the sections, in a stable random order, are train, the others eval. Pairs without a section have one of their own."""
    sections = made.select(F.col("source_section").alias("marlwork_section")).distinct()
    order = Window.orderBy(drawn(F.col("marlwork_section"), seed), "marlwork_section")  # a small table
    ranked = sections.withColumn("place", F.row_number().over(order)).crossJoin(F.broadcast(sections.agg(F.count("*").alias("n"))))
    side = few(ranked.select("marlwork_section", F.when(F.col("place") <= F.floor(F.col("n") * share), F.lit("train")).otherwise(F.lit("eval")).alias("split")))
    return made.join(side, made["source_section"].eqNullSafe(side["marlwork_section"])).select(*made.columns, "split")


def split_summary(split: DataFrame) -> DataFrame:
    """split, number of pairs and of sections, and the pair ids in order, of what split_by_section() returns."""
    return split.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("source_section").alias("sections"), F.array_sort(F.collect_list("pair_id")).alias("pair_ids"))


def labelling_rows(made: DataFrame) -> DataFrame:
    """What people label: previews of 100 characters, counts of citations and empty columns for their marks."""
    preview = lambda x: F.when(F.length(x) > 100, F.concat(F.substring(x, 1, 100), F.lit("..."))).otherwise(F.col(x))
    blank = lambda name: F.lit("").alias(name)
    return made.select(
        "pair_id",
        "prompt",
        preview("chosen").alias("chosen_preview"),
        preview("rejected").alias("rejected_preview"),
        F.size("chosen_grounding.predicted_section_ids").alias("chosen_valid_citations"),
        F.size("rejected_grounding.predicted_section_ids").alias("rejected_valid_citations"),
        blank("ok_chosen"),
        blank("ok_rejected"),
        blank("notes"),
    )


def write_pairs(split: DataFrame, path: str) -> None:
    """Writes what split_by_section() returns as JSON lines (train, eval and all), the split's summary and the labelling rows as CSV."""
    for side in ("train", "eval"):
        split.where(F.col("split") == side).drop("split").write.mode("overwrite").json(f"{path}/{side}")
    split.drop("split").write.mode("overwrite").json(f"{path}/all")
    split_summary(split).write.mode("overwrite").json(f"{path}/split_metadata")
    labelling_rows(split).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{path}/labelling")


def fixed_subset(rows: DataFrame, wanted: DataFrame, key: str = "pair_id", most: int = 30) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is in `wanted`, the first `most` of them by key, and one row of counts: expected, found, missing."""
    ids = few(wanted.select(key).distinct())
    found = rows.join(ids, key, "left_semi")
    missing = ids.join(rows.select(key), key, "left_anti")
    counts = ids.agg(F.count("*").alias("expected")).crossJoin(found.agg(F.count("*").alias("found"))).crossJoin(missing.agg(F.count("*").alias("missing")))
    return found.orderBy(key).limit(most), counts.withColumn("integrity_ok", F.col("missing") == 0)


def dpo_rows(made: DataFrame, system: str, template: Callable[[Column], Column] | None = None) -> DataFrame:
    """prompt, chosen and rejected of made: the prompt as `template` writes its messages (role, content), the answers as they are."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    plain = lambda ms: F.concat(F.array_join(F.transform(ms, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), ""), F.lit("<|assistant|>\n"))
    messages = F.array(message("system", F.lit(system)), message("user", F.col("prompt")))
    return made.select("pair_id", (template or plain)(messages).alias("prompt"), "chosen", "rejected")


def cycled_prompts(prompts: DataFrame, order: list[str], n: int) -> DataFrame:
    """id and prompt of `n` prompts: those of prompts (prompt, and the columns of `order`) in turn, from the second round on in one of four variations.

    Without prompts there are none; a null prompt is empty.
    """
    own = kept(in_order(prompts.select(F.coalesce("prompt", F.lit("")).alias("prompt"), *order), order))
    size = own.count()
    ids = prompts.sparkSession.range(n if size else 0).withColumn("place", F.col("id") % max(size, 1))
    id_, base = F.col("id"), F.col("prompt")
    low = F.lower(base)
    varied = F.array(F.concat(F.lit("According to Malaysian law, "), low), F.concat(F.lit("Under the Employment Act, "), low), F.concat(F.lit("What does the Employment Act say about: "), F.replace(low, F.lit("?"), F.lit(""))), base)
    return ids.join(own.select("place", "prompt"), "place").select("id", F.when(id_ < size, base).otherwise(F.get(varied, (id_ % 4).cast("int"))).alias("prompt"))
