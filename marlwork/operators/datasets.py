"""Fine-tuning sets: examples, checks of rows, of sets and of splits, statistics, writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlwork.functions.text import holds_any, once, stripped
from marlwork.operators import citations, questions
from marlwork.operators.governance import canonical
from marlwork.operators.training import keep_first_similar, stratified

#: What marks a question, and a legal answer; the form of a citation. Fixed values.
QUESTION_MARKS = ["?", "how", "what", "when", "where", "why", "can", "should", "is", "are"]
ANSWER_TERMS = ["employment act", "section", "according", "entitled", "shall", "must"]
CITATION = r"^EA-\d{4}-\d+[A-Z]*(?:\(\d+\))?$"


def missing_fields(instruction: Column, output: Column, cited: Column) -> Column:
    """Which fields of an example are null (missing) or empty."""
    text = lambda name, x: F.when(x.isNull(), F.lit(f"missing_{name}")).when(x == "", F.lit(f"empty_{name}"))
    many = F.when(cited.isNull(), F.lit("missing_citations")).when(F.size(cited) == 0, F.lit("empty_citations"))
    return F.array_compact(F.array(text("instruction", instruction), text("output", output), many))


def row_issues(instruction: Column, given: Column, output: Column, cited: Column) -> Column:
    """Which rules of the row schema an example breaks; null fields break theirs."""
    say = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    bare = lambda x: F.length(stripped(x))
    return F.array_compact(
        F.array(
            say(F.length(instruction).between(10, 2000) & (bare(instruction) >= 10), "instruction_length"),
            say(holds_any(F.lower(instruction), QUESTION_MARKS), "instruction_not_a_question"),
            say(F.length(F.coalesce(given, F.lit(""))) <= 500, "input_length"),
            say(F.length(output).between(20, 1000) & (bare(output) >= 20), "output_length"),
            say(holds_any(F.lower(output), ANSWER_TERMS), "output_not_legal"),
            say(F.size(cited).between(1, 10), "citations_number"),
            say(F.forall(cited, lambda c: F.coalesce(c.rlike(CITATION), F.lit(False))), "citations_form"),
        )
    )


def checked(rows: DataFrame, valid: Column) -> DataFrame:
    """rows (instruction, input, output, citations) with errors, warnings and what the summary needs.

    Rows with missing or empty fields have no other errors or warnings. A citation is unknown if its canonical form is
    not in `valid`, where that isn't empty; it is present if it stands in the output as it is or in canonical form.
    """
    cited, any_known = F.coalesce("citations", F.lit(None).cast("array<string>")), F.size(valid) > 0
    missing = missing_fields(F.col("instruction"), F.col("output"), cited)
    unknown = F.filter(cited, lambda c: canonical(c).isNotNull() & any_known & ~F.array_contains(valid, canonical(c)))
    unformed = F.filter(cited, lambda c: canonical(c).isNull())
    here = F.filter(cited, lambda c: F.contains(F.col("output"), c) | F.coalesce(F.array_contains(citations.extracted(F.col("output")), canonical(c)), F.lit(False)))
    n_in, n_out = F.length("instruction"), F.length("output")
    whole = F.size(missing) == 0
    warned = F.array_compact(
        F.array(
            F.when(F.size(unformed) > 0, F.lit("citation_form")),
            F.when(n_in < 10, F.lit("short_instruction")),
            F.when(n_out < 20, F.lit("short_output")),
            F.when(n_out > 1000, F.lit("long_output")),
            F.when(F.size(here) < F.size(cited), F.lit("citation_absent")),
        )
    )
    none = F.array().cast("array<string>")
    out = rows.withColumn("missing", missing).withColumn("schema_issues", row_issues(F.col("instruction"), F.col("input"), F.col("output"), cited))
    out = out.withColumn("unknown", F.coalesce(unknown, none)).withColumn("present", F.coalesce(here, none)).withColumn("n_cited", F.coalesce(F.greatest(F.size(cited), F.lit(0)), F.lit(0)))
    errors = F.concat(F.col("missing"), F.when(whole & (F.size("unknown") > 0), F.array(F.lit("citation_unknown"))).otherwise(none), F.when(F.size("schema_issues") > 0, F.array(F.lit("schema"))).otherwise(none))
    return out.withColumn("errors", errors).withColumn("warnings", F.when(whole, warned).otherwise(none))


def validation(rows: DataFrame, valid: Column) -> DataFrame:
    """One row of statistics over rows (instruction, input, output, citations), and whether all of them are right."""
    c = checked(rows, valid)
    count = lambda ok: F.coalesce(F.sum(F.when(ok, 1).otherwise(0)), F.lit(0))
    whole = F.size("missing") == 0
    normal = F.size(F.filter(F.coalesce("citations", F.array().cast("array<string>")), lambda x: F.coalesce(~F.array_contains(valid, F.coalesce(canonical(x), x)), F.lit(True)))) == 0
    short = F.when(whole, F.when(F.length("instruction") < 10, 1).otherwise(0) + F.when(F.length("output") < 20, 1).otherwise(0)).otherwise(0)
    share = lambda a, b: F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0))
    total = c.agg(
        F.count("*").alias("total_examples"),
        count(whole).alias("valid_examples"),
        count(F.size("schema_issues") == 0).alias("schema_valid_examples"),
        count(normal | (F.size(valid) == 0)).alias("citation_valid_examples"),
        count(F.size("present") > 0).alias("citation_present_in_output"),
        share(count(F.size("present") > 0), F.count("*")).alias("citation_presence_rate"),
        share(F.sum(F.size("present")), F.sum("n_cited")).alias("individual_citation_presence_rate"),
        F.coalesce(F.avg(F.when(whole, F.length("instruction"))), F.lit(0.0)).alias("avg_instruction_length"),
        F.coalesce(F.avg(F.when(whole, F.length("output"))), F.lit(0.0)).alias("avg_output_length"),
        F.coalesce(F.sum(short), F.lit(0)).alias("examples_with_length_issues"),
        count(F.size("errors") > 0).alias("rows_with_errors"),
        count(F.size("warnings") > 0).alias("rows_with_warnings"),
    )
    unique = c.where(whole).select(F.explode("citations").alias("x")).agg(F.countDistinct("x").alias("unique_citations"))
    right = (F.col("rows_with_errors") == 0) & (F.col("valid_examples") > 0) & (F.col("citation_valid_examples") == F.col("total_examples"))
    return total.crossJoin(F.broadcast(unique)).withColumn("known_section_ids_count", F.size(valid)).withColumn("is_valid", right)


def split_validation(rows: DataFrame) -> DataFrame:
    """One row about rows (split: train or eval, instruction, citations): sizes, share, what both sides share, warning, is_valid."""
    side = lambda x: rows.where(F.col("split") == x)
    asked = side("train").select("instruction").intersect(side("eval").select("instruction")).agg(F.count("*").alias("instruction_overlap"))
    cited = lambda x: side(x).select(F.explode("citations").alias("c"))
    shared = cited("train").intersect(cited("eval")).agg(F.count("*").alias("section_overlap"))
    sizes = rows.agg(F.count("*").alias("total_examples"), F.coalesce(F.sum((F.col("split") == "train").cast("int")), F.lit(0)).alias("train_examples"), F.coalesce(F.sum((F.col("split") == "eval").cast("int")), F.lit(0)).alias("eval_examples"))
    out = sizes.crossJoin(F.broadcast(asked)).crossJoin(F.broadcast(shared))
    ratio = F.coalesce(F.try_divide(F.col("eval_examples"), F.col("total_examples")), F.lit(0.0))
    warning = F.when(ratio < 0.1, F.lit("eval_small")).when(ratio > 0.3, F.lit("eval_large")).otherwise(F.lit(""))
    return out.withColumn("eval_ratio", ratio).withColumn("warning", warning).withColumn("is_valid", (F.col("instruction_overlap") == 0) & (F.col("section_overlap") == 0))


def set_rules(rows: DataFrame, least: int = 50, most_repeated: float = 0.05) -> DataFrame:
    """One row: n, share of repeated instructions (up to case and white space at the ends) and the rules that the set breaks."""
    total = rows.agg(F.count("*").alias("n"), F.countDistinct(F.lower(stripped(F.col("instruction")))).alias("d"))
    rate = F.when(F.col("n") > 0, 1 - F.col("d") / F.greatest(F.col("n"), F.lit(1))).otherwise(F.lit(0.0))
    broken = F.array_compact(F.array(F.when(F.col("n") < least, F.lit("too_small")), F.when(rate > most_repeated, F.lit("repeated_instructions"))))
    return total.select("n", rate.alias("duplicate_rate"), broken.alias("issues"))


def statistics(rows: DataFrame, valid: Column) -> DataFrame:
    """One row of statistics over rows (instruction, output, citations, has_numeric_claims)."""
    none = F.array().cast("array<string>")
    own = rows.withColumn("citations", F.coalesce("citations", none))
    rate = lambda ok: F.coalesce(100.0 * F.avg(F.when(ok, 1).otherwise(0)), F.lit(0.0))
    known = F.forall("citations", lambda c: F.coalesce(F.array_contains(valid, F.coalesce(canonical(c), c)), F.lit(False)))
    total = own.agg(
        F.count("*").alias("total_examples"),
        F.coalesce(F.avg(F.length("instruction")), F.lit(0.0)).alias("avg_instruction_length"),
        F.coalesce(F.avg(F.length("output")), F.lit(0.0)).alias("avg_answer_length"),
        rate(F.size("citations") > 0).alias("pct_with_citations"),
        rate(F.coalesce("has_numeric_claims", F.lit(False))).alias("pct_numeric_claims"),
        rate(known).alias("citation_validation_rate"),
    )
    coverage = own.select(F.explode("citations").alias("c")).agg(F.countDistinct("c").alias("section_coverage"))
    return total.crossJoin(F.broadcast(coverage))


def top_sections(rows: DataFrame, most: int = 5) -> DataFrame:
    """section and n of the most cited sections, ties in order of their names: a top-k report."""
    counted = rows.select(F.explode("citations").alias("section")).groupBy("section").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "section").limit(most)


def schema_report(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that keep the row schema, with canonical citations, and one row: total, valid and both rates."""
    form = F.array_compact(F.transform("citations", lambda x: canonical(x)))
    own = rows.withColumn("citations", F.when(F.size(form) > 0, form).otherwise(F.col("citations")))
    own = own.withColumn("issues", row_issues(F.col("instruction"), F.col("input"), F.col("output"), F.col("citations")))
    good = F.size("issues") == 0
    total = own.agg(F.count("*").alias("total_examples"), F.coalesce(F.sum(F.when(good, 1).otherwise(0)), F.lit(0)).alias("valid_examples"))
    rate = F.coalesce(F.try_divide(F.col("valid_examples"), F.col("total_examples")), F.lit(0.0))
    report = total.select("*", rate.alias("validation_rate"), F.when(F.col("total_examples") > 0, 1 - rate).otherwise(F.lit(0.0)).alias("error_rate"))
    return own.where(good).drop("issues"), report


def told_apart(rows: DataFrame, key: str) -> DataFrame:
    """rows (instruction, title, section) whose instruction repeats an earlier one's, in any case, marked by title, else by section.

    Rows without an instruction repeat none and stay as they are.
    """
    same = F.lower(stripped(F.col("instruction")))
    first = rows.where(same.isNotNull()).groupBy(same.alias("marlwork_same")).agg(F.min(key).alias("marlwork_first"))
    title = stripped(F.coalesce(F.col("title"), F.lit("")))
    by_title = F.concat(F.lit("(regarding "), title, F.lit(")"))
    fresh = (title != "") & ~F.contains(same, F.lower(by_title))
    mark = F.when(fresh, by_title).otherwise(F.concat_ws("", F.lit("[Section "), F.col("section"), F.lit("]")))
    repeats = F.col("marlwork_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("marlwork_first"))
    marked = F.when(repeats, F.concat_ws(" ", "instruction", mark)).otherwise(F.col("instruction"))
    return rows.join(first, same == F.col("marlwork_same"), "left").withColumn("instruction", marked).select(*rows.columns)


def distinct_examples(rows: DataFrame, key: str) -> DataFrame:
    """rows without those that repeat an earlier row's section and instruction, up to case and white space at the ends."""
    same = F.md5(F.concat_ws("|", F.lower(stripped(F.col("instruction"))), "section"))
    first = rows.groupBy(same.alias("marlwork_hash")).agg(F.min(key).alias("marlwork_first"))
    return rows.join(first, (same == F.col("marlwork_hash")) & (F.col(key) == F.col("marlwork_first")), "left_semi")


def examples(chunks: DataFrame, valid: Column, target: int = 200, spare: float = 2.0, threshold: float = 0.95, seed: int = 42) -> DataFrame:
    """`target` examples (chunk_id, section, category, instruction, input, output, citations, has_numeric_claims) of chunks (chunk_id, section_id, title, text).

    Strata of sections give `spare` times as many candidates as are wanted, once, instead of rounds of retries; repeated
    and similar instructions of a section and unknown citations go, and the first `target` by chunk_id stay.
    """
    named = citations.families(chunks).select("chunk_id", "section", "title", "text")
    some = stratified(named, "section", "chunk_id", int(target * spare), seed).dropDuplicates(["chunk_id"])
    text, key = F.col("text"), F.col("chunk_id")
    kind = questions.kind(F.concat_ws(" ", F.coalesce("title", F.lit("")), text), key)
    made = some.withColumn("category", kind).withColumn("instruction", questions.question(F.col("category"), key))
    made = distinct_examples(told_apart(made, "chunk_id"), "chunk_id")
    made = keep_first_similar(made, "section", "chunk_id", "instruction", threshold).where(F.array_contains(valid, F.col("section")) | (F.size(valid) == 0))
    return made.orderBy("chunk_id").limit(target).select(
        "chunk_id",
        "section",
        "category",
        "instruction",
        F.lit("").alias("input"),
        questions.answer(text, F.col("section")).alias("output"),
        F.array("section").alias("citations"),
        (F.size(questions.claims(text)) > 0).alias("has_numeric_claims"),
    )


def chat_messages(instruction: Column, output: Column, system: str) -> Column:
    """The three messages of an example."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", instruction), message("assistant", output))


def masked_labels(prompt: Column, answer: Column, most: int, pad: int = 0) -> Column:
    """input_ids, labels and attention_mask of two arrays of token ids, cut or padded to `most`.

    Labels are -100 over the prompt; padding is labelled and attended to as any token.
    """
    padded = F.slice(F.concat(prompt, answer, F.array_repeat(F.lit(pad), F.lit(most))), 1, most)
    masked = F.transform(padded, lambda x, i: F.when(i < F.size(prompt), F.lit(-100)).otherwise(x))
    return once(padded, lambda x: F.struct(x.alias("input_ids"), masked.alias("labels"), F.transform(x, lambda _: F.lit(1)).alias("attention_mask")))


def write_examples(rows: DataFrame, valid: Column, path: str, subset: int = 30) -> None:
    """Writes rows with `split` and `stable_id` as JSON lines: train, eval, the fixed eval subset, and the reports."""
    for side in ("train", "eval"):
        rows.where(F.col("split") == side).drop("split").write.mode("overwrite").json(f"{path}/{side}")
    rows.where("split = 'eval'").orderBy("stable_id").limit(subset).drop("split").write.mode("overwrite").json(f"{path}/eval_subset")
    for name, report in {"statistics": statistics(rows, valid), "top_sections": top_sections(rows), "schema": schema_report(rows)[1], "split": split_validation(rows)}.items():
        report.write.mode("overwrite").json(f"{path}/reports/{name}")
