"""Queries of citations, preference pairs, fine-tuning sets and evaluation. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlwork.functions.text import tokens
from marlwork.operators import citations, datasets, evaluation, keywords, preferences, training
from marlwork.sources.ranges import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Pairs and examples that the queries make.
N_PAIRS, N_EXAMPLES = 300, 120


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark, d) -> DataFrame:
    """chunk_id, section_id (old form, by doc_id) and text of the documents."""
    key = F.col("doc_id")
    suffix = F.when(key % 3 == 0, F.lit("E")).when(key % 3 == 1, F.lit("")).otherwise(F.lit("F(1)"))
    return table(spark, d, "documents").select(key.alias("chunk_id"), F.concat(F.lit("EA-"), (key % 61 + 12).cast("string"), suffix).alias("section_id"), "text")


def valid() -> F.Column:
    return citations.literal(citations.DEFAULT_SECTIONS)


def known() -> F.Column:
    return citations.literal([f"EA-2022-{n}" for n in range(20, 50)])


def listed(values) -> F.Column:
    return F.array_join(F.array_sort(values), ",")


@query
def section_universe(spark, d):
    return citations.section_universe(chunks(spark, d))


@query
def section_families(spark, d):
    rows = citations.families(chunks(spark, d))
    return rows.groupBy("family").agg(F.count("*").alias("n_chunks"), F.countDistinct("section").alias("n_sections"), listed(F.collect_set("section")).alias("sections"))


@query
def keyword_families(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'")
    begins = citations.literal(["Overtime or rest day? ", "A complaint: ", "Notice! ", ""])
    asked = F.concat(F.get(begins, (F.col("conv_id") % 4).cast("int")), "text")
    return rows.select("conv_id", "turn", F.array_join(citations.families_of(asked), ",").alias("families"))


@query
def families_by_table(spark, d):
    """As keyword_families, with the keywords as a table that is joined."""
    rows = table(spark, d, "conversations").where("role = 'user'")
    begins = citations.literal(["Overtime or rest day? ", "A complaint: ", "Notice! ", ""])
    asked = rows.withColumn("q", F.concat(F.get(begins, (F.col("conv_id") % 4).cast("int")), "text"))
    found = keywords.families_found(asked, ["conv_id", "turn"], "q", keywords.family_table(spark))
    return found.select("conv_id", "turn", F.array_join("families", ",").alias("families"))


def answers(spark, d) -> DataFrame:
    """p_partkey, a response that cites sections, its section and two targets."""
    k = F.col("p_partkey")
    cited = F.concat(F.lit("Under EA-2022-"), (k % 80).cast("string"), F.when(k % 3 == 0, F.lit("E")).otherwise(F.lit("")), F.lit(" and ea-2022-60f(1) the law says: "), "p_name")
    response = F.when(k % 7 == 0, F.col("p_name")).otherwise(cited)
    section = F.concat(F.lit("EA-"), (k % 5 * 20).cast("string"), F.when(k % 2 == 0, F.lit("F")).otherwise(F.lit("")))
    return dealt(table(spark, d, "part")).select("p_partkey", response.alias("response"), section.alias("section"), F.concat(F.lit("the law says "), "p_name").alias("good"), F.concat(F.lit("it depends on "), "p_name", F.lit(" under EA-2022-60F")).alias("bad"))


@query
def citation_grounding(spark, d):
    rows = answers(spark, d).select("p_partkey", citations.grounding(F.col("response"), F.col("section"), valid()).alias("g"), citations.groundedness(F.col("response"), F.array("section"), valid())["legal_anchoring"].alias("anchored"))
    return rows.select("p_partkey", listed("g.predicted_section_ids").alias("predicted"), "g.correctly_grounded", "g.valid_sections_mentioned", F.round("g.grounding_score", 6).alias("iou"), "g.citation_em", "anchored")


@query
def enhanced_win_rate(spark, d):
    like = lambda x: citations.similarity_of(F.col("g"), F.col("response"), F.col(x))
    rows = answers(spark, d).withColumn("g", citations.groundedness(F.col("response"), F.array("section"), valid())).select((F.col("p_partkey") % 10).alias("kind"), like("good").alias("a"), like("bad").alias("b"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") > F.col("b")).cast("int")), 6).alias("win_rate"), F.round(F.avg("a"), 6).alias("mean"))


@query
def different_section(spark, d):
    k = F.col("p_partkey")
    own = F.get(valid(), (k % len(citations.DEFAULT_SECTIONS)).cast("int"))
    rows = dealt(table(spark, d, "part")).select("p_partkey", own.alias("section"))
    return rows.select("p_partkey", "section", citations.different_section(citations.DEFAULT_SECTIONS, F.col("section"), k).alias("other"), F.size(citations.of_family(citations.DEFAULT_SECTIONS, citations.family(F.col("section")))).alias("n_family"))


def made_pairs(spark, d) -> DataFrame:
    return preferences.pairs(chunks(spark, d), valid(), N_PAIRS)


@query
def pref_pairs(spark, d):
    """A pair for every document; kinds of prompts and of flaws go round."""
    k = F.col("chunk_id")
    kind, flaw = F.get(citations.literal(preferences.KINDS), (k % 4).cast("int")), F.get(citations.literal(preferences.FLAWS), (k % 4).cast("int"))
    rows = citations.families(chunks(spark, d)).withColumn("prompt", preferences.prompt(kind, k))
    chosen, rejected = preferences.chosen(F.col("prompt"), F.col("section"), F.col("text")), preferences.rejected(flaw, F.col("section"), F.col("text"), k, valid())
    return rows.select(k.alias("pair_id"), "prompt", chosen.alias("chosen"), rejected.alias("rejected"))


@query
def dataset_validation(spark, d):
    count = lambda ok: F.sum(F.when(ok, 1).otherwise(0))
    uncited = F.size(citations.extracted(F.col("chosen"))) == 0
    return pref_pairs(spark, d).agg(F.count("*").alias("n"), count(uncited).alias("uncited"), count(F.col("chosen") == F.col("rejected")).alias("same"), F.countDistinct("prompt").alias("prompts"), count(F.length("rejected") < 200).alias("short"))


@query
def preference_set(spark, d):
    rows = made_pairs(spark, d)
    return rows.select("pair_id", "template_type", "prompt", "source_section", "chunk_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), F.col("chosen_grounding.correctly_grounded").alias("chosen_ok"), F.col("rejected_grounding.correctly_grounded").alias("rejected_ok"))


@query
def preference_gate(spark, d):
    return preferences.grounded_ratio(made_pairs(spark, d)).select("n", "grounded", F.round("ratio", 6).alias("ratio"), "enough")


@query
def preference_issues(spark, d):
    issues = preferences.quality_issues(F.col("chosen"), F.col("rejected"), F.upper("source_section"))
    return answers(spark, d).select("p_partkey", F.col("response").alias("chosen"), F.col("bad").alias("rejected"), F.when(F.col("p_partkey") % 2 == 0, "ea-2022-60f").otherwise("x").alias("source_section")).select("p_partkey", F.array_join(issues, ",").alias("issues"))


@query
def preference_feedback(spark, d):
    rows = answers(spark, d).select(F.col("p_partkey").alias("pair_id"), F.col("response").alias("chosen"), F.col("bad").alias("rejected"), F.lit("EA-2022-60E").alias("source_section"))
    k = F.col("p_partkey")
    marks = citations.literal(["1", "0", " 1", "", "yes"])
    feedback = table(spark, d, "part").where("p_partkey % 3 = 0").select(k.alias("pair_id"), F.get(marks, (k % 5).cast("int")).alias("ok_chosen"), F.when(k % 4 == 0, "0").otherwise("1").alias("ok_rejected"))
    return preferences.with_feedback(rows, feedback, strict=True).select("pair_id", "label_verified")


@query
def preference_split(spark, d):
    rows = chunks(spark, d).select(F.col("chunk_id").alias("pair_id"), F.col("section_id").alias("source_section"))
    return preferences.split_by_section(rows).select("pair_id", "split")


@query
def labelling_rows(spark, d):
    rows = preferences.labelling_rows(made_pairs(spark, d))
    return rows.select("pair_id", F.md5("chosen_preview").alias("chosen_preview"), F.md5("rejected_preview").alias("rejected_preview"), "chosen_valid_citations", "rejected_valid_citations")


@query
def flawed_drafts(spark, d):
    k, own = F.col("p_partkey"), F.concat(F.lit("EA-2022-"), (F.col("p_partkey") % 80).cast("string"))
    rows = answers(spark, d).select("p_partkey", F.concat("response", F.lit(". (Source: Employment Act Section "), own, F.lit(")\nEnd.")).alias("draft"), own.alias("section"))
    return rows.select("p_partkey", F.md5(preferences.flawed(F.col("draft"), F.col("section"), k, citations.DEFAULT_SECTIONS)).alias("flawed"), F.md5(preferences.with_citation(F.col("draft"), F.lit("EA-2022-99"))).alias("cited"))


@query
def dpo_rows(spark, d):
    rows = answers(spark, d).select(F.col("p_partkey").alias("pair_id"), F.col("good").alias("prompt"), F.col("response").alias("chosen"), F.col("bad").alias("rejected"))
    return preferences.dpo_rows(rows, "Answer by the Act.")


@query
def cycled_prompts(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("prompt"), "conv_id", "turn")
    return preferences.cycled_prompts(asked, ["conv_id", "turn"], 1000)


def sft_rows(spark, d) -> DataFrame:
    """doc_id, instruction, input, output, citations, has_numeric_claims and split of examples with all kinds of faults."""
    k = F.col("doc_id")
    asked = F.when(k % 7 == 0, F.lit("Short?")).when(k % 7 == 1, F.lit("")).when(k % 7 == 2, F.lit("Tell me about your country")).otherwise(F.concat(F.lit("What does "), "source", F.lit(" say in matter "), (k % 97).cast("string"), F.lit("?")))
    section = F.concat(F.when(k % 2 == 0, F.lit("EA-2022-")).otherwise(F.lit("EA-")), (k % 40 + 20).cast("string"))
    said = F.when(k % 5 == 0, F.lit("None.")).when(k % 5 == 1, F.col("text")).otherwise(F.concat(F.lit("According to "), section, F.lit(": "), F.substring("text", 1, 200)))
    cited = F.when(k % 11 == 0, F.array().cast("array<string>")).when(k % 13 == 0, F.array(section, F.lit("Act 5"))).otherwise(F.array(section))
    return table(spark, d, "documents").select("doc_id", asked.alias("instruction"), F.lit("").alias("input"), said.alias("output"), cited.alias("citations"), (k % 3 == 0).alias("has_numeric_claims"), F.when(k % 6 == 0, F.lit("eval")).otherwise(F.lit("train")).alias("split"))


@query
def example_checks(spark, d):
    rows = datasets.checked(sft_rows(spark, d), known())
    line = lambda x: F.array_join(x, ",").alias(x)
    return rows.select("doc_id", line("errors"), line("warnings"), line("schema_issues"), F.size("present").alias("n_present"))


@query
def example_validation(spark, d):
    rounded = ("citation_presence_rate", "individual_citation_presence_rate", "avg_instruction_length", "avg_output_length")
    return datasets.validation(sft_rows(spark, d), known()).select(*(F.round(c, 6).alias(c) if c in rounded else c for c in datasets.validation(sft_rows(spark, d), known()).columns))


@query
def split_checks(spark, d):
    return datasets.split_validation(sft_rows(spark, d)).withColumn("eval_ratio", F.round("eval_ratio", 6))


@query
def set_rules(spark, d):
    return datasets.set_rules(sft_rows(spark, d)).select("n", F.round("duplicate_rate", 6).alias("duplicate_rate"), F.array_join("issues", ",").alias("issues"))


@query
def example_statistics(spark, d):
    rows = datasets.statistics(sft_rows(spark, d), known())
    return rows.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in rows.dtypes))


@query
def top_sections(spark, d):
    return datasets.top_sections(sft_rows(spark, d))


@query
def schema_report(spark, d):
    return datasets.schema_report(sft_rows(spark, d))[1].select("total_examples", "valid_examples", F.round("validation_rate", 6).alias("validation_rate"), F.round("error_rate", 6).alias("error_rate"))


@query
def instructions_with_titles(spark, d):
    rows = sft_rows(spark, d).select("doc_id", "instruction", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Title "), (F.col("doc_id") % 9).cast("string"))).alias("title"), F.get("citations", F.lit(0)).alias("section"))
    rows = datasets.told_apart(rows.withColumn("section", F.coalesce("section", F.lit("none"))), "doc_id")
    return datasets.distinct_examples(rows, "doc_id").select("doc_id", "instruction")


@query
def sft_examples(spark, d):
    rows = datasets.examples(chunks(spark, d).withColumn("title", F.lit(None).cast("string")), F.array().cast("array<string>"), N_EXAMPLES)
    return rows.select("chunk_id", "section", "category", "instruction", F.md5("output").alias("output"), "has_numeric_claims")


@query
def chat_labels(spark, d):
    ids = F.transform(tokens(F.col("text")), lambda w: F.length(w))
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    rows = rows.select("conv_id", "turn", datasets.masked_labels(F.slice(ids, 1, 10), F.slice(ids, 11, 1000), 64).alias("x"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    return rows.select("conv_id", "turn", total(F.col("x.input_ids")).alias("input_sum"), total(F.col("x.labels")).alias("label_sum"), total(F.col("x.attention_mask")).alias("attended"))


def judged(spark, d) -> DataFrame:
    """conv_id, turn, an assistant's text with telling words, and a judge's reply."""
    k = F.col("conv_id") + F.col("turn")
    tail = citations.literal(["", " I cannot help; please consult a lawyer.", " It depends on your situation.", " You get triple compensation.", " According to section EA-2022-60E you get 14 days.", " The law: EA-2022-999."])
    reply = F.concat(F.lit("grounded: "), F.when(k % 3 == 0, "no").otherwise("yes"), F.lit("\nSCORE: "), F.when(k % 4 == 0, "high").otherwise((k % 10 / 10).cast("string")), F.lit("\nREASONING: because \n it is "))
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.concat("text", F.get(tail, (k % 6).cast("int"))).alias("text"), F.when(k % 11 == 0, "?").otherwise(reply).alias("reply"))


@query
def answer_flags(spark, d):
    return judged(spark, d).select("conv_id", "turn", evaluation.answer_flags(F.col("text")).alias("f")).select("conv_id", "turn", "f.*")


def graded(spark, d) -> DataFrame:
    rows = judged(spark, d).select("conv_id", "turn", evaluation.answer_flags(F.col("text")).alias("f"), evaluation.judge_reply(F.col("reply")).alias("j"))
    return rows.select("conv_id", "turn", "f.refusal", "f.hallucination", "j.reasoning", evaluation.capped(F.col("j.ok"), F.col("j.score"), F.col("f.hallucination")).alias("c")).select("conv_id", "turn", "refusal", "hallucination", "reasoning", F.col("c.ok").alias("grounded"), F.col("c.score").alias("score"))


@query
def judge_replies(spark, d):
    return graded(spark, d).select("conv_id", "turn", "grounded", "score", "reasoning")


@query
def generation_metrics(spark, d):
    rows = evaluation.generation_metrics(graded(spark, d).withColumn("refusal_score", F.when(F.col("turn") % 4 != 1, F.col("score"))))
    return rows.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in rows.dtypes))


@query
def response_quality(spark, d):
    return judged(spark, d).select("conv_id", "turn", F.round(evaluation.quality(F.col("text")), 6).alias("quality"))


@query
def training_report(spark, d):
    rows = judged(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("response"), F.array(F.lit("EA-2022-60E")).alias("gold"))
    rows = evaluation.training_report(rows, "id")
    return rows.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in rows.dtypes))


@query
def judged_rewards(spark, d):
    rows = judged(spark, d).select("conv_id", "turn", evaluation.judged_reward(F.col("text"), F.when(F.col("conv_id") % 2 == 0, "EA-2022-60E"), valid()).alias("r"))
    return rows.select("conv_id", "turn", "r.citations", "r.grounding", "r.gold_section", "r.hallucination", "r.policy_violation", "r.total")


@query
def em_probe(spark, d):
    rows = evaluation.em_probe(judged(spark, d).select((F.col("conv_id") % 8).alias("step"), F.col("text").alias("response")), valid())
    return rows.select("step", F.round("avg_em", 6).alias("avg_em"), "num_prompts")


@query
def run_advice(spark, d):
    k = F.col("p_partkey")
    at = lambda n: (k % n).cast("double") / n
    ppo = evaluation.ppo_advice(at(7) * 4 - 2, at(5), at(3), k % 13 == 0)
    dpo = evaluation.dpo_advice(at(6), at(4), at(9))
    return table(spark, d, "part").select("p_partkey", F.array_join(ppo, "|").alias("ppo"), F.array_join(dpo, "|").alias("dpo"), F.round(evaluation.citation_f1(at(7), at(5)), 6).alias("f1"))


@query
def retrieval_gate(spark, d):
    k = F.col("conv_id")
    rows = table(spark, d, "conversations").groupBy((k % 50).alias("query_id")).agg(((F.sum("turn") % 4) / 3).alias("recall_8"))
    return evaluation.gate(rows).select("n", "failed", F.array_join("failed_ids", ",").alias("failed_ids"), F.round("mean", 6).alias("mean"), "passed")


@query
def misjudged(spark, d):
    rows = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("actual"), (F.col("quality") == 0).alias("predicted"))
    return evaluation.misjudged(rows, "doc_id").select("doc_id", "error")


@query
def aligned_series(spark, d):
    step = (F.col("event_id") % 100).alias("step")
    series = [table(spark, d, "events").where(F.col("event_id") % m == 0).groupBy(step).agg(F.round(F.avg("value"), 4).alias(name)) for m, name in ((2, "win_rate"), (3, "citation_em"), (5, "citation_iou"))]
    return evaluation.aligned(series)


@query
def trailing_average(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return evaluation.trailing_average(rows, "conv_id", "turn", "n").select("conv_id", "turn", F.round("moving", 6).alias("moving"))


@query
def relevance(spark, d):
    gold = F.array(F.lit(" EA-6 "), F.concat(F.lit("ea-"), (F.col("chunk_id") % 50).cast("string")))
    return chunks(spark, d).select("chunk_id", evaluation.relevant(F.when(F.col("chunk_id") % 5 > 0, F.col("section_id")), F.col("text"), gold).alias("relevant"))


@query
def eval_subset_integrity(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("pair_id"))
    wanted = table(spark, d, "benchmark").select((F.col("item_id") * 37).alias("pair_id"))
    return preferences.fixed_subset(rows, wanted)[1]


@query
def stable_split(spark, d):
    rows = training.isolated_split(chunks(spark, d), "section_id")
    return rows.groupBy("split").agg(F.countDistinct("section_id").alias("sections"), F.count("*").alias("n"))
