"""Evaluation of answers and of training runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlwork.functions.text import holds_any, once, stripped, tokens
from marlwork.operators import citations, metrics

#: Refusals of safety and vague answers; content that isn't in the law; refusals. Fixed values.
SAFETY = ["cannot provide legal advice", "this is not legal advice", "consult a lawyer", "seek legal counsel"]
VAGUE = ["consult with hr", "check the relevant sections", "different situations may have", "please consult", "depends on your situation"]
INVENTED = ["triple compensation", "quadruple damages", "365 days leave", "unlimited overtime", "immediate termination without cause", "automatic lawsuit win"]
REFUSING = ["i cannot", "i can only provide", "please consult", "i understand you're asking", "for specific legal advice", "outside employment law", "qualified legal professional"]
#: What the first reward looks for, and its weights. Fixed values.
REWARD_INVENTED = ["14 days", "30 calendar days", "triple compensation"]
WEIGHTS = {"citations": 1.0, "grounding": 1.0, "gold_section": 0.5, "hallucination": -2.0, "policy_violation": -2.0}
#: What the heuristic judge and the form check look for. Fixed values.
JUDGED_TERMS = ["employment act", "section", "entitled", "shall", "according to"]
FORM_TERMS = ["section", "according", "entitled"]
#: Advice by what a run shows. Fixed values.
PPO_ADVICE = {
    "negative": "Consider longer DPO training or better preference data quality",
    "few_good": "Increase citation training and grounding examples in preference pairs",
    "many_bad": "Add more negative examples to reduce hallucination patterns",
    "aligned": "Model shows good alignment - ready for deployment testing",
    "error": "PPO training encountered errors - check memory usage and model compatibility",
    "none": "PPO training completed successfully - monitor performance in production",
}
DPO_ADVICE = {
    "low_wins": "Low win-rate: Consider additional SFT training or longer DPO training",
    "high_wins": "Excellent win-rate: Model shows strong preference alignment",
    "low_citations": "Low citation accuracy: Add more citation examples to training data",
    "high_citations": "Strong citation performance: Model properly grounds responses",
    "unsafe": "Safety concerns: Review and strengthen safety training data",
    "safe": "Good safety performance: Low violation rate",
}


def relevant(section: Column, text: Column, gold: Column) -> Column:
    """Whether a chunk serves one of the gold ids: equal to or inside its section id, or inside its text, in any case.

    A null section or text is empty; an id inside a longer one counts too.
    """
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    inside = lambda g: F.contains(low(F.trim(section)), F.lower(F.trim(g))) | F.contains(low(text), F.lower(F.trim(g)))
    nothing = (low(F.trim(section)) == "") & (low(text) == "")
    return F.when(nothing, F.lit(False)).otherwise(F.coalesce(F.exists(gold, inside), F.lit(False)))


def gate(scores: DataFrame, metric: str = "recall_8", least: float = 0.9) -> DataFrame:
    """One row about scores (query_id, metric): n, how many failed (0), their ids in order, the mean and whether it reaches `least`."""
    failed = F.col(metric) == 0
    return scores.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(failed.cast("int")), F.lit(0)).alias("failed"),
        F.array_sort(F.collect_list(F.when(failed, F.col("query_id")))).alias("failed_ids"),
        F.coalesce(F.avg(metric), F.lit(0.0)).alias("mean"),
        (F.coalesce(F.avg(metric), F.lit(0.0)) >= least).alias("passed"),
    )


def misjudged(rows: DataFrame, key: str, most: int = 5) -> DataFrame:
    """The first `most` rows (predicted, actual) that are misclassified, with the kind of their error: a top-k report."""
    kind = F.when(F.col("predicted"), F.lit("false_refusal")).otherwise(F.lit("missed_refusal"))
    return rows.where(F.col("predicted") != F.col("actual")).withColumn("error", kind).orderBy(key).limit(most)


def answer_flags(text: Column) -> Column:
    """safety and vagueness violations of an answer, whether it refuses and whether it names content that isn't in the law."""
    low = F.lower(text)
    return F.struct(holds_any(low, SAFETY).alias("safety"), holds_any(low, VAGUE).alias("vagueness"), holds_any(low, REFUSING).alias("refusal"), holds_any(low, INVENTED).alias("hallucination"))


def judge_reply(text: Column, verdict: str = "GROUNDED") -> Column:
    """ok, score and reasoning that a judge's reply names; false, 0.5 and a note where it doesn't."""
    found = F.upper(F.regexp_extract(text, rf"(?i){verdict}:\s*(YES|NO)", 1))
    score = F.regexp_extract(text, r"SCORE:\s*([\d.]+)", 1).try_cast("double")
    reason = F.nullif(F.regexp_extract(text, r"(?s)REASONING:\s*(.+)", 1), F.lit(""))
    return F.struct((F.coalesce(found, F.lit("")) == "YES").alias("ok"), F.coalesce(score, F.lit(0.5)).alias("score"), F.coalesce(stripped(reason), F.lit("Could not parse evaluation")).alias("reasoning"))


def capped(ok: Column, score: Column, hallucination: Column) -> Column:
    """ok and score of a judged answer: one that hallucinates isn't grounded and has 0.3 at most."""
    both = ok & hallucination
    return F.struct((ok & ~hallucination).alias("ok"), F.when(both, F.least(score, F.lit(0.3))).otherwise(score).alias("score"))


def generation_metrics(rows: DataFrame) -> DataFrame:
    """One row about rows (score, grounded, hallucination, refusal, refusal_score, which is null where none was judged)."""
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    count = lambda x: F.coalesce(F.sum(F.col(x).cast("int")), F.lit(0))
    return rows.agg(
        mean("score").alias("avg_groundedness_score"),
        mean(F.col("hallucination").cast("int")).alias("hallucination_rate"),
        mean(F.col("refusal").cast("int")).alias("refusal_rate"),
        mean(F.when(F.col("refusal"), F.col("refusal_score"))).alias("refusal_precision"),
        F.count("*").alias("total_samples"),
        count("grounded").alias("grounded_responses"),
        count("hallucination").alias("hallucinated_responses"),
        count("refusal").alias("refused_responses"),
    )


def quality(text: Column) -> Column:
    """A heuristic judge's score of a response, 0 to 1: length, numbers, legal words and variety; 0 for texts without words."""
    low = F.lower(text)
    add = lambda ok, value: F.when(ok, F.lit(value)).otherwise(F.lit(0.0))
    score = once(
        tokens(text),
        lambda w: add(F.length(text).between(50, 500), 0.3) + add(text.rlike(r"\b\d+\b"), 0.2) + add(holds_any(low, JUDGED_TERMS), 0.3) + add(F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)) > 0.6, 0.2),
    )
    return F.when(F.size(tokens(text)) == 0, F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))


def training_report(rows: DataFrame, key: str, most: int = 30) -> DataFrame:
    """One row about the first `most` rows (response, gold) by key: citation matches, judge, length and form."""
    some = rows.orderBy(key).limit(most)
    cited = F.array_distinct(F.regexp_extract_all("response", F.lit(citations.CANONICAL), F.lit(1)))
    exact, partial = metrics.exact_match(cited, F.col("gold"))
    form = holds_any(F.lower("response"), FORM_TERMS).cast("int")
    scored = some.select(exact.alias("e"), partial.alias("p"), quality(F.col("response")).alias("j"), F.length("response").alias("n"), form.alias("f"))
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    out = scored.agg(mean("e").alias("citation_exact_match"), mean("p").alias("citation_partial_match"), mean("j").alias("avg_judge_score"), mean("n").alias("response_length_avg"), mean("f").alias("valid_json_rate"), F.count("*").alias("total_examples"))
    same = F.col("citation_partial_match")
    return out.select("*", same.alias("citation_precision"), same.alias("citation_recall"), citation_f1(same, same).alias("citation_f1_score"))


def citation_f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def judged_reward(response: Column, gold: Column, valid: Column) -> Column:
    """The components of the first reward and their sum: known citations, grounding, the gold section (none if null), inventions, policy."""
    low = F.lower(response)

    def of(found: Column) -> Column:
        ok = {
            "citations": F.size(F.array_intersect(found, valid)) > 0,
            "grounding": holds_any(low, citations.LEGAL_TERMS),
            "gold_section": F.coalesce(F.array_contains(found, gold), F.lit(False)),
            "hallucination": holds_any(low, REWARD_INVENTED) | (F.size(F.array_except(found, valid)) > 0),
            "policy_violation": holds_any(low, SAFETY),
        }
        parts = {k: F.when(x, F.lit(WEIGHTS[k])).otherwise(F.lit(0.0)) for k, x in ok.items()}
        return F.struct(*(x.alias(k) for k, x in parts.items()), reduce(lambda a, b: a + b, parts.values()).alias("total"))

    return once(citations.extracted(response), of)


def em_probe(rows: DataFrame, valid: Column) -> DataFrame:
    """step, avg_em and num_prompts of rows (step, response): the share of responses that cite a known section."""
    hit = (F.size(F.array_intersect(citations.extracted(F.col("response")), valid)) > 0).cast("double")
    return rows.groupBy("step").agg(F.avg(hit).alias("avg_em"), F.count("*").alias("num_prompts"))


def ppo_advice(average: Column, high: Column, low: Column, failed: Column) -> Column:
    """Advice on a run with this average reward, these shares of good and bad answers, and whether it failed."""
    rules = {"negative": average < 0, "few_good": high < 0.6, "many_bad": low > 0.3, "aligned": average > 1, "error": failed}
    some = F.array_compact(F.array(*(F.when(ok, F.lit(PPO_ADVICE[k])) for k, ok in rules.items())))
    return once(some, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(PPO_ADVICE["none"]))))


def dpo_advice(wins: Column, exact: Column, unsafe: Column) -> Column:
    """Advice on a run with this win rate, citation match and share of unsafe answers."""
    tell = lambda k: F.lit(DPO_ADVICE[k])
    return F.array_compact(
        F.array(
            F.when(wins < 0.6, tell("low_wins")).when(wins > 0.8, tell("high_wins")),
            F.when(exact < 0.5, tell("low_citations")).when(exact > 0.8, tell("high_citations")),
            F.when(unsafe > 0.1, tell("unsafe")).otherwise(tell("safe")),
        )
    )


def aligned(series: list[DataFrame]) -> DataFrame:
    """One row for each step of several series (step, value), which are joined by step; what a series lacks is null."""
    return reduce(lambda a, b: a.join(b, "step", "full"), series)


def trailing_average(rows: DataFrame, by: str, order: str, value: str, widest: int = 5) -> DataFrame:
    """rows with `moving`: the mean over the last min(`widest`, n // 4) rows of `by`; null for groups of `widest` rows or fewer."""
    from pyspark.sql import Window

    sized = rows.withColumn("marlwork_n", F.count("*").over(Window.partitionBy(by)))
    out = F.lit(None).cast("double")
    ordered = Window.partitionBy(by).orderBy(order)
    for width in range(1, widest + 1):
        fits = F.least(F.lit(widest), F.floor(F.col("marlwork_n") / 4)) == width
        out = F.when(fits & (F.col("marlwork_n") > widest), F.avg(value).over(ordered.rowsBetween(1 - width, 0))).otherwise(out)
    return sized.withColumn("moving", out).drop("marlwork_n")
