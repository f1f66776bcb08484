"""Queries of the service: keys, texts, settings, statistics, older guardrails. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlwork.functions.text import unique_ratio
from marlwork.operators import answers, calculator, chunking, governance, metrics, search, service
from marlwork.streaming import serving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def among(values, key) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


@query
def cache_keys(spark, d):
    odd = among(["", ' "quoted" \\ back\t', " é € 😀 \u0001"], F.col("turn"))
    ids = F.array(F.lit("doc2"), F.concat(F.lit("doc"), F.col("turn").cast("string")), F.lit("doc1"))
    key = service.query_key(F.concat(F.lit("  What "), "text", odd), ids, F.lit("abc"), F.lit("v1"))
    return table(spark, d, "conversations").select("conv_id", "turn", key.alias("key"), service.model_key(F.lit("model"), F.col("text")).alias("embedding_key"), service.section_key(F.col("role")).alias("section_key"))


def claims(spark, d) -> DataFrame:
    """c_custkey, wage, years, reason, leave_days, notice as the service takes them."""
    k = F.col("c_custkey")
    reason = among(["redundancy", "dismissal_with_cause", "dismissal_without_cause", "mutual_agreement", "Resignation"], k)
    return table(spark, d, "customer").select("c_custkey", (k % 90 * 100 + 1500).cast("double").alias("wage"), ((k % 24) / 2).alias("years"), reason.alias("asked"), F.when(k % 3 > 0, k % 20).alias("leave_days"), (k % 4 > 0).alias("notice"))


@query
def severance_keys(spark, d):
    return claims(spark, d).select("c_custkey", service.severance_key(F.col("wage"), F.col("years"), F.col("asked"), F.col("leave_days")).alias("key"))


@query
def severance_summary(spark, d):
    rows = claims(spark, d).withColumn("reason", service.calculator_reason(F.col("asked"))).withColumn("leave_days", F.coalesce("leave_days", F.lit(0)))
    rows = calculator.severance(rows.withColumn("reason", F.coalesce("reason", F.lit("unmapped"))))
    text = service.severance_summary(F.col("severance"), F.col("notice_pay"), F.col("leave_pay"), F.col("total"), F.lit("days x years x wage / 30"))
    return rows.select("c_custkey", "error", F.md5(text).alias("summary"))


@query
def endpoint_counts(spark, d):
    path = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("/section/EA-"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("/api/v1/"), "event_type"))
    return table(spark, d, "events").groupBy(service.endpoint(path).alias("endpoint")).agg(F.count("*").alias("n"))


@query
def prompts(spark, d):
    chunk = lambda section, text: F.struct(section.alias("section_id"), text.alias("text"))
    context = F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<struct<section_id:string,text:string>>")).otherwise(F.array(chunk(F.lit("EA-60E"), F.col("role")), chunk(F.lit(None).cast("string"), F.col("text"))))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(service.context_prompt(context, F.col("text"))).alias("prompt"), F.md5(service.section_context(context, 8)).alias("paragraphs"))


@query
def tier_settings(spark, d):
    rows = table(spark, d, "conversations").groupBy(F.when(F.col("conv_id") % 4 == 0, "large").otherwise("small").alias("tier")).agg(F.count("*").alias("n"))
    return service.with_settings(rows, "tier").select("tier", "n", "settings.max_tokens", "settings.temperature", "settings.top_p", "settings.timeout", "settings.quantization")


@query
def section_lookup(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("EA-"), (F.col("doc_id") % 31).cast("string")).alias("section_id"), "text")
    wanted = spark.range(40).select(service.search_section(F.concat(F.lit(" section "), F.col("id").cast("string"))).alias("section_id"))
    return service.sections_named(chunks, wanted).select("section_id", "chunk_id", F.md5("text").alias("text"))


@query
def answer_responses(spark, d):
    k = F.col("p_partkey")
    made = service.answer_response(F.when(k % 2 == 0, F.col("p_name")), F.when(k % 3 == 0, F.array(F.lit("EA-1"))), F.when(k % 5 > 0, (k % 10) / 10), F.when(k % 7 == 0, F.lit(True)), F.when(k % 4 == 0, F.array(F.lit("pii_masked"))), F.when(k % 6 == 0, F.lit(True)))
    rows = table(spark, d, "part").select("p_partkey", made.alias("r"))
    listed = lambda x: F.array_join(x, ",")
    return rows.select("p_partkey", "r.answer", listed("r.citations").alias("citations"), "r.confidence", "r.should_escalate", listed("r.safety_flags").alias("flags"), "r.cache_hit", service.confidence_color(F.col("r.confidence")).alias("color"), service.health(k % 3 > 0, F.when(k % 5 > 0, F.lit(True))).alias("health"))


@query
def cache_statistics(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type"), (F.col("event_id") % 3 == 0).alias("hit"))
    return service.cache_stats(rows, "event_type").withColumn("hit_rate", F.round("hit_rate", 6))


@query
def key_usage(spark, d):
    secret = lambda x: F.concat(F.lit("key-"), x.cast("string"))
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("key_id"), F.sha2(secret(F.col("c_custkey")), 256).alias("secret_hash"), (F.col("c_custkey") % 5 > 0).alias("is_active"))
    used = service.key_usage(keys, table(spark, d, "events").select(secret(F.col("user_id")).alias("secret"), "ts"))
    return used.select("key_id", "is_active", "usage_count", F.floor(serving.micros("last_used") / 1_000_000).cast("long").alias("last_used"))


@query
def client_metrics(spark, d):
    rows = service.client_metrics(table(spark, d, "events").select("event_type", (F.col("event_id") % 4 > 0).alias("ok")), "event_type")
    return rows.withColumn("error_rate", F.round("error_rate", 6)).withColumn("failure_share", F.round("failure_share", 6))


@query
def search_settings(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", service.search_settings((k % 23).cast("int"), (k % 9).cast("int")).alias("hits"))


@query
def queries_in_scope(spark, d):
    text = F.concat(among(["My visa? ", "A divorce? ", "Annual leave? ", "Commission: "], F.col("conv_id")), "text")
    return search.in_scope(table(spark, d, "conversations").select("conv_id", "turn", text.alias("query"))).select("conv_id", "turn")


@query
def legacy_guardrails(spark, d):
    text = F.concat(among(["Hire a lawyer? ", "Mail a.b@example.com: ", "My IC is 900101-14-5678. ", "I promise triple compensation. ", ""], F.col("conv_id")), "text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", governance.legacy_input(text).alias("i"), governance.legacy_input(text, "refuse").alias("r"), answers.legacy_output(text).alias("o"))
    listed = lambda x, name: F.array_join(x, ",").alias(name)
    return rows.select("conv_id", "turn", F.col("i.passed").alias("in_passed"), "i.confidence", listed("i.rules", "in_rules"), F.md5("i.processed").alias("processed"), F.col("r.passed").alias("strict_passed"), F.col("o.passed").alias("out_passed"), listed("o.rules", "out_rules"))


@query
def guardrail_statistics(spark, d):
    text = F.concat(among(["Hire a lawyer? ", "Mail a.b@example.com: ", ""], F.col("conv_id")), "text")
    rows = table(spark, d, "conversations").select((governance.policy_category(text).isNotNull()).alias("policy"), (F.size(governance.pii_kinds(text)) > 0).alias("personal"))
    out = governance.guardrail_stats(rows.withColumn("refused", F.col("policy")))
    return out.withColumn("refusal_rate", F.round("refusal_rate", 6)).withColumn("pii_detection_rate", F.round("pii_detection_rate", 6))


def plain_answers(spark, d) -> DataFrame:
    """p_partkey, a plain answer as JSON text, right or wrong in many ways, and its context."""
    k = F.col("p_partkey")
    cites = among(["[]", '[{"section_id": "EA-60E", "snippet": "s"}]', '[{"section_id": "EA-9"}]', '"none"'], k)
    body = F.concat(F.lit('{"answer": '), among(['"yes"', "5"], F.floor(k / 4)), F.lit(', "citations": '), cites, F.lit(', "confidence": '), among(["0.9", "1", "1.5", '"high"', "0.2"], k), F.lit(', "should_escalate": '), among(["false", "true", "1"], k), F.lit("}"))
    chunk = lambda section, text: F.struct(F.lit(section).alias("section_id"), text.alias("text"))
    context = F.array(chunk("N/A", F.col("p_name")), chunk("EA-60E", F.repeat(F.col("p_name"), 20)), chunk("EA-7", F.col("p_name")), chunk("EA-8", F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", F.when(k % 11 == 0, "no json").otherwise(body).alias("body"), context.alias("context"))


@query
def plain_formats(spark, d):
    rows = plain_answers(spark, d)
    return rows.select("p_partkey", answers.plain_format(F.col("body")).alias("ok"), answers.plain_format(answers.plain_body(F.concat(F.lit(" So: "), "body"))).alias("found"))


@query
def citation_backfill(spark, d):
    good = F.when(F.col("p_partkey") % 2 == 0, F.lit('{"answer": "yes", "citations": [], "confidence": 0.25}')).otherwise(F.lit('{"answer": "yes", "citations": [{"section_id": "EA-7", "snippet": "s"}, {"section_id": "EA-1", "snippet": "t"}], "confidence": 0.9, "safety_flags": ["x"]}'))
    rows = plain_answers(spark, d).select("p_partkey", "context", answers.backfilled(F.when(F.col("body") == "no json", F.col("body")).otherwise(good), F.col("context")).alias("r"))
    cited = F.array_join(F.transform("r.citations", lambda c: answers.displayed(c["section_id"], c["snippet"])), ";")
    return rows.select("p_partkey", F.md5(cited).alias("citations"), F.round("r.confidence", 6).alias("confidence"), F.array_join("r.safety_flags", ",").alias("flags"), answers.against_context(F.col("r.citations"), F.col("context"))["accuracy"].alias("accuracy"))


@query
def cache_replay_tiers(spark, d):
    return serving.tiered_cache(table(spark, d, "events"), "user_id", 7200, 1800).select("event_id", "tier")


@query
def address_limit(spark, d):
    return serving.rate_limited(table(spark, d, "events"), "user_id", 10).select("event_id", "allowed")


@query
def cache_lifetimes(spark, d):
    known = F.create_map(*(F.lit(x) for pair in service.TTL_SECONDS.items() for x in pair))
    kind = among(list(service.TTL_SECONDS), F.col("event_id"))
    return table(spark, d, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).withColumn("ttl", known[F.col("kind")])


@query
def corpus_report(spark, d):
    chunks = chunking.chunk(table(spark, d, "documents"))
    return chunking.corpus_report(table(spark, d, "documents"), chunks, table(spark, d, "embeddings"))


@query
def reward_rates(spark, d):
    rows = table(spark, d, "conversations").where("role = 'assistant'").select(metrics.reward(F.col("text")).alias("reward"))
    return metrics.reward_rates(rows, "reward")


@query
def lexical_diversity(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(unique_ratio(F.col("text")), 6).alias("ratio"), (unique_ratio(F.col("text")) > 0.6).alias("varied"))


@query
def all_numeric_claims(spark, d):
    k, gap = F.col("o_orderkey"), F.lit(" " + "." * 60 + " ")
    text = F.concat(F.lit("Take "), (k % 100).cast("string"), F.lit(" days of annual leave"), gap, (k % 20).cast("string"), F.lit(" weeks notice"), gap, F.lit("8 hours per day"), gap, (k % 5).cast("string"), F.lit(" times the rate."))
    rows = table(spark, d, "orders").select("o_orderkey", F.posexplode(governance.numeric_claims(text)).alias("i", "c"))
    return rows.select("o_orderkey", "i", "c.number", "c.unit", "c.category", "c.ok")
