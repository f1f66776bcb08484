"""The queries over the tables, and their SQL. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlwork.functions.text import hits, tokens, word_f1
from marlwork.operators import answers, calculator, cells, chunking, governance, keywords, metrics, questions, search, segments, training
from marlwork.plans import oracle, service_oracle, service_queries, training_oracle, training_queries
from marlwork.sources.durable import fresh_folder, kept
from marlwork.sources.ranges import dealt
from marlwork.streaming import reuse, serving

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    _queries[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    """query_id and text of each benchmark item."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query
def bm25_index_stats(spark, d):
    return search.term_weights(table(spark, d, "documents")).select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(spark, d):
    return search.bm25(table(spark, d, "documents"), search_queries(spark, d))


@query
def bm25_stored(spark, d):
    """As bm25_topk, from an index that is stored in the shared folder and read by term."""
    where = fresh_folder(spark, "index")
    search.write_index(table(spark, d, "documents"), where)
    return search.found(search.read_index(spark, where), search_queries(spark, d))


@query
def bm25_updated(spark, d):
    """As bm25_topk, from an index of two files, of which one was written anew after it was indexed with other and fewer texts."""
    docs, files, where = table(spark, d, "documents").select("doc_id", "text"), fresh_folder(spark, "files"), fresh_folder(spark, "index")
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    even.write.parquet(f"{files}/even")
    odd.where("doc_id % 5 > 0").withColumn("text", F.when(F.col("doc_id") % 3 > 0, F.col("text")).otherwise(F.concat(F.lit("once "), "text"))).write.parquet(f"{files}/odd")
    segments.update(spark, files, where)
    odd.write.mode("overwrite").parquet(f"{files}/odd")
    segments.update(spark, files, where)
    return search.found(segments.read(spark, where), search_queries(spark, d))


@query
def dense_cells(spark, d):
    """The nearest vectors of all cells, from an inverted file in the shared folder."""
    where, rows = fresh_folder(spark, "cells"), table(spark, d, "embeddings")
    n = cells.write_cells(rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), where, 20)
    wanted = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return cells.search_cells(spark, where, wanted, probes=n)


@query
def dense_topk(spark, d):
    rows = table(spark, d, "embeddings")
    wanted = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.dense(rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), wanted)


@query
def hybrid_topk(spark, d):
    docs, wanted, rows = table(spark, d, "documents"), search_queries(spark, d), table(spark, d, "embeddings")
    vectors = rows.join(wanted, rows["vec_id"] == wanted["query_id"]).select("query_id", F.col("embedding").alias("q"))
    near = search.dense(rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), vectors, 20)
    return search.hybrid(search.bm25(docs, wanted, 30), near, docs, wanted)


@query
def boosted_topk(spark, d):
    found = search.bm25(table(spark, d, "documents"), search_queries(spark, d), 20)
    docs = table(spark, d, "documents").select("doc_id", "source")
    raised = search.boosted(found.join(docs, "doc_id"), F.col("source").isin("src1", "src2"), 8)
    return raised.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query
def query_expand(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat_ws(" ", F.lit("annual leave salary"), "text").alias("q"))
    return rows.select("conv_id", "turn", F.size(search.expanded(F.col("q"))).alias("n"), F.md5(F.array_join(search.expanded(F.col("q")), "|")).alias("variants"))


@query
def chunk_documents(spark, d):
    return chunking.chunk(table(spark, d, "documents")).select("doc_id", "chunk_index", "chunk_id", "start_pos", "end_pos", "section_id", F.length("original_text").alias("length"))


@query
def chunk_stats(spark, d):
    return chunking.chunk_stats(chunk_documents(spark, d))


@query
def section_backfill(spark, d):
    cut = chunking.chunk(table(spark, d, "documents"))
    return chunking.backfill_sections(cut.select("doc_id", "chunk_index", "text", "section_id")).select("doc_id", "chunk_index", "section_id")


@query
def chunk_text(spark, d):
    return chunking.chunk(table(spark, d, "documents")).select("doc_id", "chunk_index", "section_title", "length", F.md5("text").alias("text"))


@query
def frames_removed(spark, d):
    """Documents as the pages of others, four each, their lines as blocks down the page."""
    lines = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("block_no", "text"))
    placed = lines.select("doc", "page", F.lit(100.0).alias("height"), (4.0 + 13 * (F.col("block_no") % 8)).alias("y0"), "block_no", "text")
    return chunking.without_repeated(placed).select("doc", F.md5("text").alias("text"))


@query
def labelled_documents(spark, d):
    return search.lookup(table(spark, d, "documents"), table(spark, d, "labels").where("quality = 1")).select("doc_id", "n_chars")


@query
def repeated_blocks(spark, d):
    lines = table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n", -1)).alias("text"))
    return chunking.repeated_blocks(lines)


@query
def clean_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(chunking.clean_lines(F.col("text"))).alias("cleaned"))


@query
def pii_scrub(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(governance.pii_kinds(text), ",").alias("kinds"), F.md5(governance.pii_masked(text)).alias("masked"))


@query
def pii_stats(spark, d):
    kinds = table(spark, d, "documents").select(F.explode(governance.pii_kinds(F.col("text"))).alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@query
def policy_classify(spark, d):
    rows = table(spark, d, "conversations").withColumn("q", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Should I hire a lawyer, is it a guarantee? "), "text")).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", governance.policy_category(F.col("q")).alias("category"), F.array_join(governance.policy_rules(F.col("q")), ",").alias("rules"))


@query
def policy_by_table(spark, d):
    """As policy_classify, with the policies as a table that is joined."""
    rows = table(spark, d, "conversations").withColumn("q", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Should I hire a lawyer, is it a guarantee? "), "text")).otherwise(F.col("text")))
    found = keywords.classified(rows, ["conv_id", "turn"], "q", keywords.policy_table(spark))
    return found.select("conv_id", "turn", "category", F.array_join("rules", ",").alias("rules"))


@query
def keyword_documents(spark, d):
    """In how many documents each longer word of the benchmark stands, also inside words."""
    words = table(spark, d, "benchmark").select(F.explode(tokens(F.col("text"))).alias("keyword")).where(F.length("keyword") >= 6)
    return keywords.held(table(spark, d, "documents"), ["doc_id"], "text", words).groupBy("keyword").agg(F.count("*").alias("documents"))


@query
def guardrail_report(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", governance.input_report(F.concat("text", F.when(F.col("conv_id") % 4 == 0, F.lit(" mail a.b@example.com")).otherwise(F.lit("")))).alias("r"))
    return rows.select("conv_id", "turn", F.array_join("r.flags", ",").alias("flags"), "r.decision", "r.confidence", F.md5("r.processed").alias("processed"))


@query
def answer_check(spark, d):
    k = F.col("p_partkey")
    cites = F.when(k % 4 == 0, F.lit("[]")).otherwise(F.lit('[{"section_id": "EA-60E", "snippet": "s"}]'))
    grade = F.when(k % 3 == 0, F.lit("sure")).otherwise(F.lit("high"))
    body = F.concat(F.lit('Here: {"answer": "'), F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("yes")), F.lit('", "citations": '), cites, F.lit(', "confidence": "'), grade, F.lit('", "should_escalate": false} end'))
    rows = table(spark, d, "part").select("p_partkey", F.when(k % 7 == 0, F.lit("no json")).otherwise(body).alias("body"))
    return rows.select("p_partkey", F.array_join(governance.answer_problems(F.col("body")), ",").alias("problems"))


@query
def token_usage(spark, d):
    rows = table(spark, d, "conversations").groupBy("role").agg(F.sum(F.size(tokens(F.col("text")))).alias("words"))
    return rows.select("role", F.floor(F.col("words") * 13 / 10).cast("long").alias("tokens"))


@query
def circuit_breaker(spark, d):
    return serving.circuit_breaker(table(spark, d, "events").withColumn("ok", F.col("event_id") % 3 == 0), "event_type", 5, 60).select("event_id", "state")


def cited(spark, d) -> DataFrame:
    """p_partkey and a sentence with citations."""
    key = F.col("p_partkey")
    text = F.concat(F.lit("Section EA-"), (key % 110).cast("string"), F.when(key % 3 == 0, F.lit("F")).otherwise(F.lit("")), F.lit(" applies; see Section "), (key % 7 + 57).cast("string"), F.lit(" and ea-60f."))
    return table(spark, d, "part").select("p_partkey", text.alias("sentence"))


@query
def citation_validate(spark, d):
    known = F.array(*(F.lit(f"EA-{n}") for n in (*range(2, 21), 25, 60, "60A", "60F", 77)))
    good, bad = governance.split_citations(F.col("sentence"), known)
    return cited(spark, d).select("p_partkey", F.array_join(good, ",").alias("valid"), F.array_join(bad, ",").alias("invalid"))


@query
def canonical_normalize(spark, d):
    key = F.col("p_partkey")
    form = F.when(key % 3 == 0, F.concat(F.lit("ea-"), (key % 90).cast("string"), F.lit("e"))).when(key % 3 == 1, F.concat(F.lit("EA-2022-"), (key % 90).cast("string"), F.lit("E(1)"))).otherwise(F.concat(F.lit("EA-"), (key % 90).cast("string"), F.lit("F(2)")))
    return table(spark, d, "part").select("p_partkey", governance.canonical(form).alias("section"))


@query
def citation_scores(spark, d):
    key = F.col("p_partkey")
    ids = lambda *xs: F.array_distinct(F.array(*(F.concat(F.lit("EA-"), x.cast("string")) for x in xs)))
    predicted, gold = ids(key % 5, key % 7), ids(key % 3, key % 5)
    (any_em, any_iou), (em, iou) = metrics.overlap_match(predicted, gold), metrics.exact_match(predicted, gold)
    return table(spark, d, "part").select("p_partkey", any_em.alias("overlap_em"), F.round(any_iou, 6).alias("overlap_iou"), em.alias("exact_em"), F.round(iou, 6).alias("exact_iou"))


@query
def numeric_validate(spark, d):
    key = F.col("o_orderkey")
    what = F.element_at(F.array(*(F.lit(x) for x in ("days of annual leave", "days of sick leave", "weeks of notice", "hours per day", "months maternity"))), (key % 5 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", governance.numeric_claim(F.concat(F.lit("You get "), (key % 100).cast("string"), F.lit(" "), what)).alias("c"))
    return rows.select("o_orderkey", "c.number", "c.unit", "c.category", "c.ok")


def judged_hits(spark, d) -> tuple[DataFrame, DataFrame]:
    """Hits that count as relevant where they share the source of the document with the query's id."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    gold = docs.join(search_queries(spark, d), F.col("doc_id") == F.col("query_id")).select("query_id", F.col("source").alias("gold"), F.lit(2).alias("n_gold"))
    found = bm25_topk(spark, d).join(docs, "doc_id").join(gold, "query_id")
    return found.select("query_id", "rank", (F.col("source") == F.col("gold")).alias("relevant")), gold.select("query_id", "n_gold")


@query
def retrieval_metrics(spark, d):
    return metrics.retrieval(*judged_hits(spark, d))


@query
def retrieval_summary(spark, d):
    rows = metrics.retrieval(*judged_hits(spark, d)).unpivot("query_id", None, "metric", "value")
    return rows.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query
def confusion_rollup(spark, d):
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id")
    predicted = F.size(hits(F.lower("text"), ["worthless", "pathetic", "stupid", "hate"])) > 0
    return metrics.confusion(labels.select("lang", predicted.alias("predicted"), (F.col("toxic") == 1).alias("actual")), "lang")


def turn_pairs(spark, d) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").withColumn("next", F.lead("text").over(order)).where("next is not null")


@query
def lexical_f1_pairs(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", F.round(word_f1(F.col("text"), F.col("next")), 6).alias("f1"))


@query
def win_rate(spark, d):
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = turn_pairs(spark, d).withColumn("before", F.lag("text").over(order)).where("before is not null")
    wins = (word_f1(F.col("text"), F.col("next")) > word_f1(F.col("text"), F.col("before"))).cast("int")
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(wins), 6).alias("win_rate"))


@query
def rewards(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", metrics.reward(F.col("text")).alias("reward"))


@query
def reward_moving_avg(spark, d):
    width = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, 0)
    return rewards(spark, d).select("conv_id", "turn", F.round(F.avg("reward").over(width), 6).alias("moving"))


@query
def reward_summary(spark, d):
    r = F.col("reward")
    count = lambda ok: F.sum(F.when(ok, 1).otherwise(0))
    return rewards(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(r), 6).alias("mean"), F.round(F.stddev_pop(r), 6).alias("deviation"), count(r > 0).alias("positive"), count(r == 0).alias("neutral"), count(r < 0).alias("negative"))


@query
def sft_stratified(spark, d):
    return training.stratified(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 100)


@query
def sft_split(spark, d):
    return training.isolated_split(table(spark, d, "documents").select("doc_id", "source"), "source").select("doc_id", "split")


@query
def stable_eval_subset(spark, d):
    rows = table(spark, d, "documents").select("doc_id", training.stable_id(F.col("doc_id").cast("string"), F.col("source"), F.col("lang")).alias("stable_id"))
    return rows.orderBy("stable_id").limit(30)  # a top-k report


@query
def leakage_check(spark, d):
    rows = training.isolated_split(table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("h")), "source")
    side = lambda x: rows.where(F.col("split") == x).select("h")
    return side("train").intersect(side("eval")).agg(F.count("*").alias("shared_texts"))


@query
def near_dup_pairs(spark, d):
    rows = table(spark, d, "benchmark").select(F.lit("all").alias("section"), "item_id", "text").unionByName(table(spark, d, "benchmark").select(F.lit("all").alias("section"), (F.col("item_id") + 1_000_000).alias("item_id"), F.concat("text", F.lit(" x")).alias("text")))
    return training.similar_pairs(rows, "section", "item_id", "text").select("a", "b", "similarity")


@query
def near_dup_kept(spark, d):
    rows = table(spark, d, "benchmark").select(F.lit("all").alias("section"), "item_id", "text")
    return training.keep_first_similar(rows, "section", "item_id", "text").select("item_id")


@query
def severance(spark, d):
    key = F.col("c_custkey")
    reasons = F.array(*(F.lit(x) for x in (*calculator.REASONS[:5], "unknown")))
    rows = table(spark, d, "customer").select("c_custkey", (F.abs("c_acctbal").cast("double") + 1).alias("wage"), (key % 12).cast("double").alias("years"), F.element_at(reasons, (key % 6 + 1).cast("int")).alias("reason"), (key % 20).alias("leave_days"), (key % 4 > 0).alias("notice"))
    return calculator.severance(rows).select("c_custkey", "severance", "notice_pay", "leave_pay", "total", "error")


@query
def model_routing(spark, d):
    k = F.col("conv_id")
    flags = F.when(k % 7 == 0, F.array(F.lit("guarantees"))).otherwise(F.array(F.lit("pii_masked")))
    sections = F.transform(F.sequence(F.lit(1), (k % 5 + 1).cast("int")), lambda i: F.concat(F.lit("EA-"), i.cast("string")))
    text = F.concat(F.when(k % 6 == 0, F.lit("A complex review with an exception? ")).otherwise(F.lit("")), "text")
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", governance.routing(text, F.array((k % 10) / 10, F.lit(0.1)), sections, flags, k % 9 == 0).alias("r"))
    return rows.select("conv_id", "turn", "r.tier", "r.threshold", F.array_join("r.signals", ",").alias("signals"), F.array_join("r.reasoning", "|").alias("reasoning"))


@query
def answer_confidence(spark, d):
    rows = bm25_topk(spark, d).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"] / 1000).alias("scores"))
    return rows.select("query_id", F.round(governance.confidence(F.col("scores"), F.col("query_id") % 2 == 0), 6).alias("confidence"))


@query
def json_extract(spark, d):
    rows = table(spark, d, "events").select("event_id", governance.json_object(F.concat(F.lit("Answer: "), "props", F.lit(" done."))).alias("body"))
    return rows.select("event_id", F.md5("body").alias("body"))


@query
def rate_limit(spark, d):
    return serving.rate_limited(table(spark, d, "events"), "event_type", 1).select("event_id", "allowed")


@query
def telemetry_minute(spark, d):
    rows = serving.minute_counts(table(spark, d, "events"), "event_type")
    return rows.select(F.floor(serving.micros("minute") / 1_000_000).cast("long").alias("minute"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def cache_replay_ttl(spark, d):
    return serving.ttl_cache(table(spark, d, "events"), "user_id", 3600).select("event_id", "hit")


@query
def active_requests(spark, d):
    return serving.active_requests(table(spark, d, "events"), "event_type", 60)


@query
def latest_events(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "event_type")  # a top-k report


@query
def changed_events(spark, d):
    return serving.changed(table(spark, d, "events"), "user_id", ("ts", "event_id"), "event_type").select("event_id", "user_id", "event_type")


@query
def output_report(spark, d):
    key = F.col("o_orderkey")
    ends = ("Take 12 days of annual leave.", "Take 90 days of annual leave.", "You should sue them.", "Expect triple compensation.", "Write to a.b@example.com.")
    text = F.concat(F.lit("Section "), (key % 30).cast("string"), F.lit(" says so. "), F.element_at(F.array(*map(F.lit, ends)), (key % 5 + 1).cast("int")))
    known = F.array(*(F.lit(f"EA-{n}") for n in range(25)))
    rows = table(spark, d, "orders").select("o_orderkey", answers.output_report(text, known).alias("r"))
    line = lambda x, name: F.array_join(x, ",").alias(name)
    return rows.select("o_orderkey", line("r.flags", "flags"), "r.decision", "r.confidence", line("r.escalation_reasons", "reasons"), line("r.rules", "rules"), F.md5("r.processed").alias("processed"))


@query
def query_flags(spark, d):
    text = F.concat(F.element_at(F.array(*map(F.lit, ("Shall I go to court? ", "Give me legal advice. ", "My mail is a.b@example.com. ", "So: "))), (F.col("conv_id") % 4 + 1).cast("int")), "text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", answers.query_flags(text, F.col("turn") % 3, "refuse").alias("r"))
    return rows.select("conv_id", "turn", F.array_join("r.flags", ",").alias("flags"), "r.refusal", F.md5(answers.refusal_message(F.col("r.refusal"), F.col("r.flags"))).alias("message"))


@query
def answer_repair(spark, d):
    k = F.col("p_partkey")
    cites = F.when(k % 3 == 0, F.lit("[]")).when(k % 3 == 1, F.lit('[{"section_id": "EA-60E"}, {"snippet": "own"}]')).otherwise(F.concat(F.lit('[{"section_id": "EA-9", "snippet": "'), F.repeat(F.lit("z"), 250), F.lit('"}]')))
    body = F.concat(F.lit('So: {"answer": "'), F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("yes")), F.lit('", "citations": '), cites, F.lit(', "confidence": "'), F.when(k % 4 == 0, F.lit("sure")).otherwise(F.lit("high")), F.lit('"} end'))
    context = F.when(k % 2 == 0, F.array(F.struct(F.lit("EA-60E").alias("section_id"), F.repeat(F.col("p_name"), 20).alias("text")), F.struct(F.lit("").alias("section_id"), F.lit("none").alias("text")))).otherwise(F.array().cast("array<struct<section_id:string,text:string>>"))
    rows = dealt(table(spark, d, "part")).select("p_partkey", answers.repaired(F.when(k % 7 == 0, F.lit("no json")).otherwise(body), context).alias("r"))
    listed = F.array_join(F.transform("r.citations", lambda c: F.concat_ws(":", c["section_id"], c["snippet"])), ";")
    return rows.select("p_partkey", "r.answer", F.md5(listed).alias("citations"), "r.confidence", "r.should_escalate")


@query
def sft_questions(spark, d):
    text, key = F.col("text"), F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", questions.kind(text, key).alias("category"), F.size(questions.claims(text)).alias("n_claims"), F.md5(questions.answer(text, F.col("source"))).alias("answer"))
    return rows.withColumn("question", questions.question(F.col("category"), key))


@query
def questions_by_table(spark, d):
    """The questions of sft_questions, with templates and words as tables that are joined."""
    rows = table(spark, d, "documents").select("doc_id", questions.kind(F.col("text"), F.col("doc_id")).alias("category"))
    return questions.asked(rows, "doc_id", "category", questions.template_table(spark), questions.word_table(spark))


@query
def token_stream(spark, d):
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    rows = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), tokens(F.col("text")).alias("tokens"), (F.col("conv_id") % 5 == 0).alias("failed"))
    return serving.token_stream(rows)


@query
def token_answers(spark, d):
    """Chunks put together again; those of some requests are lost on the way."""
    sent = token_stream(spark, d)
    return serving.answers_of(sent.where(~((F.col("request_id") % 11 == 3) & (F.col("seq") == 1))))


@query
def sliding_limit(spark, d):
    return serving.sliding_limited(table(spark, d, "events"), "event_type", 2, 600).select("event_id", "allowed")


@query
def cache_replay_lru(spark, d):
    return reuse.lru_cache(table(spark, d, "events"), "user_id", 20, 3600)


@query
def context_filter(spark, d):
    found = search.bm25(table(spark, d, "documents"), search_queries(spark, d), 12)
    return search.enough_context(found.withColumn("score", F.col("score") / 600)).select("query_id", "rank", "doc_id")


@query
def unique_instructions(spark, d):
    category = questions.kind(F.col("text"), F.col("doc_id"))
    rows = table(spark, d, "documents").select("doc_id", "source", category.alias("category"))
    rows = kept(rows.select("doc_id", "source", questions.question(F.col("category"), F.col("doc_id")).alias("question")))
    return training.told_apart(rows, "doc_id", "question", "source").select("doc_id", "question")


@query
def reward_normalised(spark, d):
    return metrics.normalised_rewards(rewards(spark, d), "reward").select("conv_id", "turn", F.round("normal", 6).alias("normal"))


@query
def duration_histogram(spark, d):
    return metrics.histogram(table(spark, d, "events"), "event_type", "value", [1, 5, 10, 50, 100])


@query
def failure_category(spark, d):
    begins = ("Pregnant and sick leave? ", "Can they fire me? ", "My visa? ", "Where? ", "Is salary advance due? ")
    text = F.concat(F.element_at(F.array(*map(F.lit, begins)), (F.col("conv_id") % 5 + 1).cast("int")), "text")
    found = F.array(F.concat(F.lit("EA-"), (F.col("turn") % 3 + 12).cast("string")), F.lit("EA-44"))
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", search.failure_category(text, found).alias("category"), F.array_join(search.priority_sections(text), ",").alias("sections"))


def queries() -> dict[str, Query]:
    return _queries | training_queries.QUERIES | service_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracle.all_sql() | training_oracle.all_sql() | service_oracle.all_sql()
