"""The numbered queries: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlwork.llm import ann, bpe, chat, html, langid, licenses, lm, oracle, packing, phrases, quality, runs, secrets, simhash
from marlwork.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("removed_words", "text_hash")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encoding_digests(bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.windows(turns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), lm.learned(F.col("doc_id")))
    return scored.withColumns({"held_out": lm.held_out(F.col("doc_id")), **{x: F.round(x, 6) for x in ("base_score", "score")}})


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.scan(table(spark, sf_dir, "documents"), rewrite=runs.looped))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_quality_rules, op3_packing, op4_bpe, op5_license_scan, op6_html_extract, op7_ann, op8_language, op9_chat_format, op10_simhash, op11_lm_score, op12_phrases, op13_runs, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    found = {
        "op1_secret_scan": oracle.secrets_sql(),
        "op2_quality_rules": oracle.quality_sql(),
        "op5_license_scan": oracle.licenses_sql(),
        "op9_chat_format": oracle.chat_sql(),
        "op11_lm_score": oracle.lm_sql(),
        "op12_phrases": oracle.phrases_sql(),
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
