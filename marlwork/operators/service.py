"""Small functions of the service: keys, texts, settings, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlwork.functions.text import once, stripped

#: Seconds that answers stay in the cache, by what they are. Fixed values.
TTL_SECONDS = {"refusal": 300, "insufficient": 900, "answer": 1800, "severance": 3600, "section": 7200, "embedding": 7200, "rerank": 7200}
#: Settings of the two models. Fixed values.
TIERS = {
    "small": {"max_tokens": 512, "temperature": 0.1, "top_p": 0.95, "timeout": 60.0, "quantization": "4bit"},
    "large": {"max_tokens": 1024, "temperature": 0.05, "top_p": 0.9, "timeout": 120.0, "quantization": "4bit"},
}
#: Reasons of a request, as the calculator names them. Fixed values.
REASONS = {"redundancy": "retrenchment", "dismissal_with_cause": "misconduct", "mutual_agreement": "mutual_consent", "resignation": "resignation", "retirement": "retirement"}
#: Characters that JSON writes in a short form, by UTF-16 code. Fixed values.
SHORT = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "000C": "\\f", "000A": "\\n", "000D": "\\r", "0009": "\\t"}


def json_text(text: Column) -> Column:
    """`text` as a JSON string of ASCII characters, in quotes."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))

    def written(u: Column) -> Column:
        short = F.coalesce(*(F.when(u == code, F.lit(x)) for code, x in SHORT.items()))
        plain = F.when((u >= "0020") & (u <= "007E"), F.char(F.conv(u, 16, 10).cast("int")))
        return F.coalesce(short, plain, F.concat(F.lit("\\u"), F.lower(u)))

    safe = text.rlike(r"^[ !#-\[\]-~]*$")
    return F.concat(F.lit('"'), F.when(safe, text).otherwise(F.array_join(F.transform(units, written), "")), F.lit('"'))


def json_number(x: Column) -> Column:
    """A double as JSON writes it: 5000.0, 0.5, 20000000.5; from 1e16 up and below 1e-4 with an exponent of two digits or more, as 1e+16 and 1e-05."""
    # Digits of the JVM, from 1e7 up and below 1e-3 with an exponent; it gives one digit too many at times.
    text = F.abs(x).cast("string")
    n = F.length(F.regexp_replace(F.regexp_replace(text, "E.*$", ""), r"^0?\.0*|\.", ""))
    shorter = F.call_function("format_string", F.concat(F.lit("%."), F.greatest(n - 2, F.lit(0)).cast("string"), F.lit("E")), F.abs(x))
    text = F.when(shorter.cast("double") == F.abs(x), F.when(F.abs(x).between(1e-3, 9999999.0), text).otherwise(shorter)).otherwise(text)
    digits, power = F.regexp_replace(F.regexp_replace(text, "E.*$", ""), r"\.", ""), F.coalesce(F.nullif(F.regexp_extract(text, r"E([-+]?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))

    def written(p: Column) -> Column:
        d, e = p["digits"], p["power"]
        short = F.when(F.rtrim(d, F.lit("0")) == "", F.lit("0")).otherwise(F.rtrim(d, F.lit("0")))
        large = F.concat(F.substring(F.rpad(d, 24, "0"), F.lit(1), e + 1), F.lit("."), F.coalesce(F.nullif(F.substring(short, e + 2, F.length(short)), F.lit("")), F.lit("0")))
        tiny = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), short)
        end = F.concat(F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(e).cast("string"), 2, "0"))
        end = F.when(F.abs(e) > 99, F.concat(F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.abs(e).cast("string"))).otherwise(end)
        far = F.concat(F.substring(short, 1, 1), F.when(F.length(short) > 1, F.concat(F.lit("."), F.substring(short, F.lit(2), F.length(short)))).otherwise(F.lit("")), end)
        return F.when(~p["exponent"], p["text"]).when((e >= 0) & (e < 16), large).when((e < 0) & (e >= -4), tiny).otherwise(far)

    parts = F.struct(text.alias("text"), digits.alias("digits"), power.alias("power"), F.contains(text, F.lit("E")).alias("exponent"))
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    return F.when(F.isnan(x), F.lit("NaN")).otherwise(F.concat(sign, once(parts, written)))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def query_key(query: Column, context_ids: Column, config_hash: Column, version: Column) -> Column:
    """The cache key of a query with its context, in any order, and settings; case and white space at the ends don't count."""
    ids = F.array_join(F.transform(F.array_sort(context_ids), json_text), ", ")
    body = F.concat(F.lit('{"config_hash": '), json_text(config_hash), F.lit(', "context_ids": ['), ids, F.lit('], "guardrails_version": '), json_text(version), F.lit(', "query": '), json_text(stripped(F.lower(query))), F.lit("}"))
    return F.concat(F.lit("query:"), short_hash(body))


def severance_key(wage: Column, years: Column, reason: Column, leave_days: Column) -> Column:
    body = F.concat(F.lit('{"annual_leave_days": '), F.coalesce(leave_days.cast("string"), F.lit("null")), F.lit(', "monthly_wage": '), json_number(wage), F.lit(', "termination_reason": '), json_text(reason), F.lit(', "years_of_service": '), json_number(years), F.lit("}"))
    return F.concat(F.lit("severance:"), short_hash(body))


def section_key(section: Column) -> Column:
    return F.concat(F.lit("section:"), section)


def model_key(*parts: Column) -> Column:
    """The cache key of an embedding (model, query) or of a rerank score (model, query, chunk)."""
    return short_hash(F.concat_ws(":", *parts))


def severance_summary(severance: Column, notice: Column, leave: Column, total: Column, formula: Column) -> Column:
    """The summary of a calculation in lines; null where there is no total."""
    amount = lambda name, x: F.concat(F.lit(f"{name}: RM "), F.format_number(x, 2))
    lines = [F.lit("SEVERANCE CALCULATION SUMMARY"), F.lit("=" * 35), amount("Severance Pay", severance), amount("Notice Pay", notice), amount("Annual Leave Pay", leave), amount("TOTAL COMPENSATION", total), F.lit(""), F.concat(F.lit("Formula Used: "), formula)]
    return F.when(total.isNotNull(), F.array_join(F.array(*lines), "\n"))


def calculator_reason(reason: Column) -> Column:
    """A request's reason as the calculator names it; null for reasons that it doesn't know."""
    low = F.lower(reason)
    return F.coalesce(*(F.when(low == k, F.lit(v)) for k, v in REASONS.items()))


def endpoint(path: Column) -> Column:
    """A request's path with its section id left out."""
    return F.when(path.startswith("/section/"), F.lit("/section/{section_id}")).otherwise(path)


def context_prompt(context: Column, question: Column) -> Column:
    """Numbered context blocks of (section_id, text) and the question."""
    block = lambda c, i: F.concat(F.lit("[Context "), (i + 1).cast("string"), F.lit("] Section: "), F.coalesce(c["section_id"], F.lit("N/A")), F.lit("\n"), c["text"], F.lit("\n\n"))
    blocks = F.array_join(F.transform(context, block), "")
    body = F.when(stripped(blocks) == "", F.lit("[No relevant context found]")).otherwise(blocks)
    return F.concat(F.lit("CONTEXT:\n"), body, F.lit("\n\nQUESTION: "), question)


def section_context(context: Column, most: int = 8) -> Column:
    """The first `most` chunks (section_id, text) as paragraphs that name their sections."""
    return F.array_join(F.transform(F.slice(context, 1, most), lambda c: F.concat(F.lit("Section "), F.coalesce(c["section_id"], F.lit("Unknown")), F.lit(": "), F.coalesce(c["text"], F.lit("")))), "\n\n")


def with_settings(rows: DataFrame, tier: str) -> DataFrame:
    """rows with the settings of the model that column `tier` names."""
    known = F.create_map(*(x for name, own in TIERS.items() for x in (F.lit(name), F.struct(*(F.lit(v).alias(k) for k, v in own.items())))))
    return rows.withColumn("settings", known[F.col(tier)])


def sections_named(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted's section_id with the chunk_id and text of the first chunk (by chunk_id) of that section; null where there is none."""
    first = chunks.groupBy("section_id").agg(F.min_by(F.struct("chunk_id", "text"), "chunk_id").alias("x"))
    return wanted.join(first, "section_id", "left").select("section_id", "x.chunk_id", "x.text")


def answer_response(answer: Column, citations: Column, confidence: Column, escalates: Column, flags: Column, cache_hit: Column) -> Column:
    """An answer as the service sends it; what is missing has its default."""
    return F.struct(
        F.coalesce(answer, F.lit("")).alias("answer"),
        F.coalesce(citations, F.array().cast("array<string>")).alias("citations"),
        F.coalesce(confidence, F.lit(0.5)).alias("confidence"),
        F.coalesce(escalates, F.lit(False)).alias("should_escalate"),
        F.coalesce(flags, F.array().cast("array<string>")).alias("safety_flags"),
        F.coalesce(cache_hit, F.lit(False)).alias("cache_hit"),
    )


def health(rag_ready: Column, indices_ok: Column) -> Column:
    return F.when(F.coalesce(rag_ready & indices_ok, F.lit(False)), F.lit("ok")).otherwise(F.lit("degraded"))


def confidence_color(confidence: Column) -> Column:
    return F.when(confidence > 0.8, F.lit("green")).when(confidence > 0.5, F.lit("orange")).otherwise(F.lit("red"))


def cache_stats(requests: DataFrame, by: str | None = None) -> DataFrame:
    """hits, misses and hit_rate (0 without requests) of requests (hit), in all or by a column."""
    grouped = requests.groupBy(by) if by else requests.groupBy()
    count = lambda ok: F.coalesce(F.sum(F.when(ok, 1).otherwise(0)), F.lit(0))
    out = grouped.agg(count(F.col("hit")).alias("hits"), count(~F.col("hit")).alias("misses"))
    return out.withColumn("hit_rate", F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)))


def key_usage(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """key_id, is_active, usage_count and last_used of keys (key_id, secret_hash, is_active); requests (secret, ts) name their key by its hash."""
    used = requests.groupBy(F.sha2("secret", 256).alias("secret_hash")).agg(F.count("*").alias("usage_count"), F.max("ts").alias("last_used"))
    return keys.join(used, "secret_hash", "left").select("key_id", "is_active", F.coalesce("usage_count", F.lit(0)).alias("usage_count"), "last_used")


def client_metrics(calls: DataFrame, by: str) -> DataFrame:
    """Counts of calls (ok) and two error rates: failed by successful calls, as clients report it, and failed by all."""
    failed = F.coalesce(F.sum(F.when(F.col("ok"), 0).otherwise(1)), F.lit(0))
    good = F.coalesce(F.sum(F.when(F.col("ok"), 1).otherwise(0)), F.lit(0))
    out = calls.groupBy(by).agg(good.alias("total_requests"), failed.alias("failed_requests"))
    rate = lambda n: F.coalesce(F.try_divide(F.col("failed_requests"), n), F.lit(0.0))
    return out.select(by, "total_requests", "failed_requests", rate(F.col("total_requests")).alias("error_rate"), rate(F.col("total_requests") + F.col("failed_requests")).alias("failure_share"))


def search_settings(final: Column, least_chunks: Column) -> Column:
    """How many hits a search returns: the wanted number or the least number of chunks, whichever is more; the first must be 1 to 20, the other 1 to the first."""
    ok = final.between(1, 20) & least_chunks.between(1, final)
    return once(ok, lambda good: F.when(good, F.greatest(final, least_chunks)))


def search_section(section: Column) -> Column:
    """A section id as the search writes it: upper case, SECTION n as EA-n, no space behind the dash."""
    up = F.upper(stripped(section))
    named = F.when(up.startswith("SECTION "), F.concat(F.lit("EA-"), F.substring(up, 9, 1000))).otherwise(up)
    return F.replace(named, F.lit("EA- "), F.lit("EA-"))
