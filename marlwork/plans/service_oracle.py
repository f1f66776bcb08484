"""The queries of service_queries in DuckDB SQL, and the replays of the registry."""

from __future__ import annotations

from marlwork.operators import answers, governance, search, service
from marlwork.plans.oracle import CHUNKS, any_of, listing, q, rewarding, words


def among(values, key: str) -> str:
    return f"{listing(values)}[{key} % {len(values)} + 1]"


def json_text(x: str) -> str:
    """A JSON string in ASCII, character by character."""
    unit = "'\\u' || lpad(lower(hex({})), 4, '0')"
    short = " ".join(f"WHEN chr({int(code, 16)}) THEN {q(text)}" for code, text in service.SHORT.items())
    high, low = unit.format("(55296 + (ord(c) - 65536) // 1024)::INT"), unit.format("(56320 + (ord(c) - 65536) % 1024)::INT")
    one = f"CASE c {short} ELSE CASE WHEN ord(c) BETWEEN 32 AND 126 THEN c WHEN ord(c) < 65536 THEN {unit.format('ord(c)')} ELSE {high} || {low} END END"
    return f"'\"' || array_to_string(list_transform(string_split({x}, ''), lambda c: {one}), '') || '\"'"


def kinds(x: str, rows) -> str:
    names = {"phone_malaysia": "phone_my"}
    return ", ".join(f"CASE WHEN regexp_matches({x}, {q(p)}) THEN 'pii_{names.get(n, n)}_masked' END" for n, p, _ in rows)


def legacy() -> str:
    begins = ["Hire a lawyer? ", "Mail a.b@example.com: ", "My IC is 900101-14-5678. ", "I promise triple compensation. ", ""]
    some, low = governance.PII[:3], "lower(t)"
    policy = " OR ".join(any_of(low, ws) for ws in governance.LEGACY_POLICIES.values())
    said = "CASE " + " ".join(f"WHEN {any_of(low, ws)} THEN {q(governance.LEGACY_TEMPLATES[n])}" for n, ws in governance.LEGACY_POLICIES.items()) + " END"
    rules = ", ".join(f"CASE WHEN contains({low}, {q(w)}) THEN {q('policy_' + n + '_' + w.replace(' ', '_'))} END" for n, ws in governance.LEGACY_POLICIES.items() for w in ws)
    mask = "t"
    for _, pattern, mark in some:
        mask = f"regexp_replace({mask}, {q(pattern)}, {q(mark)}, 'g')"
    return f"""WITH a AS (SELECT conv_id, turn, {among(begins, 'conv_id')} || text AS t FROM conversations), b AS (SELECT *, {policy} AS p, list_filter([{kinds('t', some)}], lambda z: z IS NOT NULL) AS k, list_filter([{rules}], lambda z: z IS NOT NULL) AS r FROM a),
c AS (SELECT *, list_concat(list_filter([CASE WHEN {any_of(low, answers.LEGACY_HALLUCINATIONS)} THEN 'output_hallucination' END, CASE WHEN {any_of(low, answers.ADVICE)} THEN 'output_inappropriate_advice' END], lambda z: z IS NOT NULL), k) AS o FROM b)
SELECT conv_id, turn, NOT p AS in_passed, CASE WHEN p THEN 0.9 WHEN len(k) > 0 THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence, array_to_string(CASE WHEN p THEN r ELSE k END, ',') AS in_rules, md5(CASE WHEN p THEN {said} ELSE {mask} END) AS processed,
  NOT p AND len(k) = 0 AS strict_passed, len(o) = 0 AS out_passed, array_to_string(o, ',') AS out_rules FROM c"""


def guard_stats() -> str:
    hit = " OR ".join(any_of("lower(t)", ws) for ws in governance.POLICIES.values())
    personal = " OR ".join(f"regexp_matches(t, {q(p)})" for _, p, _ in governance.PII)
    return f"""WITH a AS (SELECT {among(['Hire a lawyer? ', 'Mail a.b@example.com: ', ''], 'conv_id')} || text AS t FROM conversations), b AS (SELECT {hit} AS p, {personal} AS i FROM a)
SELECT count(*) AS total_processed, count(*) FILTER (p) AS policy_violations, count(*) FILTER (i AND NOT p) AS pii_detections, count(*) FILTER (p) AS refusals, count(*) FILTER (i AND NOT p) AS maskings, round(avg(p::INT), 6) AS refusal_rate, round(avg((i AND NOT p)::INT), 6) AS pii_detection_rate FROM b"""


def replay(key: str, first: str, then: str, shown: str) -> str:
    """A fold over each key's events in the order of time and id: `first` is the first event's state, `then` the next from s (the one before) and e (the event)."""
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY us, event_id) AS n FROM (SELECT event_id, coalesce({key}::VARCHAR, '') AS {key}, epoch_us(ts) AS us FROM events)),
s AS (SELECT e.{key}, e.n, e.event_id, {first} FROM e WHERE n = 1 UNION ALL SELECT e.{key}, e.n, e.event_id, {then} FROM s JOIN e ON e.{key} = s.{key} AND e.n = s.n + 1)
SELECT event_id, {shown} FROM s"""


def severing() -> str:
    reason = "CASE c_custkey % 5 WHEN 0 THEN 'retrenchment' WHEN 1 THEN 'misconduct' WHEN 3 THEN 'mutual_consent' WHEN 4 THEN 'resignation' END"
    line = lambda name, x: f"'{name}: RM ' || format('{{:,.2f}}', {x})"
    total = " || chr(10) || ".join(["'SEVERANCE CALCULATION SUMMARY'", q("=" * 35), line("Severance Pay", "a"), line("Notice Pay", "b"), line("Annual Leave Pay", "c"), line("TOTAL COMPENSATION", "t"), "''", "'Formula Used: days x years x wage / 30'"])
    return f"""WITH a AS (SELECT c_custkey, (c_custkey % 90 * 100 + 1500)::DOUBLE AS w, (c_custkey % 24) / 2 AS y, {reason} AS r, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 20 ELSE 0 END AS d, c_custkey % 4 > 0 AS n FROM customer),
b AS (SELECT c_custkey, r, CASE WHEN r = 'retrenchment' THEN CASE WHEN y < 1 THEN 0.0 WHEN y < 2 THEN 10.0 WHEN y <= 5 THEN 15.0 ELSE 20.0 END::DOUBLE * y * w / 30 ELSE 0.0 END AS s, CASE WHEN n AND r <> 'misconduct' THEN CASE WHEN y < 2 THEN 4.0 WHEN y <= 5 THEN 6.0 ELSE 8.0 END::DOUBLE * w / 4.33::DOUBLE ELSE 0.0 END AS m, CASE WHEN d > 0 THEN d * w / 30 ELSE 0.0 END AS l FROM a),
c AS (SELECT c_custkey, r, floor(s * 100 + 0.5::DOUBLE) / 100 AS a, floor(m * 100 + 0.5::DOUBLE) / 100 AS b, floor(l * 100 + 0.5::DOUBLE) / 100 AS c, floor((s + m + l) * 100 + 0.5::DOUBLE) / 100 AS t FROM b)
SELECT c_custkey, CASE WHEN r IS NULL THEN 'reason' END AS error, CASE WHEN r IS NOT NULL THEN md5({total}) END AS summary FROM c"""


def claiming() -> str:
    """All claims of a fixed sentence, by rule and place."""
    rules = [
        ("o_orderkey % 100", "day", "annual_leave", "o_orderkey % 100 BETWEEN 8 AND 60"),
        ("o_orderkey % 20", "week", "notice_period", "o_orderkey % 20 BETWEEN 1 AND 16"),
        ("8", "hour", "daily_hours", "true"),
    ]
    order = [rules[0], rules[1], rules[2], rules[0], rules[1], rules[2]]
    return " UNION ALL ".join(f"SELECT o_orderkey, {i} AS i, ({n})::DOUBLE AS number, '{u}' AS unit, '{c}' AS category, ({ok})::BOOLEAN AS ok FROM orders" for i, (n, u, c, ok) in enumerate(order))


def all_sql() -> dict[str, str]:
    odd = "CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN ' \"quoted\" \\ back' || chr(9) ELSE ' é € 😀 ' || chr(1) END"
    query = f"regexp_replace(lower('  What ' || text || {odd}), '^[\\s]+|[\\s]+$', '', 'g')"
    ids = "list_sort(['doc2', 'doc' || turn, 'doc1'])"
    body = f"'{{\"config_hash\": \"abc\", \"context_ids\": [' || array_to_string(list_transform({ids}, lambda z: '\"' || z || '\"'), ', ') || '], \"guardrails_version\": \"v1\", \"query\": ' || {json_text(query)} || '}}'"
    asked = among(["redundancy", "dismissal_with_cause", "dismissal_without_cause", "mutual_agreement", "Resignation"], "c_custkey")
    sev = f"'{{\"annual_leave_days\": ' || CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 20)::VARCHAR ELSE 'null' END || ', \"monthly_wage\": ' || (c_custkey % 90 * 100 + 1500) || '.0, \"termination_reason\": \"' || {asked} || '\", \"years_of_service\": ' || ((c_custkey % 24) / 2)::DOUBLE || '}}'"
    context = "'[Context 1] Section: EA-60E' || chr(10) || role || chr(10) || chr(10) || '[Context 2] Section: N/A' || chr(10) || text || chr(10) || chr(10)"
    setting = lambda name, kind: "CASE tier " + " ".join(f"WHEN '{k}' THEN {q(v[name]) if kind == 'VARCHAR' else v[name]}" for k, v in service.TIERS.items()) + f" END::{kind} AS {name}"
    form = "p_partkey % 11 > 0 AND p_partkey // 4 % 2 = 0 AND p_partkey % 4 < 2 AND p_partkey % 5 IN (0, 1, 4) AND p_partkey % 3 < 2"
    name150 = "CASE WHEN length(repeat(p_name, 20)) > 150 THEN repeat(p_name, 20)[1:150] || '...' ELSE repeat(p_name, 20) END"
    shown = lambda section, x: f"'[{section}] ' || CASE WHEN length({x}) > 100 THEN ({x})[1:97] || '...' ELSE {x} END"
    hour = 3_600_000_000
    return {
        "cache_keys": f"SELECT conv_id, turn, 'query:' || sha256({body})[1:16] AS key, sha256('model:' || text)[1:16] AS embedding_key, 'section:' || role AS section_key FROM conversations",
        "severance_keys": f"SELECT c_custkey, 'severance:' || sha256({sev})[1:16] AS key FROM customer",
        "severance_summary": severing(),
        "endpoint_counts": "SELECT CASE WHEN user_id % 3 = 0 THEN '/section/{section_id}' ELSE '/api/v1/' || event_type END AS endpoint, count(*) AS n FROM events GROUP BY 1",
        "prompts": f"""SELECT conv_id, turn, md5('CONTEXT:' || chr(10) || CASE WHEN conv_id % 3 = 0 THEN '[No relevant context found]' ELSE {context} END || chr(10) || chr(10) || 'QUESTION: ' || text) AS prompt,
  md5(CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'Section EA-60E: ' || role || chr(10) || chr(10) || 'Section Unknown: ' || text END) AS paragraphs FROM conversations""",
        "tier_settings": "WITH a AS (SELECT CASE WHEN conv_id % 4 = 0 THEN 'large' ELSE 'small' END AS tier, count(*) AS n FROM conversations GROUP BY 1) SELECT tier, n, " + ", ".join(setting(*x) for x in (("max_tokens", "INT"), ("temperature", "DOUBLE"), ("top_p", "DOUBLE"), ("timeout", "DOUBLE"), ("quantization", "VARCHAR"))) + " FROM a",
        "section_lookup": "WITH w AS (SELECT 'EA-' || i AS section_id, i FROM (SELECT unnest(range(40)) AS i)), f AS (SELECT doc_id % 31 AS i, min(doc_id) AS chunk_id FROM documents GROUP BY 1) SELECT section_id, chunk_id, md5(text) AS text FROM w LEFT JOIN f USING (i) LEFT JOIN documents ON doc_id = chunk_id",
        "answer_responses": """WITH a AS (SELECT *, coalesce(CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 10 / 10 END, 0.5)::DOUBLE AS c FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS answer, CASE WHEN p_partkey % 3 = 0 THEN 'EA-1' ELSE '' END AS citations, c AS confidence, p_partkey % 7 = 0 AS should_escalate, CASE WHEN p_partkey % 4 = 0 THEN 'pii_masked' ELSE '' END AS flags, p_partkey % 6 = 0 AS cache_hit,
  CASE WHEN c > 0.8::DOUBLE THEN 'green' WHEN c > 0.5 THEN 'orange' ELSE 'red' END AS color, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 5 > 0 THEN 'ok' ELSE 'degraded' END AS health FROM a""",
        "cache_statistics": "SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS hits, count(*) FILTER (event_id % 3 > 0) AS misses, round(avg((event_id % 3 = 0)::INT), 6) AS hit_rate FROM events GROUP BY 1",
        "key_usage": "WITH u AS (SELECT user_id, count(*) AS n, max(ts) AS t FROM events GROUP BY 1) SELECT c_custkey AS key_id, c_custkey % 5 > 0 AS is_active, coalesce(n, 0) AS usage_count, floor(epoch(t))::BIGINT AS last_used FROM customer LEFT JOIN u ON user_id = c_custkey",
        "client_metrics": "WITH a AS (SELECT event_type, count(*) FILTER (event_id % 4 > 0) AS g, count(*) FILTER (event_id % 4 = 0) AS f FROM events GROUP BY 1) SELECT event_type, g AS total_requests, f AS failed_requests, round(coalesce(f / nullif(g, 0), 0), 6) AS error_rate, round(f / (f + g), 6) AS failure_share FROM a",
        "search_settings": "WITH a AS (SELECT p_partkey, (p_partkey % 23)::INT AS f, (p_partkey % 9)::INT AS m FROM part) SELECT p_partkey, CASE WHEN f BETWEEN 1 AND 20 AND m BETWEEN 1 AND f THEN greatest(f, m) END AS hits FROM a",
        "queries_in_scope": f"WITH a AS (SELECT conv_id, turn, lower({among(['My visa? ', 'A divorce? ', 'Annual leave? ', 'Commission: '], 'conv_id')} || text) AS t FROM conversations) SELECT conv_id, turn FROM a WHERE NOT regexp_matches(t, {q('|'.join(search.OUT_OF_SCOPE))})",
        "legacy_guardrails": legacy(),
        "guardrail_statistics": guard_stats(),
        "plain_formats": f"SELECT p_partkey, {form} AS ok, {form} AS found FROM part",
        "citation_backfill": f"""SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN md5(CASE WHEN p_partkey % 2 = 0 THEN {shown('EA-60E', name150)} || ';' || {shown('EA-7', 'p_name')} ELSE '[EA-7] s;[EA-1] t' END) END AS citations, CASE WHEN p_partkey % 11 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 0.1 ELSE 0.9 END END::DOUBLE AS confidence,
  CASE WHEN p_partkey % 11 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'citations_backfilled' ELSE 'x' END END AS flags, CASE WHEN p_partkey % 11 = 0 THEN 0.0 WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS accuracy FROM part""",
        "address_limit": "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= 10 AS allowed FROM events",
        "cache_lifetimes": f"WITH a AS (SELECT {among(list(service.TTL_SECONDS), 'event_id')} AS kind, count(*) AS n FROM events GROUP BY 1) SELECT kind, n, CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in service.TTL_SECONDS.items()) + " END::INT AS ttl FROM a",
        "corpus_report": f"WITH {CHUNKS}, f AS (SELECT * FROM ch ORDER BY doc_id, chunk_index LIMIT 1) SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM ch) AS n_chunks, (SELECT count(*) FROM embeddings) AS n_vectors, chunk_id AS first_chunk, section_id AS first_section, length AS first_length FROM f",
        "reward_rates": f"WITH {rewarding()} SELECT count(*) AS n, round(avg(reward), 6) AS mean, round(stddev_samp(reward), 6) AS deviation, count(*) FILTER (reward > 0) AS positive, count(*) FILTER (reward = 0) AS neutral, count(*) FILTER (reward < 0) AS negative, round(avg((reward > 0)::INT), 6) AS positive_rate, round(avg((reward = 0)::INT), 6) AS neutral_rate, round(avg((reward < 0)::INT), 6) AS negative_rate FROM rd",
        "lexical_diversity": f"WITH a AS (SELECT conv_id, turn, {words('text')} AS w FROM conversations), b AS (SELECT conv_id, turn, coalesce(len(list_distinct(w)) / nullif(len(w), 0), 0.0) AS r FROM a) SELECT conv_id, turn, round(r, 6) AS ratio, r > 0.6::DOUBLE AS varied FROM b",
        "all_numeric_claims": claiming(),
        "cache_replay_ttl": replay("user_id", "e.us AS since, false AS hit", f"CASE WHEN e.us - s.since <= {hour} THEN s.since ELSE e.us END, e.us - s.since <= {hour}", "hit"),
        "cache_replay_tiers": replay("user_id", f"e.us + {2 * hour} AS f, e.us + {2 * hour} AS g, 0 AS tier", f"CASE WHEN e.us <= s.f THEN s.f WHEN e.us <= s.g THEN e.us + {hour // 2} ELSE e.us + {2 * hour} END, CASE WHEN e.us <= s.f OR e.us <= s.g THEN s.g ELSE e.us + {2 * hour} END, CASE WHEN e.us <= s.f THEN 1 WHEN e.us <= s.g THEN 2 ELSE 0 END", "tier"),
        "circuit_breaker": replay(
            "event_type",
            "CASE WHEN e.event_id % 3 = 0 THEN 0 ELSE 1 END AS failures, NULL::BIGINT AS opened, 'closed' AS state",
            f"""CASE WHEN s.opened IS NOT NULL AND e.us - s.opened < {hour // 60} THEN s.failures WHEN e.event_id % 3 = 0 THEN 0 ELSE s.failures + 1 END,
  CASE WHEN s.opened IS NOT NULL AND e.us - s.opened < {hour // 60} THEN s.opened WHEN e.event_id % 3 > 0 AND (s.opened IS NOT NULL OR s.failures + 1 >= 5) THEN e.us END,
  CASE WHEN s.opened IS NOT NULL AND e.us - s.opened < {hour // 60} THEN 'open' WHEN s.opened IS NULL THEN 'closed' ELSE 'half_open' END""",
            "state",
        ),
    }
