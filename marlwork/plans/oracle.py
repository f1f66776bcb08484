"""The queries of the registry in DuckDB SQL."""

from __future__ import annotations

from marlwork.operators import answers, calculator, chunking, governance, metrics, questions, search


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> '')"


def any_of(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def first_of(x: str, patterns: list[str], flags: str = "") -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {q(flags + p)}, 1), '')" for p in patterns) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def f1(a: str, b: str) -> str:
    x, y = f"list_distinct({words(a)})", f"list_distinct({words(b)})"
    return f"CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 1.0 WHEN len(list_intersect({x}, {y})) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"


QUERIES = "sq AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
TERMS = f"""tk AS MATERIALIZED (SELECT doc_id, source, {words('text')} AS w FROM documents),
st AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM tk) GROUP BY term),
rw AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM tk) - df + 0.5) - ln(df + 0.5) AS raw FROM st),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rw) ELSE raw END AS idf FROM rw)"""
BM25 = f"""{TERMS}, {QUERIES},
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({words('query')}) AS term FROM sq) GROUP BY ALL),
tf AS (SELECT doc_id, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY doc_id, term),
av AS MATERIALIZED (SELECT avg(len(w)) AS a FROM tk),
sd AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS raw FROM tf JOIN idf USING (term) JOIN qt USING (term), av GROUP BY query_id, doc_id),
bm AS (SELECT query_id, doc_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 10) DESC, doc_id) AS rank FROM sd)"""


def dense(right: str, k: int) -> str:
    """A CTE nn of the k nearest vectors of the queries of `right` (query_id, q)."""
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
    return f"""nn AS (SELECT * FROM (SELECT query_id, vec_id AS doc_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 10) DESC, vec_id) AS rank FROM
  (SELECT query_id, vec_id, {dot('embedding', 'q')} / (sqrt({dot('embedding', 'embedding')}) * sqrt({dot('q', 'q')})) AS raw FROM embeddings, {right})) WHERE rank <= {k})"""


def expansion() -> str:
    n = "lower(q)"
    for pattern, new in search.REWRITES:
        n = f"regexp_replace({n}, {q(pattern)}, {q(new)}, 'g')"
    out = q("|".join(search.OUT_OF_SCOPE))
    return f"""WITH a AS (SELECT conv_id, turn, 'annual leave salary ' || text AS q FROM conversations WHERE role = 'user'),
b AS (SELECT *, {n} AS n FROM a),
c AS (SELECT *, [q, n, 'Employment Act Malaysia ' || n, n || ' section ' || array_to_string(string_split(n, ' ')[1:3], ' '), 'statutory ' || n, 'legal requirements ' || n, n || ' provisions law'] AS v FROM b),
d AS (SELECT *, list_transform(v, lambda x: lower(x)) AS l FROM c),
e AS (SELECT conv_id, turn, CASE WHEN regexp_matches(lower(q), {out}) THEN [q] ELSE list_filter(v, lambda x, i: list_position(l, lower(x)) = i)[1:6] END AS o FROM d)
SELECT conv_id, turn, len(o)::INT AS n, md5(array_to_string(o, '|')) AS variants FROM e"""


CHUNKS = f"""wi AS (SELECT doc_id, text AS t, length(text) AS n, unnest(range(0, greatest(0, ceil((length(text) - 1000) / 700.0)::INT) * 700 + 1, 700)) AS s FROM documents WHERE length(text) > 0),
wd AS (SELECT *, t[s + 1:s + 1000] AS w FROM wi),
ix AS (SELECT *, reverse(w) AS r, length(w) AS m FROM wd),
ps AS (SELECT *, CASE WHEN instr(r, '.') > 0 THEN m - instr(r, '.') ELSE -1 END AS dot, CASE WHEN instr(r, chr(10) || chr(10)) > 0 THEN m - instr(r, chr(10) || chr(10)) - 1 ELSE -1 END AS bl, CASE WHEN instr(r, chr(10)) > 0 THEN m - instr(r, chr(10)) ELSE -1 END AS li FROM ix),
en AS (SELECT *, s + 1000 >= n AS fin, CASE WHEN s + 1000 >= n THEN n ELSE s + CASE WHEN dot > 500 THEN dot + 1 WHEN bl > 0 THEN bl + 2 WHEN li > 0 THEN li + 1 ELSE 1000 END END AS e FROM ps),
bo AS (SELECT *, {strip('t[s + 1:e]')} AS body, fin AND n - s < 100 AND s > 0 AS tiny FROM en),
kp AS (SELECT *, coalesce(lead(tiny) OVER o, false) AS nt, row_number() OVER o - 1 AS i FROM bo WHERE tiny OR n < 100 OR length(body) >= 100 WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
ch AS (SELECT doc_id, i::INT AS chunk_index, 'chunk_' || lpad(i::VARCHAR, 4, '0') || '_' || md5(body)[1:8] AS chunk_id, s::INT AS start_pos, (CASE WHEN nt THEN n ELSE e END)::INT AS end_pos,
  'EA-' || {first_of('body', chunking.SECTION_PATTERNS, '(?i)')} AS section_id, length(body)::INT AS length, body FROM kp WHERE NOT tiny OR (i = 0 AND length(body) >= 100))"""


def enriched() -> str:
    """CTEs up to rt: chunks with their title and the text that names their section."""
    title = f"regexp_replace(regexp_replace({strip(first_of('body[1:200]', chunking.TITLE_PATTERNS))}, '\\s*[-–]\\s*$', ''), '\\s*\\.$', '')"
    return f"""{CHUNKS},
ri AS (SELECT doc_id, i::INT AS chunk_index, 'EA-' || {first_of('body', chunking.SECTION_PATTERNS, '(?i)')} AS section_id, {title} AS section_title, body, CASE WHEN nt THEN t[e + 1:n] ELSE '' END AS tail FROM kp WHERE NOT tiny OR (i = 0 AND length(body) >= 100)),
rt AS (SELECT doc_id, chunk_index, section_id, section_title, CASE WHEN length(body) < 100 OR section_id IS NULL THEN body WHEN coalesce(section_title, '') = '' THEN '[Employment Act Section ' || section_id || '] ' || body
  WHEN NOT contains(lower(body[1:100]), lower(section_title)) THEN '[Employment Act Section ' || section_id || ': ' || section_title || '] ' || body ELSE body END || tail AS text FROM ri)"""


def masked(x: str) -> str:
    for _, pattern, mark in governance.PII:
        x = f"regexp_replace({x}, {q(pattern)}, {q(mark)}, 'g')"
    return x


def policies() -> str:
    low = "lower(q)"
    category = "CASE " + " ".join(f"WHEN {any_of(low, ws)} THEN {q(name)}" for name, ws in governance.POLICIES.items()) + " END"
    rules = ", ".join(f"CASE WHEN contains({low}, {q(w)}) THEN {q('policy_' + name + '_' + w.replace(' ', '_'))} END" for name, ws in governance.POLICIES.items() for w in ws)
    return f"""WITH a AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'Should I hire a lawyer, is it a guarantee? ' || text ELSE text END AS q FROM conversations)
SELECT conv_id, turn, {category} AS category, array_to_string(list_filter([{rules}], lambda x: x IS NOT NULL), ',') AS rules FROM a"""


def guarding() -> str:
    hit = " OR ".join(any_of("lower(q)", ws) for ws in governance.POLICIES.values())
    said = "CASE " + " ".join(f"WHEN {any_of('lower(q)', ws)} THEN {q(governance.POLICY_TEMPLATES[name])}" for name, ws in governance.POLICIES.items()) + " END"
    personal = " OR ".join(f"regexp_matches(q, {q(p)})" for _, p, _ in governance.PII)
    return f"""WITH a AS (SELECT conv_id, turn, text || CASE WHEN conv_id % 4 = 0 THEN ' mail a.b@example.com' ELSE '' END AS q FROM conversations), b AS (SELECT *, {hit} AS p, {personal} AS i FROM a)
SELECT conv_id, turn, concat_ws(',', CASE WHEN p THEN 'policy_violation' END, CASE WHEN i THEN 'pii_masked' END) AS flags, CASE WHEN p THEN 'refused' ELSE 'allowed' END AS decision, CASE WHEN p THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence,
  md5(CASE WHEN p THEN {said} ELSE {masked('q')} END) AS processed FROM b"""


def citing() -> str:
    known = "[" + ", ".join(q(f"EA-{n}") for n in (*range(2, 21), 25, 60, "60A", "60F", 77)) + "]"
    found = "flatten([" + ", ".join(f"regexp_extract_all(s, {q('(?i)' + p)}, 1)" for p in governance.CITATIONS) + "])"
    return f"""WITH a AS (SELECT p_partkey, 'Section EA-' || p_partkey % 110 || CASE WHEN p_partkey % 3 = 0 THEN 'F' ELSE '' END || ' applies; see Section ' || (p_partkey % 7 + 57) || ' and ea-60f.' AS s FROM part),
b AS (SELECT p_partkey, {found} AS f FROM a),
c AS (SELECT p_partkey, 'EA-' || x AS c, min(i) AS i FROM (SELECT p_partkey, unnest(f) AS x, unnest(range(len(f))) AS i FROM b) GROUP BY ALL)
SELECT p_partkey, coalesce(string_agg(c, ',' ORDER BY i) FILTER (list_contains({known}, c)), '') AS valid, coalesce(string_agg(c, ',' ORDER BY i) FILTER (NOT list_contains({known}, c)), '') AS invalid FROM c GROUP BY p_partkey"""


def numbers() -> str:
    category = "CASE " + " ".join(f"WHEN {any_of('t', ws)} THEN {q(name)}" for name, ws in governance.CATEGORY_WORDS) + " ELSE 'general' END"
    days = "CASE unit " + " ".join(f"WHEN {q(u)} THEN {d}.0" for u, d in governance.DAYS.items()) + " END"
    ok = "CASE category " + " ".join(
        f"WHEN {q(name)} THEN (" + (f"CASE WHEN unit = {q(unit)} THEN number ELSE number * {days} / {governance.DAYS[unit]} END" if unit in governance.DAYS else f"CASE WHEN unit = {q(unit)} THEN number END") + f") BETWEEN {least} AND {most}"
        for name, least, most, unit in governance.BOUNDS
    ) + " END"
    rule = q("(\\d+(?:\\.\\d+)?)\\s+(day|week|month|year|hour)s?")
    return f"""WITH a AS (SELECT o_orderkey, 'you get ' || o_orderkey % 100 || ' ' || ['days of annual leave', 'days of sick leave', 'weeks of notice', 'hours per day', 'months maternity'][o_orderkey % 5 + 1] AS t FROM orders),
b AS (SELECT o_orderkey, regexp_extract(t, {rule}, 1)::DOUBLE AS number, regexp_extract(t, {rule}, 2) AS unit, {category} AS category FROM a)
SELECT *, {ok} AS ok FROM b"""


def retrieval() -> str:
    recall = ", ".join(f"round(least(coalesce(sum(CASE WHEN rank <= {k} AND rel THEN 1 ELSE 0 END), 0) / 2.0, 1.0), 6) AS recall_{k}" for k in (1, 3, 5, 8, 10))
    gain = ", ".join(f"round(coalesce(sum(CASE WHEN rank <= {k} AND rel THEN CASE WHEN rank = 1 THEN 1.0 ELSE 1.0 / log2(rank) END ELSE 0.0 END), 0.0) / 2.0, 6) AS ndcg_{k}" for k in (5, 8, 10))
    return f"""WITH {BM25},
go AS (SELECT query_id, source AS gold FROM documents JOIN sq ON doc_id = query_id),
hi AS (SELECT bm.query_id, rank, source = gold AS rel FROM bm JOIN documents USING (doc_id) JOIN go ON go.query_id = bm.query_id WHERE rank <= 10 AND score > 0),
me AS (SELECT go.query_id, {recall}, round(coalesce(1.0 / min(CASE WHEN rel THEN rank END), 0.0), 6) AS mrr, {gain} FROM go LEFT JOIN hi USING (query_id) GROUP BY go.query_id)"""


def rewarding() -> str:
    low, ws = "lower(text)", words("text")
    add = lambda ok, value: f"CASE WHEN {ok} THEN {value} ELSE 0.0 END"
    parts = [
        add(f"length({strip('text')}) > 20 AND NOT starts_with({low}, 'i cannot')", 0.5),
        add(any_of(low, metrics.CITING), 1.0),
        add(any_of(low, metrics.GROUNDED), 1.0),
        add(any_of(low, metrics.LEGAL), 0.3),
        add(any_of(low, metrics.INVENTED), -2.0),
        add(any_of(low, metrics.GENERIC), -3.0),
        add("length(text) > 400", -0.2),
        add(f"len({ws}) > 10 AND len(list_distinct({ws})) / len({ws}) < 0.6", -0.5),
    ]
    return f"rd AS (SELECT conv_id, turn, round(({' + '.join(parts)})::DOUBLE, 6) AS reward FROM conversations WHERE role = 'assistant')"


PAIRS = "pr AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations)"
SPLIT = """gr AS (SELECT source, row_number() OVER (ORDER BY md5(concat_ws('|', source, '42')), source NULLS FIRST) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
sp AS (SELECT doc_id, md5(text) AS h, CASE WHEN place <= greatest(1, floor(n * 0.15)) THEN 'eval' ELSE 'train' END AS split FROM documents d JOIN gr ON d.source IS NOT DISTINCT FROM gr.source)"""


def similar() -> str:
    return """WITH e AS (SELECT item_id AS id, lower(text) AS t FROM benchmark UNION ALL SELECT item_id + 1000000, lower(text || ' x') FROM benchmark), a AS (SELECT min(id) AS id, t FROM e GROUP BY t),
b AS (SELECT l.id AS a, r.id AS b, round(1 - levenshtein(l.t, r.t) / greatest(length(l.t), length(r.t)), 6) AS similarity FROM a l JOIN a r ON l.id < r.id AND greatest(length(l.t), length(r.t)) > 0)
SELECT * FROM b WHERE similarity > 0.8"""


def severance() -> str:
    reasons = "[" + ", ".join(map(q, (*calculator.REASONS[:5], "unknown"))) + "]"
    return f"""WITH a AS (SELECT c_custkey, abs(c_acctbal)::DOUBLE + 1 AS wage, (c_custkey % 12)::DOUBLE AS y, {reasons}[c_custkey % 6 + 1] AS reason, c_custkey % 20 AS d, c_custkey % 4 > 0 AS notice FROM customer),
b AS (SELECT c_custkey, CASE WHEN reason = 'retrenchment' THEN CASE WHEN y < 1 THEN 0.0 WHEN y < 2 THEN 10.0 WHEN y <= 5 THEN 15.0 ELSE 20.0 END::DOUBLE * y * wage / 30 ELSE 0.0 END AS s,
  CASE WHEN notice AND reason <> 'misconduct' THEN CASE WHEN y < 2 THEN 4.0 WHEN y <= 5 THEN 6.0 ELSE 8.0 END::DOUBLE * wage / 4.33::DOUBLE ELSE 0.0 END AS n, CASE WHEN d > 0 THEN d * wage / 30 ELSE 0.0 END AS l, CASE WHEN reason = 'unknown' THEN 'reason' END AS error FROM a)
SELECT c_custkey, CASE WHEN error IS NULL THEN floor(s * 100 + 0.5::DOUBLE) / 100 END AS severance, CASE WHEN error IS NULL THEN floor(n * 100 + 0.5::DOUBLE) / 100 END AS notice_pay, CASE WHEN error IS NULL THEN floor(l * 100 + 0.5::DOUBLE) / 100 END AS leave_pay, CASE WHEN error IS NULL THEN floor((s + n + l) * 100 + 0.5::DOUBLE) / 100 END AS total, error FROM b"""


def routing() -> str:
    some = lambda parts: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(t), {q(p)}) THEN {q(p)} END" for p in parts) + "], lambda z: z IS NOT NULL), ', ')"
    return f"""WITH a AS (SELECT conv_id, turn, CASE WHEN conv_id % 6 = 0 THEN 'A complex review with an exception? ' ELSE '' END || text AS t, conv_id AS k FROM conversations WHERE role = 'user'),
b AS (SELECT *, {some(governance.ESCALATION)} AS w, {some(governance.COMPLEX)} AS l, greatest(k % 10 / 10, 0.1) AS s FROM a),
c AS (SELECT *, concat_ws(',', CASE WHEN k % 9 = 0 THEN 'explicit_user_request' END, CASE WHEN w <> '' THEN 'escalation_keywords' END, CASE WHEN s < 0.25 THEN 'low_retrieval_confidence' END, CASE WHEN k % 5 >= 2 THEN 'multi_section_synthesis' END, CASE WHEN k % 7 = 0 THEN 'safety_policy_hits' END, CASE WHEN l <> '' THEN 'complex_legal_language' END) AS signals,
  concat_ws('|', CASE WHEN k % 9 = 0 THEN 'User explicitly requested review/escalation' END, CASE WHEN w <> '' THEN 'Query contains escalation keywords: ' || w END, CASE WHEN s < 0.25 THEN 'Low retrieval confidence: top_score=' || format('{{:.3f}}', s::DOUBLE) || ' < 0.25' END, CASE WHEN k % 5 >= 2 THEN 'Multi-section synthesis required: ' || (k % 5 + 1) || ' sections >= 3' END,
  CASE WHEN k % 7 = 0 THEN 'Safety/policy flags triggered: guarantees' END, CASE WHEN l <> '' THEN 'Complex legal language detected: ' || l END) AS why FROM b)
SELECT conv_id, turn, CASE WHEN signals = '' THEN 'small' ELSE 'large' END AS tier, CASE WHEN signals = '' THEN 0.7 ELSE 0.8 END::DOUBLE AS threshold, signals, CASE WHEN signals = '' THEN 'Using default small model' ELSE 'ESCALATED to large model|' || why END AS reasoning FROM c"""


def listing(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def personal(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {q(p)})" for _, p, _ in governance.PII) + ")"


def reporting() -> str:
    ends = listing(("Take 12 days of annual leave.", "Take 90 days of annual leave.", "You should sue them.", "Expect triple compensation.", "Write to a.b@example.com."))
    return f"""WITH a AS (SELECT o_orderkey, o_orderkey % 30 AS n, 'Section ' || o_orderkey % 30 || ' says so. ' || {ends}[o_orderkey % 5 + 1] AS t FROM orders),
b AS (SELECT o_orderkey, n, t, n > 24 AS c, contains(t, '90 days') AS m, regexp_matches(lower(t), {q('|'.join(answers.HALLUCINATIONS))}) AS h, regexp_matches(lower(t), {q('|'.join(answers.ADVICE))}) AS v, {personal('t')} AS p FROM a)
SELECT o_orderkey, concat_ws(',', CASE WHEN c THEN 'invalid_citations' END, CASE WHEN m THEN 'numeric_out_of_bounds' END, CASE WHEN h THEN 'hallucination_pattern' END, CASE WHEN v THEN 'inappropriate_advice' END, CASE WHEN p THEN 'output_pii_detected' END) AS flags,
  CASE WHEN c OR m THEN 'escalated' WHEN h OR v OR p THEN 'refused' ELSE 'allowed' END AS decision, CASE WHEN c OR m OR h OR v OR p THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence, concat_ws(',', CASE WHEN c THEN 'invalid_citations' END, CASE WHEN m THEN 'numeric_bounds' END) AS reasons,
  concat_ws(',', CASE WHEN c THEN 'citation_invalid_EA-' || n END, CASE WHEN m THEN 'numeric_invalid_annual_leave,numeric_invalid_annual_leave' END, CASE WHEN h THEN 'hallucination_triple compensation' END, CASE WHEN v THEN 'inappropriate_you should sue' END, CASE WHEN p THEN 'output_pii_email' END) AS rules, md5(CASE WHEN c OR m OR h OR v OR p THEN {q(answers.FILTERED)} ELSE t END) AS processed FROM b"""


def flagging() -> str:
    begins = listing(("Shall I go to court? ", "Give me legal advice. ", "My mail is a.b@example.com. ", "So: "))
    policy = " OR ".join(any_of("lower(t)", ws) for ws in governance.POLICIES.values())
    message = "CASE coalesce(refusal, CASE WHEN x THEN 'complex_legal' END, 'other') " + " ".join(f"WHEN {q(k)} THEN {q(text)}" for k, text in answers.REFUSALS.items()) + " END"
    return f"""WITH a AS (SELECT conv_id, turn, {begins}[conv_id % 4 + 1] || text AS t FROM conversations),
b AS (SELECT conv_id, turn, {policy} AS p, {personal('t')} AS i, {any_of('lower(t)', answers.COMPLEX_CASE)} AS x FROM a),
c AS (SELECT *, CASE WHEN p THEN 'policy_violation' WHEN i THEN 'privacy_concern' END AS refusal FROM b)
SELECT conv_id, turn, concat_ws(',', CASE WHEN p THEN 'policy_violation' END, CASE WHEN i THEN 'pii_refusal' END, CASE WHEN i THEN 'pii_detected' END, CASE turn % 3 WHEN 0 THEN 'insufficient_context' WHEN 1 THEN 'limited_context' END, CASE WHEN x THEN 'complex_legal' END) AS flags, refusal, md5({message}) AS message FROM c"""


def repairing() -> str:
    return f"""WITH a AS (SELECT p_partkey AS k, repeat(p_name, 20) AS t FROM part),
b AS (SELECT k, CASE WHEN length(t) > 150 THEN t[1:150] || '...' ELSE t END AS filled, t[1:150] || '...' AS quoted FROM a),
c AS (SELECT k, CASE k % 3 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'EA-60E:' || filled ELSE {q(answers.NO_SECTION + ':' + answers.NO_CONTEXT)} END
  WHEN 1 THEN 'EA-60E:' || CASE WHEN k % 2 = 0 THEN quoted ELSE {q(answers.NO_SNIPPET)} END || ';' || {q(answers.NO_SECTION + ':own')} ELSE 'EA-9:' || repeat('z', 197) || '...' END AS cites FROM b)
SELECT k AS p_partkey, CASE WHEN k % 7 > 0 THEN CASE WHEN k % 5 = 0 THEN {q(answers.NO_ANSWER)} ELSE 'yes' END END AS answer, CASE WHEN k % 7 > 0 THEN md5(cites) END AS citations, CASE WHEN k % 7 > 0 THEN CASE WHEN k % 4 = 0 THEN 'low' ELSE 'high' END END AS confidence, CASE WHEN k % 7 > 0 THEN true END AS should_escalate FROM c"""


def asking() -> str:
    pick = lambda values, what: f"{listing(values)}[('0x' || md5(doc_id || '|{what}')[1:8])::BIGINT % {len(values)} + 1]"
    category = "CASE " + " ".join(f"WHEN {any_of('lower(text)', ws)} THEN {q(name)}" for name, ws in questions.KINDS.items()) + f" ELSE {pick(questions.KINDS, 'kind')} END"
    question = "CASE category " + " ".join(f"WHEN {q(k)} THEN {pick(ts, 'template')}" for k, ts in questions.TEMPLATES.items()) + " END"
    for word, values in questions.WORDS.items():
        question = f"replace({question}, '{{{word}}}', {pick(values, word)})"
    claims = "flatten([" + ", ".join(f"regexp_extract_all(text, {q('(?i)' + p)}, 1)" for p in questions.CLAIMS) + "])"
    return f"""WITH a AS (SELECT doc_id, source, {category} AS category, {claims} AS cl, list_filter(list_transform(string_split(text, '.'), lambda x: {strip('x')}), lambda x: length(x) > 20)[1] AS s FROM documents),
b AS (SELECT *, concat_ws(' ', 'According to the Employment Act, ' || lower(s) || '.', 'The specific requirement is ' || cl[1] || ' as stated in the legislation.', 'This is covered under section ' || source || '.') AS w FROM a)
SELECT doc_id, category, len(cl)::INT AS n_claims, md5(CASE WHEN length(w) > 500 THEN w[1:450] || '... (Reference: ' || source || ')' ELSE w END) AS answer, {question} AS question FROM b"""


def streaming() -> str:
    return f"""WITH a AS (SELECT conv_id * 1000 + turn AS request_id, {words('text')} AS w, conv_id % 5 = 0 AS bad FROM conversations WHERE role = 'assistant'),
b AS (SELECT request_id, list_concat(list_concat([{{'t': 'metadata', 'c': ''}}], list_transform(w, lambda x: {{'t': 'token', 'c': x}})), CASE WHEN bad THEN [{{'t': 'error', 'c': 'error'}}, {{'t': 'status', 'c': 'error'}}] ELSE [{{'t': 'usage', 'c': len(w)::VARCHAR}}, {{'t': 'status', 'c': 'completed'}}] END || [{{'t': 'done', 'c': '[DONE]'}}]) AS o FROM a),
c AS (SELECT request_id, unnest(range(len(o)))::INT AS seq, unnest(o) AS e FROM b)
SELECT request_id, seq, e.t AS chunk_type, e.c AS content FROM c"""


def lru(capacity: int, seconds: int) -> str:
    """Requests between two for one key whose own last one stands before both are the distinct keys between them."""
    return f"""WITH RECURSIVE e AS (SELECT event_id, user_id AS k, epoch_us(ts) AS tm, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
p AS MATERIALIZED (SELECT *, coalesce(lag(i) OVER o, 0) AS p, row_number() OVER o AS n FROM e WINDOW o AS (PARTITION BY k ORDER BY i)),
d AS MATERIALIZED (SELECT a.event_id, a.k, a.tm, a.n, a.p > 0 AND count(b.i) < {capacity} AS held FROM p a LEFT JOIN p b ON b.i > a.p AND b.i < a.i AND b.p < a.p AND a.p > 0 GROUP BY a.event_id, a.k, a.tm, a.n, a.p),
c AS (SELECT event_id, k, n, tm AS since, false AS hit FROM d WHERE n = 1
  UNION ALL SELECT d.event_id, d.k, d.n, CASE WHEN d.held AND d.tm - c.since <= {seconds}000000 THEN c.since ELSE d.tm END, d.held AND d.tm - c.since <= {seconds}000000 FROM c JOIN d ON d.k = c.k AND d.n = c.n + 1)
SELECT event_id, hit FROM c"""


def failing() -> str:
    n = "lower(t)"
    for pattern, new in search.REWRITES:
        n = f"regexp_replace({n}, {q(pattern)}, {q(new)}, 'g')"
    begins = listing(("Pregnant and sick leave? ", "Can they fire me? ", "My visa? ", "Where? ", "Is salary advance due? "))
    own = ", ".join(f"CASE WHEN contains(n, {q(topic)}) THEN {listing(sections)} END" for topic, sections in search.TOPICS.items())
    return f"""WITH a AS (SELECT conv_id, turn, {begins}[conv_id % 5 + 1] || text AS t, ['EA-' || (turn % 3 + 12), 'EA-44'] AS found FROM conversations),
b AS (SELECT *, {n} AS n FROM a), c AS (SELECT *, flatten(list_filter([{own}], lambda x: x IS NOT NULL)) AS every FROM b),
e AS (SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i) AS wanted FROM c)
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(t), {q("|".join(search.OUT_OF_SCOPE))}) THEN 'OUT_OF_SCOPE' WHEN len(wanted) = 0 THEN 'COVERAGE_MISS' WHEN list_has_any(wanted, found) THEN 'RANKING_MISS' ELSE 'VOCAB_MISS' END AS category,
  array_to_string(wanted, ',') AS sections FROM e"""


def all_sql() -> dict[str, str]:
    lines = f"li AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS t FROM documents), no AS (SELECT doc, regexp_replace({strip('lower(t)')}, '\\s+', ' ', 'g') AS norm FROM li), pg AS (SELECT doc, count(DISTINCT page) AS pages FROM li GROUP BY doc)"
    cleaned = f"array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^\\d+$') AND length(x) >= 10), lambda x: regexp_replace(x, '\\s+', ' ', 'g')), chr(10))"
    kinds = ", ".join(f"CASE WHEN regexp_matches(text, {q(p)}) THEN {q(name)} END" for name, p, _ in governance.PII)
    flag = lambda p, a: f"sum(CASE WHEN {'' if p else 'NOT '}p AND {'' if a else 'NOT '}a THEN 1 ELSE 0 END)"
    ids = lambda *xs: "list_distinct([" + ", ".join(f"'EA-' || {x}" for x in xs) + "])"
    return {
        "output_report": reporting(),
        "query_flags": flagging(),
        "answer_repair": repairing(),
        "sft_questions": asking(),
        "questions_by_table": f"SELECT doc_id, category, question FROM ({asking()})",
        "token_stream": streaming(),
        "token_answers": f"""WITH ch AS ({streaming()}), k AS (SELECT * FROM ch WHERE NOT (request_id % 11 = 3 AND seq = 1)),
g AS (SELECT request_id, coalesce(string_agg(content, ' ' ORDER BY seq) FILTER (chunk_type = 'token'), '') AS answer, (count(*) FILTER (chunk_type = 'token'))::INT AS n_tokens, max(content) FILTER (chunk_type = 'status') AS st, max(seq) = count(*) - 1 AND count(*) FILTER (chunk_type = 'done') > 0 AS complete FROM k GROUP BY request_id)
SELECT request_id, answer, n_tokens, CASE WHEN complete THEN coalesce(st, 'error') ELSE 'error' END AS status, complete FROM g""",
        "sliding_limit": """WITH RECURSIVE e AS (SELECT event_id, event_type AS k, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
c AS (SELECT event_id, k, n, true AS allowed, [tm] AS passed FROM e WHERE n = 1
  UNION ALL SELECT event_id, k, n, len(f) < 2, CASE WHEN len(f) < 2 THEN f || [tm] ELSE f END FROM (SELECT e.event_id, e.k, e.n, e.tm, list_filter(c.passed, lambda x: e.tm - x < 600000000) AS f FROM c JOIN e ON e.k = c.k AND e.n = c.n + 1))
SELECT event_id, allowed FROM c""",
        "failure_category": failing(),
        "context_filter": f"""WITH {BM25}, hi AS (SELECT query_id, rank, doc_id, score / 600 AS s, count(*) OVER (PARTITION BY query_id) AS n, count(*) FILTER (score / 600 >= 0.3) OVER (PARTITION BY query_id) AS good FROM bm WHERE rank <= 12 AND score > 0)
SELECT query_id, rank, doc_id FROM hi WHERE CASE WHEN n < 6 THEN true WHEN good < 6 THEN rank <= 8 ELSE s >= 0.3 END""",
        "unique_instructions": f"""WITH qs AS ({asking()}), ra AS (SELECT doc_id, question, source, row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY doc_id) AS n FROM qs JOIN documents USING (doc_id))
SELECT doc_id, question || CASE WHEN n > 1 THEN ' [' || source || ']' ELSE '' END AS question FROM ra""",
        "reward_normalised": f"WITH {rewarding()} SELECT conv_id, turn, round((reward - avg(reward) OVER ()) / (stddev_pop(reward) OVER () + 1e-8), 6) AS normal FROM rd",
        "duration_histogram": "SELECT event_type, bound::DOUBLE AS bound, count(*) FILTER (bound IS NULL OR value <= bound) AS n FROM events, (SELECT unnest([1, 5, 10, 50, 100, NULL]) AS bound) GROUP BY ALL",
        "bm25_index_stats": f"WITH {TERMS} SELECT term, df, round(idf, 6) AS idf FROM idf",
        "bm25_topk": f"WITH {BM25} SELECT query_id, rank, doc_id, score FROM bm WHERE rank <= 10 AND score > 0",
        "bm25_stored": f"WITH {BM25} SELECT query_id, rank, doc_id, score FROM bm WHERE rank <= 10 AND score > 0",
        "bm25_updated": f"WITH {BM25} SELECT query_id, rank, doc_id, score FROM bm WHERE rank <= 10 AND score > 0",
        "dense_cells": f"WITH {dense('(SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)', 10)} SELECT query_id, rank, doc_id, score FROM nn",
        "dense_topk": f"WITH {dense('(SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)', 10)} SELECT query_id, rank, doc_id, score FROM nn",
        "hybrid_topk": f"""WITH {BM25}, {dense('(SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id IN (SELECT query_id FROM sq))', 20)},
un AS (SELECT query_id, doc_id, min(rank) AS best FROM (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 30 AND score > 0 UNION ALL SELECT query_id, doc_id, rank FROM nn) GROUP BY ALL),
cp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, doc_id) AS place FROM un),
rr AS (SELECT query_id, doc_id, {f1('query', 'text')} AS raw FROM cp JOIN documents USING (doc_id) JOIN sq USING (query_id) WHERE place <= 40),
rk AS (SELECT query_id, doc_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 10) DESC, doc_id) AS rank FROM rr) SELECT query_id, rank, doc_id, score FROM rk WHERE rank <= 8""",
        "boosted_topk": f"""WITH {BM25}, bb AS (SELECT query_id, doc_id, rank, round(score + CASE WHEN source IN ('src1', 'src2') THEN 2.0 ELSE 0.0 END, 6) AS score FROM bm JOIN documents USING (doc_id) WHERE rank <= 20 AND score > 0),
bk AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM bb) SELECT query_id, rank, doc_id, score FROM bk WHERE rank <= 8""",
        "query_expand": expansion(),
        "chunk_documents": f"WITH {CHUNKS} SELECT * EXCLUDE (body) FROM ch",
        "chunk_stats": f"WITH {CHUNKS} SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, round(100.0 * count(section_id) / count(*), 6) AS section_coverage, min(length) AS min_length, max(length) AS max_length, round(avg(length), 6) AS avg_length FROM ch",
        "chunk_text": f"WITH {enriched()} SELECT doc_id, chunk_index, section_title, length(text)::INT AS length, md5(text) AS text FROM rt",
        "frames_removed": f"""WITH li AS (SELECT doc_id // 4 AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
no AS (SELECT *, 4 + 13 * (i % 8) AS y0, regexp_replace({strip('lower(t)')}, '\\s+', ' ', 'g') AS norm FROM li), pg AS (SELECT doc, count(DISTINCT page) AS pages FROM li GROUP BY doc),
re AS (SELECT doc, norm FROM no JOIN pg USING (doc) WHERE length(norm) > 5 AND length(norm) < 100 AND pages > 1 GROUP BY doc, norm, pages HAVING count(*) >= greatest(2, pages // 3)),
kp AS (SELECT doc, page, string_agg(t, chr(10) ORDER BY i, t) AS t FROM no WHERE y0 >= 8 AND y0 <= 92 AND length({strip('t')}) > 5 AND (doc, norm) NOT IN (SELECT doc, norm FROM re) GROUP BY doc, page)
SELECT doc, md5(string_agg(t, chr(10) || chr(10) ORDER BY page, t)) AS text FROM kp WHERE {strip('t')} <> '' GROUP BY doc""",
        "labelled_documents": "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "section_backfill": f"""WITH {enriched()},
ar AS (SELECT doc_id, chunk_index, coalesce(section_id, 'EA-' || {first_of("concat_ws(' ', l2, l1, n1, n2, text)", chunking.SECTION_PATTERNS, '(?i)')}) AS found FROM
  (SELECT *, lag(text, 2) OVER o AS l2, lag(text, 1) OVER o AS l1, lead(text, 1) OVER o AS n1, lead(text, 2) OVER o AS n2 FROM rt WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_index))),
sq2 AS (SELECT *, row_number() OVER o AS rn, max(CASE WHEN found IS NOT NULL THEN chunk_index END) OVER o AS src FROM ar WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_index))
SELECT a.doc_id, a.chunk_index, coalesce(a.found, b.found || repeat('-cont', a.rn - b.rn)) AS section_id FROM sq2 a LEFT JOIN sq2 b ON b.doc_id = a.doc_id AND b.chunk_index = a.src""",
        "repeated_blocks": f"WITH {lines} SELECT doc, norm, count(*) AS n FROM no JOIN pg USING (doc) WHERE length(norm) > 5 AND length(norm) < 100 AND pages > 1 GROUP BY doc, norm, pages HAVING count(*) >= greatest(2, pages // 3)",
        "clean_lines": f"SELECT doc_id, md5({cleaned}) AS cleaned FROM documents",
        "pii_scrub": f"SELECT doc_id, array_to_string(list_filter([{kinds}], lambda x: x IS NOT NULL), ',') AS kinds, md5({masked('text')}) AS masked FROM documents",
        "pii_stats": f"SELECT kind, count(*) AS n FROM (SELECT unnest([{kinds}]) AS kind FROM documents) WHERE kind IS NOT NULL GROUP BY kind",
        "policy_classify": policies(),
        "policy_by_table": policies(),
        "keyword_documents": f"""WITH w AS (SELECT DISTINCT unnest({words('text')}) AS keyword FROM benchmark)
SELECT keyword, count(*) AS documents FROM w JOIN documents ON contains(lower(text), keyword) WHERE length(keyword) >= 6 GROUP BY keyword""",
        "guardrail_report": guarding(),
        "answer_check": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'no_object,answer,citations,confidence,should_escalate' ELSE concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'answer' END,
  CASE WHEN p_partkey % 4 = 0 THEN 'citations' END, CASE WHEN p_partkey % 3 = 0 THEN 'confidence' END) END AS problems FROM part""",
        "token_usage": f"SELECT role, (sum(len({words('text')})) * 13 // 10)::BIGINT AS tokens FROM conversations GROUP BY role",
        "citation_validate": citing(),
        "canonical_normalize": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'EA-2022-' || p_partkey % 90 || 'E' WHEN 1 THEN 'EA-2022-' || p_partkey % 90 || 'E' ELSE 'EA-2022-' || p_partkey % 90 || 'F(2)' END AS section FROM part",
        "citation_scores": f"""WITH a AS (SELECT p_partkey, {ids('p_partkey % 5', 'p_partkey % 7')} AS p, {ids('p_partkey % 3', 'p_partkey % 5')} AS g FROM part),
b AS (SELECT p_partkey, len(list_intersect(p, g)) AS c, len(list_distinct(list_concat(p, g))) AS u FROM a)
SELECT p_partkey, (c > 0)::INT::DOUBLE AS overlap_em, round(c / u, 6) AS overlap_iou, (c = u)::INT::DOUBLE AS exact_em, round(c / u, 6) AS exact_iou FROM b""",
        "numeric_validate": numbers(),
        "retrieval_metrics": f"{retrieval()} SELECT * FROM me",
        "retrieval_summary": f"{retrieval()}, up AS (UNPIVOT me ON COLUMNS(* EXCLUDE (query_id)) INTO NAME metric VALUE value) SELECT metric, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM up GROUP BY metric",
        "confusion_rollup": f"""WITH a AS (SELECT lang, {any_of('lower(text)', ['worthless', 'pathetic', 'stupid', 'hate'])} AS p, toxic = 1 AS a FROM labels JOIN documents USING (doc_id)),
b AS (SELECT lang, {flag(1, 1)} AS tp, {flag(1, 0)} AS fp, {flag(0, 1)} AS fn, {flag(0, 0)} AS tn FROM a GROUP BY GROUPING SETS ((lang), ())),
c AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM b)
SELECT lang, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""",
        "lexical_f1_pairs": f"WITH {PAIRS} SELECT conv_id, turn, round({f1('text', 'nx')}, 6) AS f1 FROM pr WHERE nx IS NOT NULL",
        "win_rate": f"""WITH {PAIRS}, bf AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS bt FROM pr WHERE nx IS NOT NULL)
SELECT role, count(*) AS n, round(avg(CASE WHEN {f1('text', 'nx')} > {f1('text', 'bt')} THEN 1 ELSE 0 END), 6) AS win_rate FROM bf WHERE bt IS NOT NULL GROUP BY role""",
        "rewards": f"WITH {rewarding()} SELECT * FROM rd",
        "reward_moving_avg": f"WITH {rewarding()} SELECT conv_id, turn, round(avg(reward) OVER (PARTITION BY conv_id ORDER BY turn ROWS 4 PRECEDING), 6) AS moving FROM rd",
        "reward_summary": f"WITH {rewarding()} SELECT count(*) AS n, round(avg(reward), 6) AS mean, round(stddev_pop(reward), 6) AS deviation, count(*) FILTER (reward > 0) AS positive, count(*) FILTER (reward = 0) AS neutral, count(*) FILTER (reward < 0) AS negative FROM rd",
        "sft_stratified": """WITH z AS (SELECT source, count(*) AS n FROM documents GROUP BY source), o AS (SELECT source, row_number() OVER (ORDER BY n DESC, source) AS place, greatest(1, 100 // count(*) OVER ()) AS base, count(*) OVER () AS strata FROM z),
u AS (SELECT source, base + CASE WHEN place <= 100 - base * strata THEN 1 ELSE 0 END AS quota FROM o), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|42'), doc_id) AS k FROM documents)
SELECT doc_id, r.source FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source WHERE k <= quota""",
        "sft_split": f"WITH {SPLIT} SELECT doc_id, split FROM sp",
        "stable_eval_subset": "SELECT doc_id, 'eval_' || sha256(concat_ws('|', doc_id::VARCHAR, source, lang))[1:12] AS stable_id FROM documents ORDER BY stable_id LIMIT 30",
        "leakage_check": f"WITH {SPLIT} SELECT count(*) AS shared_texts FROM (SELECT h FROM sp WHERE split = 'train' INTERSECT SELECT h FROM sp WHERE split = 'eval')",
        "near_dup_pairs": similar(),
        "near_dup_kept": """WITH RECURSIVE e AS MATERIALIZED (SELECT item_id AS id, lower(text) AS t, row_number() OVER (ORDER BY item_id) AS n FROM benchmark),
p AS MATERIALIZED (SELECT r.id, list(l.id) AS near FROM e l JOIN e r ON l.id < r.id AND l.t <> '' AND r.t <> '' AND (l.t = r.t OR round(1 - levenshtein(l.t, r.t) / greatest(length(l.t), length(r.t)), 6) > 0.8) GROUP BY r.id),
s AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS stay UNION ALL SELECT e.n, CASE WHEN list_has_any(coalesce(p.near, []), s.stay) THEN s.stay ELSE s.stay || [e.id] END FROM s JOIN e ON e.n = s.n + 1 LEFT JOIN p ON p.id = e.id)
SELECT unnest(stay) AS item_id FROM (SELECT stay FROM s ORDER BY n DESC LIMIT 1)""",
        "severance": severance(),
        "model_routing": routing(),
        "answer_confidence": f"""WITH {BM25}, ls AS (SELECT query_id, list(score / 1000 ORDER BY rank) AS s FROM bm WHERE rank <= 10 AND score > 0 GROUP BY query_id)
SELECT query_id, round(greatest(0.1, least(s[1] + least(len(list_filter(s, lambda x: x > 0.5)) / 5, 0.2) + CASE WHEN query_id % 2 = 0 THEN 0.1 ELSE 0.0 END, 0.95)), 6) AS confidence FROM ls""",
        "json_extract": "SELECT event_id, md5(nullif(regexp_extract('Answer: ' || props || ' done.', '(?s)\\{.*\\}', 0), '')) AS body FROM events",
        "rate_limit": "SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events",
        "telemetry_minute": "SELECT epoch(date_trunc('minute', ts))::BIGINT AS minute, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
        "active_requests": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS active FROM events",
        "cache_replay_lru": lru(20, 3600),
        "latest_events": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
        "changed_events": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b",
    }
