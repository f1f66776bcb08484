"""The numbered queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from marlwork.llm import chat, licenses, quality, secrets

WS = "[\\x20\\x09-\\x0D]+"
WHITE_LIST = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secrets_sql(scope: int = 256) -> str:
    re2 = lambda p: quoted(p.replace("((?i)", "((?i:").replace("api_?key)", "api_?key))").replace("account_id)", "account_id))"))
    patterns = [
        (secrets.ASSIGN, 2, "length(part) >= 6"),
        (secrets.ACCESS, 0, "length(part) >= 20"),
        (secrets.HEX[:-1] + "{24,}", 0, "true"),
        (secrets.LOGIN, 2, "length(part) >= 3"),
        (secrets.KEY[:-1] + "{32,}", 0, "regexp_matches(part, '[A-Z]') AND regexp_matches(part, '[a-z]') AND regexp_matches(part, '[0-9]')"),
        (secrets.ENDPOINT, 0, "true"),
    ]
    found = " UNION ALL ".join(
        f"SELECT uid, {k} AS k, regexp_extract_all(t, {re2(p)}, 0) AS ms, string_split_regex(t, {re2(p)}) AS gs, regexp_extract_all(t, {re2(p)}, {g}) AS ps FROM d"
        for k, (p, g, _) in enumerate(patterns)
    )
    kept = " OR ".join(f"(k = {k} AND {rule})" for k, (_, _, rule) in enumerate(patterns))
    kinds = "[" + ", ".join(map(quoted, secrets.KINDS)) + "]"
    parts = "[" + ", ".join(map(quoted, secrets.KINDS.values())) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
p AS (SELECT uid, k, ps[i] AS part, length(ms[i]) AS n,
  list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS st FROM i),
s AS (SELECT uid, k, st::BIGINT AS st, (st + n)::BIGINT AS en, {parts}[k + 1] AS cls FROM p WHERE {kept}),
o AS (SELECT * FROM s WHERE k < 3 UNION ALL SELECT * FROM s w WHERE k >= 3 AND EXISTS (SELECT 1 FROM s b WHERE b.uid = w.uid AND b.cls <> w.cls AND abs(b.st - w.st) <= {scope})),
a AS (SELECT uid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg({kinds}[k + 1] || ':' || st || ':' || en, ',' ORDER BY st, k) FILTER (k < 3) AS base, string_agg({kinds}[k + 1] || ':' || st || ':' || en, ',' ORDER BY st, k) AS spans FROM o GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (uid)"""


def quality_sql(limit: int = 20, share: float = 0.05, left: float = 0.2, enough: int = 200) -> str:
    split = lambda x: f"list_filter(string_split_regex({x}, '{WS}'), lambda y: y <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {split("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: translate(x, {WHITE_LIST}, '') <> '') AS ls FROM d),
g AS (SELECT uid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT uid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8)),
r AS (SELECT uid, i FROM g QUALIFY count(*) OVER (PARTITION BY uid, g) > 1),
c AS (SELECT uid, sum(n)::BIGINT AS n FROM (SELECT uid, least(8, coalesce(lead(i) OVER (PARTITION BY uid ORDER BY i) - i, 8)) AS n FROM r) GROUP BY uid),
a AS (SELECT uid, host, list_transform(ls, lambda x: {{'h': md5(trim(regexp_replace(lower(x), '{WS}', ' ', 'g'), ' ')), 'n': len({split("x")})}}) AS ls FROM w),
o AS (SELECT uid, host, ls, md5(array_to_string(list_transform(ls, lambda x: x.h), ',')) AS name FROM a),
h AS (SELECT uid, host, name, l.h AS h, l.n AS n FROM (SELECT uid, host, name, unnest(ls) AS l FROM o)),
k AS (SELECT host, h, count(DISTINCT name) AS holders FROM h GROUP BY host, h),
z AS (SELECT host, count(DISTINCT name) AS size FROM o GROUP BY host),
x AS (SELECT host, h FROM k JOIN z USING (host) WHERE holders > {limit} AND holders > least({share}::DOUBLE * size, {enough})),
m AS (SELECT uid, sum(n)::BIGINT AS removed FROM h JOIN x USING (host, h) GROUP BY uid),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(t, {WHITE_LIST}, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, {quoted(quality.SYMBOLS)}, '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, coalesce(m.removed, 0) AS removed_words FROM w LEFT JOIN c USING (uid) LEFT JOIN m USING (uid)),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - removed_words >= {left} * n_words AS kept FROM b"""


def licenses_sql(k: int = 4, shift: int = 3, least: float = 0.75) -> str:
    rows = ", ".join(f"({i}, {quoted(label)}, string_split({quoted(text)}, ' '))" for i, (label, text) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"(string_split({quoted(p)}, ' '), {quoted(label)})" for p, label in licenses.PHRASES.items())
    coded = lambda x: f"array_to_string(list_transform({x}, lambda y: chr((33 + coalesce(list_position(tw, y), 0))::INT)), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT uid, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
ph(p, label) AS (VALUES {phrases}),
b AS (SELECT uid, i - 1 AS st, label FROM i JOIN ph ON i.w[i] = ph.p[1] AND i.w[i:i + len(ph.p) - 1] = ph.p),
tp(template, label, w) AS (VALUES {rows}),
tg AS (SELECT template, label, len(w) AS size, i - 1 AS tpos, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {k - 2})) AS i FROM tp WHERE len(w) >= {k})),
g AS (SELECT uid, i - 1 AS pos, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM i WHERE i + {k - 1} <= len(w)),
v AS (SELECT uid, template, label, size, pos - tpos AS diagonal, pos, tpos FROM g JOIN tg USING (g)),
dg AS (SELECT DISTINCT uid, template, diagonal FROM v),
f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY uid, template ORDER BY diagonal) <= {shift} THEN 0 ELSE 1 END AS far FROM dg),
sp AS (SELECT *, sum(far) OVER (PARTITION BY uid, template ORDER BY diagonal) AS span FROM f),
c AS (SELECT uid, template, label, size, span, min(pos) AS st, max(pos) + {k} AS en, list(DISTINCT tpos) AS ts FROM v JOIN sp USING (uid, template, diagonal) GROUP BY uid, template, label, size, span),
e AS (SELECT *, len(list_distinct(flatten(list_transform(ts, lambda t: range(t, t + {k}))))) / size AS cover FROM c),
q AS (SELECT e.uid, e.label, cover, d.w[st + 1:en] AS own, tp.w AS tw FROM e JOIN d USING (uid) JOIN tp USING (template) WHERE cover >= {least} AND en - st <= ceil(size * {2 - least})),
n AS (SELECT uid, label, cover FROM q WHERE 1 - levenshtein({coded("own")}, {coded("tw")}) / greatest(len(own), len(tw)) >= {least}),
ba AS (SELECT uid, count(*) AS n_base, min(st) AS first_word, max(st) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY uid),
al AS (SELECT uid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT uid, label FROM b UNION ALL SELECT uid, label FROM n) GROUP BY uid),
be AS (SELECT uid, max(cover) AS best FROM n GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN ba USING (uid) LEFT JOIN al USING (uid) LEFT JOIN be USING (uid)"""


def chat_sql(budget: int = 1024, history: int = 256, bytes_per_token: int = 4, turn_cost: int = 4, stretch: int = 64) -> str:
    def escaped(x: str, escapes) -> str:
        for plain, code in escapes:
            x = f"replace({x}, {quoted(plain)}, {quoted(code)})"
        return x

    control = quoted("\\### Assistant: </turn> ok")
    frame = len(chat.OPEN + chat.MIDDLE + chat.CLOSE)
    return f"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -7, 0, 'user', {control} UNION ALL SELECT -7, 1, 'assistant', {control}),
a AS (SELECT *, {turn_cost} + (strlen(t) + {bytes_per_token - 1}) // {bytes_per_token} AS tokens, {frame} + length({escaped("role", chat.ROLE_ESCAPES)}) + length({escaped("t", chat.ESCAPES)}) AS chars FROM r),
n AS (SELECT *, coalesce(conv_id::VARCHAR, '') AS k, row_number() OVER o AS n, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS after FROM a WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t)),
y AS (SELECT k, tokens, chars FROM n WHERE n = 1 AND role = 'system'),
b AS (SELECT n.*, after - n.tokens AS before, (after - n.tokens) // {stretch * budget} AS st, coalesce(y.tokens, 0) AS sys, coalesce(y.chars, 0) AS sys_chars FROM n LEFT JOIN y USING (k)),
w AS (SELECT k, n, n AS first, before AS begin, st, sys FROM b WHERE n = 1
  UNION ALL SELECT b.k, b.n, CASE WHEN fits THEN w.first ELSE b.n END, CASE WHEN fits THEN w.begin ELSE b.before END, b.st, b.sys FROM w JOIN b ON b.k = w.k AND b.n = w.n + 1,
  LATERAL (SELECT b.st = w.st AND b.after - w.begin <= CASE WHEN w.first = 1 THEN {budget} ELSE {budget} - b.sys - {history} END AS fits)),
s AS (SELECT k, first, any_value(begin) AS begin, any_value(b.sys) AS sys, any_value(sys_chars) AS sys_chars, least({history}, {budget} - any_value(b.sys) - sum(tokens)) AS room FROM w JOIN b USING (k, n) WHERE first > 1 GROUP BY k, first),
h AS (SELECT s.k, sum(p.chars) AS chars FROM s JOIN b p ON p.k = s.k AND p.before >= s.begin - s.room AND p.before < s.begin AND p.n < s.first WHERE NOT (p.n = 1 AND p.role = 'system') GROUP BY s.k),
z AS (SELECT k, sum(sys_chars) AS chars FROM s GROUP BY k),
c AS (SELECT k, any_value(conv_id) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY n)) AS turns_sha256, coalesce(string_agg(t, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM b GROUP BY k)
SELECT c.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (c.chars + coalesce(h.chars, 0) + coalesce(z.chars, 0))::BIGINT AS formatted_chars
FROM c LEFT JOIN h USING (k) LEFT JOIN z USING (k)"""


def lm_sql(strength: float = 20.0) -> str:
    """The model of order 2: a word's probability after another, or after the beginning, and by itself."""
    steps = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    # crc32, byte by byte: a byte is mixed in, and each -1 is one of the eight shifts that follow it.
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WS}'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce({crc} % 7 = 2, false) AS held_out, doc_id IS NOT NULL AS known, list_transform({words}, lambda x: 'w' || x) || ['e'] AS w FROM documents),
t AS MATERIALIZED (SELECT uid, known AND NOT held_out AS learn, unnest(w) AS x, unnest(['b'] || w[:-2]) AS h FROM d),
u AS MATERIALIZED (SELECT x, count(*) AS c FROM t WHERE learn GROUP BY x),
n AS MATERIALIZED (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM u),
s AS (SELECT x, c FROM u UNION ALL SELECT 'b', count(*) FROM d WHERE known AND NOT held_out),
b AS (SELECT h, x, count(*) AS c FROM t WHERE learn GROUP BY h, x),
p AS (SELECT uid, coalesce(u.c, 0) AS c, coalesce(s.c, 0) AS ch, coalesce(b.c, 0) AS cb, (coalesce(u.c, 0) + 1)::DOUBLE / (n + v + 1) AS q FROM n, t LEFT JOIN u ON u.x = t.x LEFT JOIN s ON s.x = t.h LEFT JOIN b ON b.h = t.h AND b.x = t.x),
a AS (SELECT uid, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, sum(log10(q)) AS base_score, sum(log10(CASE WHEN ch > 0 THEN (cb + {strength}::DOUBLE * q) / (ch + {strength}::DOUBLE) ELSE q END)) AS score FROM p GROUP BY uid)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM d JOIN a USING (uid), n"""


def phrases_sql(least: int = 10, share: int = 50, top: int = 2000) -> str:
    """Phrases of two and three words."""
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) r(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g HAVING count(*) >= {least}),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS s, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
e AS (SELECT c.lang, c.g, c.k, a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score FROM c
  JOIN f l ON l.lang = c.lang AND l.k = cut AND l.g = array_to_string(s[:cut], ' ') JOIN f r ON r.lang = c.lang AND r.k = c.k - cut AND r.g = array_to_string(s[cut + 1:], ' ')),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
o AS (SELECT lang, f, unnest([array_to_string(string_split(g, ' ')[:2], ' '), array_to_string(string_split(g, ' ')[2:], ' ')]) AS g FROM f WHERE k = 3),
x AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.g = b.g AND 100 * o.f >= {share} * b.a)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM x)
SELECT lang, rank, g AS phrase, a, l, r, n, score::BIGINT AS score FROM k JOIN n USING (lang) WHERE rank <= {top}"""
