"""The queries of training_queries in DuckDB SQL."""

from __future__ import annotations

from marlwork.operators import citations, datasets, evaluation, preferences
from marlwork.plans.oracle import any_of, f1, listing, q, strip, words
from marlwork.plans.training_queries import N_PAIRS

VALID = listing(citations.DEFAULT_SECTIONS)
KNOWN = listing([f"EA-2022-{n}" for n in range(20, 50)])
CH = "ch AS (SELECT doc_id AS chunk_id, 'EA-' || (doc_id % 61 + 12) || CASE doc_id % 3 WHEN 0 THEN 'E' WHEN 1 THEN '' ELSE 'F(1)' END AS section_id, text FROM documents)"


def canon(x: str) -> str:
    up = f"upper({strip(x)})"
    full, old = q(r"^(EA-\d{4}-\d+[A-Z]*(?:\(\d+\))?)\b"), q(r"^EA-(\d+[A-Z]*(?:\(\d+\))?)$")
    return f"coalesce(nullif(regexp_extract({up}, {full}, 1), ''), 'EA-2022-' || nullif(regexp_extract({up}, {old}, 1), ''))"


def extracted(x: str) -> str:
    return f"list_distinct(regexp_extract_all(upper({x}), {q(citations.CANONICAL)}, 1))"


def family(x: str) -> str:
    return f"nullif(regexp_extract({x}, {q(citations.FAMILY)}, 1), '')"


def number(key: str, what: str) -> str:
    return f"('0x' || md5({key} || '|{what}')[1:8])::BIGINT"


def picked(values: str, key: str, what: str) -> str:
    return f"{values}[{number(key, what)} % len({values}) + 1]"


def canons(xs: str) -> str:
    return f"list_filter(list_transform({xs}, lambda z: {canon('z')}), lambda z: z IS NOT NULL AND list_contains({VALID}, z))"


def joined(xs: str) -> str:
    return f"array_to_string(list_sort({xs}), ',')"


def filled(sentence: str, *values: str) -> str:
    parts = sentence.split("{}")
    return " || ".join([q(parts[0])] + [y for v, p in zip(values, parts[1:], strict=True) for y in (f"({v})", q(p))])


def different(section: str, key: str) -> str:
    others = f"list_sort(list_filter({VALID}, lambda z: z <> {section}))"
    far = f"list_filter({others}, lambda z: {family(section)} IS NOT NULL AND {family('z')} IS DISTINCT FROM {family(section)})"
    values = f"CASE WHEN len({far}) > 0 THEN {far} ELSE {others} END"
    return picked(f"({values})", key, "different")


ANSWERS = """an AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE 'Under EA-2022-' || p_partkey % 80 || CASE WHEN p_partkey % 3 = 0 THEN 'E' ELSE '' END || ' and ea-2022-60f(1) the law says: ' || p_name END AS response,
  'EA-' || p_partkey % 5 * 20 || CASE WHEN p_partkey % 2 = 0 THEN 'F' ELSE '' END AS section, 'the law says ' || p_name AS good, 'it depends on ' || p_name || ' under EA-2022-60F' AS bad FROM part)"""
METRICS = f"""gm AS (SELECT *, {extracted('response')} AS found FROM an), gn AS (SELECT *, {canons('found')} AS p, {canons('[section]')} AS g, list_filter(found, lambda z: list_contains({VALID}, z)) AS vp FROM gm),
me AS (SELECT *, (len(list_intersect(p, g)) > 0)::INT::DOUBLE AS em, coalesce(len(list_intersect(p, g)) / nullif(len(list_distinct(list_concat(p, g))), 0), 0.0) AS iou FROM gn)"""


def similarity(target: str) -> str:
    return f"0.5 * em + 0.3 * iou + 0.2 * ({f1('response', target)})"


def prompting(kind: str, key: str) -> str:
    out = f"CASE {kind} " + " ".join(f"WHEN {q(k)} THEN {picked(listing(v), key, 'prompt')}" for k, v in preferences.PROMPTS.items()) + " END"
    for name, values in preferences.FILLS.items():
        out = f"replace({out}, '{{{name}}}', {picked(listing(values), key, name)})"
    return out


def choosing(prompt: str, section: str, text: str) -> str:
    lead = "CASE " + " ".join(f"WHEN {any_of(f'lower({prompt})', ws)} THEN {filled(s, section)}" for ws, s in preferences.LEADS) + f" ELSE {filled(preferences.LEAD, section)} END"
    return f"{lead} || {filled(preferences.STATES, strip(f'{text}[1:300]'))} || {filled(preferences.SOURCE, section)}"


def rejecting(flaw: str, section: str, text: str, key: str) -> str:
    quote = lambda n: strip(f"{text}[1:{n}]")
    other = different(section, key)
    return f"""CASE {flaw} WHEN 0 THEN {filled(preferences.UNCITED, quote(300))} WHEN 1 THEN {filled(preferences.WRONG, other, quote(200))} || {filled(preferences.SOURCE, other)}
  WHEN 2 THEN {filled(preferences.INVENTED, picked(listing(preferences.DETAILS), key, 'detail'), quote(150))} || {filled(preferences.SOURCE, section)} ELSE {q(preferences.VAGUE)} END"""


def pairing(target: int = N_PAIRS, first: int = 50) -> str:
    """CTEs up to pp: the pairs with their answers."""
    n = len(preferences.KINDS)
    keywords = ", ".join(f"CASE WHEN contains(lower(prompt), {q(k)}) THEN {listing(v)} END" for k, v in citations.KEYWORDS.items())
    return f"""{CH}, nm AS (SELECT *, coalesce({canon('section_id')}, section_id) AS section FROM ch), nf AS (SELECT *, {family('section')} AS family, md5(chunk_id || '|42') AS r FROM nm),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY r, chunk_id) AS k FROM nf) WHERE k = 1),
fi AS (SELECT * FROM (SELECT chunk_id, row_number() OVER (ORDER BY md5(section_id || '|42'), section_id) - 1 AS pair_id FROM one) WHERE pair_id < {target}),
aa AS (SELECT pair_id, pair_id >= (SELECT count(*) FROM fi) AS more, {listing(preferences.KINDS)}[CASE WHEN pair_id < (SELECT count(*) FROM fi) THEN pair_id ELSE 2 * pair_id - (SELECT count(*) FROM fi) END % {n} + 1] AS template_type FROM (SELECT unnest(range({target})) AS pair_id)),
ab AS (SELECT *, {prompting('template_type', 'pair_id')} AS prompt FROM aa),
po AS (SELECT *, count(*) OVER (PARTITION BY family) AS held FROM (SELECT family, chunk_id, row_number() OVER (PARTITION BY family ORDER BY r, chunk_id) - 1 AS place FROM nf WHERE family IS NOT NULL)),
hf AS (SELECT DISTINCT family, held FROM po),
ex AS (SELECT DISTINCT pair_id, unnest(flatten(list_filter([{keywords}], lambda z: z IS NOT NULL))) AS family FROM ab WHERE more),
ta AS (SELECT pair_id, list(struct_pack(family := family, held := held) ORDER BY family) AS xs FROM ex JOIN hf USING (family) GROUP BY pair_id),
tb AS (SELECT pair_id, xs[{number('pair_id', 'family')} % len(xs) + 1] AS x FROM ta),
bf AS (SELECT pair_id, po.chunk_id FROM tb JOIN po ON po.family = x.family AND po.place = {number('pair_id', 'chunk')} % x.held),
lf AS (SELECT pair_id, prompt FROM ab WHERE more AND pair_id NOT IN (SELECT pair_id FROM bf)),
fw AS (SELECT chunk_id, list_distinct({words('text')}) AS w FROM (SELECT * FROM nf ORDER BY chunk_id LIMIT {first})),
sw AS (SELECT pair_id, chunk_id, len(list_intersect(list_distinct({words('prompt')}), w)) / len(list_distinct(list_concat({words('prompt')}, w))) AS score FROM lf, fw),
bw AS (SELECT pair_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, chunk_id) AS k FROM sw WHERE score > 0) WHERE k = 1),
ad AS (SELECT chunk_id, row_number() OVER (ORDER BY r, chunk_id) - 1 AS place FROM nf),
bc AS (SELECT pair_id, chunk_id FROM lf JOIN ad ON place = {number('pair_id', 'any')} % (SELECT count(*) FROM ad) WHERE pair_id NOT IN (SELECT pair_id FROM bw)),
pl AS (SELECT pair_id, chunk_id FROM fi UNION ALL SELECT * FROM bf UNION ALL SELECT * FROM bw UNION ALL SELECT * FROM bc),
pa AS (SELECT pair_id, template_type, prompt, section_id, section, chunk_id, text FROM ab JOIN pl USING (pair_id) JOIN nf USING (chunk_id)),
pp AS (SELECT *, {choosing('prompt', 'section', 'text')} AS chosen, {rejecting('pair_id % 4', 'section', 'text', 'pair_id')} AS rejected FROM pa),
pq AS (SELECT *, list_has_any(list_filter({extracted('chosen')}, lambda z: list_contains({VALID}, z)), {canons('[section]')}) AS chosen_ok, list_has_any(list_filter({extracted('rejected')}, lambda z: list_contains({VALID}, z)), {canons('[section]')}) AS rejected_ok FROM pp)"""


def every_pair() -> str:
    return f"""{CH}, nm AS (SELECT *, coalesce({canon('section_id')}, section_id) AS section, {listing(preferences.KINDS)}[chunk_id % 4 + 1] AS kind FROM ch), ns AS (SELECT *, {prompting('kind', 'chunk_id')} AS prompt FROM nm),
ep AS (SELECT chunk_id AS pair_id, prompt, {choosing('prompt', 'section', 'text')} AS chosen, {rejecting('chunk_id % 4', 'section', 'text', 'chunk_id')} AS rejected FROM ns)"""


SFT = """sf AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Short?' WHEN 1 THEN '' WHEN 2 THEN 'Tell me about your country' ELSE 'What does ' || source || ' say in matter ' || doc_id % 97 || '?' END AS instruction,
  CASE WHEN doc_id % 2 = 0 THEN 'EA-2022-' ELSE 'EA-' END || (doc_id % 40 + 20) AS section, text, doc_id % 3 = 0 AS numeric_claims, CASE WHEN doc_id % 6 = 0 THEN 'eval' ELSE 'train' END AS split FROM documents),
sg AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'None.' WHEN 1 THEN text ELSE 'According to ' || section || ': ' || text[1:200] END AS output, CASE WHEN doc_id % 11 = 0 THEN []::VARCHAR[] WHEN doc_id % 13 = 0 THEN [section, 'Act 5'] ELSE [section] END AS cites FROM sf)"""


def row_issues(cites: str = "cites") -> str:
    form = q(datasets.CITATION)
    rules = [
        (f"length(instruction) BETWEEN 10 AND 2000 AND length({strip('instruction')}) >= 10", "instruction_length"),
        (any_of("lower(instruction)", datasets.QUESTION_MARKS), "instruction_not_a_question"),
        (f"length(output) BETWEEN 20 AND 1000 AND length({strip('output')}) >= 20", "output_length"),
        (any_of("lower(output)", datasets.ANSWER_TERMS), "output_not_legal"),
        (f"len({cites}) BETWEEN 1 AND 10", "citations_number"),
        (f"len(list_filter({cites}, lambda z: NOT regexp_matches(z, {form}))) = 0", "citations_form"),
    ]
    return "list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN {q(name)} END" for ok, name in rules) + "], lambda z: z IS NOT NULL)"


CHECKED = f"""{SFT}, s1 AS (SELECT *, list_filter([CASE WHEN instruction = '' THEN 'empty_instruction' END, CASE WHEN output = '' THEN 'empty_output' END, CASE WHEN len(cites) = 0 THEN 'empty_citations' END], lambda z: z IS NOT NULL) AS missing, {row_issues()} AS issues,
  list_filter(cites, lambda z: {canon('z')} IS NOT NULL AND NOT list_contains({KNOWN}, {canon('z')})) AS unk, list_filter(cites, lambda z: {canon('z')} IS NULL) AS unformed, {extracted('output')} AS outs FROM sg),
s2 AS (SELECT *, list_filter(cites, lambda z: contains(output, z) OR coalesce(list_contains(outs, {canon('z')}), false)) AS present FROM s1),
s3 AS (SELECT *, list_concat(list_concat(missing, CASE WHEN len(missing) = 0 AND len(unk) > 0 THEN ['citation_unknown'] ELSE [] END), CASE WHEN len(issues) > 0 THEN ['schema'] ELSE [] END) AS errors,
  CASE WHEN len(missing) > 0 THEN [] ELSE list_filter([CASE WHEN len(unformed) > 0 THEN 'citation_form' END, CASE WHEN length(instruction) < 10 THEN 'short_instruction' END, CASE WHEN length(output) < 20 THEN 'short_output' END, CASE WHEN length(output) > 1000 THEN 'long_output' END, CASE WHEN len(present) < len(cites) THEN 'citation_absent' END], lambda z: z IS NOT NULL) END AS warnings FROM s2)"""
JUDGED = """ju AS (SELECT conv_id, turn, text || ['', ' I cannot help; please consult a lawyer.', ' It depends on your situation.', ' You get triple compensation.', ' According to section EA-2022-60E you get 14 days.', ' The law: EA-2022-999.'][(conv_id + turn) % 6 + 1] AS text,
  CASE WHEN (conv_id + turn) % 11 = 0 THEN '?' ELSE 'grounded: ' || CASE WHEN (conv_id + turn) % 3 = 0 THEN 'no' ELSE 'yes' END || chr(10) || 'SCORE: ' || CASE WHEN (conv_id + turn) % 4 = 0 THEN 'high' ELSE ((conv_id + turn) % 10 / 10)::VARCHAR END || chr(10) || 'REASONING: because ' || chr(10) || ' it is ' END AS reply FROM conversations WHERE role = 'assistant')"""
GRADED = f"""{JUDGED}, jf AS (SELECT conv_id, turn, {any_of('lower(text)', evaluation.REFUSING)} AS refusal, {any_of('lower(text)', evaluation.INVENTED)} AS hallucination, (conv_id + turn) % 11 > 0 AND (conv_id + turn) % 3 > 0 AS ok,
  CASE WHEN (conv_id + turn) % 11 = 0 OR (conv_id + turn) % 4 = 0 THEN 0.5 ELSE (conv_id + turn) % 10 / 10 END::DOUBLE AS raw, CASE WHEN (conv_id + turn) % 11 = 0 THEN 'Could not parse evaluation' ELSE 'because ' || chr(10) || ' it is' END AS reasoning FROM ju),
gr AS (SELECT *, ok AND NOT hallucination AS grounded, CASE WHEN ok AND hallucination THEN least(raw, 0.3::DOUBLE) ELSE raw END AS score FROM jf)"""


def quality(x: str) -> str:
    add = lambda ok, v: f"CASE WHEN {ok} THEN {v}::DOUBLE ELSE 0.0::DOUBLE END"
    w = words(x)
    total = " + ".join([add(f"length({x}) BETWEEN 50 AND 500", 0.3), add(f"regexp_matches({x}, '\\b\\d+\\b')", 0.2), add(any_of(f"lower({x})", evaluation.JUDGED_TERMS), 0.3), add(f"len(list_distinct({w})) / len({w}) > 0.6", 0.2)])
    return f"CASE WHEN len({w}) = 0 THEN 0.0::DOUBLE ELSE least({total}, 1.0::DOUBLE) END"


def rewarding() -> str:
    ok = {
        "citations": f"len(list_filter(found, lambda z: list_contains({VALID}, z))) > 0",
        "grounding": any_of("lower(text)", citations.LEGAL_TERMS),
        "gold_section": "conv_id % 2 = 0 AND list_contains(found, 'EA-2022-60E')",
        "hallucination": f"({any_of('lower(text)', evaluation.REWARD_INVENTED)} OR len(list_filter(found, lambda z: NOT list_contains({VALID}, z))) > 0)",
        "policy_violation": any_of("lower(text)", evaluation.SAFETY),
    }
    parts = {k: f"CASE WHEN {x} THEN {evaluation.WEIGHTS[k]}::DOUBLE ELSE 0.0::DOUBLE END" for k, x in ok.items()}
    return f"WITH {JUDGED}, jx AS (SELECT *, {extracted('text')} AS found FROM ju) SELECT conv_id, turn, " + ", ".join(f"{x} AS {k}" for k, x in parts.items()) + f", {' + '.join(parts.values())} AS total FROM jx"


def advising() -> str:
    p, d = evaluation.PPO_ADVICE, evaluation.DPO_ADVICE
    at = lambda n: f"(p_partkey % {n} / {n})"
    some = f"list_filter([CASE WHEN {at(7)} * 4 - 2 < 0 THEN {q(p['negative'])} END, CASE WHEN {at(5)} < 0.6::DOUBLE THEN {q(p['few_good'])} END, CASE WHEN {at(3)} > 0.3::DOUBLE THEN {q(p['many_bad'])} END, CASE WHEN {at(7)} * 4 - 2 > 1 THEN {q(p['aligned'])} END, CASE WHEN p_partkey % 13 = 0 THEN {q(p['error'])} END], lambda z: z IS NOT NULL)"
    wins = f"CASE WHEN {at(6)} < 0.6::DOUBLE THEN {q(d['low_wins'])} WHEN {at(6)} > 0.8::DOUBLE THEN {q(d['high_wins'])} END"
    exact = f"CASE WHEN {at(4)} < 0.5 THEN {q(d['low_citations'])} WHEN {at(4)} > 0.8::DOUBLE THEN {q(d['high_citations'])} END"
    return f"""SELECT p_partkey, CASE WHEN len({some}) = 0 THEN {q(p['none'])} ELSE array_to_string({some}, '|') END AS ppo, concat_ws('|', {wins}, {exact}, CASE WHEN {at(9)} > 0.1::DOUBLE THEN {q(d['unsafe'])} ELSE {q(d['safe'])} END) AS dpo,
  round(coalesce(2 * {at(7)} * {at(5)} / nullif({at(7)} + {at(5)}, 0), 0.0), 6) AS f1 FROM part"""


def moving() -> str:
    cases = " ".join(f"WHEN least(5, n // 4) = {w} THEN avg(v) OVER (PARTITION BY conv_id ORDER BY turn ROWS {w - 1} PRECEDING)" for w in range(1, 6))
    return f"WITH a AS (SELECT conv_id, turn, length(text) AS v, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, round(CASE WHEN n <= 5 THEN NULL {cases} END, 6) AS moving FROM a"


def telling() -> str:
    mark = "CASE WHEN title <> '' AND NOT contains(s, lower('(regarding ' || title || ')')) THEN '(regarding ' || title || ')' ELSE '[Section ' || section || ']' END"
    return f"""WITH {SFT}, a AS (SELECT doc_id, instruction, CASE WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id % 9 ELSE '' END AS title, coalesce(cites[1], 'none') AS section, lower({strip('instruction')}) AS s FROM sg),
b AS (SELECT doc_id, section, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY doc_id) = 1 THEN instruction ELSE instruction || ' ' || {mark} END AS instruction FROM a)
SELECT doc_id, instruction FROM b QUALIFY row_number() OVER (PARTITION BY lower({strip('instruction')}), section ORDER BY doc_id) = 1"""


def all_sql() -> dict[str, str]:
    begins = listing(["Overtime or rest day? ", "A complaint: ", "Notice! ", ""])
    keywords = ", ".join(f"CASE WHEN contains(lower(t), {q(k)}) THEN {listing(v)} END" for k, v in citations.KEYWORDS.items())
    own = f"{VALID}[p_partkey % {len(citations.DEFAULT_SECTIONS)} + 1]"
    issues = f"concat_ws(',', CASE WHEN len({extracted('response')}) = 0 THEN 'chosen_no_citations' END, CASE WHEN list_contains({extracted('bad')}, upper(s)) THEN 'rejected_has_gold_section' END)"
    draft = "response || '. (Source: Employment Act Section EA-2022-' || p_partkey % 80 || ')' || chr(10) || 'End.'"
    kind = number("p_partkey", "flaw") + " % 3"
    preview = lambda x: f"md5(CASE WHEN length({x}) > 100 THEN {x}[1:100] || '...' ELSE {x} END)"
    ids = "list_transform(string_split_regex(trim(lower(text)), '\\s+'), lambda z: length(z))"
    ids = f"list_transform({words('text')}, lambda z: length(z))"
    return {
        "section_universe": f"WITH {CH} SELECT DISTINCT {canon('section_id')} AS section FROM ch",
        "section_families": f"WITH {CH}, nm AS (SELECT {canon('section_id')} AS section FROM ch) SELECT {family('section')} AS family, count(*) AS n_chunks, count(DISTINCT section) AS n_sections, string_agg(DISTINCT section, ',' ORDER BY section) AS sections FROM nm GROUP BY 1",
        "keyword_families": f"WITH a AS (SELECT conv_id, turn, {begins}[conv_id % 4 + 1] || text AS t FROM conversations WHERE role = 'user') SELECT conv_id, turn, {joined(f'list_distinct(flatten(list_filter([{keywords}], lambda z: z IS NOT NULL)))')} AS families FROM a",
        "families_by_table": f"WITH a AS (SELECT conv_id, turn, {begins}[conv_id % 4 + 1] || text AS t FROM conversations WHERE role = 'user') SELECT conv_id, turn, {joined(f'list_distinct(flatten(list_filter([{keywords}], lambda z: z IS NOT NULL)))')} AS families FROM a",
        "citation_grounding": f"WITH {ANSWERS}, {METRICS} SELECT p_partkey, {joined('found')} AS predicted, em > 0 AS correctly_grounded, len(vp) > 0 AS valid_sections_mentioned, round(iou, 6) AS iou, em AS citation_em, {any_of('lower(response)', citations.LEGAL_TERMS)}::INT::DOUBLE AS anchored FROM me",
        "enhanced_win_rate": f"WITH {ANSWERS}, {METRICS}, sm AS (SELECT p_partkey % 10 AS kind, {similarity('good')} AS a, {similarity('bad')} AS b FROM me) SELECT kind, count(*) AS n, round(avg((a > b)::INT), 6) AS win_rate, round(avg(a), 6) AS mean FROM sm GROUP BY kind",
        "different_section": f"WITH a AS (SELECT p_partkey, {own} AS section FROM part) SELECT p_partkey, section, {different('section', 'p_partkey')} AS other, len(list_filter({VALID}, lambda z: {family('z')} = {family('section')}))::INT AS n_family FROM a",
        "pref_pairs": f"WITH {every_pair()} SELECT * FROM ep",
        "dataset_validation": f"WITH {every_pair()} SELECT count(*) AS n, count(*) FILTER (len({extracted('chosen')}) = 0) AS uncited, count(*) FILTER (chosen = rejected) AS same, count(DISTINCT prompt) AS prompts, count(*) FILTER (length(rejected) < 200) AS short FROM ep",
        "preference_set": f"WITH {pairing()} SELECT pair_id, template_type, prompt, section_id AS source_section, chunk_id, md5(chosen) AS chosen, md5(rejected) AS rejected, chosen_ok, rejected_ok FROM pq",
        "preference_gate": f"WITH {pairing()} SELECT count(*) AS n, count(*) FILTER (chosen_ok) AS grounded, round(avg(chosen_ok::INT), 6) AS ratio, avg(chosen_ok::INT) >= 0.6::DOUBLE AS enough FROM pq",
        "labelling_rows": f"WITH {pairing()} SELECT pair_id, {preview('chosen')} AS chosen_preview, {preview('rejected')} AS rejected_preview, len({extracted('chosen')})::INT AS chosen_valid_citations, len({extracted('rejected')})::INT AS rejected_valid_citations FROM pq",
        "preference_issues": f"WITH {ANSWERS}, a AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'ea-2022-60f' ELSE 'x' END AS s FROM an) SELECT p_partkey, {issues} AS issues FROM a",
        "preference_feedback": f"""WITH {ANSWERS}, a AS (SELECT *, 'EA-2022-60E' AS s FROM an), b AS (SELECT p_partkey, p_partkey % 3 = 0 AND p_partkey % 5 < 3 AS judged, p_partkey % 5 <> 1 AND p_partkey % 4 > 0 AS good FROM a WHERE {issues} = '')
SELECT p_partkey AS pair_id, judged AS label_verified FROM b WHERE NOT judged OR good""",
        "preference_split": f"WITH {CH}, s AS (SELECT section_id, row_number() OVER (ORDER BY md5(section_id || '|42'), section_id) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT section_id FROM ch)) SELECT chunk_id AS pair_id, CASE WHEN place <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'eval' END AS split FROM ch JOIN s USING (section_id)",
        "flawed_drafts": f"""WITH {ANSWERS}, a AS (SELECT p_partkey, 'EA-2022-' || p_partkey % 80 AS section, {draft} AS t FROM an), b AS (SELECT *, {different('section', 'p_partkey')} AS other FROM a)
SELECT p_partkey, md5(CASE {kind} WHEN 0 THEN replace(t, section, other) WHEN 1 THEN replace(regexp_replace(t, {q('(?i)' + citations.CANONICAL)}, 'the relevant section', 'g'), '(Source: Employment Act Section', '(Source: the relevant section')
  ELSE t || ' Additionally, you are entitled to ' || {picked(listing(preferences.DRAFT_DETAILS), 'p_partkey', 'draft')} || ' in such cases.' END) AS flawed, md5(t[1:instr(t, '. ')] || ' (EA-2022-99)' || t[instr(t, '. ') + 1:]) AS cited FROM b""",
        "dpo_rows": f"WITH {ANSWERS} SELECT p_partkey AS pair_id, '<|system|>' || chr(10) || 'Answer by the Act.' || chr(10) || '<|user|>' || chr(10) || good || chr(10) || '<|assistant|>' || chr(10) AS prompt, response AS chosen, bad AS rejected FROM an",
        "cycled_prompts": """WITH p AS (SELECT coalesce(text, '') AS p, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place, count(*) OVER () AS size FROM conversations WHERE role = 'user'),
a AS (SELECT unnest(range(1000)) AS id), b AS (SELECT id, p, size FROM a JOIN p ON place = id % size)
SELECT id, CASE WHEN id < size OR id % 4 = 3 THEN p WHEN id % 4 = 0 THEN 'According to Malaysian law, ' || lower(p) WHEN id % 4 = 1 THEN 'Under the Employment Act, ' || lower(p) ELSE 'What does the Employment Act say about: ' || replace(lower(p), '?', '') END AS prompt FROM b""",
        "example_checks": f"WITH {CHECKED} SELECT doc_id, array_to_string(errors, ',') AS errors, array_to_string(warnings, ',') AS warnings, array_to_string(issues, ',') AS schema_issues, len(present)::INT AS n_present FROM s3",
        "example_validation": f"""WITH {CHECKED}, t AS (SELECT count(*) AS total_examples, count(*) FILTER (len(missing) = 0) AS valid_examples, count(*) FILTER (len(issues) = 0) AS schema_valid_examples,
  count(*) FILTER (len(list_filter(cites, lambda z: NOT list_contains({KNOWN}, coalesce({canon('z')}, z)))) = 0) AS citation_valid_examples, count(*) FILTER (len(present) > 0) AS citation_present_in_output, round(100.0 * count(*) FILTER (len(present) > 0) / count(*), 6) AS citation_presence_rate,
  round(100.0 * sum(len(present)) / sum(len(cites)), 6) AS individual_citation_presence_rate, round(avg(length(instruction)) FILTER (len(missing) = 0), 6) AS avg_instruction_length, round(avg(length(output)) FILTER (len(missing) = 0), 6) AS avg_output_length,
  sum(CASE WHEN len(missing) = 0 THEN (length(instruction) < 10)::INT + (length(output) < 20)::INT ELSE 0 END)::BIGINT AS examples_with_length_issues, count(*) FILTER (len(errors) > 0) AS rows_with_errors, count(*) FILTER (len(warnings) > 0) AS rows_with_warnings FROM s3)
SELECT *, (SELECT count(DISTINCT c) FROM (SELECT unnest(cites) AS c FROM s3 WHERE len(missing) = 0)) AS unique_citations, 30 AS known_section_ids_count, rows_with_errors = 0 AND valid_examples > 0 AND citation_valid_examples = total_examples AS is_valid FROM t""",
        "split_checks": f"""WITH {SFT}, t AS (SELECT count(*) AS total_examples, count(*) FILTER (split = 'train') AS train_examples, count(*) FILTER (split = 'eval') AS eval_examples FROM sg),
u AS (SELECT *, (SELECT count(*) FROM (SELECT instruction FROM sg WHERE split = 'train' INTERSECT SELECT instruction FROM sg WHERE split = 'eval')) AS instruction_overlap, (SELECT count(*) FROM (SELECT unnest(cites) FROM sg WHERE split = 'train' INTERSECT SELECT unnest(cites) FROM sg WHERE split = 'eval')) AS section_overlap FROM t)
SELECT *, round(eval_examples / total_examples, 6) AS eval_ratio, CASE WHEN eval_examples / total_examples < 0.1 THEN 'eval_small' WHEN eval_examples / total_examples > 0.3 THEN 'eval_large' ELSE '' END AS warning, instruction_overlap = 0 AND section_overlap = 0 AS is_valid FROM u""",
        "set_rules": f"WITH {SFT}, t AS (SELECT count(*) AS n, 1 - count(DISTINCT lower({strip('instruction')})) / count(*) AS rate FROM sg) SELECT n, round(rate, 6) AS duplicate_rate, concat_ws(',', CASE WHEN n < 50 THEN 'too_small' END, CASE WHEN rate > 0.05::DOUBLE THEN 'repeated_instructions' END) AS issues FROM t",
        "example_statistics": f"""WITH {SFT} SELECT count(*) AS total_examples, round(avg(length(instruction)), 6) AS avg_instruction_length, round(avg(length(output)), 6) AS avg_answer_length, round(100.0 * avg((len(cites) > 0)::INT), 6) AS pct_with_citations, round(100.0 * avg(numeric_claims::INT), 6) AS pct_numeric_claims,
  round(100.0 * avg((len(list_filter(cites, lambda z: NOT list_contains({KNOWN}, coalesce({canon('z')}, z)))) = 0)::INT), 6) AS citation_validation_rate, (SELECT count(DISTINCT c) FROM (SELECT unnest(cites) AS c FROM sg)) AS section_coverage FROM sg""",
        "top_sections": f"WITH {SFT} SELECT c AS section, count(*) AS n FROM (SELECT unnest(cites) AS c FROM sg) GROUP BY c ORDER BY n DESC, c LIMIT 5",
        "schema_report": f"""WITH {SFT}, a AS (SELECT *, list_filter(list_transform(cites, lambda z: {canon('z')}), lambda z: z IS NOT NULL) AS cn FROM sg), b AS (SELECT *, CASE WHEN len(cn) > 0 THEN cn ELSE cites END AS c2 FROM a),
t AS (SELECT count(*) AS total_examples, count(*) FILTER (len({row_issues('c2')}) = 0) AS valid_examples FROM b) SELECT *, round(valid_examples / total_examples, 6) AS validation_rate, round(1 - valid_examples / total_examples, 6) AS error_rate FROM t""",
        "instructions_with_titles": telling(),
        "chat_labels": f"""WITH a AS (SELECT conv_id, turn, ({ids})[1:1010] AS x FROM conversations WHERE role = 'assistant'), b AS (SELECT *, least(len(x), 10) AS p FROM a)
SELECT conv_id, turn, coalesce(list_sum(x[1:64]), 0)::INT AS input_sum, (coalesce(list_sum(x[1:64]), 0) - coalesce(list_sum(x[1:p]), 0) - 100 * p)::INT AS label_sum, 64 AS attended FROM b""",
        "answer_flags": f"WITH {JUDGED} SELECT conv_id, turn, {any_of('lower(text)', evaluation.SAFETY)} AS safety, {any_of('lower(text)', evaluation.VAGUE)} AS vagueness, {any_of('lower(text)', evaluation.REFUSING)} AS refusal, {any_of('lower(text)', evaluation.INVENTED)} AS hallucination FROM ju",
        "judge_replies": f"WITH {GRADED} SELECT conv_id, turn, grounded, score, reasoning FROM gr",
        "generation_metrics": f"""WITH {GRADED} SELECT round(avg(score), 6) AS avg_groundedness_score, round(avg(hallucination::INT), 6) AS hallucination_rate, round(avg(refusal::INT), 6) AS refusal_rate, round(coalesce(avg(score) FILTER (refusal AND turn % 4 <> 1), 0.0), 6) AS refusal_precision,
  count(*) AS total_samples, count(*) FILTER (grounded) AS grounded_responses, count(*) FILTER (hallucination) AS hallucinated_responses, count(*) FILTER (refusal) AS refused_responses FROM gr""",
        "response_quality": f"WITH {JUDGED} SELECT conv_id, turn, round({quality('text')}, 6) AS quality FROM ju",
        "training_report": f"""WITH {JUDGED}, a AS (SELECT *, list_distinct(regexp_extract_all(text, {q(citations.CANONICAL)}, 1)) AS c FROM ju ORDER BY conv_id * 1000 + turn LIMIT 30), b AS (SELECT (len(c) = 1 AND c[1] = 'EA-2022-60E')::INT::DOUBLE AS e, CASE WHEN list_contains(c, 'EA-2022-60E') THEN 1.0 / len(c) ELSE 0.0 END AS p, {quality('text')} AS j, length(text) AS n, {any_of('lower(text)', evaluation.FORM_TERMS)}::INT AS f FROM a),
t AS (SELECT avg(coalesce(e, 0)) AS e, avg(p) AS p, avg(j) AS j, avg(n) AS n, avg(f) AS f, count(*) AS k FROM b)
SELECT round(e, 6) AS citation_exact_match, round(p, 6) AS citation_partial_match, round(j, 6) AS avg_judge_score, round(n, 6) AS response_length_avg, round(f, 6) AS valid_json_rate, k AS total_examples, round(p, 6) AS citation_precision, round(p, 6) AS citation_recall, round(coalesce(2 * p * p / nullif(p + p, 0), 0.0), 6) AS citation_f1_score FROM t""",
        "judged_rewards": rewarding(),
        "em_probe": f"WITH {JUDGED} SELECT conv_id % 8 AS step, round(avg((len(list_filter({extracted('text')}, lambda z: list_contains({VALID}, z))) > 0)::INT), 6) AS avg_em, count(*) AS num_prompts FROM ju GROUP BY 1",
        "run_advice": advising(),
        "retrieval_gate": "WITH a AS (SELECT conv_id % 50 AS q, (sum(turn) % 4) / 3 AS r FROM conversations GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (r = 0) AS failed, coalesce(string_agg(q, ',' ORDER BY q) FILTER (r = 0), '') AS failed_ids, round(avg(r), 6) AS mean, avg(r) >= 0.9 AS passed FROM a",
        "misjudged": "SELECT doc_id, CASE WHEN quality = 0 THEN 'false_refusal' ELSE 'missed_refusal' END AS error FROM labels WHERE (quality = 0) <> (toxic = 1) ORDER BY doc_id LIMIT 5",
        "aligned_series": "WITH " + ", ".join(f"{n} AS (SELECT event_id % 100 AS step, round(avg(value), 4) AS {n} FROM events WHERE event_id % {m} = 0 GROUP BY 1)" for m, n in ((2, "win_rate"), (3, "citation_em"), (5, "citation_iou"))) + " SELECT step, win_rate, citation_em, citation_iou FROM win_rate FULL JOIN citation_em USING (step) FULL JOIN citation_iou USING (step)",
        "trailing_average": moving(),
        "relevance": f"WITH {CH}, a AS (SELECT chunk_id, lower(CASE WHEN chunk_id % 5 > 0 THEN section_id ELSE '' END) AS s, lower(text) AS t, ['ea-6', 'ea-' || chunk_id % 50] AS g FROM ch) SELECT chunk_id, len(list_filter(g, lambda z: contains(s, z) OR contains(t, z))) > 0 AS relevant FROM a",
        "eval_subset_integrity": "WITH w AS (SELECT DISTINCT item_id * 37 AS pair_id FROM benchmark), t AS (SELECT count(*) AS expected, count(*) FILTER (pair_id IN (SELECT doc_id FROM documents)) AS found FROM w) SELECT expected, found, expected - found AS missing, expected = found AS integrity_ok FROM t",
        "stable_split": f"""WITH {CH}, g AS (SELECT section_id, count(*) AS n FROM ch GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY md5(section_id || '|42'), section_id) AS place, count(*) OVER () AS k FROM g), e AS (SELECT *, place <= greatest(1, floor(k * 0.15)) AS drawn FROM r),
s AS (SELECT *, CASE WHEN drawn OR coalesce(sum(n) OVER (ORDER BY drawn DESC, n DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 30 THEN 'eval' ELSE 'train' END AS split FROM e) SELECT split, count(*) AS sections, sum(n)::BIGINT AS n FROM s GROUP BY split""",
    }
