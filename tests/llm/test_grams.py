"""Language-model scores, phrases and periodic runs against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlwork.llm import grams, lm, oracle, phrases, runs

WORDS = re.compile("[^\x20\x09-\x0d]+")
COLUMNS = "doc_id long, text string, lang string, source string, unit string, piece string, learn string, first string"


def lower(text):
    return text.translate({a: a + 32 for a in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    words = ["the", "Ring", "über", "and", "été", "of", "x#", "日本", "a", "New", "York", "City"]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", "\n", "\t", ".\r"]) for _ in range(n))
    texts = [None, "", " \n\t ", "one", "New York City", "\x00\x01 \x1c\x85\xa0", *(prose(rng.randint(1, 300)) for _ in range(60)), "the New York " * 400, prose(9000)]
    rows = [(i, x, [None, "en", "de"][i % 3], None, "u", "p", "l", "f") for i, x in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[7], rows[7], (None, "null id and id", "en", None, None, None, None, None), (None, None, None, None, None, None, None, None)], COLUMNS).repartition(3)


def brute_scores(rows, order, strength):
    """doc_id, n_tokens, n_known, N, base and model scores by definition, without an automaton."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda r: ["<s>", *WORDS.findall(lower(r.text or "")), "</s>"]
    counts = collections.Counter()
    for r in rows:
        if r.doc_id is not None and not held(r.doc_id):
            t = tokens(r)
            counts.update(tuple(t[i - n : i]) for n in range(1, order + 1) for i in range(n, len(t) + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1 and g != ("<s>",))
    kinds = sum(len(g) == 1 and g != ("<s>",) for g in counts)

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + 1) / (total + kinds + 1)
        return (counts[gram] + strength * p(gram[1:])) / (counts[gram[:-1]] + strength) if counts[gram[:-1]] else p(gram[1:])

    for r in rows:
        t = tokens(r)
        own = [tuple(t[max(0, i - order + 1) : i + 1]) for i in range(1, len(t))]
        known = [counts[g[-1:]] for g in own]
        yield r.doc_id, len(own), sum(c > 0 for c in known), total, sum(math.log10((c + 1) / (total + kinds + 1)) for c in known), sum(math.log10(p(g)) for g in own)


@pytest.mark.parametrize(("order", "longest"), [(2, 1 << 20), (3, 1 << 20), (3, 500), (1, 1 << 20)])
def test_scores(docs, monkeypatch, order, longest):
    monkeypatch.setattr(grams, "pieces", lambda text, between, lead, most, words=50, own=grams.pieces: own(text, between, lead, most, words))
    got = lm.score(docs, lm.learned(docs["doc_id"]), order, 5.0, 4000, longest).collect()
    assert list(got[0].asDict()) == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[4], 6), round(r[5], 6))
    assert sorted(map(key, got)) == sorted(map(key, brute_scores(docs.collect(), order, 5.0)))


def test_every_state_sums_to_one():
    rng = np.random.default_rng(3)
    symbols = np.append(rng.integers(0, 9, 400), 9).astype(np.uint64)  # 9 ends the text and is followed by nothing
    hashes = np.stack([symbols, symbols + np.uint64(50)])
    found = list(grams.levels(np.zeros_like(hashes), hashes, np.arange(401), 3))
    counts = [x.counts(np.ones(401)) for x in found]
    automaton = lm.Automaton(found, counts, 401, 10, 2.0)
    for state in range(len(automaton.fail)):
        _, weight = automaton.step(np.full(10, state), np.arange(10))
        if state - 1 != found[0].ids[-1] and state - 11 != found[1].ids[-1]:
            assert abs((10**weight).sum() + mass_of_unknown(automaton, state, 401, 10) - 1) < 1e-9


def mass_of_unknown(automaton, state, total, kinds):
    weight = 0.0
    while state:
        weight += automaton.fail_weight[state]
        state = int(automaton.fail[state])
    return 10**weight / (total + kinds + 1)


def test_scores_of_nothing_learned_and_empty_tables(spark, docs):
    none = lm.score(docs, docs["doc_id"] < 0).collect()
    assert len(none) == docs.count()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in none} == {(0, 0, 0.0, 0.0)}
    assert lm.score(docs.limit(0), lm.learned(docs["doc_id"])).count() == 0
    assert phrases.mine(docs.limit(0)).count() == 0
    assert runs.digest(runs.scan(docs.limit(0))).count() == 0


def test_scores_favour_what_was_seen(spark):
    rng = random.Random(1)
    line = lambda: " ".join(x for _ in range(30) for x in rng.choice([("new", "york", "city"), ("los", "angeles"), ("old", "town")]))
    df = spark.createDataFrame([(i, line()) for i in range(200)] + [(1000, "york new angeles los city town old")], "doc_id long, text string")
    for r in lm.score(df, lm.learned(df["doc_id"])).collect():
        assert (r.score > r.base_score) == (r.doc_id != 1000)


def by_row(df):
    return collections.Counter(tuple(r) for r in df.collect())


def brute_phrases(rows, most, least, share, top):
    f, n = collections.Counter(), collections.Counter()
    for r in rows:
        lang = r.lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(r.text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    frequent = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    for lang in n:
        rows = []
        for (own, *w), a in frequent.items():
            inside = lambda g: any(g[1 + i : 1 + i + len(w)] == tuple(w) for i in range(len(g) - len(w)))  # noqa: E731, B023
            if own != lang or any(g[0] == lang and len(g) > len(w) + 1 and 100 * b >= share * a and inside(g) for g, b in frequent.items()):
                continue
            cuts = [(1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, n[lang], -s


@pytest.mark.parametrize(("most", "least", "longest"), [(3, 10, 1 << 20), (4, 3, 1 << 20), (3, 5, 400)])
def test_phrases(docs, monkeypatch, most, least, longest):
    monkeypatch.setattr(grams, "pieces", lambda text, between, lead, most, words=50, own=grams.pieces: own(text, between, lead, most, words))
    got = phrases.mine(docs, most, least, top=150, unit_bytes=4000, longest=longest)
    want = collections.Counter(brute_phrases(docs.collect(), most, least, 50, 150))
    assert len(want) > 20
    assert by_row(got) == want


def test_phrases_match_their_sql(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = con.execute(oracle.phrases_sql(least=3, top=40)).fetchall()
    names = [x[0] for x in con.description]
    got = by_row(phrases.mine(docs, least=3, top=40).select(*names))
    assert got == collections.Counter(rows)
    assert len(rows) > 50


def test_scores_match_their_sql(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = con.execute(oracle.lm_sql()).fetchall()
    names = [x[0] for x in con.description]
    got = lm.score(docs, lm.learned(docs["doc_id"])).withColumn("held_out", lm.held_out(F.col("doc_id"))).select(*names).collect()
    close = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert collections.Counter(map(close, got)) == collections.Counter(map(close, rows))


def brute_runs(w, least=12):
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(4)
    for case in range(300):
        kinds = rng.choice([1, 2, 2, 3, 5, 30])
        w = [b"%d" % rng.randrange(kinds) for _ in range(rng.randrange(0, 120))]
        if case % 3 == 0 and w:
            a, p = rng.randrange(len(w)), rng.randint(1, 20)
            w = [*w[:a], *(w[a:][:p] * 9), *w[a:]]
        for least in (1, 12):
            got = runs.found_in(w, least)
            assert got == brute_runs(w, least), (w, least)
            kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + length for s, length, q in got)]
            assert runs.collapsed(w, got) == kept


def test_runs_without_the_cutting_of_rare_words():
    rng = random.Random(8)
    for _ in range(100):
        x = [rng.randrange(3) for _ in range(rng.randrange(2, 80))]
        assert sorted((s, n, q) for s, n, q in runs.runs_of(x) if n >= 12) == sorted(brute_runs(x))


def test_runs_of_long_texts():
    rng = random.Random(2)
    once = [b"w%d" % i for i in range(3000)]
    assert runs.found_in(once * 20) == [(0, 60000, 3000)]
    assert runs.found_in([b"a"] * 100_000) == [(0, 100_000, 1)]
    some = [rng.choice([b"a", b"b"]) for _ in range(3000)]
    assert runs.found_in(some) == brute_runs(some)


def test_places_stay_in_order():
    rng, every = random.Random(1), [500]
    own = runs.Places(500)
    for x in rng.sample([*range(500), *range(501, 5000)], 4000):
        every.append(x)
        every.sort()
        i = every.index(x)
        assert own.add(x) == (every[i - 1] if i else None, every[i + 1] if i + 1 < len(every) else None)
    assert list(own) == every


def test_runs_query(spark, docs):
    def digests(r):
        w = [x.encode() for x in WORDS.findall(r.text or "")]
        w = runs.looped(r.doc_id, w)
        found = brute_runs(w) if len(w) < 2000 else runs.found_in(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        kept = b" ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        return (r.doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines.encode()), sha(kept))

    more = spark.createDataFrame([(i, "x y x y " * 5 + " ".join(str(j % (i + 1)) for j in range(70)), *["x"] * 6) for i in range(100, 140)], COLUMNS)
    every = docs.unionByName(more)
    got = runs.digest(runs.scan(every, rewrite=runs.looped))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert by_row(got) == collections.Counter(map(digests, every.collect()))


def test_looped():
    w = [b"%d" % i for i in range(50)]
    same = [i for i in range(200) if runs.looped(i, w) == w]
    assert all(zlib.crc32(str(i).encode()) % 10 for i in same)
    assert 150 < len(same) < 195
    i = next(i for i in range(200) if i not in same)
    g = zlib.crc32(str(i).encode()) // 10
    a = g % 50
    p = 1 + (50 - a) // (3 + g % 8)
    assert runs.looped(i, w) == [w[k] if k < a else w[a + (k - a) % p] for k in range(50)]
    assert runs.looped(None, w) == w
    assert runs.looped(i, []) == []
