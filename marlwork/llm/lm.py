"""Log-probabilities of texts under a smoothed n-gram model of the corpus, by a weighted backoff automaton.

A state is an n-gram that can be a context; the root is the empty one. An arc reads a word, costs the logarithm of its
smoothed probability after the state, and leads to the longest known context that ends there. Where a state has no arc
for a word, its failure arc costs the state's backoff weight and leads to the state without its first word. A text is
read once, from left to right.

The smoothing is that of Dirichlet priors: P(x | h) = (c(hx) + m P(x | h')) / (c(h) + m), h' being h without its first
word, and P(x) = (c(x) + 1) / (N + V + 1). So a state's backoff weight is m / (c(h) + m), all weights follow from
counts, and every state's probabilities sum to 1.

The automaton grows with the corpus and is nowhere held whole: each unit of texts asks for the counts of its own n-grams
(see grams) and builds the states and arcs that its texts can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlwork.llm import grams
from marlwork.llm.common import WHITE, text_hash

#: Hashes of what stands before and after a text.
BEGIN, END = (np.array([[a], [b]], np.uint64) for a, b in ((0xB5297A4D3F84D5B5, 0x68E31DA4A1B2C3D5), (0x1B56C4E97F4A7C16, 0xC2B2AE3D27D4EB4F)))
KINDS = grams.kinds_of(WHITE)
#: Words of a text that are read in one go beside those of others.
STRETCH = 256


class Automaton:
    """States, arcs and failure arcs over the n-grams of some texts."""

    def __init__(self, found: list[grams.Level], counts: list[np.ndarray], total: int, kinds: int, strength: float):
        """found: the n-grams of 1, 2 ... words; counts: how often each stands in the training texts; total and kinds: N and V."""
        order, self.symbols = len(found), len(counts[0])
        starts = np.cumsum([1, *map(len, counts)])  # the number of the first state of each length
        probability = [(counts[0] + 1) / (total + kinds + 1)]
        live = [c > 0 for c in counts]
        size = int(starts[order - 1]) if order > 1 else 1
        self.fail, self.fail_weight = np.zeros(size, np.int64), np.zeros(size)
        target = np.where(live[0], starts[0] + np.arange(self.symbols), 0) if order > 1 else np.zeros(self.symbols, np.int64)
        self.root_weight, self.root_target = np.log10(probability[0]), target
        keys, weights, targets = [], [], []
        for n in range(2, order + 1):
            at, c = found[n - 1].first, counts[n - 1]
            prefix, suffix, symbol = (x.astype(np.int64) for x in (found[n - 2].ids[at - 1], found[n - 2].ids[at], found[0].ids[at]))
            probability.append((c + strength * probability[-1][suffix]) / (counts[n - 2][prefix] + strength))
            known = live[n - 1]
            own = np.arange(len(c)) + starts[n - 1] if n < order else starts[n - 2] + suffix
            keys.append(((starts[n - 2] + prefix) * self.symbols + symbol)[known])
            weights.append(np.log10(probability[-1][known]))
            targets.append(own[known])
            if n < order:
                self.fail[starts[n - 1] : starts[n]] = starts[n - 2] + suffix
        for n in range(1, order):
            self.fail_weight[starts[n - 1] : starts[n]] = np.log10(strength / (counts[n - 1] + strength))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.weights = np.concatenate(weights)[by] if weights else np.zeros(0)
        self.targets = np.concatenate(targets)[by] if targets else np.zeros(0, np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the log-probability that each step costs; one failure arc after the other is taken where there is no arc."""
        weight, after, left = np.zeros(len(state)), np.zeros(len(state), np.int64), np.arange(len(state))
        state = state.copy()
        while len(left):
            at_root = state[left] == 0
            done = left[at_root]
            weight[done] += self.root_weight[symbol[done]]
            after[done] = self.root_target[symbol[done]]
            left = left[~at_root]
            if not len(left) or not len(self.keys):
                weight[left] += self.fail_weight[state[left]]
                state[left] = self.fail[state[left]]
                continue
            key = state[left] * self.symbols + symbol[left]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            weight[left[hit]] += self.weights[place[hit]]
            after[left[hit]] = self.targets[place[hit]]
            left = left[~hit]
            weight[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return after, weight

    def read(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray, warm: np.ndarray) -> np.ndarray:
        """The log-probabilities of stretches of symbols, [lo, hi) each, all read from left to right beside each other.

        The first `warm` symbols of a stretch only set its state.
        """
        by = np.argsort(lo - hi, kind="stable")
        lo, warm, size = lo[by], warm[by], (hi - lo)[by]
        state, total = np.zeros(len(lo), np.int64), np.zeros(len(lo))
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "left"))  # those longer than t
            state[:n], weight = self.step(state[:n], symbols[lo[:n] + t])
            total[:n] += np.where(t >= warm[:n], weight, 0.0)
        found = np.empty(len(lo))
        found[by] = total
        return found


class Corpus:
    """The words of a unit's pieces, each text begun and ended, and their n-grams."""

    def __init__(self, rows: pa.Table, order: int):
        lead = [x.encode("utf-8", "replace") for x in rows.column("lead").to_pylist()]
        own = [x.encode("utf-8", "replace") for x in rows.column("own").to_pylist()]
        words = grams.words_of([a + b" " + b for a, b in zip(lead, own, strict=True)], KINDS)
        self.first = np.array(rows.column("piece").to_pylist(), np.int64) == 0
        self.last = np.array(rows.column("last").to_pylist(), bool)
        n = np.bincount(words.text, minlength=rows.num_rows)
        self.size = n + self.first + self.last
        self.begins = np.concatenate([[0], np.cumsum(self.size)])
        total = int(self.begins[-1])
        self.piece = np.repeat(np.arange(rows.num_rows), self.size)
        self.place = np.arange(total) - self.begins[self.piece]
        self.order, self.words = order, np.zeros((2, total), np.uint64)
        at = np.arange(len(words.text)) - np.concatenate([[0], np.cumsum(n)])[words.text] + (self.begins[:-1] + self.first)[words.text]
        self.words[:, at] = words.hashes
        self.words[:, self.begins[:-1][self.first]] = BEGIN
        self.words[:, self.begins[1:][self.last] - 1] = END
        #: 1 at words and ends that belong to the piece, 0 at those that lead to it; what begins a text is no token.
        self.own = np.ones(total, bool)
        self.own[at] = words.start >= words.begins[words.text] + np.array([len(x) for x in lead], np.int64)[words.text] + 1
        self.token = self.own.copy()
        self.token[self.begins[:-1][self.first]] = False

    def levels(self) -> Iterator[grams.Level]:
        return grams.levels(np.zeros((2, 1), np.uint64), self.words, self.place, self.order)

    def scored(self, answers: grams.Answers, total: int, kinds: int, strength: float) -> tuple[np.ndarray, ...]:
        """Of each piece: tokens, known tokens, the base score and the model's."""
        levels = list(self.levels())
        counts = [answers.of(n, x.hashes) for n, x in enumerate(levels, 1)]
        automaton = Automaton(levels, counts, total, kinds, strength)
        symbols = levels[0].ids
        # Stretches start at every STRETCH-th token of a piece; what stands before sets the state.
        lead = np.bincount(self.piece[~self.token], minlength=len(self.size)) if len(self.piece) else np.zeros(len(self.size), np.int64)
        tokens = self.size - lead
        cuts = -(-tokens // STRETCH)
        piece = np.repeat(np.arange(len(self.size)), cuts)
        k = np.arange(len(piece)) - np.concatenate([[0], np.cumsum(cuts)])[piece]
        lo = (self.begins[:-1] + lead)[piece] + k * STRETCH
        hi = np.minimum(lo + STRETCH, self.begins[1:][piece])
        warm = np.minimum(self.order - 1, lo - self.begins[:-1][piece])
        score = np.bincount(piece, automaton.read(symbols, lo - warm, hi, warm), len(self.size))
        known = counts[0][symbols[self.token]]
        of = self.piece[self.token]
        base = np.bincount(of, np.log10(known + 1.0), len(self.size)) - tokens * np.log10(total + kinds + 1.0)
        return tokens, np.bincount(of, known > 0, len(self.size)).astype(np.int64), base, score


ANSWER = "unit long, bucket long, size int, counts binary, tokens long, kinds long"


def totals(request: pa.Table) -> pa.Table:
    """What a bucket answers: of each n-gram how often it stands in the training texts. tokens and kinds: N and V of its words, once."""
    units, buckets, sizes, counts, tokens, kinds = [], [], [], [], [], []
    begin = grams.chained(np.zeros_like(BEGIN), BEGIN)[0][0]
    for size in sorted(set(request.column("size").to_pylist())):
        own, begins, inverse, distinct, total = grams.summed(request, size)
        for i, unit in enumerate(own):
            units.append(unit)
            buckets.append(request.column("bucket")[0].as_py())
            sizes.append(size)
            counts.append(grams.packed(total[inverse[begins[i] : begins[i + 1]]]))
            tokens.append(0)
            kinds.append(0)
        if size == 1:
            words = distinct != begin
            tokens[0], kinds[0] = int(total[words].sum()), int((total[words] > 0).sum())
    return pa.table({"unit": pa.array(units, pa.int64()), "bucket": pa.array(buckets, pa.int64()), "size": pa.array(sizes, pa.int32()), "counts": pa.array(counts, pa.binary()), "tokens": pa.array(tokens, pa.int64()), "kinds": pa.array(kinds, pa.int64())})


def score(docs: DataFrame, learn: Column, order: int = 2, strength: float = 20.0, unit_bytes: int = 6 << 20, longest: int = 1 << 20) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score and score.

    The model has n-grams of up to `order` words, counted over all rows for which `learn` (an expression over docs; null:
    no) holds; `strength` is m above. A null text is empty, which is one token, its end. base_score adds up the
    logarithms of (c + 1) / (N + V + 1). Without any training text all probabilities are 1. Repeated rows stay repeated,
    other columns are ignored. Texts of over `longest` letters are read in pieces that go to different tasks.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    sizes = grams.sizes_of(own, unit_bytes)
    cut = F.explode(grams.pieces(F.col("text"), "[\\x20\\x09-\\x0D]+", order - 1, longest)).alias("p")
    rows = grams.in_units(own.select("doc_id", text_hash().alias("text_hash"), "learn", cut).select("doc_id", "text_hash", "learn", "p.*"), sizes.units, "doc_id", "text_hash", "piece")

    def ask(unit: pa.Table) -> pa.Table:
        corpus = Corpus(unit, order)
        learned = np.array(unit.column("learn").to_pylist(), bool)[corpus.piece] & corpus.own
        return grams.requests(unit.column("unit")[0].as_py(), ((n, x.hashes, x.counts(learned)) for n, x in enumerate(corpus.levels(), 1)), sizes.buckets)

    def give(unit: pa.Table, answers: pa.Table) -> pa.Table:
        corpus = Corpus(unit, order)
        total, kinds = (answers.column(x)[0].as_py() for x in ("all_tokens", "all_kinds"))
        n, known, base, found = corpus.scored(grams.Answers(answers, sizes.buckets), total, kinds, strength)
        return pa.table({"doc_id": unit.column("doc_id"), "text_hash": unit.column("text_hash"), "first": pa.array(corpus.first.astype(np.int64)), "tokens": pa.array(n), "known": pa.array(known), "train_tokens": pa.array([total] * unit.num_rows, pa.int64()), "base": pa.array(base), "model": pa.array(found)})

    answers = grams.met(rows, ask, totals, ANSWER)
    every = answers.agg(F.sum("tokens").alias("all_tokens"), F.sum("kinds").alias("all_kinds"))
    answers = answers.drop("tokens", "kinds").crossJoin(F.broadcast(every))  # one row
    scored = rows.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(give, "doc_id long, text_hash long, first long, tokens long, known long, train_tokens long, base double, model double")
    # The pieces of a text come together; rows that repeat one another are told by the number of first pieces.
    texts = scored.groupBy("doc_id", "text_hash").agg(*(F.sum(x).alias(x) for x in ("first", "tokens", "known", "base", "model")), F.max("train_tokens").alias("train_tokens"))
    each = lambda x: (F.col(x) / F.col("first")).alias(x)
    rowwise = texts.select("doc_id", each("tokens"), each("known"), "train_tokens", each("base"), each("model"), F.explode(F.sequence(F.lit(1), F.col("first"))))
    return rowwise.select("doc_id", F.col("tokens").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"), "train_tokens", F.col("base").alias("base_score"), F.col("model").alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text leaves 2 by 7. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def learned(doc_id: Column) -> Column:
    """Whether a document is learned from: it has an id and isn't held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)
