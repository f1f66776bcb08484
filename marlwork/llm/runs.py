"""Periodic runs of words: stretches in which words a period apart are identical, at least twice the period long.

The words' suffix automaton has a state for each set of places at which some stretches of words end. These sets are
built from the leaves of its suffix links up, the smaller merged into the larger, in order. When a place comes between
two others, the distances to them are those of two occurrences of the state's stretch; where such a distance isn't
larger than the stretch, the two overlap or touch, which makes a square of that period. Squares are extended to runs.
A run's words all occur again within it, so words that occur once in what is left cut the text first.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlwork.llm.common import texts_of

#: Elements of a block of an ordered set.
BLOCK = 512


class Places:
    """An ordered set of integers in blocks, so that neither a search nor an insertion moves all of it."""

    def __init__(self, first: int):
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Puts x, which isn't there, in its place; returns what now stands before and after it."""
        k = max(0, bisect_right(self.heads, x) - 1)
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else None
        after = block[i] if i < len(block) else self.heads[k + 1] if k + 1 < len(self.heads) else None
        block.insert(i, x)
        self.heads[k] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            self.blocks.insert(k + 1, block[BLOCK // 2 :])
            self.heads.insert(k + 1, block[BLOCK // 2])
            del block[BLOCK // 2 :]
        return before, after


def suffix_automaton(x: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each state: the length of its longest stretch, its suffix link, and the place at which it was made (-1: copies)."""
    length, link, place, after = [0], [-1], [-1], [{}]
    last = 0
    for i, c in enumerate(x):
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        place.append(i)
        after.append({})
        p = last
        while p != -1 and c not in after[p]:
            after[p][c] = cur
            p = link[p]
        if p != -1:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                place.append(-1)
                after.append(dict(after[q]))
                while p != -1 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return length, link, place


class Runs:
    """The runs of one stretch of words that have been found, by period."""

    def __init__(self, x: list[int]):
        self.x, self.by_period = x, {}

    def seed(self, e: int, d: int) -> None:
        """The words that end at e and those that end at e - d agree for d words: extended unless a known run has them."""
        found = self.by_period.setdefault(d, [])
        at = bisect_right(found, (e - 2 * d + 1, len(self.x))) - 1
        if at >= 0 and found[at][1] > e:
            return
        x, lo, hi = self.x, e - 2 * d + 1, e + 1
        while lo > 0 and x[lo - 1] == x[lo - 1 + d]:
            lo -= 1
        while hi < len(x) and x[hi] == x[hi - d]:
            hi += 1
        found.insert(bisect_left(found, (lo, hi)), (lo, hi))

    def smallest(self) -> list[tuple[int, int, int]]:
        """start, length and period; a stretch found under several periods has the smallest."""
        best: dict[tuple[int, int], int] = {}
        for d in sorted(self.by_period):
            for lo, hi in self.by_period[d]:
                best.setdefault((lo, hi), d)
        return [(lo, hi - lo, d) for (lo, hi), d in best.items()]


def runs_of(x: list[int]) -> list[tuple[int, int, int]]:
    """start, length and period of every run of x of at least twice its period."""
    length, link, place = suffix_automaton(x)
    found = Runs(x)
    sets: list[Places | None] = [Places(p) if p >= 0 else None for p in place]
    # Longer states first, so that a state is whole before it goes into the one that its link names.
    by = np.argsort(-np.asarray(length, np.int64), kind="stable").tolist()
    for v in by:
        parent = link[v]
        if parent <= 0:  # the root's stretch is empty
            sets[v] = None
            continue
        large, few, most = sets[parent], sets[v], length[parent]
        sets[v] = None
        if large is None:
            sets[parent] = few
            continue
        if large.size < few.size:
            large, few = few, large
        sets[parent] = large
        for e in few:
            before, after = large.add(e)
            if before is not None and e - before <= most:
                found.seed(e, e - before)
            if after is not None and after - e <= most:
                found.seed(after, after - e)
    return found.smallest()


def crowded(x: np.ndarray, least: int, rounds: int = 24) -> list[tuple[int, int]]:
    """Stretches [lo, hi) of at least `least` words outside of which no run of that length has a word.

    A word that occurs once in its stretch is in no run. Cutting there makes shorter stretches in which more words occur
    once; after `rounds` of it the rest is left to the automaton, which is exact whatever it gets.
    """
    at, part = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(rounds):
        if not len(at):
            break
        _, inverse, n = np.unique(part * (len(x) + 1) + x[at], return_inverse=True, return_counts=True)
        stays = n[inverse] > 1
        whole = bool(stays.all())
        at, part = at[stays], part[stays]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) != 1) | (np.diff(part) != 0)
        part = np.cumsum(fresh) - 1
        long = np.bincount(part, minlength=1)[part] >= least if len(part) else fresh
        if whole and long.all():
            break
        at, part = at[long], part[long]
    if not len(at):
        return []
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(part) != 0)]))
    ends = np.append(begins[1:], len(at))
    return [(int(at[b]), int(at[e - 1]) + 1) for b, e in zip(begins, ends, strict=True)]


def found_in(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """start, length and period of the runs of words of length max(least, 2 * period) or more, by start, then period."""
    if len(words) < least:
        return []
    codes: dict[bytes, int] = {}
    x = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    if len(codes) == len(words):
        return []
    every = [(lo + s, n, q) for lo, hi in crowded(x, least) for s, n, q in runs_of(x[lo:hi].tolist()) if n >= max(least, 2 * q)]
    return sorted(every, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    stays = np.cumsum(change[:-1]) == 0
    return [w for w, s in zip(words, stays, strict=True) if s]


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def scan(docs: DataFrame, least: int = 12, rewrite: Rewrite | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_runs, runs (start, length, period; by start, then period) and collapsed, the text without its repetitions.

    Words are `[^\\x20\\x09-\\x0D]+`; `collapsed` has the kept ones, joined by one space. `rewrite` may change a document's
    words by its id before they are read. A null or empty text has no words, no runs and an empty `collapsed`. Repeated
    rows stay repeated, other columns are ignored. A document is one row of one task; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lo, step = batch.column(0), 0, 128
            texts = texts_of(batch)
            while lo < batch.num_rows:
                some = ids.slice(lo, step)
                found, left = [], []
                for doc_id in some.to_pylist():
                    words = (next(texts) or "").encode("utf-8", "replace").split()  # bytes are split at exactly these characters
                    if rewrite is not None:
                        words = rewrite(doc_id, words)
                    runs = found_in(words, least)
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    left.append(b" ".join(collapsed(words, runs)).decode("utf-8", "replace"))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([some, pa.array([len(x) for x in found], pa.int64()), pa.array(found, kind), pa.array(left, pa.string())], ["doc_id", "n_runs", "runs", "collapsed"])
                lo += step

    plain = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return plain.mapInArrow(run, "doc_id long, n_runs long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of which a tenth (by crc32 of the id) repeat a stretch of theirs to the end; those without an id don't."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: the first, then the shorter period), and digests of all runs and of the collapsed text."""
    best = "array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return found.selectExpr("doc_id", "n_runs", f"{best} as best", f"sha2({lines}, 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256").selectExpr(
        "doc_id", "n_runs", "-best.start as start", "best.length as length", "-best.period as period", "1000 * best.length div -best.period as exponent_milli", "runs_sha256", "collapsed_sha256"
    )
