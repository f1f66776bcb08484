"""Word n-grams of a corpus, counted over all of it and brought back to the texts that hold them.

Texts are dealt to units of a few megabytes. A unit names each of its n-grams once, however often it has it, with its
own count, to the bucket that the n-gram's hash names. A bucket adds up what all units say and answers each of them in
the order of its request. So a frequent n-gram is one row a unit, no n-gram or source is a hot key, and no task holds
more than a unit or a bucket. An n-gram is known by a 64-bit hash and, independently, by its bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlwork.llm.common import let

#: Kinds of bytes: of words, between words, and at which n-grams end.
WORD, SPACE, BREAK = 0, 1, 2
#: Multipliers of the hashes; any odd numbers do.
BASE, CHAIN, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_rng = np.random.default_rng(7)
#: Two independent random values of each byte; letters A-Z have those of a-z.
VALUES = _rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
VALUES[:, 65:91] = VALUES[:, 97:123]
#: Bytes hashed at once.
STEP = 1 << 20
_powers: dict[str, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        row = np.full(max(n, 2 * STEP), base, np.uint64)
        row[0] = 1
        _powers[key] = np.cumprod(row, dtype=np.uint64)
    return _powers[key][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in zip((30, 27), MIX, strict=True):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of n-grams, of those without the last word and of the last word."""
    return mixed(before * np.uint64(CHAIN) + word)


def kinds_of(space: str, breaks: str = "") -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[[ord(c) for c in space]] = SPACE
    kinds[[ord(c) for c in breaks]] = BREAK
    return kinds


@dataclass
class Words:
    """The words of some texts, in order. start and end are bytes of `raw`; words of one text with equal `gap` have no break between them."""

    raw: bytes
    text: np.ndarray
    begins: np.ndarray
    start: np.ndarray
    end: np.ndarray
    gap: np.ndarray
    hashes: np.ndarray  # 2 x words


def words_of(texts: list[bytes], kinds: np.ndarray) -> Words:
    """`begins` has where each text begins in `raw`."""
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    raw = b"\n".join([*texts, b""])
    whole, found, lo, breaks = np.frombuffer(raw, np.uint8), [], 0, 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(begins, begins[lo] + STEP, "right")) - 1)
        at = int(begins[lo])
        a = whole[at : int(begins[hi])]
        kind = kinds[a]
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = kind == WORD
        edges = np.flatnonzero(np.diff(inside))
        start, end = edges[::2], edges[1::2]
        gap = np.cumsum(kind == BREAK) + breaks
        # A hash is a sum over prefixes: that of a word is the difference of two, moved to the word's start.
        weights, back = powers(BASE, len(a)), powers(pow(BASE, -1, 1 << 64), len(a) + 1)
        hashes = []
        for values in VALUES:
            sums = np.zeros(len(a) + 1, np.uint64)
            np.cumsum(values[a] * weights, out=sums[1:])
            hashes.append(mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)))
        text = np.searchsorted(begins[lo : hi + 1] - at, start, "right") - 1 + lo
        # 32 bits do for the places of a unit.
        found.append((*(x.astype(np.int32) for x in (text, start + at, end + at, gap[start])), np.stack(hashes)))
        breaks, lo = int(gap[-1]) + 1, hi
    if not found:
        return Words(raw, *(np.zeros(0, np.int64) for _ in range(5)), np.zeros((2, 0), np.uint64))
    text, start, end, gap = (np.concatenate([x[i] for x in found]) for i in range(4))
    return Words(raw, text, begins, start, end, gap, np.concatenate([x[4] for x in found], axis=1))


@dataclass
class Level:
    """The distinct n-grams of one length: ids by the position of their last word (-1: none), where each stands first, and their hashes."""

    ids: np.ndarray
    first: np.ndarray
    hashes: np.ndarray  # 2 x distinct, in ascending order of the first

    def counts(self, weights: np.ndarray) -> np.ndarray:
        known = self.ids >= 0
        return np.bincount(self.ids[known], weights[known], len(self.first)).astype(np.int64)


def level(hashes: np.ndarray, valid: np.ndarray) -> Level:
    at = np.flatnonzero(valid)
    _, first, inverse = np.unique(hashes[0][at], return_index=True, return_inverse=True)
    ids = np.full(hashes.shape[1], -1, np.int32)
    ids[at] = inverse
    return Level(ids, at[first], hashes[:, at[first]])


def levels(seeds: np.ndarray, words: np.ndarray, place: np.ndarray, most: int) -> Iterator[Level]:
    """The n-grams of 1 to `most` words, one length after the other.

    seeds and words: 2 x positions; place: how many words of its sequence stand before a word.
    """
    hashes = seeds
    for n in range(1, most + 1):
        before = hashes if n == 1 else np.concatenate([hashes[:, :1], hashes[:, :-1]], axis=1)
        hashes = chained(before, words)
        yield level(hashes, place >= n - 1)


def packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype(np.int64).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


def buckets_of(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams by bucket, and where each bucket begins in it."""
    bucket = (hashes[1] % np.uint64(buckets)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


REQUEST = "unit long, bucket long, size int, grams binary, counts binary"


def requests(unit: int, named: Iterable[tuple[int, np.ndarray, np.ndarray]], buckets: int) -> pa.Table:
    """Rows of REQUEST: a unit's n-grams of each size with their hashes and counts, a row for each bucket."""
    rows = []
    for size, hashes, counts in named:
        order, begins = buckets_of(hashes, buckets)
        grams, counts = hashes[0][order], counts[order]
        for b in np.flatnonzero(np.diff(begins)):
            some = slice(begins[b], begins[b + 1])
            rows.append((unit, int(b), size, grams[some].tobytes(), packed(counts[some])))
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table(dict(zip(("unit", "bucket", "size", "grams", "counts"), map(pa.array, columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())), strict=True)))


class Answers:
    """The answers to a unit's requests()."""

    def __init__(self, rows: pa.Table, buckets: int):
        self.buckets = buckets
        self.rows: dict[tuple[int, int], bytes] = {(s, b): c for s, b, c in zip(*(rows.column(x).to_pylist() for x in ("size", "bucket", "counts")), strict=True)}

    def of(self, size: int, hashes: np.ndarray) -> np.ndarray:
        """Those for n-grams of one size, in the order of their hashes."""
        order, begins = buckets_of(hashes, self.buckets)
        found = np.zeros(len(order), np.int64)
        some = [unpacked(self.rows[size, int(b)]) for b in np.flatnonzero(np.diff(begins))]
        found[order] = np.concatenate(some) if some else 0
        return found


def pieces(text: Column, between: str, lead: int, most: int = 1 << 20, words: int = 1 << 16) -> Column:
    """An array of pieces (piece, lead, own, last) of a text, null being empty.

    A text of up to `most` letters is one piece. A longer one is cut at matches of `between` (which end no word of an
    n-gram) into pieces of `words` parts; each has the `lead` parts before its own.
    """
    empty = F.lit("")

    def cut(parts: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / words).cast("int"))

        def one(i: Column) -> Column:
            at = i * words
            before = F.least(at, F.lit(lead))
            own = F.array_join(F.slice(parts, at + 1, F.lit(words)), " ")
            return F.struct(i.alias("piece"), F.array_join(F.slice(parts, at - before + 1, before), " ").alias("lead"), own.alias("own"), (at + words >= F.size(parts)).alias("last"))

        return F.transform(steps, one)

    whole = F.coalesce(text.cast("string"), empty)
    single = F.array(F.struct(F.lit(0).alias("piece"), empty.alias("lead"), whole.alias("own"), F.lit(True).alias("last")))
    return F.when(F.length(whole) <= most, single).otherwise(let(F.split(whole, between, -1), cut))


@dataclass(frozen=True)
class Sizes:
    """How a corpus is dealt out: units of texts, buckets of n-grams."""

    units: int
    buckets: int


def sizes_of(docs: DataFrame, unit_bytes: int = 8 << 20, bucket_bytes: int = 2 << 20) -> Sizes:
    """Numbers that follow the bytes of all texts, so that units and buckets stay as large as they are."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    return Sizes(max(24, -(-total // unit_bytes)), max(48, -(-total // bucket_bytes)))


def in_units(rows: DataFrame, units: int, *by: str) -> DataFrame:
    """rows with `unit`, by the hash of `by`."""
    return rows.withColumn("unit", F.pmod(F.xxhash64(*by), F.lit(units)))


def met(rows: DataFrame, ask: Callable[[pa.Table], pa.Table], answer: Callable[[pa.Table], pa.Table], kind: str) -> DataFrame:
    """The answers (of the schema `kind`) to all units' requests. `answer` sees one bucket: rows of REQUEST of all units."""
    return rows.groupBy("unit").applyInArrow(ask, REQUEST).groupBy("bucket").applyInArrow(answer, kind)


def summed(request: pa.Table, size: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one size in a bucket: the rows' units, where their n-grams begin, each n-gram's number among the distinct, these, and their totals."""
    rows = request.filter(pc.equal(request.column("size"), size)).sort_by("unit")
    grams = [np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()]
    counts = np.concatenate([unpacked(x) for x in rows.column("counts").to_pylist()])
    distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    # Whole numbers far below 2**53, so that the sums of doubles are exact.
    total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
    return rows.column("unit").to_pylist(), np.concatenate([[0], np.cumsum([len(x) for x in grams])]), inverse, distinct, total
