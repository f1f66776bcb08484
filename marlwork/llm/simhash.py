"""SimHash near-duplicates over a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so that neighbours in the order share most bits. Ranges of that order
are the leaves of an index; a node keeps only the bits that all fingerprints below it share and that no node above it
holds already. A query walks down, adding up the differences in those bits, and leaves a group as soon as the sum
exceeds the threshold. The upper part of the index (bounded in size) tells each fingerprint which ranges it has to
visit; the lower part is built inside the task that holds a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlwork.llm.common import durable, small, small_batches, texts_of
from marlwork.llm.grams import CHAIN, chained, mixed

#: Seed of a shingle's XXH64. Fixed value.
SEED = 42
#: Bits that are summed at once; bounds the memory for very long texts.
STEP = 1 << 15
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text; 0 for null and for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    ones, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, STEP):
        part = words[at : min(at + STEP, n) + k - 1]
        hashes = [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(k)), strict=False)]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """The place of each fingerprint (uint64) in Gray order."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree over groups that stand in Gray order; each group is given by the AND and the OR of its fingerprints."""

    def __init__(self, all_and: np.ndarray, all_or: np.ndarray, fanout: int = 16):
        self.fanout, levels = fanout, [(all_and, all_or)]
        while len(levels[-1][0]) > 1:
            a, o = levels[-1]
            starts = np.arange(0, len(a), fanout)
            levels.append((np.bitwise_and.reduceat(a, starts), np.bitwise_or.reduceat(o, starts)))
        self.levels = levels[::-1]  # the root first
        self.shared = [~(a ^ o) for a, o in self.levels]

    def visit(self, prints: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in `prints`, group) pairs whose accumulated differences are at most `most`, in pieces."""
        if len(self.levels[0][0]):
            yield from self._walk(0, 0, 1, np.arange(len(prints)), prints, np.zeros(len(prints), np.uint8), np.uint64(0), most)

    def _walk(self, level, lo, hi, at, prints, sums, seen, most):
        """seen: the bits that the nodes above have compared; sums: the differences found in them."""
        own, pattern = self.shared[level][lo:hi] & ~seen, self.levels[level][0][lo:hi]
        total = np.bitwise_count((prints[:, None] ^ pattern) & own) + sums[:, None]
        who, node = np.nonzero(total <= most)
        if level == len(self.levels) - 1:
            if len(who):
                yield at[who], node + lo
            return
        width = len(self.levels[level + 1][0])
        for k in np.unique(node):
            mine = who[node == k]
            child = (lo + int(k)) * self.fanout
            yield from self._walk(level + 1, child, min(child + self.fanout, width), at[mine], prints[mine], total[mine, k], seen | own[k], most)


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the members of each pair the same label, the smallest place that they reach. Changes `labels`."""
    while True:
        x, y = labels[a], labels[b]
        if not (differ := x != y).any():
            return
        np.minimum.at(labels, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (labels != (up := labels[labels])).any():
            labels[:] = up


def star_edges(pdf: pd.DataFrame, most: int, step: int = 4096) -> pd.DataFrame:
    """The links of one range of the index, as (fingerprint, smallest fingerprint of its local component)."""
    prints, members = np.unique(pdf["fp"].to_numpy().view(np.uint64)), pdf.loc[pdf["member"], "fp"].to_numpy().view(np.uint64)
    members = members[np.argsort(gray_rank(members), kind="stable")]
    place, labels = np.searchsorted(prints, members), np.arange(len(prints))
    index = GrayIndex(members, members)
    for lo in range(0, len(prints), step):
        for who, leaf in index.visit(prints[lo : lo + step], most):
            join_labels(labels, who + lo, place[leaf])
    moved = labels != np.arange(len(prints))
    return pd.DataFrame({"v": prints[moved].view(np.int64), "u": prints[labels[moved]].view(np.int64)})


def fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, words_in_shingle) for x in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def links(prints: DataFrame, most: int = 2, range_size: int = 1024, most_ranges: int = 65_536) -> DataFrame:
    """Star edges (v, u) that connect the distinct fingerprints `prints` (fp) whose distance is at most `most`.

    A range of the Gray order holds about `range_size` fingerprints until there are `most_ranges` ranges, the bound on
    what is broadcast (24 bytes each); beyond that ranges grow: with ten billion fingerprints a range has 150,000
    members and some tens of times as many visitors, about 100 MB in its task.
    """
    spark = prints.sparkSession
    count = prints.count()
    n = max(1, min(most_ranges, -(-count // range_size)))

    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    by_rank = prints.select("fp", rank.bitwiseXOR(F.lit(-(1 << 63))).alias("rank"))  # as a signed long it sorts alike
    cuts = [] if n == 1 else by_rank.agg(F.percentile_approx("rank", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    def home_of(pdf: pd.DataFrame) -> np.ndarray:
        return np.searchsorted(cuts, pdf["rank"].to_numpy(), side="right").astype(np.int32)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"fp": pdf["fp"], "home": home_of(pdf)})

    at_home = by_rank.mapInPandas(placed, "fp long, home int")
    rows = at_home.groupBy("home").agg(F.bit_and("fp").alias("a"), F.bit_or("fp").alias("o")).orderBy("home").collect()
    if not rows:
        return spark.createDataFrame([], "v long, u long")
    homes = np.array([r["home"] for r in rows], np.int32)
    ends = [np.array([r[k] for r in rows], np.int64).view(np.uint64) for k in "ao"]

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = GrayIndex(*ends)
        for pdf in batches:
            fp, home = pdf["fp"].to_numpy(), home_of(pdf)
            for lo in range(0, len(fp), 4096):
                some = fp[lo : lo + 4096].view(np.uint64)
                for who, leaf in index.visit(some, most):
                    to = homes[leaf]
                    yield pd.DataFrame({"range": to, "fp": some[who].view(np.int64), "member": home[lo : lo + 4096][who] == to})

    visits = by_rank.mapInPandas(routed, "range int, fp long, member boolean")
    return visits.groupBy("range").applyInPandas(lambda pdf: star_edges(pdf, most), "v long, u long")


def components(edges: DataFrame) -> DataFrame:
    """(v, u): each linked node v and u, the smallest node that it reaches (v itself is not listed where v = u).

    Alternating large-star and small-star steps until the edges stay as they are; each round is kept durably.
    """

    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    now = durable(edges.where("v <> u").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct())
    before = summary(now)
    while before[0]:
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy(F.col("v").alias("w")).agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(low, both["v"] == low["w"]).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        least = large.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m"))
        small = large.join(least, large["v"] == least["w"])
        new = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", F.col("m").alias("u")))
        now = durable(new.where("v <> u").distinct())
        after = summary(now)
        if after == before:
            break
        before = after
    return now


def near_duplicates(docs: DataFrame, most: int = 2, words_in_shingle: int = 3, range_size: int = 1024, hot: int = 1000) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint (16 hex digits) and component_id.

    Rows are linked where their fingerprints differ in `most` bits or fewer; component_id is the smallest doc_id that
    is reachable. Null and empty texts have fingerprint zero and are linked like any other; shorter texts than a
    shingle count as one shingle. Repeated rows stay repeated. A null doc_id never is a component_id unless the
    component has no other; other columns of `docs` are ignored. An empty table gives an empty result. Fingerprints of
    more than `hot` rows, as of null texts and of large groups of copies, meet their rows where these are.
    """
    with small_batches(docs.sparkSession):
        prints = durable(fingerprints(docs, words_in_shingle))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")))
    roots = components(links(distinct.select("fp"), most, range_size))
    rooted = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first_id", "rows", F.coalesce("u", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = durable(rooted.join(named, "root").select("fp", "component_id", "rows"))
    large = small(classes.where(F.col("rows") > hot))
    rest = prints.join(large, "fp", "left_anti").join(classes.where(F.col("rows") <= hot), "fp")
    out = prints.join(large, "fp").unionByName(rest)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of seven bits of which any two differ in three or more: a Hamming code of sixteen words.
TAGS = [w for w in range(128) if not (1 & w) ^ (2 & w and 2) ^ (4 & w and 3) ^ (8 & w and 4) ^ (16 & w and 5) ^ (32 & w and 6) ^ (64 & w and 7)]
#: Bits of a fingerprint below its tag.
BITS = 57
#: Values of a sketch.
SKETCH = 64
_odd = np.random.default_rng(3).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def several(text: str | None, copies: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """`copies` tagged fingerprints of the set of a text's words, and the least values of its shingles under SKETCH hashes.

    A change of one word changes one word of the set, but `shingle` shingles: fingerprints of words stay closer than
    those of shingles, and the shingles tell texts apart that have common words alone in common.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    codes: dict[bytes, int] = {}
    place = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in codes), np.uint64, len(codes))
    prints = np.zeros(copies, np.uint64)
    for k in range(copies):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), STEP):
            own = mixed(hashes[at : at + STEP] + np.uint64(k) * np.uint64(CHAIN))
            ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])
        prints[k] = TAGS[k] << BITS | bits & (1 << BITS) - 1
    sequence = hashes[place] if len(place) else np.zeros(1, np.uint64)
    width = min(shingle, len(sequence))
    sketch = np.full(SKETCH, FULL)
    for at in range(0, len(sequence) - width + 1, STEP):
        part = sequence[at : at + STEP + width - 1]
        own = part[: len(part) - width + 1]
        for j in range(1, width):
            own = chained(own, part[j : len(part) - width + 1 + j])
        sketch = np.minimum(sketch, [(own * odd).min() for odd in _odd])
    return prints, (sketch >> np.uint64(32)).astype(np.uint32)


def near_groups(docs: DataFrame, copies: int = 8, shingle: int = 5, range_size: int = 8192, least_ranges: int = 256, hot: int = 1000) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of the group) and likeness of the rows of docs (doc_id, text), which have ids.

    Texts are linked where any of `copies` fingerprints differ in two bits or fewer. The tags keep fingerprints of
    different kinds apart, so that one index holds all, in `least_ranges` ranges at least: fewer would be visited less,
    and more often as the corpus grows. likeness is the share of shingles in common with the row that
    gives the group its id, as their sketches tell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [several(x, copies, shingle) for x in texts_of(batch)]
            prints = pa.array([p.view(np.int64) for p, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints, pa.array([k.tobytes() for _, k in found], pa.binary())], ["doc_id", "prints", "sketch"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with small_batches(docs.sparkSession):
        own = durable(plain.mapInArrow(run, "doc_id long, prints array<long>, sketch binary").withColumn("key", F.xxhash64("prints")))
    classes = durable(own.groupBy("key").agg(F.first("prints").alias("prints"), F.min("doc_id").alias("first_id"), F.count("*").alias("rows")))
    # Classes are joined where they share a fingerprint or have linked ones; those that don't are in no edge.
    holders = classes.select("key", F.explode("prints").alias("fp"))
    first = durable(holders.groupBy("fp").agg(F.min("key").alias("held"), F.count("*").alias("holders")))
    edges = links(first.select("fp"), 2, max(1, min(range_size, first.count() // least_ranges)))
    shared = holders.join(first.where("holders > 1"), "fp").select(F.col("key").alias("v"), F.col("held").alias("u"))
    end = lambda x: first.select(F.col("fp").alias(x), F.col("held").alias(f"held_{x}"))
    linked = edges.join(end("v"), "v").join(end("u"), "u").select(F.col("held_v").alias("v"), F.col("held_u").alias("u"))
    roots = components(shared.unionByName(linked).where("v <> u").distinct())
    rooted = classes.join(roots, classes["key"] == roots["v"], "left").select("key", "first_id", "rows", F.coalesce("u", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = durable(rooted.join(named, "root").select("key", "component_id", "rows"))
    large = small(classes.where(F.col("rows") > hot))
    rest = own.join(large, "key", "left_anti").join(classes.where(F.col("rows") <= hot), "key")
    placed = own.join(large, "key").unionByName(rest).select("doc_id", "sketch", "component_id")
    firsts = classes.select("component_id").distinct()
    chosen = small(own.join(firsts, own["doc_id"] == firsts["component_id"]).groupBy("component_id").agg(F.min("sketch").alias("chosen")).join(classes.groupBy("component_id").agg(F.sum("rows").alias("n")).where("n > 1"), "component_id"))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = (np.frombuffer(b"".join(pdf[x]), np.uint32).reshape(-1, SKETCH) for x in ("sketch", "chosen"))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "component_id": pdf["component_id"], "likeness": (a == b).mean(axis=1)})

    # Groups of one row have nothing to compare.
    return placed.join(chosen, "component_id").select("doc_id", "component_id", "sketch", "chosen").mapInPandas(compared, "doc_id long, component_id long, likeness double")


def keep_first(docs: DataFrame, copies: int = 8, shingle: int = 5, least: float = 0.5) -> DataFrame:
    """docs with one row of each group of near copies, that with the smallest doc_id. Rows without an id stay.

    See near_groups(). A row that has less than `least` of its shingles in common with the one that would stay for it
    stays too. Of repeated rows with this id one stays. Null and empty texts are copies of one another. The columns are
    those of docs; an empty table stays empty.
    """
    found = durable(near_groups(docs.where("doc_id is not null"), copies, shingle))
    gone = small(found.where((F.col("doc_id") != F.col("component_id")) & (F.col("likeness") >= least)).select(F.col("doc_id").alias("marlwork_gone")).distinct())
    kept = docs.join(gone, docs["doc_id"] == gone["marlwork_gone"], "left_anti")
    repeated = small(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("marlwork_twice")))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, kept["doc_id"] == repeated["marlwork_twice"], "left_anti")
    return once.unionByName(kept.join(repeated, kept["doc_id"] == repeated["marlwork_twice"], "left_semi").dropDuplicates(["doc_id"]))
