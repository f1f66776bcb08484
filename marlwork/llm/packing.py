"""Sequence packing: shortest-pack-first over the histogram of lengths.

Only the histogram of piece lengths (as many entries as the sequence length at most) reaches the driver. Lengths are
placed longest first, each into the pack with the most room; packs of one composition are counted, not listed. The
compositions are then joined back to the pieces by length and rank.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, cached_property

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlwork.llm.bpe import Codec, Vocabulary
from marlwork.llm.common import durable, small_batches, texts_of


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The ids that a byte-level tokenizer file gives a text, its added tokens included, where ids follow the merges.

    An added token that stands in a text becomes its id, as the file's own library has it.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        self.special = {x["content"]: x["id"] for x in vocabulary["added_tokens"]}
        raw = byte_of_character()
        self.ranks = {bytes(raw[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in self.special}
        self.pattern = pattern
        self.own = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=self.special)

    def packed_ids(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        try:
            return self.own.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except ValueError:  # its splitter gives up on runs of about a million spaces; split here and encode piece by piece
            return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self.by_pieces.encode(x) for x in self.cut(text))

    def cut(self, text: str) -> list[str]:
        """The text cut at its added tokens."""
        longest_first = sorted(map(regex.escape, self.special), key=len, reverse=True)
        return regex.split(f"({'|'.join(longest_first)})", text) if longest_first else [text]

    @cached_property
    def by_pieces(self) -> Codec:
        return Codec(Vocabulary(self.ranks), self.pattern)


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path, pattern)


def shortest_pack_first(histogram: dict[int, int], most: int) -> list[tuple[int, dict[int, int]]]:
    """(number of packs, {length: how many of it in each pack}) whose packs hold every length as often as it occurs."""
    open_packs: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)  # by the room that is left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in open_packs.items() if packs), default=0)
            if room >= length:
                count, inside = open_packs[room].pop()
                each = 1
            else:
                room, count, inside, each = most, left, {}, min(left, most // length)
                count = left // each  # a pack that is opened takes as many as fit
            used = min(count, left // each)
            if used < count and inside:
                open_packs[room].append((count - used, inside))
            open_packs[room - each * length].append((used, {**inside, length: inside.get(length, 0) + each}))
            left -= used * each
    return [pack for room in sorted(open_packs) for pack in open_packs[room]]


def slots(packs: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end of ranks, how many in a pack, first sequence, offset) of each length of each pattern."""
    out, ranks, sequence = [], defaultdict(int), 0
    for count, inside in packs:
        offset = 0
        for length, each in sorted(inside.items(), reverse=True):
            out.append((length, ranks[length], ranks[length] + count * each, each, sequence, offset))
            ranks[length] += count * each
            offset += each * length
        sequence += count
    return out


def tokenized_pieces(docs: DataFrame, path: str, pattern: str, most: int, end_id: int) -> DataFrame:
    """Each document's ids and `end_id`, cut into pieces of `most` ids and a rest."""

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path, pattern), end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = own.packed_ids(text or "") + end
                n = len(ids) // 4
                rows += [(doc_id, at, min(most, n - at), zlib.crc32(ids[4 * at : 4 * (at + most)]), n) for at in range(0, n, most)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    shape = ", ".join(f"{x} long" for x in names)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, shape)


def pack(docs: DataFrame, path: str, pattern: str, most: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `path` is a tokenizer file whose pre-tokenizer splits by `pattern`. Only documents of more than `most` ids are cut.
    Null is an empty text, which has the one id `end_id`. Repeated rows are packed as often as they occur, a null
    doc_id stays null, other columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = tokenized_pieces(docs, path, pattern, most, end_id).withColumn("uid", F.monotonically_increasing_id())
    with small_batches(spark):
        pieces = durable(pieces.withColumn("part", F.shiftright("uid", 33).cast("int")))
    # A length's rank: the pieces of this length in earlier partitions, then the place in its own one, so that no task
    # sorts all pieces of a frequent length.
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "part").orderBy("uid")) - 1
    ranked = pieces.withColumn("local", local).join(counts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    names = ["slot_length", "low", "high", "each", "first_sequence", "first_offset"]
    found = slots(shortest_pack_first(histogram, most))
    # As an Arrow table it needs no Python workers; those of a list stay in each executor beside the others.
    table = spark.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else [()] * len(names))], names))
    # At most 44 different lengths fit in a pack of 1024 and there are a few packs a length: a bounded table.
    at = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    nth = F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(table), at).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
