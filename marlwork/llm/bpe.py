"""Byte-level BPE by prefix dynamic programming, and decoding.

Every byte prefix of a piece has one valid encoding, so one valid last token. The table of these last tokens is filled
from left to right: a token that ends at a place is the last one there if it may follow the last token of the prefix
before it. Reading the table backwards gives the encoding. An append goes on from the table's end; an edit keeps the
table before it and rejoins the old table as soon as the last tokens agree again over the longest token's width.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlwork.llm.common import texts_of

#: Distinct pieces and token pairs that a Python worker remembers; beyond that it forgets all and begins anew.
REMEMBERED = 300_000


def unicode_white(pattern: str) -> str:
    """`pattern` with \\s and \\S as Unicode's White_Space, as the tokenizer libraries read them."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Vocabulary:
    """Tokens by rank, and the valid last tokens of prefixes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Finds the tokens that end at each place, the longest first. Its keys are bytes as Latin-1 characters.
        self.endings = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.endings.add_word(token.decode("latin-1"), (len(token), i))
        self.endings.make_automaton()
        self.may_follow: dict[int, bool] = {}
        self.made_of: dict[int, tuple[int, int] | None] = {}

    @classmethod
    def from_tiktoken(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merged(self, piece: bytes, below: int = 1 << 62) -> list[int]:
        """The encoding by its definition: always the lowest-ranked, then leftmost, pair is merged; ranks from `below` on don't count."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; None for single bytes and for tokens that no merge reaches."""
        if token not in self.made_of:
            parts = self.merged(self.bytes_of[token], token) if len(self.bytes_of[token]) > 1 else []
            self.made_of[token] = tuple(parts) if len(parts) == 2 and max(parts) < token else None
        return self.made_of[token]

    def reachable(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def follows(self, before: int | None, token: int) -> bool:
        """Whether `token` may stand after `before` (None: at the start) in an encoding.

        Undoes the merges inside both tokens, the latest first, and looks at the two parts that touch: had their merge
        come before either part was used up, the two tokens would not stand side by side.
        """
        if before is None:
            return self.reachable(token)
        if (known := self.may_follow.get(before << 32 | token)) is None:
            if len(self.may_follow) > REMEMBERED:
                self.may_follow.clear()
            known = self.may_follow[before << 32 | token] = self.reachable(token) and self._untouched(before, token)
        return known

    def _untouched(self, left: int, right: int) -> bool:
        left_used = right_used = never = 1 << 62
        while True:
            rank = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], never)
            if rank < left_used and rank <= right_used and rank != never:
                return False
            left_halves, right_halves = self.halves(left), self.halves(right)
            if right_halves and (right >= left or not left_halves):
                right_used, right = right, right_halves[0]
            elif left_halves:
                left_used, left = left, left_halves[1]
            else:
                return True


class PrefixTable:
    """The last tokens of all prefixes of one piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.table = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """The piece with `more` at its end; nothing before is computed again."""
        self.piece += more
        self._fill()

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Puts `new` in place of piece[start:end]; how many prefixes were computed again."""
        tail, shift = self.table[end:], start + len(new)
        self.piece = self.piece[:start] + new + self.piece[end:]
        del self.table[start:]
        return self._fill(tail, shift)

    def _fill(self, tail: list[int] | None = None, shift: int = 0) -> int:
        """The rest of the table. tail: last tokens from place `shift` on before an edit; taken once they agree again."""
        table, vocabulary, first, agree = self.table, self.vocabulary, len(self.table), 0
        may_follow, begin = vocabulary.may_follow.get, max(0, len(self.table) + 1 - vocabulary.longest)
        for at, (n, token) in vocabulary.endings.iter(self.piece[begin:].decode("latin-1")):
            end = begin + at + 1
            if end != len(table) + 1:
                continue  # this prefix has its last token already
            before = table[end - n - 1] if end > n else None
            known = None if before is None else may_follow(before << 32 | token)
            if vocabulary.follows(before, token) if known is None else known:
                table.append(token)
                if tail is not None and end > shift:
                    agree = agree + 1 if token == tail[end - 1 - shift] else 0
                    if agree >= vocabulary.longest:
                        table += tail[end - shift :]
                        return end - first
        if len(table) < len(self.piece):
            raise ValueError(f"no token for byte {self.piece[len(table)]}")
        return len(table) - first

    def ids(self) -> list[int]:
        out, end = [], len(self.piece)
        while end:
            out.append(self.table[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Pieces(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        whole = self.vocabulary.ranks.get(raw)
        ids = PrefixTable(self.vocabulary, raw).ids() if whole is None else [whole]
        found = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = found
        return found


class Codec:
    """Text to packed ids and back."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.split = regex.compile(unicode_white(pattern)).findall
        self.pieces = Pieces(vocabulary)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.vocabulary.bytes_of.__getitem__, memoryview(packed).cast("I")))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec a Python worker."""
    return Codec(Vocabulary.from_tiktoken(path), pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary).

    `path` is a rank file, `pattern` splits a text into the pieces that are encoded separately. Null is an empty text;
    empty texts have no ids. Repeated rows stay repeated, a null doc_id stays null, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [own.encode(x or "") for x in texts_of(part)]
                columns = [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encoding_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what encode_decode() returns."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


__all__ = ["Codec", "PrefixTable", "Vocabulary", "encode_decode", "encoding_digests"]
