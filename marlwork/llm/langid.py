"""Language identification by prediction by partial matching over bytes.

Each language has a context tree: how often each byte follows each context of up to `ORDER` bytes. A byte unseen after
a context costs an escape and is looked up after the next shorter one, down to a uniform byte. The statistics are
frozen after training, so a byte's code length depends on its context alone; the code lengths of all grams that some
language has seen are worked out once, a row per gram and a column per language, and a text's code length under each
language is a sum of such rows. Grams that none has seen are looked up by their shorter contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlwork.llm.common import durable, small, small_batches, text_hash, texts_of, without

#: Bytes of context: three letters of Latin script, one or two of most others.
ORDER = 3
#: Bytes counted or scored at once.
STEP = 1 << 18
#: What stands before a text.
LEAD = b" " * ORDER


def grams_of(text: str) -> Iterator[np.ndarray]:
    """The last ORDER bytes and the next one, as one integer, of every byte of a text, in pieces."""
    raw = LEAD + text.encode("utf-8", "replace")
    for lo in range(0, len(raw) - ORDER, STEP):
        b = np.frombuffer(raw[lo : lo + STEP + ORDER], np.uint8).astype(np.uint32)
        yield b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]


def gram_counts(sample: DataFrame) -> DataFrame:
    """lang, gram and n, over whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counted(lang: str, found: list[np.ndarray]) -> pd.DataFrame:
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            return pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n.astype(np.int64)})

        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                found, size = [], 0
                for piece in (x for text in texts for x in grams_of(text)):
                    found.append(piece)
                    size += len(piece)
                    if size >= 4 * STEP:
                        yield counted(lang, found)
                        found, size = [], 0
                if found:
                    yield counted(lang, found)

    return sample.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Code lengths of bytes after contexts, for each of some languages."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        """grams: by language, distinct grams and their counts; all of them are kept."""
        self.langs = langs
        #: By order: grams in ascending order with their code lengths, contexts in ascending order with what an escape costs.
        self.grams, self.costs, self.contexts, self.escapes = [], [], [], []
        for order in range(ORDER + 1 if langs else 0):
            mask = (1 << 8 * (order + 1)) - 1
            own = [np.unique(grams[x][0] & mask, return_inverse=True) for x in langs]
            keys = np.unique(np.concatenate([np.arange(256), *(k for k, _ in own)]) if order == 0 else np.concatenate([k for k, _ in own]))
            contexts, at = np.unique(keys >> 8, return_inverse=True)
            cost, escape = np.empty((len(keys), len(langs)), np.float32), np.empty((len(contexts), len(langs)), np.float32)
            shorter = None if order == 0 else self.costs[order - 1][np.searchsorted(self.grams[order - 1], keys & (mask >> 8))]
            for k, lang in enumerate(langs):
                found, place = own[k]
                c = np.zeros(len(keys))
                c[np.searchsorted(keys, found)] = np.bincount(place, grams[lang][1], len(found))
                total, kinds = np.bincount(at, c, len(contexts)), np.bincount(at, c > 0, len(contexts))
                escape[:, k] = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0)
                rest = escape[at, k] + (8 if shorter is None else shorter[:, k])
                cost[:, k] = np.where(c > 0, -np.log2(np.maximum(c, 1) / np.maximum(total + kinds, 1)[at]), rest)
            self.grams.append(keys.astype(np.uint32))
            self.contexts.append(contexts.astype(np.uint32))
            self.costs.append(cost)
            self.escapes.append(escape)

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits of the whole text under each language."""
        bits = np.zeros(len(self.langs))
        for gram in grams_of(text):
            for order in range(ORDER, -1, -1):
                gram = gram & np.uint32((1 << 8 * (order + 1)) - 1)
                at = np.minimum(np.searchsorted(self.grams[order], gram), len(self.grams[order]) - 1)
                known = self.grams[order][at] == gram
                bits += self.costs[order][at[known]].sum(axis=0, dtype=np.float64)
                gram = gram[~known]
                if not len(gram):
                    break
                context = gram >> np.uint32(8)
                at = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
                bits += self.escapes[order][at[self.contexts[order][at] == context]].sum(axis=0, dtype=np.float64)
        return bits

    def judged(self, text: str | None) -> tuple[str, float, float]:
        """The language with the shortest code, its bits, and the sum of all languages' probabilities by its own; `und` without a letter."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        bits = self.code_lengths(text)
        k = int(bits.argmin())
        return self.langs[k], float(bits[k]), float(np.exp2(np.maximum(bits[k] - bits, -1000)).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the shortest code, and its posterior under equal priors; `und` and 0 without a letter."""
        lang, _, spread = self.judged(text)
        return lang, 1 / spread if spread else 0.0


def models(grams: dict[str, tuple[np.ndarray, np.ndarray]], most_bytes: int = 64 << 20) -> list[Model]:
    """Models that have all languages between them, in order, each of at most about `most_bytes` (or one language)."""
    groups, bound = [[]], 0
    for lang in sorted(grams):
        rows = bound + 2 * len(grams[lang][0])  # grams of all orders and contexts are fewer than twice those of the longest
        if groups[-1] and rows * (4 + 4 * (len(groups[-1]) + 1)) > most_bytes:
            groups.append([])
            rows = 2 * len(grams[lang][0])
        groups[-1].append(lang)
        bound = rows
    return [Model(group, grams) for group in groups]


def held_out(doc_id) -> F.Column:
    """Whether a document's lang is never learned from: crc32 of its id as text leaves 2 by 4. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, docs_per_lang: int = 1500, most_bytes: int = 64 << 20) -> list[Model]:
    """Models of the languages in docs (doc_id, text, lang), from whole texts that are not held out.

    Bounded: of each language, about `docs_per_lang` documents are read, chosen by a hash of the id. Rows without text,
    lang or id don't take part. There is one model unless the languages' statistics exceed `most_bytes`.
    """
    usable = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    usable = usable.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    shares = small(usable.groupBy("lang").agg(F.least(F.lit(1.0), docs_per_lang / F.count("*")).alias("share")))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    with small_batches(docs.sparkSession):
        counts = gram_counts(usable.join(shares, "lang").where(drawn).select("lang", "text")).toArrow()
    lang = counts.column("lang").combine_chunks().dictionary_encode()
    code, gram, n = lang.indices.to_numpy(), counts.column("gram").to_numpy(), counts.column("n").to_numpy().astype(np.float64)
    return models({x: (gram[code == k], n[code == k]) for k, x in enumerate(lang.dictionary.to_pylist())}, most_bytes)


def identify(docs: DataFrame, trained: list[Model]) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, lang_pred and score (0 to 1).

    lang_pred is `und` and score 0 where the text is null or has no letter, or where nothing could be learned. Ties go
    to the language that sorts first. Repeated rows stay repeated; other columns are ignored. Several models each read
    the texts in a pass of their own, so that a task holds one of them.
    """
    return coded(docs, trained).drop("bits")


def coded(docs: DataFrame, trained: list[Model]) -> DataFrame:
    """What identify() gives, and bits, the text's code length under lang_pred."""
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))

    def judged(rows: DataFrame, model: Model, key: str) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # of a bounded size, see models()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [shared.value.judged(x) for x in texts_of(batch)]
                lang, bits, spread = zip(*found, strict=True) if found else ((), (), ())
                columns = [batch.column(key), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(bits, pa.float64()), pa.array(spread, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [key, "held_out", "lang_pred", "bits", "spread"])

        return rows.mapInArrow(run, f"{key} long, held_out boolean, lang_pred string, bits double, spread double")

    score = F.when(F.col("spread") > 0, 1 / F.col("spread")).otherwise(F.lit(0.0)).alias("score")
    if len(trained) == 1:
        return judged(plain, trained[0], "doc_id").select("doc_id", "held_out", "lang_pred", score, "bits")
    rows = durable(plain.withColumn("uid", F.monotonically_increasing_id()))
    found = judged(rows, trained[0], "uid")
    for model in trained[1:]:
        found = found.unionByName(judged(rows, model, "uid"))
    best = found.groupBy("uid").agg(F.min(F.struct("bits", "lang_pred")).alias("best"), F.collect_list(F.struct("bits", "spread")).alias("each"))
    spread = F.aggregate("each", F.lit(0.0), lambda s, x: s + x["spread"] * F.pow(F.lit(2.0), F.col("best.bits") - x["bits"]))
    best = best.select("uid", F.col("best.lang_pred").alias("lang_pred"), F.col("best.bits").alias("bits"), spread.alias("spread"))
    return rows.select("uid", "doc_id", "held_out").join(best, "uid").select("doc_id", "held_out", "lang_pred", score, "bits")


def keep_identified(docs: DataFrame, trained: list[Model], least: float = 0.999, most_bits: float = 6.0) -> DataFrame:
    """The rows of docs (doc_id, text, lang) whose language is known to the models and isn't another than `lang` says. All columns stay.

    Rows of `und` go, and those of which a model is sure (`least` or more of the probability) that they are in another
    of its languages than the one they are labelled with. Among languages that all don't fit, one is always the likeliest
    by far: a text that costs this language more than `most_bits` a byte (characters drawn from 64 cost six) is in none
    of them, and contradicts no label. Rows without a label, or with one that no model has, go by the
    text alone. A row without an id is judged by its text as any other; rows of one id and text share the verdict (they
    go if any of their labels is wrong); an empty table stays empty. Only ids, labels and texts pass by Python, and only the rows that go come back.
    """
    plain = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), F.col("text").cast("string"), F.col("lang").cast("string"))
    if len(trained) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(trained[0])  # of a bounded size, see models()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = set(shared.value.langs)
            for batch in batches:
                gone = []
                for text, lang in zip(texts_of(batch), batch.column("lang").to_pylist(), strict=True):
                    found, bits, spread = shared.value.judged(text)
                    sure = spread > 0 and 1 / spread >= least and bits <= most_bits * len(text.encode("utf-8", "replace"))
                    gone.append(found == "und" or (lang in known and lang != found and sure))
                yield batch.select(["doc_id", "text_hash"]).filter(pa.array(gone, pa.bool_()))

        with small_batches(docs.sparkSession):
            return without(docs, plain.mapInArrow(run, "doc_id long, text_hash long"))
    known = [x for model in trained for x in model.langs]
    rows = durable(plain.withColumn("uid", F.monotonically_increasing_id()))
    found = coded(rows.select(F.col("uid").alias("doc_id"), "text"), trained).withColumnRenamed("doc_id", "uid")
    sure = (F.col("score") >= least) & (F.col("bits") <= most_bits * F.octet_length("text"))
    wrong = F.col("lang").isin(known) & (F.col("lang") != F.col("lang_pred")) & sure
    with small_batches(docs.sparkSession):
        return without(docs, rows.join(found, "uid").where((F.col("lang_pred") == "und") | F.coalesce(wrong, F.lit(False))))
