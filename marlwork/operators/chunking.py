"""Overlapping chunks of documents, with section ids and back-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlwork.functions.text import first_group, last_index, once, stripped

#: Patterns of section ids, tried in this order, in either case. Fixed values.
SECTION_PATTERNS = [
    r"(?:Section|Sec\.?)\s*(\d+[A-Z]?(?:\([a-z]+\))?)",
    r"(\d+[A-Z]?(?:\([a-z]+\))?)\.\s*[A-Z]",
    r"(\d+[A-Z]?)\s+[A-Z]",
    r"Part\s+([IVX]+)",
    r"Chapter\s+(\d+)",
    r"(\d+[A-Z]?)\s*[-–]\s*[A-Z]",
    r"(\d+[A-Z]?)\s*[:\.]",
]
#: Patterns of section titles, tried in this order, in the case given. Fixed values.
TITLE_PATTERNS = [
    r"(?:Section|Sec\.?)\s*\d+[A-Z]?(?:\([a-z]+\))?\s*[-–]?\s*([A-Z][^\n.]{10,80})",
    r"\d+[A-Z]?(?:\([a-z]+\))?\.\s*([A-Z][^\n.]{10,80})",
    r"\d+[A-Z]?(?:\([a-z]+\))?\s+([A-Z][^\n.]{10,80})",
    r"\d+[A-Z]?\s*[-–]\s*([A-Z][^\n.]{10,80})",
]


def section_id(text: Column) -> Column:
    return F.concat(F.lit("EA-"), first_group(text, SECTION_PATTERNS, "(?i)"))


def section_title(text: Column) -> Column:
    title = stripped(first_group(F.substring(text, 1, 200), TITLE_PATTERNS))
    return F.regexp_replace(F.regexp_replace(title, r"\s*[-–]\s*$", ""), r"\s*\.$", "")


def chunk_bounds(docs: DataFrame, size: int = 1000, overlap: int = 300, least: int = 100) -> DataFrame:
    """doc_id, chunk_index, start_pos, end_pos, body (stripped) and tail of the chunks of docs (doc_id, text).

    Windows begin every size - overlap characters. A window that isn't the last one ends behind its last full stop, if
    that lies in its second half, else behind its last blank line, else behind its last line feed, else at its full
    size. A last window shorter than `least` is appended to the chunk before it, from that chunk's end on: its tail.
    Chunks of fewer than `least` stripped characters are left out; shorter documents are one chunk, empty ones none.
    A document is cut in its row, without a shuffle.
    """
    step = size - overlap
    more = -(-overlap // step)  # blocks of `step` characters that a window reaches into behind its own
    n, blocks = F.col("n"), F.col("blocks")
    cut = docs.where(F.length("text") > 0).select("doc_id", F.length("text").alias("n"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("blocks"))
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")

    def window(i: Column, text: Column) -> Column:
        dot, blank, line = (last_index(text, x) for x in (".", "\n\n", "\n"))
        inner = F.when(dot > size // 2, dot + 1).when(blank > 0, blank + 2).when(line > 0, line + 1).otherwise(F.lit(size))
        end = F.when(i == last, n).otherwise(i * step + inner)
        body = lambda e: stripped(F.substring(text, F.lit(1), e - i * step))
        tiny = (i == last) & (n - i * step < least) & (i > 0)
        return once(end, lambda e: F.struct((i * step).alias("start_pos"), e.alias("end_pos"), body(e).alias("body"), tiny.alias("tiny")))

    part = lambda i: F.substring(F.array_join(F.slice(blocks, i + 1, F.lit(1 + more)), ""), 1, size)
    every = F.transform(F.sequence(F.lit(0), last), lambda i: once(part(i), lambda text: window(i, text)))
    kept = F.filter(every, lambda w: w["tiny"] | (n < least) | (F.length(w["body"]) >= least))

    def numbered(windows: Column) -> Column:
        def placed(w: Column, i: Column) -> Column:
            joined = F.coalesce(F.get(windows, i + 1)["tiny"], F.lit(False))
            rest = F.array_join(F.slice(blocks, (w["start_pos"] / step).cast("int") + 1, F.size(blocks)), "")
            tail = F.when(joined, F.substring(rest, w["end_pos"] - w["start_pos"] + 1, n)).otherwise(F.lit(""))
            # Without a chunk before it a tiny window stands by itself, and needs its length as any other.
            alone = ~w["tiny"] | ((i == 0) & (F.length(w["body"]) >= least))
            end = F.when(joined, n).otherwise(w["end_pos"])
            return F.struct(i.alias("chunk_index"), w["start_pos"].alias("start_pos"), end.alias("end_pos"), w["body"].alias("body"), tail.alias("tail"), alone.alias("alone"))

        return F.filter(F.transform(windows, placed), lambda w: w["alone"])

    return cut.select("doc_id", F.explode(once(kept, numbered)).alias("w")).select("doc_id", "w.chunk_index", "w.start_pos", "w.end_pos", "w.body", "w.tail")


def chunk(docs: DataFrame, size: int = 1000, overlap: int = 300, least: int = 100, label: str = "Employment Act Section") -> DataFrame:
    """Chunks with ids, section ids, titles and the enriched text; `label` names sections in it."""
    cut = chunk_bounds(docs, size, overlap, least).withColumn("section_id", section_id(F.col("body"))).withColumn("section_title", section_title(F.col("body")))
    sid, title, body = F.col("section_id"), F.col("section_title"), F.col("body")
    titled = F.concat(F.lit(f"[{label} "), sid, F.lit(": "), title, F.lit("] "), body)
    plain = F.concat(F.lit(f"[{label} "), sid, F.lit("] "), body)
    missing = ~F.contains(F.lower(F.substring(body, 1, 100)), F.lower(title))
    rich = F.when(sid.isNull(), body).when(F.coalesce(title, F.lit("")) == "", plain).when(missing, titled).otherwise(body)
    rich = F.when(F.length("body") < least, body).otherwise(rich)
    named = F.format_string("chunk_%04d_%s", "chunk_index", F.substring(F.md5("body"), 1, 8))
    out = F.concat(rich, F.col("tail"))
    return cut.select("doc_id", "chunk_index", named.alias("chunk_id"), "start_pos", "end_pos", F.length(out).alias("length"), "section_id", "section_title", out.alias("text"), body.alias("original_text"))


def backfill_sections(chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_index, text, section_id) with missing ids taken from the texts around, else from before.

    A missing id is looked for in the texts of the two chunks before, the two after and the chunk itself, joined by
    spaces; else the id before it is taken over with -cont, once more for each step.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    around = F.concat_ws(" ", *(F.lag("text", n).over(order) for n in (2, 1)), *(F.lead("text", n).over(order) for n in (1, 2)), F.col("text"))
    filled = chunks.withColumn("found", F.coalesce("section_id", section_id(around))).withColumn("at", F.when(F.col("found").isNotNull(), F.row_number().over(order)))
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    steps = F.row_number().over(order) - F.last("at", ignorenulls=True).over(back)
    carried = F.concat(F.last("found", ignorenulls=True).over(back), F.repeat(F.lit("-cont"), steps))
    return filled.select(*[c for c in chunks.columns if c != "section_id"], F.coalesce("found", carried).alias("section_id"))


def repeated_blocks(blocks: DataFrame) -> DataFrame:
    """doc, norm and n of blocks (doc, page, text) that repeat like headers: in a third of the pages and twice at least."""
    norm = F.regexp_replace(stripped(F.lower("text")), r"(?U)\s+", " ")
    pages = blocks.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    counts = blocks.select("doc", norm.alias("norm")).where((F.length("norm") > 5) & (F.length("norm") < 100)).groupBy("doc", "norm").agg(F.count("*").alias("n"))
    enough = F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 3))
    return counts.join(pages, "doc").where((F.col("pages") > 1) & enough).select("doc", "norm", "n")


def without_repeated(blocks: DataFrame, top: float = 0.08, bottom: float = 0.08) -> DataFrame:
    """The text of each doc of blocks (doc, page, height, y0, block_no, text) without frame and repeated blocks."""
    norm = F.regexp_replace(stripped(F.lower("text")), r"(?U)\s+", " ")
    inside = (F.col("y0") >= F.col("height") * top) & (F.col("y0") <= F.col("height") * (1 - bottom)) & (F.length(stripped(F.col("text"))) > 5)
    kept = blocks.withColumn("norm", norm).where(inside).join(repeated_blocks(blocks).select("doc", "norm"), ["doc", "norm"], "left_anti")
    line = lambda what: F.transform(F.array_sort(F.collect_list(F.struct(what, "text"))), lambda x: x["text"])
    pages = kept.groupBy("doc", "page").agg(F.array_join(line("block_no"), "\n").alias("text")).where(stripped(F.col("text")) != "")
    return pages.groupBy("doc").agg(F.array_join(line("page"), "\n\n").alias("text"))


def clean_lines(text: Column) -> Column:
    """`text` without blank lines, page numbers and lines of fewer than 10 characters, white space squeezed."""
    lines = F.transform(F.split(text, "\n", -1), stripped)
    good = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\d+$") & (F.length(x) >= 10))
    return F.array_join(F.transform(good, lambda x: F.regexp_replace(x, r"(?U)\s+", " ")), "\n")


def corpus_report(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: how many documents, chunks and vectors there are, and the first chunk's id, section and length."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    first = chunks.agg(F.min_by(F.struct("chunk_id", "section_id", "length"), F.struct("doc_id", "chunk_index")).alias("x"))
    out = count(docs, "n_docs").crossJoin(count(chunks, "n_chunks")).crossJoin(count(vectors, "n_vectors")).crossJoin(first)  # one row each
    return out.select("n_docs", "n_chunks", "n_vectors", F.col("x.chunk_id").alias("first_chunk"), F.col("x.section_id").alias("first_section"), F.col("x.length").alias("first_length"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.countDistinct("doc_id").alias("n_docs"),
        F.count("*").alias("n_chunks"),
        F.round(100.0 * F.count("section_id") / F.count("*"), 6).alias("section_coverage"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.round(F.avg("length"), 6).alias("avg_length"),
    )
