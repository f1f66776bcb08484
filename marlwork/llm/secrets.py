"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong findings (assignments, access ids, long hex runs) stand alone. Weak candidates (logins, mixed-case keys,
endpoints) are reported only where parts that complement each other start within one scope: they are joined by
intervals of text, over one summary for each cell of a text and part, so that no pairs arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlwork.llm.common import durable, let, small, text_hash

#: The contract's patterns. Fixed values.
ASSIGN = """((?i)password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: Weak candidates of this library.
LOGIN = """((?i)username|user_id|login|client_id|account_id)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9_.@-]+)"""
KEY = "[A-Za-z0-9+/]+"
#: A scheme has at most 31 characters, so that a long run of letters is read once.
ENDPOINT = "[a-z][a-z0-9+.-]{0,30}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
#: Order of kinds, and the part of a credential that each kind is: identifier, secret, endpoint.
KINDS = {"assign": "s", "access": "i", "hex": "s", "login": "i", "key": "s", "endpoint": "p"}
WEAK = ("login", "key", "endpoint")
#: Cheap conditions without which a pattern cannot match. A run of 20 of these characters holds every access, hex and key finding.
LONG_RUN = "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20}"
SPAN = "array<struct<start:int,end:int>>"


def prefix_sums(numbers: Column, block: int = 256) -> Column:
    """The sums of an int array's items up to and with each item; blocks keep the copies that a fold makes short."""

    def sums(start: Column, part: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")), lambda s: s["out"])

    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)
    whole = lambda parts: let(sums(F.lit(0), F.transform(parts, total)), lambda ends: F.flatten(F.transform(parts, lambda x, i: sums(F.coalesce(F.get(ends, i - 1), F.lit(0)), x))))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int")), lambda i: F.slice(numbers, i * block + 1, F.lit(block)))
    return F.when(F.size(numbers) <= block, sums(F.lit(0), numbers)).otherwise(let(parts, whole))


def found(text: Column, pattern: str, group: int = 0, least: int = 0, also: tuple[str, ...] = ()) -> Column:
    """(start, end) code points of the leftmost non-overlapping matches whose group has `least` characters and matches `also`."""
    rule = F.lit(pattern)

    def good(part: Column) -> Column:
        ok = F.length(part) >= least
        for x in also:
            ok = ok & part.rlike(x)
        return ok

    def places(gaps: Column, matches: Column, parts: Column) -> Column:
        steps = F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0)))
        spans = lambda starts: F.transform(starts, lambda s, i: F.struct(s.alias("start"), (s + F.length(F.get(matches, i))).cast("int").alias("end"), good(F.get(parts, i)).alias("ok")))
        return F.transform(F.filter(let(let(steps, lambda x: prefix_sums(x)), spans), lambda s: s["ok"]), lambda s: F.struct(s["start"], s["end"]))

    def of(matches: Column) -> Column:
        parts = F.regexp_extract_all(text, rule, F.lit(group)) if group else matches
        located = let(F.split(text, pattern, -1), lambda gaps: let(parts, lambda p: places(gaps, matches, p)))
        return F.when(F.size(matches) == 0, F.array().cast(SPAN)).otherwise(located)

    return let(F.regexp_extract_all(text, rule, F.lit(0)), of)


def if_(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(SPAN))


def candidates(text: Column) -> dict[str, Column]:
    """The spans of each kind in a text that is not null."""
    lowered = F.lower(text)
    has = lambda *words: F.greatest(*(F.contains(lowered, F.lit(w)).cast("int") for w in words), F.lit(0)) == 1
    run = text.rlike(LONG_RUN)
    # Runs shorter than the least length can't be findings, and the patterns match whole runs, so long runs are enough.
    return {
        "assign": if_(has("password", "passwd", "secret", "token", "apikey", "api_key"), found(text, ASSIGN, 2, 6)),
        "access": if_(run & F.contains(text, F.lit("AKIA")), found(text, ACCESS, 0, 20)),
        "hex": if_(run, found(text, HEX[:-1] + "{24,}")),
        "login": if_(has("username", "user_id", "login", "client_id", "account_id"), found(text, LOGIN, 2, 3)),
        "key": if_(run, found(text, KEY[:-1] + "{32,}", 0, 32, ("[A-Z]", "[a-z]", "[0-9]"))),
        "endpoint": if_(F.contains(text, F.lit("://")), found(text, ENDPOINT)),
    }


def tag(spans: Column, k: int) -> Column:
    """(start, k, end) structs, which sort by start, then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end")))


def count_of(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of (start, k, end) structs, by start, then kind."""
    names = F.array(*(F.lit(x) for x in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = 256) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text_hash, uid, base and spans (arrays of (start, k, end); k numbers KINDS).

    base holds the strong findings, spans these and the linked weak ones. A weak candidate is linked if a candidate of
    another part (identifier, secret, endpoint), weak or strong, starts at most `scope` code points from its start. Null
    is an empty text; texts without findings have empty arrays. Repeated rows stay repeated, null ids stay null, other
    columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = F.array(*()).cast("array<struct<start:int,k:int,end:int>>")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select(
        "doc_id", F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("uid"), *(x.alias(kind) for kind, x in candidates(text).items())
    )
    tagged = {kind: tag(F.col(kind), k) for k, kind in enumerate(KINDS)}
    rows = durable(
        rows.select(
            "doc_id",
            "text_hash",
            "uid",
            F.concat(flat, *(x for kind, x in tagged.items() if kind not in WEAK)).alias("base"),
            F.concat(flat, *(x for kind, x in tagged.items() if kind in WEAK)).alias("weak"),
        )
    )
    part = F.get(F.array(*(F.lit(x) for x in KINDS.values())), F.col("s.k"))
    parts = rows.where(F.size("weak") > 0).select("uid", F.explode(F.concat("weak", "base")).alias("s"))
    parts = parts.select("uid", "s", part.alias("part"), F.floor(F.col("s.start") / scope).alias("cell"))
    # One row per text, cell and part stands for all candidates there: the nearest from the left and from the right.
    cells = parts.groupBy("uid", "cell", "part").agg(F.min("s.start").alias("least"), F.max("s.start").alias("most"))
    near = cells.select("uid", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"), F.col("part").alias("other"), "least", "most")
    near = near.groupBy("uid", "cell").agg(F.collect_list(F.struct("other", "least", "most")).alias("around"))  # nine at most
    start = F.col("s.start")
    # A summary reaches back to `least` and on to `most`; in the candidate's own cell any start is near enough.
    close = F.exists(
        "around",
        lambda x: (x["other"] != F.col("part"))
        & ((F.abs(x["least"] - start) <= scope) | (F.abs(x["most"] - start) <= scope)),
    )
    weak_kinds = [k for k, kind in enumerate(KINDS) if kind in WEAK]
    linked = parts.where(F.col("s.k").isin(weak_kinds)).join(near, ["uid", "cell"]).where(close)
    linked = linked.groupBy("uid").agg(F.collect_list("s").alias("linked"))
    return rows.join(linked, "uid", "left").select("doc_id", "text_hash", "uid", "base", F.concat("base", F.coalesce("linked", flat)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts by strong kind, base_sha256 and spans as text, of what scan() returns."""
    counts = (count_of(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(("assign", "access", "hex")))
    return scanned.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]", block: int = 4096) -> Column:
    """`text` with `mark` in place of each span; spans that overlap count as one.

    The text is rewritten in blocks of `block` characters, so that long texts with many spans aren't copied for each.
    """

    def rewritten(part: Column, lo: Column) -> Column:
        def step(state: Column, s: Column) -> Column:
            inside = s["start"] < state["at"]
            kept = F.substring(part, state["at"] - lo + 1, s["start"] - state["at"])
            longer = F.greatest(s["end"], state["at"])
            return F.struct(longer.alias("at"), F.when(inside, state["out"]).otherwise(F.concat(state["out"], kept, F.lit(mark))).alias("out"))

        # Where the spans that began in earlier blocks end.
        earlier = F.coalesce(F.array_max(F.transform(F.filter(spans, lambda s: s["start"] < lo), lambda s: s["end"])), F.lit(0))
        own = F.array_sort(F.filter(spans, lambda s: (s["start"] >= lo) & (s["start"] < lo + block)))
        zero = F.struct(F.greatest(earlier, lo).alias("at"), F.lit("").alias("out"))
        rest = lambda s: F.when(s["at"] >= lo + block, s["out"]).otherwise(F.concat(s["out"], F.substring(part, s["at"] - lo + 1, F.lit(block))))
        return F.aggregate(own, zero, step, rest)

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    whole = F.array_join(F.transform(parts, lambda part, i: rewritten(part, i * block)), "")
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, scope: int = 256) -> DataFrame:
    """`docs` with the findings in text replaced; rows without findings stay as they are.

    The rows are those of docs, which has doc_id and text; n_chars, where there is one, follows the text.
    """
    found = scan(docs, scope).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    found = small(found.select(F.col("doc_id").alias("marlwork_id"), F.col("text_hash").alias("marlwork_hash"), F.col("spans").alias("marlwork_spans")), weight=F.size("marlwork_spans"))
    text = F.coalesce(F.col("text"), F.lit(""))
    same = docs["doc_id"].cast("long").eqNullSafe(found["marlwork_id"]) & (text_hash() == found["marlwork_hash"])
    out = docs.join(found, same, "left")
    out = out.withColumn("text", F.when(F.col("marlwork_spans").isNull(), F.col("text")).otherwise(redacted(text, F.col("marlwork_spans"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("marlwork_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
