"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens choose spans of whole turns: each takes as many as fit into the budget beside the system turn
and the history. A span becomes a window that begins with the system turn and a limited stretch of the turns before it.
Only the new assistant texts of a window are targets: repeated ones are masked.

A turn is written as `### role: text</turn>` and a line feed. Inside roles and texts a backslash becomes \\b, # becomes
\\h, < becomes \\l and, in roles, a colon becomes \\c, so that no marker can occur in them; the way back is unambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's markers.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Characters and what they become, the backslash first.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escaped(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, bytes_per_token: int = 4, turn_cost: int = 4, tokens: str | None = None, stretch: int = 64) -> DataFrame:
    """conv_id, first (place of the window's first new turn), n_context, n_tokens, formatted and loss of each window.

    turns has conv_id, turn, role and text. A turn's tokens are those of the column `tokens`, if one is named (null: 0),
    else estimated as `turn_cost` and one for each `bytes_per_token` bytes begun. A window has `budget` tokens at most:
    the system turn, if the conversation begins with one, `history` tokens of the turns before and the new turns. Turns
    are never cut: only a window whose system turn and first new turn have more tokens than the budget exceeds it, and
    has neither history nor other new turns. n_context counts the repeated turns that lead, n_tokens all of the window.
    loss holds (start, end) code points of the texts of new assistant turns.

    Spans are chosen in stretches of `stretch` budgets, which no window crosses, so that no task collects a long
    conversation. Turns are ordered by turn, role and text (nulls first); null roles and texts are empty, a null conv_id
    is a conversation of its own, repeated rows are turns of their own, other columns are ignored.
    """
    texts = (F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text"))
    estimate = turn_cost + F.ceil(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) / bytes_per_token)
    size = estimate if tokens is None else F.coalesce(F.col(tokens), F.lit(0))
    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *texts, size.cast("long").alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = plain.withColumn("n", F.row_number().over(order)).withColumn("before", F.sum("tokens").over(upto) - F.col("tokens"))
    piece = F.struct("n", "before", "tokens", "role", "text")
    system = F.first(F.when((F.col("n") == 1) & (F.col("role") == "system"), piece)).over(upto)
    past = F.collect_list(piece).over(Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, -1))
    summed = summed.withColumn("system", system).withColumn("past", past)
    grouped = summed.groupBy("conv_id", F.floor(F.col("before") / (stretch * budget)).alias("stretch")).agg(
        F.min_by("system", "n").alias("system"), F.array_sort(F.collect_list(F.struct("n", "before", "tokens", "role", "text", "past"))).alias("turns")
    )
    own = F.coalesce(F.col("system.tokens"), F.lit(0))

    def begins(state: Column, turn: Column) -> Column:
        """Adds `turn` to the open window, or opens one with it; out holds the first turn of each window."""
        room = F.when(state["first"] == 1, F.lit(budget)).otherwise(budget - own - history)
        fits = turn["before"] + turn["tokens"] - state["begin"] <= room
        opened = F.struct(turn["n"].alias("first"), turn["before"].alias("begin"), F.concat(state["out"], F.array(turn["n"])).alias("out"))
        return F.when(F.coalesce(fits, F.lit(False)), state).otherwise(opened)

    none = F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("long").alias("begin"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate("turns", none, begins, lambda s: s["out"])
    cut = grouped.select("conv_id", "system", "turns", starts.alias("starts")).select("conv_id", "system", F.explode(F.transform("starts", lambda n, i: F.struct(
        n.alias("first"), F.slice("turns", n - F.get("turns", F.lit(0))["n"] + 1, F.coalesce(F.get("starts", i + 1), F.element_at("turns", -1)["n"] + 1) - n).alias("new"))
    )).alias("w"))
    spans = cut.select("conv_id", "system", "w.first", F.transform("w.new", lambda t: t.dropFields("past")).alias("new"), F.get("w.new", F.lit(0))["past"].alias("past"))
    # What the new turns leave of the budget bounds the history.
    added = F.aggregate("new", F.lit(0).cast("long"), lambda s, t: s + t["tokens"])
    spans = spans.withColumn("room", F.least(F.lit(history), budget - F.when(F.col("first") == 1, 0).otherwise(own) - added))
    begin = F.get("new", F.lit(0))["before"]
    near = F.filter("past", lambda t: (t["before"] >= begin - F.col("room")) & ~(F.col("system").isNotNull() & (t["n"] == 1)))
    context = F.when(F.col("first") == 1, F.slice("new", 1, 0)).otherwise(F.concat(F.array_compact(F.array("system")), near))

    def step(state: Column, turn: Column) -> Column:
        head = F.concat(state["out"], F.lit(OPEN), escaped(turn["role"], ROLE_ESCAPES), F.lit(MIDDLE))
        whole = F.concat(head, escaped(turn["text"]))
        target = (turn["n"] >= F.col("first")) & (turn["role"] == "assistant")
        one = F.array(F.struct(F.length(head).alias("start"), F.length(whole).alias("end")))
        return F.struct(F.concat(whole, F.lit(CLOSE)).alias("out"), F.when(target, F.concat(state["loss"], one)).otherwise(state["loss"]).alias("loss"))

    zero = F.struct(F.lit("").alias("out"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    built = spans.select("conv_id", "first", context.alias("context"), "new").select(
        "conv_id",
        "first",
        F.size("context").alias("n_context"),
        F.aggregate(F.concat("context", "new"), F.lit(0).cast("long"), lambda s, t: s + t["tokens"]).alias("n_tokens"),
        F.aggregate(F.concat("context", "new"), zero, step).alias("x"),
    )
    return built.select("conv_id", "first", "n_context", "n_tokens", F.col("x.out").alias("formatted"), F.col("x.loss").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from what windows() returns.

    Turns are read from the formatted texts, targets from the texts under the masks. A conversation's digest needs its
    text in one row.
    """
    parts = F.split("formatted", CLOSE, -1)
    new = F.slice(parts, F.col("n_context") + 1, F.size(parts) - 1 - F.col("n_context"))

    def turn(x: Column) -> Column:
        middle = F.position(F.lit(MIDDLE), x)
        role = F.substring(x, F.lit(len(OPEN) + 1), middle - len(OPEN) - 1)
        text = F.substring(x, middle + len(MIDDLE), F.length(x))
        return F.concat(unescaped(role, ROLE_ESCAPES), F.lit("\n"), unescaped(text), F.lit("\n"))

    target = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    rows = formatted.select(
        "conv_id",
        F.struct("first", F.array_join(F.transform(new, turn), "").alias("turns"), F.array_join(target, "").alias("loss")).alias("x"),
        F.size(new).cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("x")).alias("x"), F.sum("chars").alias("formatted_chars"))
    whole = whole.select("conv_id", "n_turns", F.array_join("x.turns", "").alias("turns"), F.array_join("x.loss", "").alias("loss"), "formatted_chars")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
