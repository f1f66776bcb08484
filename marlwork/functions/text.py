"""Column expressions over texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(text: Column) -> Column:
    """`text` without white space (Unicode's) at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.array_remove(F.split(F.lower(text), r"(?U)\s+", -1), "")


def last_index(text: Column, part: str) -> Column:
    """Place (from 0) of the last occurrence of `part`, which reads the same backwards; -1 without one."""
    back = F.instr(F.reverse(text), part)
    return F.when(back > 0, F.length(text) - back - len(part) + 1).otherwise(F.lit(-1))


def holds_any(text: Column, parts: list[str]) -> Column:
    """Whether lower-case `text` holds one of the strings, also inside words."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def hits(text: Column, parts: list[str]) -> Column:
    """Those of the strings that lower-case `text` holds, in their order."""
    return F.array_compact(F.array(*(F.when(F.contains(text, F.lit(x)), F.lit(x)) for x in parts)))


def first_group(text: Column, patterns: list[str], flags: str = "") -> Column:
    """Group 1 of the first pattern that matches; null if none does."""
    tried = [F.nullif(F.regexp_extract(text, flags + p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*tried)


def matches(text: Column, pattern: str) -> Column:
    """(start, end, match) of the leftmost non-overlapping matches of a pattern that matches no empty string; places from 0, in characters."""

    def placed(gaps: Column, found: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            match = F.get(found, i)
            start = state["at"] + F.length(F.get(gaps, i))
            end = start + F.length(match)
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), match.alias("match")))).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda s: s["out"])

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    some = lambda found: F.when(F.size(found) == 0, none).otherwise(once(F.split(text, pattern, -1), lambda gaps: placed(gaps, found)))
    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def word_f1(a: Column, b: Column) -> Column:
    """F1 of two texts' sets of lower-case words; 1 if both are empty, 0 if one is."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    common = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).when(common == 0, F.lit(0.0)).otherwise(2.0 * common / (F.size(x) + F.size(y)))


def unique_ratio(text: Column) -> Column:
    """The share of a text's lower-case words that are distinct; 0 for a text without words."""
    return once(tokens(text), lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))).otherwise(F.lit(0.0)))
