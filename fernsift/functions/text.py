"""Column helpers for lines and texts. Everything here is a JVM-side expression."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def shown(text: Column, limit: int | None = None) -> Column:
    """What is stored of a text as evidence: all of it, or its first ``limit`` characters where a caller asks."""
    return text if limit is None else F.substring(text, 1, limit)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


FAN_OUT = 6


def _escaped(c: str) -> str:
    return c if c.isalnum() or ord(c) > 127 else "\\" + c


def one_of(words: Iterable[str]) -> str:
    """A regex for the longest of ``words`` at a position, words with a common start sharing it.

    One pass of it over a text costs less than a substring search per word.
    """
    words = set(words)
    tails: dict[str, set[str]] = {}
    for w in words - {""}:
        tails.setdefault(w[0], set()).add(w[1:])
    branches = [(c, _escaped(c) + one_of(tails[c])) for c in sorted(tails)]
    if not branches:
        return ""
    if len(branches) > FAN_OUT:
        # Java tries alternatives one after the other, so many of them are looked up by class first
        chunks = [branches[i : i + FAN_OUT] for i in range(0, len(branches), FAN_OUT)]
        options = [
            f"(?=[{''.join(_escaped(c) for c, _ in chunk)}])(?:{'|'.join(b for _, b in chunk)})"
            for chunk in chunks
        ]
    else:
        options = [b for _, b in branches]
    body = options[0] if len(options) == 1 and "" not in words else f"(?:{'|'.join(options)})"
    return body + ("?" if "" in words else "")


def contains_any(text: Column, words: Iterable[str], ignore_case: bool = False) -> Column:
    """True where one of ``words`` occurs in ``text``."""
    words = list(words)
    if len(words) > 3 or ignore_case:
        shortest = [w for w in words if not any(o != w and o in w for o in words)]
        return text.rlike(("(?i)" if ignore_case else "") + one_of(shortest))
    return any_of(F.contains(text, F.lit(w)) for w in words)


def first_of(text: Column, words: Iterable[str]) -> Column:
    """The first of ``words``, in their given order, that occurs in ``text``; null if none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words])


def all_of(text: Column, words: Iterable[str]) -> Column:
    """Array of those ``words`` that occur in ``text``, in their given order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def alternation(words: Iterable[str]) -> str:
    return "|".join(re.escape(w).replace(r"\-", "-").replace(r"\ ", " ") for w in words)


def words_in(text: Column) -> Column:
    """All identifier-like words of a text, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0))


def group_or_null(text: Column, pattern: str, group: int) -> Column:
    """A capture group; null (not '') where the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def at_word_starts(pattern: str) -> str:
    """A pattern that begins with ``(\\w+`` and goes on with what is no part of a word, tried at the starts of words only.

    What matches from within a word matches from its start too, so the matches are the same, as long as none ends within a word; but a
    word is read once, not once for each of its characters.
    """
    assert pattern.startswith(r"(\w+")
    return r"(?<!\w)(\w++" + pattern.removeprefix(r"(\w+")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def matches(text: Column, pattern: str, groups: Iterable[int] = (0,)) -> Column:
    """Every match of ``pattern`` in a whole text, with the 1-based line it starts on.

    Array of ``struct(line INT, stop INT, g0 STRING, g<i> STRING ...)``; ``stop`` is the number of
    characters up to the end of the match. The text between two matches is what ``split`` leaves,
    so both are running counts over the gaps and matches before. A text without a match is read once.
    """
    names = ["g0", *[f"g{g}" for g in groups if g]]
    none = F.array().cast(f"array<struct<line:int,stop:int,{','.join(f'{n}:string' for n in names)}>>")

    def rows(whole: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        pairs = F.zip_with(gaps, whole, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
        parts = [let(pairs, _places).alias("at"), whole.alias("g0")]
        parts += [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups if g]
        return F.transform(
            F.arrays_zip(*parts),
            lambda m: F.struct(m["at"]["line"].alias("line"), m["at"]["stop"].alias("stop"), *[m[n].alias(n) for n in names]),
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda whole: F.when(F.size(whole) == 0, none).otherwise(rows(whole)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it.

    A chain of plain columns would be copied into every mention when a filter is pushed below it.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


RUN = 256


def _places(pairs: Column) -> Column:
    """Line and end of each match. An array is copied when something is appended, so counts run inside
    short runs of matches first and then over the runs."""
    place = "array<struct<line:int,stop:int>>"

    def counted(part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("line"), F.lit(0).alias("stop"), F.array().cast(place).alias("out")),
            lambda acc, p: let(
                F.struct(
                    (acc["line"] + newlines(p["gap"])).alias("line"),
                    (acc["stop"] + F.length(p["gap"]) + F.length(p["hit"])).alias("stop"),
                ),
                lambda here: F.struct(
                    (here["line"] + newlines(p["hit"])).alias("line"),
                    here["stop"].alias("stop"),
                    F.array_append(acc["out"], here).alias("out"),
                ),
            ),
        )

    def joined(runs: Column) -> Column:
        starts = F.aggregate(
            runs,
            F.struct(F.lit(1).alias("line"), F.lit(0).alias("stop"), F.array().cast(place).alias("out")),
            lambda acc, r: F.struct(
                (acc["line"] + r["line"]).alias("line"),
                (acc["stop"] + r["stop"]).alias("stop"),
                F.array_append(acc["out"], F.struct(acc["line"].alias("line"), acc["stop"].alias("stop"))).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        moved = F.zip_with(
            runs,
            starts,
            lambda r, start: F.transform(
                r["out"],
                lambda x: F.struct((x["line"] + start["line"]).alias("line"), (x["stop"] + start["stop"]).alias("stop")),
            ),
        )
        return F.flatten(moved)

    count = F.ceil(F.size(pairs) / RUN).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return let(F.transform(numbers, lambda i: counted(F.slice(pairs, i * RUN + 1, F.lit(RUN)))), joined)


def running(values: Column) -> Column:
    """Running sums of an array of whole numbers. As for places, runs are summed first and then moved by the sums before them."""

    def summed(part: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(part, none, lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))

    def joined(runs: Column) -> Column:
        ends = summed(F.transform(runs, lambda r: F.element_at(r, -1)))
        return let(ends, lambda e: F.flatten(F.transform(runs, lambda r, i: F.transform(r, lambda x: x + F.coalesce(F.get(e, i - 1), F.lit(0))))))

    count = F.ceil(F.size(values) / RUN).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return let(F.transform(numbers, lambda i: summed(F.slice(values, i * RUN + 1, F.lit(RUN)))), joined)


def first_at_least(ordered: Column, value: Column) -> Column:
    """Number of entries of a sorted array that are below ``value``: the place, from 0, of the first that is not. By halving."""
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(ordered, middle) < value
        return F.when(s["lo"] >= s["hi"], s).when(below, span(middle + 1, s["hi"])).otherwise(span(s["lo"], middle))

    rounds = F.length(F.bin(F.size(ordered).cast("long")))
    return F.aggregate(F.sequence(F.lit(1), rounds), span(F.lit(0), F.size(ordered)), halve, lambda s: s["lo"])


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty string."""
    size = F.greatest(F.length(value), F.lit(1)).cast("double")

    def add(total: Column, ch: Column) -> Column:
        p = (F.length(value) - F.length(F.replace(value, ch, F.lit("")))).cast("double") / size
        return total - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))

    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(
        F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), add)
    )


def mask_secret(value: Column) -> Column:
    n = F.length(value)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(value, 1, 4), F.repeat(F.lit("*"), n - 8), F.right(value, F.lit(4)))
    )
