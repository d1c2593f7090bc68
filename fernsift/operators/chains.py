"""Steps that follow each other over a few lines, matched without going back.

A chain is a pattern of steps with ``[^\\n]*`` between them. What a line does to a chain is a small function from the steps made before
the line to the steps made after it, and the lines of a window are one after the other applied to "no step made". A line's function
is computed from its text by taking the earliest next place of each step, so time is in proportion to the text, and only
functions, a few numbers a line, are shuffled.

One step may repeat the value assigned before: S, ``=\\s*(\\w+)``, ``\\1``, Z. As any first part of the assigned word may be
repeated, its first character decides. A line then holds sets of characters as bits: those assigned, those that occur, and those
that occur before the last Z.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernsift.functions import text as T

GAP = r"[^\n]*"
ECHO = (r"=\s*(\w+)", r"\1")
FLAGS = "(?isd)"
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789_"
_BITS = 4  # a number of steps


def steps_of(pattern: str) -> list[str]:
    """The steps of a chain; each has to be a pattern of its own."""
    steps = pattern.split(GAP)
    if is_echo(steps):
        if re.escape(steps[3]) != steps[3]:
            raise ValueError(f"the last step of {pattern!r} has to be plain text")
        return steps
    for step in steps:
        if re.search(r"\\[1-9]", step):
            raise ValueError(f"{pattern!r} refers back in a way that is not supported")
        re.compile(step)
    if len(steps) >= 1 << _BITS:
        raise ValueError(f"{pattern!r} has too many steps")
    return steps


def is_echo(steps: list[str]) -> bool:
    return len(steps) == 4 and tuple(steps[1:3]) == ECHO


def advances(text: Column, steps: list[str]) -> Column:
    """For every number of steps made before the line the number made after it, in bits; null if the line has no step.

    Each step is looked for behind the one before, and its first place is kept (``(?>...)``), so a text is gone through once.
    """
    some = text.rlike(FLAGS + "(?:" + "|".join(steps) + ")")
    code = F.lit(0)
    for made in range(len(steps)):
        way, after = FLAGS + r"\A", F.lit(made)
        for step in steps[made:]:
            way += f"(?>.*?(?:{step}))"
            after = after + text.rlike(way).cast("int")
        code = code + F.shiftleft(after, _BITS * made)
    return F.when(some, code + (len(steps) << _BITS * len(steps)))


def completes(codes: Column, steps: list[str]) -> Column:
    """Whether the lines of a window, as codes in order, make all steps."""
    end = F.aggregate(codes, F.lit(0), lambda made, code: _digit(code, made).cast("int"))
    return end == len(steps)


def ends_made(code: Column, steps: list[str]) -> Column:
    """Bit 0: the line has the first step; bit 1: it has the last. Lines that make a chain have both between them."""
    last = _digit(code, F.lit(len(steps) - 1)) == len(steps)
    made = F.when(_digit(code, F.lit(0)) > 0, 1).otherwise(0).cast("long")
    return F.coalesce(made.bitwiseOR(F.when(last, 2).otherwise(0).cast("long")), F.lit(0).cast("long"))


def _digit(code: Column, place: Column) -> Column:
    return F.call_function("shiftright", code, place * _BITS).bitwiseAND((1 << _BITS) - 1)


def folded(text: Column) -> Column:
    """A-Z in lower case, as far as patterns without regard to case go."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _occurring(low: Column) -> Column:
    bits = [F.when(F.contains(low, F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(LETTERS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _bit(c: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.instr(F.lit(LETTERS), c) - 1)


def _assigned(low: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"=\s*+(\w)"), F.lit(1)))


def _repeated(low: Column) -> Column:
    """Whether the first character of an assigned word comes again behind it."""
    return F.exists(_assigned(low), lambda c: F.rlike(low, F.concat(F.lit(r"(?s)=\s*+"), c, F.lit(".*"), c)))


def _before_last(low: Column, word: str) -> Column:
    """What stands before the last ``word``; '' if there is none."""
    behind = F.substring_index(low, word, -1)
    return F.when(F.contains(low, F.lit(word)), F.substring(low, F.lit(1), F.length(low) - F.length(behind) - len(word))).otherwise("")


_FACTS = "struct<starts:boolean,ends:boolean,all:bigint,head:bigint,lead:bigint,lead_again:boolean,lead_ends:boolean,a:{0},b:{0}>".format(
    "struct<set:bigint,again:boolean,ends:boolean,open:boolean>"
)


def echo_facts(text: Column, steps: list[str]) -> Column:
    """What a line means for a chain that repeats an assigned value: behind its first source (``a``), and as a whole (``b``)."""
    start, end = steps[0], steps[3].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    def part(low: Column) -> Column:
        assigns = F.contains(low, F.lit("="))
        sets = F.aggregate(_assigned(low), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(_bit(c)))
        return F.struct(
            F.when(assigns, sets).otherwise(F.lit(0).cast("long")).alias("set"),
            (assigns & _repeated(low)).alias("again"),
            (assigns & F.contains(low, F.lit(end)) & _repeated(_before_last(low, end))).alias("ends"),
            (assigns & T.strip(low).endswith("=")).alias("open"),
        )

    def facts(low: Column) -> Column:
        bare = F.ltrim(low, F.lit(T.WHITESPACE))
        first, rest = F.substring(bare, 1, 1), F.substring(bare, F.lit(2), F.length(bare))
        leads = first.rlike(r"\A\w")
        starts = low.rlike(FLAGS + start)
        head = _before_last(bare, end)
        return F.struct(
            starts.alias("starts"),
            F.contains(low, F.lit(end)).alias("ends"),
            _occurring(low).alias("all"),
            F.when(F.contains(low, F.lit(end)), _occurring(_before_last(low, end))).otherwise(F.lit(0).cast("long")).alias("head"),
            F.when(leads, _bit(first)).otherwise(F.lit(0).cast("long")).alias("lead"),
            (leads & F.contains(rest, first)).alias("lead_again"),
            (leads & F.contains(F.substring(head, F.lit(2), F.length(head)), first)).alias("lead_ends"),
            F.when(starts, part(F.regexp_extract(low, FLAGS + rf"\A(?>.*?(?:{start}))(.*)\z", 1))).alias("a"),
            part(low).alias("b"),
        )

    return T.let(folded(text), facts).cast(_FACTS)


def echoes(facts: Column) -> Column:
    """Whether the lines of a window, as facts in order, make the whole chain.

    The state is how far it has come (0: no source yet, 1: values are being assigned, 2: one has come again, 3: the whole chain), the
    first characters of assigned words, and whether the last line ended inside an assignment.
    """
    state = lambda at, held, open_: F.struct(at.cast("int").alias("at"), held.alias("set"), open_.alias("open"))
    none = F.lit(0).cast("long")

    def step(s: Column, f: Column) -> Column:
        def after(part: Column, whole: Column, again: Column, held: Column) -> Column:
            at = F.when(whole | part["ends"], 3).when(again | part["again"], 2).otherwise(1)
            return state(at, held.bitwiseOR(part["set"]), part["open"])

        meets = lambda mask: s["set"].bitwiseAND(mask) != 0
        from_start = after(f["a"], F.lit(False), F.lit(False), none)
        from_assigned = after(
            f["b"], meets(f["head"]) | (s["open"] & f["lead_ends"]), meets(f["all"]) | (s["open"] & f["lead_again"]),
            s["set"].bitwiseOR(F.when(s["open"], f["lead"]).otherwise(none)),
        )
        return (
            F.when((s["at"] == 0) & f["starts"], from_start)
            .when(s["at"] == 1, from_assigned)
            .when((s["at"] == 2) & f["ends"], state(F.lit(3), none, F.lit(False)))
            .otherwise(s)
        )

    end = F.aggregate(facts, state(F.lit(0), none, F.lit(False)), step)
    return end["at"] == 3
