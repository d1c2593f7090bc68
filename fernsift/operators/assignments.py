"""Assignments, functions and calls of a source, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsift.functions import text as T
from fernsift.functions.frames import BLOCK, running_sum
from fernsift.operators.lines import is_code

# The statement shapes, matched against lines without outer white space.
DECLARATION = r"(?d)^(?:const|let|var)\s+(\w+)\s*=\s*(.+?)(?:;|$)"
ASSIGNMENT = r"(?d)^(\w+)\s*=\s*(.+?)(?:;|$)"
DESTRUCTURING = r"^(?:const|let|var)\s*\{([^}]+)\}\s*=\s*(\w+(?:\.\w+)*)"
FUNCTION = r"^(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)"
ARROW = r"^(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>"
CALL = r"(\w+)\s*\(([^)]*)\)"
NOT_CALLS = ["if", "while", "for", "switch", "catch", "function"]
STATEMENT_STARTS = r"^(?:const|let|var|function)"


def _row(kind: str, name: Column, prop: Column, rhs: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), prop.alias("prop"), rhs.alias("rhs")
    )


def extract_assignments(lines: DataFrame) -> DataFrame:
    """(file, line, kind, name, prop, rhs), one row per assigned name.

    ``kind`` is declare, assign or destructure; ``{a: b} = src`` gives name b, prop a, rhs src.a.
    """
    bare = F.col("_bare")
    none = F.lit(None).cast("string")

    def single(kind: str, pattern: str, allowed: Column | None = None) -> Column:
        row = _row(kind, F.regexp_extract(bare, pattern, 1), none, F.regexp_extract(bare, pattern, 2))
        test = bare.rlike(pattern)
        return F.when(test if allowed is None else test & allowed, row)

    inside, source = (F.regexp_extract(bare, DESTRUCTURING, g) for g in (1, 2))
    pairs = F.arrays_zip(
        F.regexp_extract_all(inside, F.lit(r"(\w+)(?:\s*:\s*(\w+))?"), F.lit(1)).alias("prop"),
        F.regexp_extract_all(inside, F.lit(r"(\w+)(?:\s*:\s*(\w+))?"), F.lit(2)).alias("alias"),
    )
    taken = F.transform(
        pairs,
        lambda p: _row(
            "destructure",
            F.when(p["alias"] == "", p["prop"]).otherwise(p["alias"]),
            p["prop"],
            F.concat(source, F.lit("."), p["prop"]),
        ),
    )
    singles = F.array_compact(
        F.array(
            single("declare", DECLARATION),
            single("assign", ASSIGNMENT, ~bare.rlike(STATEMENT_STARTS)),
        )
    )
    rows = F.concat(singles, F.when(bare.rlike(DESTRUCTURING), taken).otherwise(F.array()))
    return (
        lines.filter(is_code(F.col("text")) & F.col("text").contains("="))
        .select("file", "line", T.strip(F.col("text")).alias("_bare"))
        .select("file", "line", F.explode_outer(rows).alias("_a"))
        .filter(F.col("_a").isNotNull())
        .select("file", "line", "_a.*")
    )


def parameters(inside: Column) -> Column:
    return F.filter(F.transform(F.split(inside, ","), lambda p: T.strip(p)), lambda p: p != "")


def is_function_line(line: Column) -> Column:
    return is_code(line) & T.strip(line).rlike(FUNCTION)


def extract_functions(lines: DataFrame) -> DataFrame:
    """(file, line, name, kind, params) of functions and of arrow functions that are given a name."""
    bare = T.strip(F.col("text"))
    arms = [("function", FUNCTION), ("arrow", ARROW)]
    found = F.coalesce(
        *[
            F.when(
                bare.rlike(pattern),
                F.struct(
                    F.regexp_extract(bare, pattern, 1).alias("name"),
                    F.lit(kind).alias("kind"),
                    parameters(F.regexp_extract(bare, pattern, 2)).alias("params"),
                ),
            )
            for kind, pattern in arms
        ]
    )
    return (
        lines.filter(is_code(F.col("text")))
        .select("file", "line", found.alias("_f"))
        .filter(F.col("_f").isNotNull())
        .select("file", "line", "_f.*")
    )


def function_params(functions: DataFrame) -> DataFrame:
    return functions.select(
        "file", "line", "name", "kind", F.posexplode("params").alias("position", "param")
    )


def assign_scopes(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, line, scope_ord): how many function lines there are up to each line.

    A scope is entered at a function line and never left.
    """
    marked = lines.select("file", "line", is_function_line(F.col("text")).cast("int").alias("_f"))
    return running_sum(marked, ["file"], "line", F.col("_f"), "scope_ord", block).select(
        "file", "line", "scope_ord"
    )


def extract_calls(sources: DataFrame) -> DataFrame:
    """(file, nth, name, args) of the calls in a text, in text order; calls may span lines."""
    text, pattern = F.col("text"), F.lit(T.at_word_starts(CALL))
    calls = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("name"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("inside"),
    )
    return (
        sources.select("file", F.posexplode(calls).alias("nth", "_c"))
        .filter(~F.col("_c.name").isin(NOT_CALLS))
        .select("file", "nth", "_c.name", parameters(F.col("_c.inside")).alias("args"))
    )
