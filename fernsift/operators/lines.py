"""Sources to lines, and the text shapes that findings use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsift.functions import text as T

# Words that make a line uninteresting, in any case.
NOISE_WORDS = [
    "www.w3.org", "xmlns", "reactjs.org", "mozilla.org", "facebook.com",
    "cdn.jsdelivr", "unpkg.com", "cdnjs.cloudflare", "googleapis.com",
    ".png", ".svg", ".jpg", ".gif", ".ico", ".woff", ".woff2", ".ttf",
    "node_modules", "webpack", "babel", "sourceMappingURL", "sourceURL",
    "license", "@license", "Copyright", "MIT License", "BSD License",
]

UNIVERSAL_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def explode_lines(sources: DataFrame, mode: str = "newline") -> DataFrame:
    """``sources(file, text)`` to ``lines(file, line, text)``, lines counted from 1.

    ``universal`` also breaks at the other line separators and drops an empty last line.
    """
    if mode == "newline":
        parts = F.split("text", "\n", -1)
    else:
        without_last = lambda raw: F.when(F.element_at(raw, -1) == "", F.slice(raw, F.lit(1), F.size(raw) - 1)).otherwise(raw)
        parts = T.let(F.split("text", UNIVERSAL_BREAK, -1), without_last)
    return sources.select("file", F.posexplode(parts).alias("_pos", "text")).select(
        "file", (F.col("_pos") + 1).alias("line"), "text"
    )


def is_eligible(line: Column, noise=NOISE_WORDS, max_length: int | None = None) -> Column:
    """Lines worth a scan; a longest length only where a caller sets one, as minified files are one line."""
    bare = T.strip(line)
    return (
        (F.lit(True) if max_length is None else F.length(line) <= max_length)
        & (bare != "")
        & ~T.any_of(bare.startswith(p) for p in ("//", "/*", "*", "#"))
        & ~T.contains_any(line, noise, ignore_case=True)
    )


def eligible_lines(lines: DataFrame, noise=NOISE_WORDS, max_length: int | None = None) -> DataFrame:
    return lines.filter(is_eligible(F.col("text"), noise, max_length))


def is_code(line: Column) -> Column:
    bare = T.strip(line)
    return ~(bare.startswith("//") | bare.startswith("/*"))


def code_lines(lines: DataFrame) -> DataFrame:
    """All lines but those that start a comment."""
    return lines.filter(is_code(F.col("text")))


def mask_match(matched: Column, evidence: Column) -> Column:
    """Evidence for a credential hit: both ends of the match, then the line."""
    short = F.concat(
        F.lit("\U0001f510 "), F.substring(matched, 1, 8), F.lit("..."), F.right(matched, F.lit(4)),
        F.lit(" | "), evidence,
    )
    return F.when(F.length(matched) > 15, short).otherwise(evidence)


def evidence_flags(severity: Column, user_input: Column, sanitized: Column, evidence: Column) -> Column:
    flags = F.array_compact(
        F.array(
            F.when(user_input, F.lit("USER_INPUT")),
            F.when(~sanitized, F.lit("NO_SANITIZE")),
        )
    )
    marked = F.concat(F.lit("["), F.array_join(flags, ", "), F.lit("] "), evidence)
    return F.when(severity.isin("CRITICAL", "HIGH") & (F.size(flags) > 0), marked).otherwise(evidence)


def format_evidence(findings: DataFrame, limit: int | None = None, path_steps: int | None = None) -> DataFrame:
    """The stored evidence text: confidence, evidence, flow, path, CWE; whole, unless a length or number of steps is given."""
    steps = F.col("path") if path_steps is None else F.slice("path", 1, path_steps)
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    flow = F.concat(filled("source"), F.lit(" → "), filled("sink"))
    path = F.when(
        F.size(F.coalesce("path", F.array().cast("array<string>"))) > 0,
        F.concat(F.lit("Path: "), F.array_join(steps, " → ")),
    )
    head = F.concat(F.lit("["), F.col("confidence"), F.lit("] "), F.col("evidence"))
    return findings.withColumn(
        "evidence", T.shown(F.concat_ws(" | ", head, flow, path, filled("cwe")), limit)
    )
