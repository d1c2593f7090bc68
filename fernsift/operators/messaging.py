"""Cross-window messages: handlers, their checks, and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsift.functions import text as T

# What handlers and calls look like, and what is wrong with them.
HANDLER_PATTERNS = [
    r"addEventListener\s*\(\s*['\"]message['\"]",
    r"onmessage\s*=",
    r"window\.onmessage\s*=",
]
CALL_PATTERN = r"(\w+(?:\.\w+)?)\.postMessage\s*\(\s*([^,]+),\s*([^)]+)\)"
DANGEROUS_USES = {
    r"eval\s*\(\s*(?:e|event|msg)\.data": "eval() with message data",
    r"innerHTML\s*=\s*(?:e|event|msg)\.data": "innerHTML with message data",
    r"document\.write\s*\(\s*(?:e|event|msg)\.data": "document.write with message data",
    r"location\s*=\s*(?:e|event|msg)\.data": "location redirect with message data",
    r"Function\s*\(\s*(?:e|event|msg)\.data": "Function() with message data",
}
SENSITIVE_WORDS = ["token", "password", "secret", "key", "auth", "session", "cookie"]
ADVICE = {
    "NO_ORIGIN_CHECK": "Always verify event.origin against a whitelist of trusted origins",
    "WILDCARD_ORIGIN": "Replace '*' with specific trusted origin(s)",
    "NO_SOURCE_CHECK": "Consider verifying event.source for additional security",
    "DANGEROUS_DATA_HANDLING": "Sanitize message data before use in sensitive operations",
    "WILDCARD_TARGET_ORIGIN": "Specify exact target origin instead of '*'",
    "DYNAMIC_TARGET_ORIGIN": "Ensure target origin is validated and not user-controlled",
}


_DEPTH = 1 << 32  # a closing brace is ordered by depth, then by place


def _braces(text: Column) -> Column:
    """The braces of a text: ``pieces`` (the text up to and with each), where each ends (``at``), how deep it is after each (``depth``), which
    open (``opens``, by number), and all that close, by depth and number (``closes``)."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^{}]*+[{}]"), F.lit(0))

    def arrays(p: Column) -> Column:
        turns = F.transform(p, lambda x: F.when(F.endswith(x, F.lit("{")), 1).otherwise(-1))
        return T.let(
            F.struct(p.alias("pieces"), T.running(F.transform(p, F.length)).alias("at"), T.running(turns).alias("depth"), turns.alias("turns")),
            lambda b: F.struct(
                b["pieces"].alias("pieces"),
                b["at"].alias("at"),
                b["depth"].alias("depth"),
                _numbers(b["turns"], 1).alias("opens"),
                F.sort_array(
                    F.transform(_numbers(b["turns"], -1), lambda i: F.get(b["depth"], i).cast("long") * _DEPTH + i)
                ).alias("closes"),
            ),
        )

    return T.let(pieces, arrays)


def _numbers(turns: Column, of: int) -> Column:
    return F.filter(F.transform(turns, lambda x, i: F.when(x == of, i)), lambda i: i.isNotNull())


def _body(braces: Column, start: Column, reach: int | None) -> Column:
    """The text behind ``start`` characters up to the brace that closes the first one opened there; '' if none closes.

    That is the first closing brace behind it after which it is as deep as at ``start``.
    """

    def to_close(first: Column) -> Column:
        depth = F.coalesce(F.get(braces["depth"], first - 1), F.lit(0)).cast("long")
        opened = F.get(braces["opens"], T.first_at_least(braces["opens"], first))
        wanted = F.get(braces["closes"], T.first_at_least(braces["closes"], depth * _DEPTH + opened))
        last = F.when(opened.isNotNull() & (F.floor(wanted / _DEPTH) == depth), F.pmod(wanted, F.lit(_DEPTH)).cast("int"))
        begun = start - F.coalesce(F.get(braces["at"], first - 1), F.lit(0))

        def joined(end: Column) -> Column:
            piece = F.get(braces["pieces"], first)
            whole = F.concat(
                F.substring(piece, begun + 1, F.length(piece)), F.array_join(F.slice(braces["pieces"], first + 2, end - first), "")
            )
            within = F.lit(True) if reach is None else F.get(braces["at"], end) <= start + reach
            return F.when(end.isNotNull() & within, whole).otherwise("")

        return T.let(last, joined)

    return T.let(T.first_at_least(braces["at"], start + 1), to_close)


def postmessage_handlers(sources: DataFrame, reach: int | None = None) -> DataFrame:
    """Message handlers with their body, however long: (file, line, pattern, body).

    The braces of a text are read once, for all of its handlers. The second and third pattern overlap, so a ``window.onmessage`` handler
    is found twice.
    """
    text = F.col("text")

    def hit(number: int):
        return lambda m: F.struct(m["line"].alias("line"), m["stop"].alias("stop"), F.lit(number).alias("pattern"))

    parts = [F.transform(T.matches(text, pattern), hit(number)) for number, pattern in enumerate(HANDLER_PATTERNS)]

    def rows(hits: Column) -> Column:
        return T.let(
            _braces(text),
            lambda b: F.transform(hits, lambda m: F.struct(m["line"].alias("line"), m["pattern"].alias("pattern"), _body(b, m["stop"], reach).alias("body"))),
        )

    found = T.let(F.concat(*parts), lambda hits: F.when(F.size(hits) > 0, rows(hits)))
    return sources.select("file", F.explode_outer(found).alias("_m")).filter(F.col("_m").isNotNull()).select("file", "_m.*")


def check_handlers(handlers: DataFrame) -> DataFrame:
    """What each handler fails to check: (file, line, type, severity, evidence, recommendation)."""
    body = F.col("body")
    has = lambda *words: T.any_of(F.contains(body, F.lit(w)) for w in words)
    origin_checked = (
        (has("origin") & has("===", "==", "includes"))
        | (has(".origin") & has("if"))
        | has("event.origin", "e.origin")
    )
    source_checked = has("source") & has("===", "==")

    def issue(when: Column, kind: str, severity: str, evidence: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
                evidence.alias("evidence"), F.lit(ADVICE[kind]).alias("recommendation"),
            ),
        )

    unverified = F.format_string("Message handler at line %d does not verify event.origin", "line")
    issues = [
        issue(~origin_checked, "NO_ORIGIN_CHECK", "CRITICAL", unverified),
        issue(
            body.rlike(r"origin\s*===?\s*['\"]?\*['\"]?"), "WILDCARD_ORIGIN", "CRITICAL",
            F.lit("Message handler accepts messages from any origin (*)"),
        ),
        issue(
            ~source_checked & ~origin_checked, "NO_SOURCE_CHECK", "HIGH",
            F.lit("Message handler does not verify event.source"),
        ),
    ]
    issues += [
        issue(
            body.rlike(pattern), "DANGEROUS_DATA_HANDLING", "CRITICAL",
            F.lit(f"Message data used in dangerous sink: {use}"),
        )
        for pattern, use in DANGEROUS_USES.items()
    ]
    return handlers.select(
        "file", "line", F.explode(F.array_compact(F.array(*issues))).alias("_i")
    ).select("file", "line", "_i.*")


def postmessage_calls(sources: DataFrame) -> DataFrame:
    """Calls that send a message: (file, line, target, data, origin)."""
    text = F.col("text")
    pattern = T.at_word_starts(CALL_PATTERN)
    hits = F.when(text.contains(".postMessage"), T.matches(text, pattern))
    found = sources.select("file", F.explode_outer(hits).alias("_m")).filter(F.col("_m").isNotNull())
    part = lambda group: F.regexp_extract(F.col("_m.g0"), pattern, group)
    return found.select(
        "file",
        "_m.line",
        part(1).alias("target"),
        T.strip(part(2)).alias("data"),
        T.strip(part(3)).alias("origin"),
    )


def check_calls(calls: DataFrame) -> DataFrame:
    origin = F.col("origin")
    wildcard = F.btrim(origin, F.lit("'\"")) == "*"
    sensitive = T.contains_any(F.col("data"), SENSITIVE_WORDS, ignore_case=True)
    literal = T.any_of(origin.startswith(q) for q in ("'", '"', "`"))
    base = "postMessage uses '*' as target origin"

    def issue(when: Column, kind: str, severity: Column, evidence: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(kind).alias("type"), severity.alias("severity"), evidence.alias("evidence"),
                F.lit(ADVICE[kind]).alias("recommendation"),
            ),
        )

    issues = F.array(
        issue(
            wildcard, "WILDCARD_TARGET_ORIGIN",
            F.when(sensitive, F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
            F.when(sensitive, F.lit(base + " with sensitive data")).otherwise(F.lit(base)),
        ),
        issue(
            ~literal, "DYNAMIC_TARGET_ORIGIN", F.lit("MEDIUM"),
            F.concat(F.lit("postMessage target origin is dynamic: "), origin),
        ),
    )
    return calls.select("file", "line", F.explode(F.array_compact(issues)).alias("_i")).select(
        "file", "line", "_i.*"
    )


def postmessage_findings(sources: DataFrame) -> DataFrame:
    return check_handlers(postmessage_handlers(sources)).unionByName(
        check_calls(postmessage_calls(sources))
    )
