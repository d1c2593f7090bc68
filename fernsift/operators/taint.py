"""Untrusted values followed through declarations, assignments and calls into dangerous places.

Everything is a join over edge tables keyed by (file, name). The reading order of a file matters
for which source a name is credited with, so edges carry line numbers and the fixpoints compute the
earliest moment a name becomes tainted; see ``functions.fixpoint``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsift.functions import text as T
from fernsift.functions.fixpoint import ROUND, in_rounds, increasing, pin, roots, smallest_labels, unchanged
from fernsift.functions.frames import BLOCK, last_before, running_sum
from fernsift.operators.assignments import (
    extract_assignments,
    extract_calls,
    extract_functions,
    function_params,
)
from fernsift.operators.lines import explode_lines

# Where untrusted values come from, what cleans them, where they do harm.
TAINT_SOURCES = [
    "location.search", "location.hash", "location.href", "location.pathname",
    "document.URL", "document.documentURI", "document.referrer", "document.cookie",
    "window.name", "window.location",
    "localStorage", "sessionStorage",
    "URLSearchParams", "searchParams",
    "req.body", "req.params", "req.query", "req.headers", "req.cookies",
    "request.body", "request.params", "request.query",
    "event.data", "e.data", "message.data",
    "props", "params", "query", "state",
    "useRouter", "useParams", "useSearchParams", "useLocation",
    "$route.params", "$route.query",
    "fetch", "axios", "XMLHttpRequest",
]
SANITIZERS = [
    "encodeURI", "encodeURIComponent",
    "escape", "escapeHtml", "escapeHTML", "htmlEscape",
    "sanitize", "sanitizeHtml", "DOMPurify.sanitize",
    "parseInt", "parseFloat", "Number", "Boolean",
    "textContent", "innerText", "createTextNode",
    "validator.escape", "xss",
]
SINKS = [
    "innerHTML", "outerHTML", "insertAdjacentHTML",
    "document.write", "document.writeln",
    "eval", "Function", "setTimeout", "setInterval",
    "location", "location.href", "location.assign", "location.replace",
    "dangerouslySetInnerHTML", "v-html",
    "exec", "execSync", "spawn", "query", "raw",
]


def _no_steps() -> Column:
    return F.array().cast("array<string>")


@dataclass
class Taint:
    """Result of :func:`analyze`.

    ``symbols``: (file, scope_ord, name, state, source, source_line, steps, visible);
    ``flows``: (file, sink, sink_line, source, source_line, variable, steps, evidence, text, uses).
    """

    symbols: DataFrame
    flows: DataFrame


def seed_taint(lines: DataFrame, sources=TAINT_SOURCES) -> DataFrame:
    """Declared names whose value contains a source word: (file, line, name, source)."""
    found = extract_assignments(lines).filter(F.col("kind") != "assign")
    return (
        definitions_of(found, sources)
        .filter(F.col("source").isNotNull())
        .select("file", "line", "name", "source")
    )


def definitions_of(assignments: DataFrame, sources=TAINT_SOURCES, sanitizers=SANITIZERS) -> DataFrame:
    """Declarations as definitions of names, with their own source word, if any.

    A destructuring declaration defines the property names, with ``<value>.<property>`` as source.
    """
    taken = F.col("kind") == "destructure"
    value = F.when(taken, F.regexp_extract("rhs", r"^(.*)\.\w+$", 1)).otherwise(F.col("rhs"))
    word = T.first_of(value, sources)
    return assignments.filter(F.col("kind") != "assign").select(
        "file",
        "line",
        F.when(taken, F.col("prop")).otherwise(F.col("name")).alias("name"),
        F.when(~taken, F.col("rhs")).alias("rhs"),
        F.when(taken & word.isNotNull(), F.col("rhs")).otherwise(word).alias("source"),
        F.coalesce(~taken & T.contains_any(value, sanitizers), F.lit(False)).alias("sanitizes"),
    )


def _references(rows: DataFrame) -> DataFrame:
    """Distinct words of ``rhs`` with their first and last position: adds (ref, first, last).

    One row per word and position, so a long line costs what it is long.
    """
    keys = ["file", "line", "name", "sanitizes", "source"]
    placed = rows.filter(F.col("rhs").isNotNull()).select(*keys, F.posexplode(T.words_in(F.col("rhs"))).alias("_at", "ref"))
    at = (F.col("_at") + 1).cast("long")
    return placed.groupBy(*keys, "ref").agg(F.min(at).alias("first"), F.max(at).alias("last"))


def _resolve(definitions: DataFrame, references: DataFrame, block: int) -> DataFrame:
    """Adds ``at``: the line of the latest definition of ``ref`` before the line; unresolved drop."""
    known = definitions.select(
        "file", F.col("name").alias("ref"), "line", F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("boolean").alias("sanitizes"), F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"),
    )
    asked = references.select(
        "file", "ref", "line", "name", "sanitizes", "source",
        F.col("first").cast("long"), F.col("last").cast("long"),
    )
    own = F.when(F.col("name").isNull(), F.col("line"))
    resolved = last_before(
        known.unionByName(asked), ["file", "ref"], "line", own, "at", block=block
    )
    return resolved.filter(F.col("name").isNotNull() & F.col("at").isNotNull())


def _self_washed(references: DataFrame) -> DataFrame:
    """Definitions from a source word and their own name through a sanitizer: clean."""
    own = F.col("sanitizes") & F.col("source").isNotNull() & (F.col("ref") == F.col("name"))
    return references.filter(own).select("file", "line", "name").distinct()


def _declared(definitions: DataFrame, resolved: DataFrame, references: DataFrame) -> DataFrame:
    """Definitions that are tainted: (file, line, name).

    A definition with a source word, a sanitizer and a tainted reference is clean. That is the one
    rule in which more taint elsewhere means less taint here, so the reachability is
    repeated until the set of such definitions is stable; references only go back in a file, so it is.
    """
    node = ["file", "line", "name"]
    seeds = definitions.filter(F.col("source").isNotNull())
    washed = seeds.filter("sanitizes").select(*node)
    self_washed = _self_washed(references)
    edges = resolved.filter((F.col("ref") != F.col("name")) & ~F.col("sanitizes")).select(
        F.col("file").alias("from_file"), F.col("at").alias("from_line"), F.col("ref").alias("from_name"),
        F.col("file").alias("to_file"), F.col("line").alias("to_line"), F.col("name").alias("to_name"),
    )
    back = pin(
        resolved.filter(F.col("ref") != F.col("name")).join(washed, node, "left_semi")
        .select(*node, F.col("at").alias("ref_line"), "ref")
    )
    clean = pin(self_washed)
    while True:
        start = seeds.join(clean, node, "left_anti").select(*node, F.lit(0).alias("label"))
        tainted = smallest_labels(start, edges, node, "label", unchanged()).select(*node)
        if back.isEmpty():
            return tainted
        reached = tainted.select("file", F.col("line").alias("ref_line"), F.col("name").alias("ref"))
        now = pin(
            back.join(reached, ["file", "ref_line", "ref"], "left_semi")
            .select(*node)
            .union(self_washed)
            .distinct()
        )
        changed = now.exceptAll(clean).union(clean.exceptAll(now))
        if changed.isEmpty():
            return tainted
        clean = now


def _credited(definitions: DataFrame, resolved: DataFrame, tainted: DataFrame) -> DataFrame:
    """Tainted definitions with the source they are credited with and the steps from it.

    The last tainted name of a value counts; without one, the value's own source word.
    """
    node = ["file", "line", "name"]
    hit = tainted.select("file", F.col("line").alias("at"), F.col("name").alias("ref"))
    via = (
        resolved.filter((F.col("ref") != F.col("name")) & ~F.col("sanitizes"))
        .join(hit, ["file", "at", "ref"], "left_semi")
        .groupBy(*node)
        .agg(F.max_by(F.struct("at", "ref"), "last").alias("_via"))
    )
    step = F.format_string("from %s at L%d", F.col("_via.ref"), F.col("line"))
    links = (
        definitions.dropDuplicates(node)
        .join(tainted, node, "left_semi")
        .join(via, node, "left")
        .select(
            *node,
            F.col("_via.at").alias("parent_line"),
            F.col("_via.ref").alias("parent_name"),
            "source",
            F.col("line").alias("source_line"),
            F.when(F.col("_via").isNull(), _no_steps()).otherwise(F.array(step)).alias("steps"),
        )
    )
    return roots(links, node, ["source", "source_line"], "steps")


def _sanitized(resolved: DataFrame, references: DataFrame, tainted: DataFrame) -> DataFrame:
    """Definitions with a sanitizer and a tainted reference."""
    hit = tainted.select("file", F.col("line").alias("at"), F.col("name").alias("ref"))
    return (
        resolved.filter("sanitizes")
        .join(hit, ["file", "at", "ref"], "left_semi")
        .select("file", "line", "name")
        .union(_self_washed(references))
        .distinct()
    )


def _assigned(
    plain: DataFrame, visible: DataFrame, max_rounds: int | None
) -> DataFrame:
    """Taint through plain assignments: (file, name, source, source_line, steps) of tainted names.

    Assignments are read in line order, round after round; a name is credited with the first
    tainted name of the assignment that taints it first.
    """
    node = ["file", "name"]
    references = pin(_references(plain).filter(F.col("ref") != F.col("name")))
    edges = references.filter(~F.col("sanitizes")).select(
        F.col("file").alias("from_file"), F.col("ref").alias("from_name"),
        F.col("file").alias("to_file"), F.col("name").alias("to_name"),
        F.col("line").cast("long").alias("at_line"),
    )
    start = visible.filter(F.col("state") == "TAINTED")
    moments = pin(
        smallest_labels(
            start.select(*node, F.lit(ROUND).alias("moment")),
            edges,
            node,
            "moment",
            in_rounds("at_line", max_rounds),
        )
    )
    reached = moments.join(start.select(*node), node, "left_anti").withColumn(
        "line", F.col("moment").bitwiseAND(ROUND - 1).cast("int")
    )
    earlier = moments.select("file", F.col("name").alias("ref"), F.col("moment").alias("ref_moment"))
    via = (
        reached.join(references.filter(~F.col("sanitizes")).select("file", "name", "line", "ref", "first"),
                     ["file", "name", "line"])
        .join(earlier, ["file", "ref"])
        .filter(F.col("ref_moment") < F.col("moment"))
        .groupBy("file", "name", "line")
        .agg(F.min_by("ref", "first").alias("parent_name"))
    )
    links = via.select(
        *node, "parent_name", F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("int").alias("source_line"),
        F.array(F.format_string("from %s at L%d", "parent_name", "line")).alias("steps"),
    ).unionByName(
        start.select(
            *node, F.lit(None).cast("string").alias("parent_name"), "source", "source_line", "steps"
        )
    )
    credited = roots(links, node, ["source", "source_line"], "steps")
    cleaned = (
        references.filter("sanitizes")
        .join(moments.select("file", F.col("name").alias("ref")), ["file", "ref"], "left_semi")
        .select(*node)
        .distinct()
        .join(moments, node, "left_anti")
    )
    state = credited.withColumn("state", F.lit("TAINTED")).unionByName(
        cleaned.withColumns(
            {
                "source": F.lit(None).cast("string"),
                "source_line": F.lit(None).cast("int"),
                "steps": _no_steps(),
                "state": F.lit("SANITIZED"),
            }
        )
    )
    return state


def propagate_calls(
    sources: DataFrame, functions: DataFrame, scopes: DataFrame, symbols: DataFrame, block: int
) -> DataFrame:
    """Taint parameters from call arguments that are exactly a tainted name.

    Calls are read in text order, so a parameter that a call has tainted can taint the next one. A
    parameter is credited with the last call that reached it.
    """
    key = ["file", "scope_ord", "name"]
    last = functions.groupBy("file", "name").agg(
        F.max_by(F.struct("line", "kind", "params"), "line").alias("_f")
    )
    params = function_params(last.select("file", "name", "_f.*")).join(scopes, ["file", "line"])
    # the symbol a parameter name stands for: the one of the latest scope up to the function's own
    asked = params.select(
        "file", F.col("param").alias("_name"), F.col("scope_ord").cast("int"),
        F.struct("name", "position").alias("_ask"),
    )
    have = symbols.select(
        "file", F.col("name").alias("_name"), "scope_ord",
        F.lit(None).cast("struct<name:string,position:int>").alias("_ask"),
    )
    placed = (
        last_before(
            have.unionByName(asked).withColumn("_late", F.col("_ask").isNotNull().cast("int")),
            ["file", "_name"], "scope_ord",
            F.when(F.col("_ask").isNull(), F.col("scope_ord")), "to_scope_ord",
            order=["_late"], block=block,
        )
        .filter(F.col("_ask").isNotNull() & F.col("to_scope_ord").isNotNull())
        .select(
            "file", F.col("_ask.name").alias("function"), F.col("_ask.position").alias("position"),
            "to_scope_ord", F.col("_name").alias("to_name"),
        )
    )
    visible = symbols.filter("visible").select(
        "file", F.col("name").alias("from_name"), F.col("scope_ord").alias("from_scope_ord")
    )
    arguments = extract_calls(sources).select(
        "file", "nth", F.col("name").alias("function"),
        F.posexplode("args").alias("position", "from_name"),
    )
    edges = pin(
        arguments.join(placed, ["file", "function", "position"])
        .join(visible, ["file", "from_name"])
        .filter(
            (F.col("from_name") != F.col("to_name"))
            | (F.col("from_scope_ord") != F.col("to_scope_ord"))
        )
        .select(
            F.col("file").alias("from_file"), "from_scope_ord", "from_name",
            F.col("file").alias("to_file"), "to_scope_ord", "to_name",
            (F.col("nth").cast("long") * 65536 + F.col("position")).alias("at"),
        )
    )
    start = symbols.filter(F.col("state") == "TAINTED")
    moments = pin(
        smallest_labels(
            start.select(*key, F.lit(-1).cast("long").alias("moment")),
            edges,
            key,
            "moment",
            increasing("at"),
        )
    )
    # every call that hands over a tainted value, linked to the one that last tainted its argument
    tainted_from = moments.select(*[F.col(c).alias(f"from_{c}") for c in key], "moment")
    events = pin(
        edges.join(tainted_from, [f"from_{c}" for c in key])
        .filter(F.col("at") > F.col("moment"))
        .drop("moment")
    )
    targets = events.select(
        *[F.col(f"to_{c}").alias(f"_{c}") for c in key], "at", F.lit(None).cast("long").alias("_event"),
    )
    handed = events.select(
        *[F.col(f"from_{c}").alias(f"_{c}") for c in key], "at", F.col("at").alias("_event"),
    )
    before = (
        last_before(
            targets.unionByName(handed), [f"_{c}" for c in key], "at",
            F.when(F.col("_event").isNull(), F.col("at")), "parent_at", block=1 << 30,
        )
        .filter(F.col("_event").isNotNull())
        .select(F.col("_file").alias("from_file"), F.col("_event").alias("at"), "parent_at")
    )
    own = start.select(
        *[F.col(c).alias(f"from_{c}") for c in key], "source", "source_line", "steps"
    )
    links = (
        events.join(before, ["from_file", "at"])
        .join(own, [f"from_{c}" for c in key], "left")
        .select(
            F.col("to_file").alias("file"), "at", "parent_at", "to_scope_ord", "to_name",
            "source", "source_line", "steps", _no_steps().alias("_none"),
        )
    )
    credited = roots(
        links.select("file", "at", "parent_at", "source", "source_line", "steps", "_none"),
        ["file", "at"], ["source", "source_line", "steps"], "_none",
    ).drop("_none")
    final = (
        links.select("file", "at", "to_scope_ord", "to_name")
        .join(credited, ["file", "at"])
        .groupBy("file", F.col("to_scope_ord").alias("scope_ord"), F.col("to_name").alias("name"))
        .agg(F.max_by(F.struct("source", "source_line", "steps"), "at").alias("_by"))
    )
    return (
        symbols.join(final, key, "left")
        .select(
            *key,
            F.when(F.col("_by").isNotNull(), F.lit("TAINTED")).otherwise(F.col("state")).alias("state"),
            *[
                F.when(F.col("_by").isNotNull(), F.col(f"_by.{c}")).otherwise(F.col(c)).alias(c)
                for c in ("source", "source_line", "steps")
            ],
            "visible",
        )
    )


def match_sinks(lines: DataFrame, symbols: DataFrame, sinks=SINKS) -> DataFrame:
    """Every dangerous word of a line with every tainted name on it."""
    text = F.col("text")
    tainted = symbols.filter(F.col("visible") & (F.col("state") == "TAINTED")).select(
        "file", F.col("name").alias("variable"), "source", "source_line", "steps"
    )
    dangerous = lines.filter(T.contains_any(text, sinks))
    used = (
        dangerous.select("file", "line", F.explode(T.words_in(text)).alias("variable"))
        .groupBy("file", "line", "variable")
        .agg(F.count("*").cast("int").alias("uses"))
        .join(tainted, ["file", "variable"])
    )
    return used.join(dangerous.select("file", "line", "text"), ["file", "line"]).select(
        "file",
        F.explode(T.all_of(text, sinks)).alias("sink"),
        F.col("line").alias("sink_line"),
        "source",
        "source_line",
        "variable",
        "steps",
        T.strip(text).alias("evidence"),
        "text",
        "uses",
    )


def tainted_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("state") == "TAINTED")


def tainted_on_lines(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Visible tainted names with the lines on which they stand, each once: (file, line, name, source)."""
    names = tainted_symbols(symbols).filter("visible").select("file", "name", "source")
    return lines.select("file", "line", F.explode(F.array_distinct(T.words_in(F.col("text")))).alias("name")).join(names, ["file", "name"])


def _scopes_of(functions: DataFrame, assignments: DataFrame, block: int) -> DataFrame:
    """(file, line, scope_ord) of the lines that define something, without looking at the others."""
    entered = functions.select("file", "line", (F.col("kind") == "function").cast("int").alias("_enters"))
    passed = assignments.select("file", "line", F.lit(0).alias("_enters"))
    marks = entered.union(passed).groupBy("file", "line").agg(F.max("_enters").alias("_enters"))
    return running_sum(marks, ["file"], "line", F.col("_enters"), "scope_ord", block).select(
        "file", "line", "scope_ord"
    )


def analyze(
    sources: DataFrame,
    taint_sources=TAINT_SOURCES,
    sanitizers=SANITIZERS,
    sinks=SINKS,
    max_rounds: int | None = None,
    block: int = BLOCK,
) -> Taint:
    """Symbols and flows of all files. Texts without a source word cannot have any and are left out.

    The others are written to the shared folder once, as functions, assignments, calls and sinks are read from them.
    """
    live = pin(sources.filter(T.contains_any(F.col("text"), taint_sources)))
    lines = explode_lines(live)
    functions = pin(extract_functions(lines))
    found = pin(extract_assignments(lines))
    scopes = pin(_scopes_of(functions, found, block))
    in_functions = function_params(functions.filter(F.col("kind") == "function")).select(
        "file", "line", F.col("param").alias("name"), F.lit(None).cast("string").alias("rhs"),
        F.lit(None).cast("string").alias("source"), F.lit(False).alias("sanitizes"),
    )
    definitions = pin(
        definitions_of(found, taint_sources, sanitizers)
        .unionByName(in_functions)
        .dropDuplicates(["file", "line", "name"])
    )
    references = _references(definitions)
    resolved = pin(_resolve(definitions, references, block))
    tainted = _declared(definitions, resolved, references)
    credited = _credited(definitions, resolved, tainted)
    cleaned = _sanitized(resolved, references, tainted).withColumn("_clean", F.lit(True))

    key = ["file", "line", "name"]
    states = (
        definitions.select(*key)
        .join(scopes, ["file", "line"])
        .join(credited, key, "left")
        .join(cleaned, key, "left")
        .select(
            *key,
            "scope_ord",
            F.when(F.col("source").isNotNull(), F.lit("TAINTED"))
            .when(F.col("_clean"), F.lit("SANITIZED"))
            .otherwise(F.lit("UNKNOWN"))
            .alias("state"),
            "source", "source_line", F.coalesce("steps", _no_steps()).alias("steps"),
        )
    )
    body = F.struct("state", "source", "source_line", "steps")
    in_scope = pin(
        states.groupBy("file", "scope_ord", "name").agg(F.max_by(body, "line").alias("_s"))
    )
    top = in_scope.groupBy("file", "name").agg(F.max("scope_ord").alias("scope_ord"))
    visible = in_scope.join(top, ["file", "scope_ord", "name"], "left_semi").select(
        "file", "name", "scope_ord", "_s.*"
    )

    plain = found.filter(F.col("kind") == "assign").select(
        "file", "line", "name", "rhs", F.lit(None).cast("string").alias("source"),
        T.contains_any(F.col("rhs"), sanitizers).alias("sanitizes"),
    )
    after = _assigned(plain, visible, max_rounds).select(
        "file", "name", *[F.col(c).alias(f"new_{c}") for c in ("state", "source", "source_line", "steps")]
    )
    deepest = functions.groupBy("file").agg(
        F.count_if(F.col("kind") == "function").cast("int").alias("_deepest")
    )
    assigned_only = (
        plain.select("file", "name").distinct().join(top, ["file", "name"], "left_anti")
        .join(deepest, "file", "left")
        .select(
            "file", F.coalesce("_deepest", F.lit(0)).alias("scope_ord"), "name",
            F.struct(
                F.lit("UNKNOWN").alias("state"), F.lit(None).cast("string").alias("source"),
                F.lit(None).cast("int").alias("source_line"), _no_steps().alias("steps"),
            ).alias("_s"),
        )
    )
    everything = in_scope.unionByName(assigned_only)
    newest = everything.groupBy("file", "name").agg(F.max("scope_ord").alias("_top"))
    changed = F.col("visible") & F.col("new_state").isNotNull()
    symbols = pin(
        everything.join(newest, ["file", "name"])
        .withColumn("visible", F.col("scope_ord") == F.col("_top"))
        .join(after, ["file", "name"], "left")
        .select(
            "file", "scope_ord", "name",
            *[
                F.when(changed, F.col(f"new_{c}")).otherwise(F.col(f"_s.{c}")).alias(c)
                for c in ("state", "source", "source_line", "steps")
            ],
            "visible",
        )
    )
    symbols = pin(propagate_calls(live, functions, scopes, symbols, block))
    return Taint(symbols, match_sinks(lines, symbols, sinks))


def propagate_taint(sources: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """The symbols of all files with their final state."""
    return analyze(sources, max_rounds=max_rounds).symbols


def mark_sanitized(sources: DataFrame) -> DataFrame:
    """Names whose last value went through a sanitizer: (file, scope_ord, name)."""
    symbols = analyze(sources).symbols
    return symbols.filter(F.col("state") == "SANITIZED").select("file", "scope_ord", "name", "visible")
