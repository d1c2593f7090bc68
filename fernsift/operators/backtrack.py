"""From a dangerous place back to where its value comes from, by the shortest way.

The search starts at the sources, all at once, and each name keeps one way only: the work grows with
the number of assignments, not with pairs of places and sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsift.functions import text as T
from fernsift.functions.fixpoint import counted, pin, roots, smallest_labels
from fernsift.operators.assignments import extract_assignments
from fernsift.operators.lines import explode_lines

# Fixed values.
BACKTRACK_SINKS = [
    "innerHTML", "outerHTML", "insertAdjacentHTML",
    "document.write", "document.writeln",
    "eval", "Function", "setTimeout", "setInterval",
    "location.href", "location.assign", "location.replace",
    "dangerouslySetInnerHTML", "v-html",
    "exec", "execSync", "spawn", "query", "raw",
    ".html(", ".append(", ".prepend(",
]
BACKTRACK_SOURCES = [
    "location.search", "location.hash", "location.href", "location.pathname",
    "document.URL", "document.documentURI", "document.referrer", "document.cookie",
    "window.name", "window.location", "localStorage", "sessionStorage",
    "URLSearchParams", "searchParams",
    "req.body", "req.params", "req.query", "req.headers",
    "request.body", "request.params", "request.query",
    "event.data", "e.data", "message.data",
    "props", "params", "query", "state",
    "useRouter", "useParams", "useSearchParams",
    "fetch", "axios", "XMLHttpRequest",
]
SKIPPED_WORDS = [
    "const", "let", "var", "function", "return", "if", "else",
    "true", "false", "null", "undefined", "this", "new",
    "parseInt", "parseFloat", "String", "Number", "Boolean",
    "JSON", "Object", "Array", "Math", "Date", "console",
]
TRANSFORMATIONS = {
    ".split(": "split",
    ".slice(": "slice",
    ".substring(": "substring",
    ".replace(": "replace",
    ".trim(": "trim",
    ".toLowerCase(": "toLowerCase",
    ".toUpperCase(": "toUpperCase",
    "encodeURI": "encoded",
    "JSON.parse": "JSON.parse",
    "atob(": "base64_decoded",
}


def label_transformations(expression: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(expression.contains(w), F.lit(label)) for w, label in TRANSFORMATIONS.items()])
    )


def find_sink_vars(lines: DataFrame, sinks=BACKTRACK_SINKS) -> DataFrame:
    """(file, sink, sink_line, variable): what is assigned or handed to each dangerous word."""
    text = F.col("text")

    def variable(sink: str) -> Column:
        word = T.alternation([sink])
        ways = [rf"{word}\s*=\s*(\w+)", rf"{word}\s*\(\s*(\w+)", rf"{word}(\w+)\s*\)"]
        return F.coalesce(*[T.group_or_null(text, way, 1) for way in ways])

    hits = F.array(
        *[
            F.when(
                text.contains(s),
                F.struct(F.lit(s).alias("sink"), variable(s).alias("variable")),
            )
            for s in sinks
        ]
    )
    return (
        lines.filter(T.contains_any(text, sinks))
        .select("file", F.col("line").alias("sink_line"), F.explode_outer(hits).alias("_h"))
        .filter(F.col("_h.variable").isNotNull())
        .select("file", "_h.sink", "sink_line", "_h.variable")
    )


def named_source(name: Column, sources=BACKTRACK_SOURCES, compat: bool = True) -> Column:
    """The source word a name stands for by itself; with ``compat`` also if it is only a part of one."""
    def fits(source: str) -> Column:
        tail = F.lit(source.split(".")[-1])
        return name.contains(source) | (tail.contains(name) if compat else tail == name)

    # most names fit none: one look at the ends of all words tells that
    ends = list(dict.fromkeys(s.split(".")[-1] for s in sources))
    likely = T.contains_any(name, sources) | (F.lit("\n".join(ends)).contains(name) if compat else name.isin(ends))
    return F.when((name != "") & likely, F.coalesce(*[F.when(fits(s), F.lit(s)) for s in sources]))


def backtrack(
    sources: DataFrame,
    sinks=BACKTRACK_SINKS,
    source_words=BACKTRACK_SOURCES,
    max_depth: int | None = None,
    compat: bool = True,
) -> DataFrame:
    """(file, sink, sink_line, variable, is_tainted, source, source_line, path, path_lines, transformations).

    Ways may be as long as they are, unless ``max_depth`` is given. Ties between equally short ways go to the earlier line, then to the name.
    """
    live = sources.filter(T.contains_any(F.col("text"), sinks))
    lines = explode_lines(live)
    starts = pin(find_sink_vars(lines, sinks))
    assigned = extract_assignments(lines).filter(
        ~((F.col("kind") == "assign") & F.col("name").rlike("^(?:if|for)"))
    )
    assigned = pin(assigned.select("file", "line", "name", "rhs"))
    uses = pin(
        assigned.select("file", "line", "name", F.explode(F.array_distinct(T.words_in(F.col("rhs")))).alias("ref"))
        .filter(~F.col("ref").isin(SKIPPED_WORDS) & ~F.col("ref").rlike("^[0-9]"))
    )
    names = (
        starts.select("file", F.col("variable").alias("name"))
        .union(uses.select("file", F.col("ref").alias("name")))
        .distinct()
    )
    direct = pin(
        names.select(
            "file", "name", named_source(F.col("name"), source_words, compat).alias("source"),
            F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("rhs"),
        ).filter(F.col("source").isNotNull())
    )
    from_value = (
        assigned.withColumn("source", T.first_of(F.col("rhs"), source_words))
        .filter(F.col("source").isNotNull())
        .join(direct, ["file", "name"], "left_anti")
        .groupBy("file", "name")
        .agg(F.min_by(F.struct("source", "line", "rhs"), "line").alias("_s"))
        .select("file", "name", "_s.*")
    )
    ends = pin(direct.unionByName(from_value))
    edges = uses.filter(F.col("ref") != F.col("name")).select(
        F.col("file").alias("from_file"), F.col("ref").alias("from_name"),
        F.col("file").alias("to_file"), F.col("name").alias("to_name"),
    ).distinct()
    depths = pin(
        smallest_labels(
            ends.select("file", "name", F.lit(0).alias("depth")),
            edges,
            ["file", "name"],
            "depth",
            counted(max_depth),
        )
    )
    onward = (
        uses.join(depths.filter(F.col("depth") > 0), ["file", "name"])
        .join(
            depths.select("file", F.col("name").alias("ref"), F.col("depth").alias("ref_depth")),
            ["file", "ref"],
        )
        .filter(F.col("ref_depth") == F.col("depth") - 1)
        .groupBy("file", "name")
        .agg(F.min(F.struct("line", "ref")).alias("_on"))
    )
    step = lambda line: F.array(F.struct(F.col("name").alias("name"), line.alias("line")))
    links = onward.select(
        "file", "name", F.col("_on.ref").alias("parent_name"),
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("end_line"),
        F.lit(None).cast("string").alias("rhs"), step(F.col("_on.line")).alias("steps"),
    ).unionByName(
        ends.select(
            "file", "name", F.lit(None).cast("string").alias("parent_name"), "source",
            F.col("line").alias("end_line"), "rhs", step(F.col("line")).alias("steps"),
        )
    )
    ways = roots(links, ["file", "name"], ["source", "end_line", "rhs"], "steps").withColumnRenamed(
        "name", "variable"
    )
    way = F.reverse("steps")
    found = F.col("source").isNotNull()
    lines_of = F.filter(F.transform(way, lambda s: s["line"]), lambda x: x.isNotNull())
    return starts.join(ways, ["file", "variable"], "left").select(
        "file",
        "sink",
        "sink_line",
        "variable",
        found.alias("is_tainted"),
        "source",
        F.when(
            found, F.coalesce("end_line", F.element_at(F.concat(lines_of, F.array("sink_line")), 1))
        ).otherwise(0).alias("source_line"),
        F.when(found, F.transform(way, lambda s: s["name"])).otherwise(F.array("variable")).alias("path"),
        F.when(
            found,
            F.when(F.col("end_line").isNull(), F.concat(lines_of, F.array("sink_line"))).otherwise(lines_of),
        ).otherwise(F.array().cast("array<int>")).alias("path_lines"),
        F.when(F.col("rhs").isNotNull(), label_transformations(F.col("rhs")))
        .otherwise(F.array().cast("array<string>")).alias("transformations"),
    )


def enrich_with_backtrack(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Add the way to findings on the same line and sink; ways without a finding become findings."""
    ways = (
        results.filter("is_tainted")
        .groupBy("file", F.col("sink_line").alias("line"), "sink")
        .agg(F.min_by(F.struct("source", "source_line", "path"), F.struct(F.size("path"), "variable")).alias("_w"))
    )
    matched = findings.join(ways, ["file", "line", "sink"], "left").select(
        *[c for c in findings.columns if c not in ("path", "source_line", "confidence")],
        F.col("_w.path").alias("path"),
        F.col("_w.source_line").alias("source_line"),
        F.when(F.col("_w").isNotNull(), F.lit("HIGH")).otherwise(F.col("confidence")).alias("confidence"),
    )
    new = ways.join(findings.select("file", "line", "sink").distinct(), ["file", "line", "sink"], "left_anti")
    upper = F.replace(F.upper("sink"), F.lit("."), F.lit("_"))
    added = {
        "type": F.concat(F.lit("TAINT_FLOW_"), upper),
        "severity": F.lit("HIGH"),
        "evidence": F.concat(
            F.lit("Taint flows from "), F.col("_w.source"), F.lit(" through: "),
            F.array_join("_w.path", " → "),
        ),
        "source": F.col("_w.source"),
        "path": F.col("_w.path"),
        "source_line": F.col("_w.source_line"),
        "confidence": F.lit("HIGH"),
        "phase": F.lit(10),
    }
    return matched.unionByName(
        new.withColumns(added).drop("_w"), allowMissingColumns=True
    )
