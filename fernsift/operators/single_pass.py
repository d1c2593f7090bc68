"""The earlier, simpler flow scan: declarations and parameters only, each read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernsift.functions import text as T
from fernsift.functions.fixpoint import increasing, pin, smallest_labels
from fernsift.functions.frames import last_before
from fernsift.operators.context import SANITIZER_WORDS, USER_INPUT_WORDS
from fernsift.operators.lines import is_code

# Fixed values.
FLOW_SINKS = [
    "eval", "Function", "setTimeout", "setInterval", "innerHTML", "outerHTML",
    "insertAdjacentHTML", "document.write", "$.html", "$.append", "$.prepend",
    "dangerouslySetInnerHTML", "v-html", "bypassSecurityTrustHtml", "$sce.trustAsHtml",
    "location", "location.href", "window.open", "navigate", "exec", "spawn",
    "query", "rawQuery", "postMessage", "fetch", "XMLHttpRequest",
]
PARAMETER_WORDS = ["req", "request", "query", "params", "body", "data", "input"]
HEADER = r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\()\s*\(([^)]*)\)"
DECLARED = r"(?d)(?:var|let|const)\s+(\w+)\s*=\s*(.+?)(?:;|$)"


def parameter_name(piece: Column) -> Column:
    """The local name of one parameter: without default, rest dots, braces, and the property it is taken from."""
    bare = F.element_at(F.split(F.regexp_replace(piece, r"[{}\[\]]|\.\.\.", ""), "="), 1)
    return T.strip(F.element_at(F.split(bare, ":"), -1))


def may_flow(text: Column) -> Column:
    """False only for whole texts without a flow: those that have no sink word, or neither a declaration nor a header by their literals."""
    has = lambda *words: T.any_of(F.contains(text, F.lit(w)) for w in words)
    declares = has("=") & has("var", "let", "const")
    return (declares | (has("(") & has("function"))) & T.contains_any(text, FLOW_SINKS, ignore_case=True)


def flow_scan_single_pass(lines: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Flows of each file, as findings ``TAINT_FLOW_HIGH``; of its first ``max_lines`` lines where that is given.

    A name is tainted by a source word or by a name tainted before; it counts as clean if its own
    value has a sanitizer word. Names are kept per function, but matched by name alone. Which function a line is in
    comes from line numbers and headers only; texts stay where they are. Rest and destructured parameters count by
    their local names, so a flow's name always stands in the line and there is no ``TAINT_FLOW_MEDIUM``.
    """
    text = F.col("text")
    header = F.when(
        text.rlike(HEADER),
        F.coalesce(F.nullif(F.regexp_extract(text, HEADER, 1), F.lit("")), F.regexp_extract(text, HEADER, 2)),
    )
    within = F.lit(True) if max_lines is None else F.col("line") <= max_lines
    lines = lines.filter(within & (T.strip(text) != "") & is_code(text))
    narrow = lines.select("file", "line", header.alias("_header"))
    named = last_before(narrow, ["file"], "line", F.col("_header"), "function", inclusive=True)
    named = pin(named.select("file", "line", F.coalesce("function", F.lit("global")).alias("function")))
    read = lines.join(named, ["file", "line"])
    params = (
        read.filter(text.rlike(HEADER))
        .select("file", "line", "function", F.explode(F.split(F.regexp_extract(text, HEADER, 3), ",")).alias("_p"))
        .select("file", "line", "function", parameter_name(F.col("_p")).alias("name"))
        .filter(F.col("name").rlike(r"^\w+$") & T.contains_any(F.col("name"), PARAMETER_WORDS, ignore_case=True))
        .select(
            "file", "function", "name", (F.col("line") * 2).alias("moment"), "line",
            F.concat(F.lit("parameter: "), "name").alias("source"), F.lit(False).alias("sanitized"),
        )
    )
    declared = pin(
        read.filter(text.rlike(DECLARED))
        .select(
            "file", "function", F.regexp_extract(text, DECLARED, 1).alias("name"),
            (F.col("line") * 2 + 1).alias("moment"), "line",
            F.regexp_extract(text, DECLARED, 2).alias("value"),
        )
        .withColumn("from_outside", T.contains_any(F.col("value"), USER_INPUT_WORDS, ignore_case=True))
        .withColumn("sanitized", T.contains_any(F.col("value"), SANITIZER_WORDS, ignore_case=True))
    )
    reads = declared.select(
        "file", "name", "moment", F.explode(F.array_distinct(T.words_in(F.col("value")))).alias("ref")
    )
    edges = reads.select(
        F.col("file").alias("from_file"), F.col("ref").alias("from_name"),
        F.col("file").alias("to_file"), F.col("name").alias("to_name"), F.col("moment").alias("at"),
    )
    seeds = declared.filter("from_outside").select("file", "name", "moment").union(
        params.select("file", "name", "moment")
    )
    first = pin(
        smallest_labels(seeds, edges, ["file", "name"], "moment", increasing("at"))
    )
    fed = (
        reads.join(first.select("file", F.col("name").alias("ref"), F.col("moment").alias("since")), ["file", "ref"])
        .filter(F.col("since") < F.col("moment"))
        .select("file", "name", "moment")
        .distinct()
        .withColumn("fed", F.lit(True))
    )
    tainted = (
        declared.join(fed, ["file", "name", "moment"], "left")
        .filter(F.col("from_outside") | F.coalesce("fed", F.lit(False)))
        .select("file", "function", "name", "moment", "line", F.col("value").alias("source"), "sanitized")
        .unionByName(params)
    )
    next_ = F.lead("line").over(Window.partitionBy("file", "function", "name").orderBy("moment"))
    active = (
        tainted.withColumn("until", next_)
        .filter(~F.col("sanitized") & (F.col("until").isNull() | (F.col("until") > F.col("line"))))
        .select("file", "name", F.col("line").alias("source_line"), "until", F.col("function").alias("declared_in"), "source")
    )
    hits = F.array_compact(
        F.array(*[F.when(F.contains(F.lower(text), F.lit(s.lower())), F.lit(s)) for s in FLOW_SINKS])
    )
    places = read.filter(T.contains_any(text, FLOW_SINKS, ignore_case=True)).select(
        "file", "line", "text", "function", F.explode(F.array_distinct(T.words_in(text))).alias("name")
    )
    return (
        places.join(active, ["file", "name"])
        .filter(
            (F.col("source_line") <= F.col("line"))
            & (F.col("until").isNull() | (F.col("line") < F.col("until")))
        )
        .withColumn("sink", F.explode(hits))
        .select(
            "file",
            "line",
            F.lit("TAINT_FLOW_HIGH").alias("type"),
            F.lit("CRITICAL").alias("severity"),
            F.format_string(
                "Tainted '%s' → %s | L%d→L%d | %s", "name", "sink", "source_line", "line",
                T.strip(text),
            ).alias("evidence"),
            F.col("name").alias("variable"),
            "sink",
            "source",
            "source_line",
            "function",
            "declared_in",
        )
    )
