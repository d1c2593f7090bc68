"""What kind of place in a page a flow ends in, and how bad that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsift.functions import text as T
from fernsift.functions.frames import BLOCK, running_sum
from fernsift.operators.lines import explode_lines

# Place -> severity, exploitable, what an attacker has to get around.
CONTEXTS = {
    "SCRIPT_CODE": ("CRITICAL", True, None),
    "HTML_TEXT": ("CRITICAL", True, None),
    "HTML_ATTR": ("HIGH", True, "quote_break"),
    "HTML_ATTR_UNQUOTED": ("CRITICAL", True, None),
    "SCRIPT_STRING": ("HIGH", True, "string_break"),
    "URL_PARAM": ("MEDIUM", True, "javascript_uri"),
    "URL_PATH": ("LOW", False, "protocol_handler"),
    "STYLE": ("MEDIUM", True, "expression"),
    "TEXTAREA": ("LOW", False, "tag_break"),
    "COMMENT": ("LOW", False, "comment_break"),
    "UNKNOWN": ("MEDIUM", True, None),
}
# Public CWE numbers of the finding groups.
CWE = {"XSS": "CWE-79", "CSPT": "CWE-22", "POSTMESSAGE": "CWE-346", "SECRET_EXPOSURE": "CWE-798"}


def script_changes(sources: DataFrame) -> DataFrame:
    """(file, line, opened): script tags opened minus closed on each line where a tag ends."""
    text = F.col("text")
    opens = F.transform(
        T.matches(text, r"(?i)<script[^>]*>"),
        lambda m: F.struct((m["line"] + T.newlines(m["g0"])).alias("line"), F.lit(1).alias("opened")),
    )
    closes = F.transform(
        T.matches(text, r"(?i)</script>"),
        lambda m: F.struct(m["line"].alias("line"), F.lit(-1).alias("opened")),
    )
    return (
        sources.filter(text.rlike(r"(?i)</?script"))
        .select("file", F.explode(F.concat(opens, closes)).alias("_t"))
        .groupBy("file", F.col("_t.line").alias("line"))
        .agg(F.sum("_t.opened").alias("opened"))
    )


def in_script_tag(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, line, in_script): more script tags opened than closed up to and with the line."""
    lines = explode_lines(sources).select("file", "line")
    marked = lines.join(script_changes(sources), ["file", "line"], "left").na.fill(0, ["opened"])
    return running_sum(marked, ["file"], "line", F.col("opened"), "_open", block).select(
        "file", "line", (F.col("_open") > 0).alias("in_script")
    )


def flows_with_line(flows: DataFrame, lines: DataFrame) -> DataFrame:
    """Flows with the whole text of the line they end on."""
    where = lines.select("file", F.col("line").alias("sink_line"), "text")
    return flows.drop("text").join(where, ["file", "sink_line"])


def context_of(sink: Column, line: Column, in_script: Column) -> Column:
    low = F.lower(line)
    timer = r"(setTimeout|setInterval)\s*\(\s*['\"]"
    unquoted = line.rlike(r"=\s*\w") & ~line.rlike(r"=['\"]")
    return (
        F.when(
            sink.isin("innerHTML", "outerHTML"),
            F.when(in_script, "SCRIPT_CODE")
            .when(low.contains("textarea"), "TEXTAREA")
            .otherwise("HTML_TEXT"),
        )
        .when(
            sink.isin("document.write", "document.writeln"),
            F.when(low.contains("<script"), "SCRIPT_CODE").otherwise("HTML_TEXT"),
        )
        .when(
            sink.isin("eval", "Function", "setTimeout", "setInterval"),
            F.when(line.rlike(timer), "SCRIPT_STRING").otherwise("SCRIPT_CODE"),
        )
        .when(
            sink.contains("location") | sink.isin("href", "src"),
            F.when(line.contains("?") | line.contains("search"), "URL_PARAM").otherwise("URL_PATH"),
        )
        .when(
            line.contains(".setAttribute") | line.contains("="),
            F.when(unquoted, "HTML_ATTR_UNQUOTED").otherwise("HTML_ATTR"),
        )
        .when(low.contains("style"), "STYLE")
        .otherwise("UNKNOWN")
    )


def rated(context: Column) -> Column:
    """Severity, exploitable and bypass of a context, as one struct."""
    pairs = [
        x
        for name, (severity, exploitable, bypass) in CONTEXTS.items()
        for x in (
            F.lit(name),
            F.struct(
                F.lit(severity).alias("severity"),
                F.lit(exploitable).alias("exploitable"),
                F.lit(bypass).cast("string").alias("bypass_needed"),
            ),
        )
    ]
    return F.create_map(*pairs)[context]


def dom_context(flows: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Flows (with their line as ``text``) as findings of type ``XSS_<context>``."""
    tagged = in_script_tag(sources.filter(F.col("text").rlike(r"(?i)<script")), block).filter("in_script")
    inside = tagged.select("file", F.col("line").alias("sink_line"), "in_script")
    context = context_of(F.col("sink"), F.col("text"), F.coalesce("in_script", F.lit(False)))
    return (
        flows.join(inside, ["file", "sink_line"], "left")
        .withColumn("context", context)
        .withColumn("_r", rated(F.col("context")))
        .select(
            "file",
            F.col("sink_line").alias("line"),
            F.concat(F.lit("XSS_"), "context").alias("type"),
            "_r.severity",
            "evidence",
            "source",
            "sink",
            "context",
            "_r.exploitable",
            "_r.bypass_needed",
            F.lit(CWE["XSS"]).alias("cwe"),
        )
    )
