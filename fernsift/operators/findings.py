"""Findings put together, reduced, scored, counted and served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]

# The columns of a finding of any analyzer; missing ones are null.
FINDING = {
    "file": "string", "line": "int", "type": "string", "severity": "string", "evidence": "string",
    "source": "string", "sink": "string", "context": "string", "exploitable": "boolean",
    "bypass_needed": "string", "recommendation": "string", "confidence": "string", "cwe": "string",
    "source_line": "int", "path": "array<string>", "phase": "int",
}


def as_findings(df: DataFrame, phase: int, confidence: str | None = None, cwe: str | None = None) -> DataFrame:
    """Rows of one analyzer in the common shape."""
    given = {"phase": F.lit(phase)}
    if confidence:
        given["confidence"] = F.lit(confidence)
    if cwe:
        given["cwe"] = F.lit(cwe)
    have = {c: F.col(c) for c in df.columns} | given
    return df.select(
        *[have.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in FINDING.items()]
    )


def all_findings(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One finding per file, type, line and sink: that of the earliest phase."""
    rest = [c for c in findings.columns if c not in ("file", "type", "line", "sink")]
    first = F.struct("phase", F.coalesce("evidence", F.lit("")), F.coalesce("source", F.lit("")))
    return (
        findings.withColumn("_sink", F.coalesce("sink", F.lit("")))
        .groupBy("file", "type", "line", "_sink")
        .agg(F.min_by(F.struct("sink", *rest), first).alias("_f"))
        .select("file", "type", "line", "_f.*")
        .select(*findings.columns)
    )


def score_confidence(findings: DataFrame) -> DataFrame:
    """HIGH, MEDIUM or LOW by how much is known: source and sink, way, context, line of the source."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    steps = F.coalesce(F.size("path"), F.lit(-1))
    score = (
        F.when(filled("source") & filled("sink"), 30).otherwise(0)
        + F.when(steps > 0, 20 + 5 * steps).otherwise(0)
        + F.when(filled("context"), 15).otherwise(0)
        + F.when(F.coalesce("source_line", F.lit(0)) > 0, 10).otherwise(0)
    )
    level = F.when(score >= 60, F.lit("HIGH")).when(score >= 30, F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    return findings.withColumn("confidence", level)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def severity_counts(findings: DataFrame, by: str = "file") -> DataFrame:
    """Findings per file and severity, in total, and how many of them are credentials."""
    return findings.groupBy(by).agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES],
        F.count("*").alias("total"),
        F.count_if(F.col("type").startswith("SECRET_")).alias("secrets"),
    )


def target_metrics(findings: DataFrame, by: list[str], compat: bool = True) -> DataFrame:
    """Counts of a target's dashboard.

    With ``compat`` the intel count looks for a type that no scan emits.
    """
    intel = "INTEL_MATCH" if compat else "INTEL_KEYWORD"
    return findings.groupBy(*by).agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("type") == intel).alias("intel"),
        F.count_if(F.col("type").contains("SHADOW")).alias("shadow"),
    )


def severity_gate(findings: DataFrame) -> DataFrame:
    """One row: are there findings of severity CRITICAL or HIGH, and how many."""
    bad = F.count_if(F.col("severity").isin("CRITICAL", "HIGH"))
    return findings.agg(bad.alias("blocking"), (bad > 0).alias("failed"))


def rule_hit_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count("*").alias("hits"))


def rule_hit_totals(findings: DataFrame) -> DataFrame:
    counts = rule_hit_counts(findings)
    return counts.agg(F.sum("hits").alias("hits"), F.count("*").alias("types"))


def report_order(findings: DataFrame) -> DataFrame:
    """Rows of a report: by severity, then file, line and type."""
    return findings.orderBy(severity_rank(F.col("severity")), "file", "line", "type")


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """Size of each severity's section of a report, worst first; the rows come from report_order."""
    return (
        findings.groupBy("severity")
        .agg(F.count("*").alias("findings"), F.count_distinct("type").alias("types"),
             F.count_distinct("file").alias("files"))
        .orderBy(severity_rank(F.col("severity")))
    )


def top_findings(findings: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` worst findings of each file, with their rank.

    Spark keeps only ``k`` rows per file and task before the shuffle.
    """
    order = [severity_rank(F.col("severity")), "phase", "line", "type", F.coalesce("sink", F.lit("")), "evidence"]
    window = Window.partitionBy("file").orderBy(*order)
    return findings.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def worst_findings(findings: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` worst findings of all files."""
    return findings.orderBy(severity_rank(F.col("severity")), "file", "line", "type", "evidence").limit(k)
