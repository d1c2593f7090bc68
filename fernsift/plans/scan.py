"""Whole scans: all analyzers over a table of sources, and jobs that store what they find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernsift.functions.fixpoint import pin
from fernsift.operators import taint as taint_flow
from fernsift.operators.backtrack import BACKTRACK_SINKS, BACKTRACK_SOURCES, backtrack, enrich_with_backtrack
from fernsift.operators.context import CHAINS, detect_chains, intel_keywords, line_context, may_chain
from fernsift.operators.cspt import cspt_scan
from fernsift.operators.decode import apply_decoded
from fernsift.operators.dom import CWE, dom_context
from fernsift.operators.findings import all_findings, as_findings, dedup_findings, score_confidence
from fernsift.operators.lines import explode_lines, format_evidence
from fernsift.operators.messaging import postmessage_findings
from fernsift.operators.rule_catalog import default_rules
from fernsift.operators.rules import dedup_line_findings, rule_findings, scan_rules, scan_structural_rules, scan_texts
from fernsift.operators.secrets import promote_secrets, scan_secrets
from fernsift.operators.single_pass import flow_scan_single_pass, may_flow
from fernsift.sources import store as tables


MOST_FILES = 500_000  # files whose hashes are sent to every executor


def _of_files(lines: DataFrame, hits: DataFrame) -> DataFrame:
    """The lines of files that have hits; all lines if too many files have some to be sent around.

    Files are told by a hash, so a few lines of other files may be among them.
    """
    files = pin(hits.select(F.xxhash64("file").alias("_of")).distinct())
    if files.count() > MOST_FILES:
        return lines
    return lines.join(F.broadcast(files), F.xxhash64("file") == F.col("_of"), "left_semi")


def scan_v2(sources: DataFrame, rules=None, window: int = 25, chains=CHAINS, scope: str = "line") -> DataFrame:
    """Line rules with their surroundings, chains, security words and single-pass flows.

    (file, line, type, severity, evidence, phase). With ``scope="rule"`` the rules that are written to span lines are
    matched against whole texts, and credited to the line on which a match begins; else all are matched against lines.
    Rules given as a table are matched against lines. Texts are written to the shared folder once, as every part reads them.
    Flows and chains are looked for in texts that have the words they need, surroundings in files that have hits.
    """
    as_table = isinstance(rules, DataFrame)
    if as_table and scope == "rule":
        raise ValueError("rules that span lines are given as a list, not as a table")
    sources = pin(sources)
    lines_of = lambda texts: explode_lines(texts, mode="universal")
    lines = lines_of(sources)
    shape = ["file", "line", "type", "severity", "evidence"]
    flows = flow_scan_single_pass(lines_of(sources.filter(may_flow(F.col("text"))))).select(*shape, F.lit(0).alias("phase"))
    if not as_table:
        rules = default_rules() if rules is None else list(rules)
    hits = scan_rules(lines, rules if as_table else [r for r in rules if scope == "line" or r.scope == "line"])
    if scope == "rule":
        spanning = scan_texts(sources, [r for r in rules if r.scope == "file"]).dropDuplicates(["file", "line", "rule_id"])
        family = F.element_at(F.split("rule_id", "_"), 1).alias("family")
        spanning = spanning.select("file", "line", "rule_id", family, "base_severity", "matched")
        hits = hits.unionByName(spanning.join(lines, ["file", "line"]).select(*hits.columns))
    hits = pin(dedup_line_findings(hits).drop("finding_key"))
    by_rule = rule_findings(hits.join(line_context(_of_files(lines, hits), window), ["file", "line"])).select(
        *shape, F.lit(1).alias("phase")
    )
    linked = detect_chains(lines_of(sources.filter(may_chain(F.col("text"), chains))), chains).select(*shape, F.lit(2).alias("phase"))
    found = pin(flows.unionByName(by_rule).unionByName(linked))
    words = intel_keywords(lines, found).select(*shape, F.lit(3).alias("phase"))
    return found.unionByName(words)


def scan(
    sources: DataFrame,
    decode: bool = True,
    compat: bool = True,
    taint_sources=taint_flow.TAINT_SOURCES,
    sanitizers=taint_flow.SANITIZERS,
    sinks=taint_flow.SINKS,
    back_sources=BACKTRACK_SOURCES,
    back_sinks=BACKTRACK_SINKS,
    secret_patterns=None,
) -> DataFrame:
    """All analyzers of the live engine: decode, structure, flows, requests, messages, credentials,
    backtracking; then one finding per type, line and sink, with confidence.

    The word lists and patterns that decide are parameters. Texts are decoded once and written to the shared folder, as a
    dozen analyzers read them.
    """
    texts = pin(apply_decoded(sources, compat)) if decode else sources
    lines = explode_lines(texts)
    tainted = taint_flow.analyze(texts, taint_sources, sanitizers, sinks)
    names = taint_flow.tainted_symbols(tainted.symbols).select("file", "name")
    found = all_findings(
        [
            as_findings(scan_structural_rules(lines), 4),
            as_findings(dom_context(tainted.flows, texts), 6, "HIGH"),
            as_findings(cspt_scan(lines, names), 7, "HIGH"),
            as_findings(
                postmessage_findings(texts).withColumn("type", F.concat(F.lit("POSTMESSAGE_"), "type")),
                8, "HIGH", CWE["POSTMESSAGE"],
            ),
            as_findings(promote_secrets(scan_secrets(texts, secret_patterns, compat)), 9, None, CWE["SECRET_EXPOSURE"]),
        ]
    )
    # two findings of one line and sink would meet the same way, so reducing first saves a larger join
    known = pin(dedup_findings(found))
    ways = backtrack(texts, back_sinks, back_sources, compat=compat)
    return score_confidence(dedup_findings(enrich_with_backtrack(known, ways)))


def run_job(
    submissions: DataFrame, store: tables.Store, scan_id: str, engine: str = "live", new_only: bool = False
) -> None:
    """Store submitted texts and what a scan of them finds.

    Every text is scanned once, however many submissions share it, and its findings are joined to
    their assets. Rows of a scan replace those of an earlier run with the same ``scan_id``, so a
    repeated run adds nothing. Of stored texts and targets only the buckets that the submissions touch are read. With ``new_only`` texts that are stored already are not scanned.
    """
    submissions = submissions.select("domain", "filename", "code")
    assets = pin(tables.link_assets(submissions, scan_id))
    fresh = tables.store_sources(submissions, store.near("source_files", assets.select("source_hash")))
    now = F.current_timestamp()
    known = store.near("targets", assets.select("target_id"))
    store.append("targets", tables.upsert_targets(submissions, known).withColumn("created_at", now))
    store.write_scan("assets", assets, scan_id)
    texts = fresh if new_only else tables.hashed(submissions).groupBy("hash").agg(
        F.first("code").alias("content")
    )
    sources = texts.select(F.col("hash").alias("file"), F.col("content").alias("text"))
    found = scan_v2(sources) if engine == "v2" else format_evidence(scan(sources))
    placed = found.withColumnRenamed("file", "source_hash").join(
        assets.select("asset_id", "source_hash"), "source_hash"
    )
    store.write_scan("findings", tables.finding_rows(placed).withColumn("created_at", now), scan_id)
    # the texts go last: a run that broke off before is repeated in full
    store.append("source_files", fresh.withColumn("created_at", now))
