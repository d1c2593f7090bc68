"""Queries over findings and the stored tables, whole scans, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernsift.operators import findings as N
from fernsift.operators import rules as R
from fernsift.operators import secrets as S
from fernsift.operators import context as C
from fernsift.operators import rule_catalog as K
from fernsift.plans import scan as P
from fernsift.sources import store as W
from fernsift.sources import submissions as B
from fernsift.streaming import ingest as I
from registry import tables as t
from registry.flow_queries import SINGLE, SINGLE_FLOWS
from registry.line_queries import CONTEXT_SQL, ELIGIBLE, FIRST_CHAIN, NEAR_TEXT, OTHER_CHAINS, RULES, STRUCTURAL_PARTS, negative_condition
from registry.tables import has_any, matched, q, stripped, with_lines
from registry.text_queries import PROMOTED_SQL

QUERIES: dict[str, tuple] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = (query, sql)


# ── findings of two analyzers ──────────────────────────────────────────────────────────────────
def findings(spark, sf) -> DataFrame:
    structural = N.as_findings(R.scan_structural_rules(t.code_lines(spark, sf)), 4)
    secret = N.as_findings(S.promote_secrets(S.scan_secrets(t.code_files(spark, sf))), 9, None, "CWE-798")
    return N.all_findings([structural, secret])


FOUND = f"""{t.CODE_LINES}, found AS MATERIALIZED (
SELECT file, line, type, severity, evidence, confidence, 4 AS phase, NULL::VARCHAR AS cwe FROM ({STRUCTURAL_PARTS})
UNION ALL SELECT file, line, type, severity, evidence, confidence, 9, 'CWE-798' FROM ({PROMOTED_SQL}))"""
BRIEF = ["file", "line", "type", "severity", "evidence", "confidence", "phase", "cwe"]
RANK = "list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'], severity)"

add("all_findings", lambda spark, sf: findings(spark, sf).select(*BRIEF), f"WITH {FOUND} SELECT * FROM found")
add(
    "dedup_findings",
    lambda spark, sf: (
        lambda f: N.dedup_findings(f.unionByName(f.withColumn("phase", F.col("phase") + 1))).select(*BRIEF)
    )(findings(spark, sf)),
    f"""WITH {FOUND} SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY file, type, line ORDER BY phase, evidence) = 1""",
)
add(
    "severity_counts",
    lambda spark, sf: N.severity_counts(findings(spark, sf)),
    f"""WITH {FOUND} SELECT file, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in N.SEVERITIES)},
    count(*) AS total, count(*) FILTER (starts_with(type, 'SECRET_')) AS secrets FROM found GROUP BY file""",
)
add(
    "severity_gate",
    lambda spark, sf: N.severity_gate(findings(spark, sf)),
    f"""WITH {FOUND} SELECT count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS blocking,
    count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) > 0 AS failed FROM found""",
)
add(
    "rule_hit_counts",
    lambda spark, sf: N.rule_hit_counts(findings(spark, sf)),
    f"WITH {FOUND} SELECT type, count(*) AS hits FROM found GROUP BY type",
)
add(
    "rule_hit_totals",
    lambda spark, sf: N.rule_hit_totals(findings(spark, sf)),
    f"WITH {FOUND} SELECT count(*) AS hits, count(DISTINCT type) AS types FROM found",
)
add(
    "findings_by_severity",
    lambda spark, sf: N.findings_by_severity(findings(spark, sf)),
    f"""WITH {FOUND} SELECT severity, count(*) AS findings, count(DISTINCT type) AS types, count(DISTINCT file) AS files
    FROM found GROUP BY severity""",
)
add(
    "report_order",
    lambda spark, sf: N.report_order(findings(spark, sf)).select("file", "line", "type", "severity"),
    f"WITH {FOUND} SELECT file, line, type, severity FROM found ORDER BY {RANK}, file, line, type",
)
add(
    "top_findings",
    lambda spark, sf: N.top_findings(findings(spark, sf)).select("rank", *BRIEF),
    f"""WITH {FOUND} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY {RANK}, phase, line, type, evidence)
    AS rank FROM found) WHERE rank <= 8""",
)
add(
    "worst_findings",
    lambda spark, sf: N.worst_findings(findings(spark, sf)).select("file", "line", "type", "severity"),
    f"WITH {FOUND} SELECT file, line, type, severity FROM found ORDER BY {RANK}, file, line, type, evidence LIMIT 8",
)


def scored(spark, sf):
    from registry.line_queries import shaped_findings

    e = shaped_findings(spark, sf)
    return N.score_confidence(
        e.withColumn("context", F.when(F.col("event_id") % 7 == 0, "HTML_TEXT"))
        .withColumn("source_line", F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 11))
    ).select("event_id", "confidence")


add(
    "score_confidence",
    scored,
    """SELECT event_id, CASE WHEN score >= 60 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (
    SELECT event_id, CASE WHEN event_type <> 'error' AND event_id % 4 <> 0 THEN 30 ELSE 0 END
      + CASE WHEN event_id % 3 <> 0 THEN 20 + 5 * (event_id % 5 + 1) ELSE 0 END
      + CASE WHEN event_id % 7 = 0 THEN 15 ELSE 0 END + CASE WHEN event_id % 11 <> 0 THEN 10 ELSE 0 END AS score FROM events)""",
)

# ── rule findings with their surroundings ──────────────────────────────────────────────────────
def rule_rows() -> str:
    return "\nUNION ALL ".join(
        f"SELECT file, line, text, {q(r.rule_id)} AS type, {q(R.base_severity(r.rule_id))} AS b, "
        + (f"regexp_extract(text, {t.re2(K.FLAGS + r.pattern)}, 0)" if r.family == "SECRET" else "NULL::VARCHAR")
        + f" AS m FROM picked WHERE {matched('text', K.FLAGS + r.pattern)}"
        for r in RULES
    )


BARE = stripped("text")
RATED = f"""s1 AS (SELECT *, CASE WHEN has_user_input AND NOT has_sanitization AND b = 'MEDIUM' THEN 'HIGH'
      WHEN has_user_input AND NOT has_sanitization AND b = 'LOW' THEN 'MEDIUM' ELSE b END AS u1 FROM hits JOIN near USING (file, line)),
    s2 AS (SELECT *, {has_any('text', R.AUTH_WORDS, True)} AS auth, CASE WHEN auth AND u1 = 'LOW' THEN 'MEDIUM'
      WHEN auth AND u1 = 'MEDIUM' THEN 'HIGH' ELSE u1 END AS u2 FROM s1),
    s3 AS (SELECT *, CASE WHEN has_validation AND has_sanitization AND u2 = 'HIGH' THEN 'MEDIUM'
      WHEN has_validation AND has_sanitization AND u2 = 'CRITICAL' THEN 'HIGH' ELSE u2 END AS severity,
      CASE WHEN length(m) > 15 THEN concat(chr(128272), ' ', substr(m, 1, 8), '...', right(m, 4), ' | ',
        {BARE}) ELSE {BARE} END AS shown FROM s2)"""
SHOWN = """SELECT file, line, type, severity, CASE WHEN severity IN ('CRITICAL', 'HIGH') AND (has_user_input OR NOT has_sanitization)
      THEN concat('[', concat_ws(', ', CASE WHEN has_user_input THEN 'USER_INPUT' END,
        CASE WHEN NOT has_sanitization THEN 'NO_SANITIZE' END), '] ', shown) ELSE shown END AS evidence FROM s3"""
add(
    "rule_findings",
    lambda spark, sf: (
        lambda lines: R.rule_findings(R.scan_rules(lines, RULES).join(C.line_context(lines), ["file", "line"]))
    )(t.code_lines(spark, sf)),
    with_lines(f""", picked AS MATERIALIZED (SELECT * FROM code_lines WHERE {ELIGIBLE})
    {CONTEXT_SQL}, hits AS ({rule_rows()}), {RATED}
    {SHOWN}""")
    .replace("code_lines\n, picked", "code_lines, picked"),
)

# ── stored tables ──────────────────────────────────────────────────────────────────────────────
ID = "CAST(('0x' || substr(md5({c}), 1, 8)) AS BIGINT)"


def table_id(column: str):
    return F.conv(F.substring(F.md5(F.col(column)), 1, 8), 16, 10).cast("long")


def submissions(spark, sf) -> DataFrame:
    docs = t.read(spark, sf, "documents")
    return docs.select(
        F.col("source").alias("domain"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"),
        F.col("text").alias("code"),
    )


def targets(spark, sf) -> DataFrame:
    return t.read(spark, sf, "documents").select(F.col("source").alias("domain")).distinct().select(
        table_id("domain").alias("target_id"), "domain"
    )


def assets(spark, sf) -> DataFrame:
    return t.read(spark, sf, "documents").select(
        F.col("doc_id").alias("asset_id"), table_id("source").alias("target_id"),
        F.concat(F.lit("/"), "lang", F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("url"),
        F.sha2("text", 256).alias("source_hash"),
    )


def source_files(spark, sf) -> DataFrame:
    return t.read(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.first("text").alias("content"))


def stored_findings(spark, sf) -> DataFrame:
    return t.read(spark, sf, "events").select(
        F.col("event_id").alias("finding_id"), F.col("user_id").alias("asset_id"),
        F.when(F.col("event_type") == "view", "SHADOW_API").when(F.col("event_type") == "click", "INTEL_MATCH")
        .otherwise(F.concat(F.lit("XSS_"), F.upper("event_type"))).alias("type"),
        F.get(F.array(*map(F.lit, N.SEVERITIES)), (F.col("event_id") % 5).cast("int")).alias("severity"),
        F.col("props").alias("evidence"), (F.col("event_id") % 100).cast("int").alias("line"),
    )


STORED = f"""targets AS (SELECT DISTINCT {ID.format(c='source')} AS target_id, source AS domain FROM documents),
assets AS (SELECT doc_id AS asset_id, {ID.format(c='source')} AS target_id, concat('/', lang, '/', doc_id % 50) AS url,
  sha256(text) AS source_hash FROM documents),
source_files AS (SELECT DISTINCT sha256(text) AS hash, text AS content FROM documents),
findings AS (SELECT event_id AS finding_id, user_id AS asset_id, CASE event_type WHEN 'view' THEN 'SHADOW_API'
  WHEN 'click' THEN 'INTEL_MATCH' ELSE concat('XSS_', upper(event_type)) END AS type,
  ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'][event_id % 5 + 1] AS severity, props AS evidence,
  (event_id % 100)::INT AS line FROM events)"""


def with_stored(sql: str) -> str:
    return f"WITH {STORED}\n{sql}"


def domain_id(domain: str) -> int:
    import hashlib

    return int(hashlib.md5(domain.encode()).hexdigest()[:8], 16)


DOMAIN = "src0"
def submitted(spark, sf):
    """The submissions as JSON files, read back by the reader."""
    path = t.scratch(spark, "submissions")
    submissions(spark, sf).write.json(path)
    return B.as_sources(B.read_submissions(spark, path)).select("file", F.length("text").alias("chars"), F.md5("text").alias("md5"))


add(
    "read_submissions",
    submitted,
    "SELECT concat(source, '/doc', doc_id) AS file, length(text) AS chars, md5(text) AS md5 FROM documents",
)
add(
    "store_sources",
    lambda spark, sf: W.store_sources(
        submissions(spark, sf),
        t.read(spark, sf, "pages").select(F.sha2("html", 256).alias("hash"))
        .union(t.read(spark, sf, "benchmark").select(F.sha2("text", 256))),
    ).select("hash", F.length("content").alias("chars")),
    """SELECT DISTINCT sha256(text) AS hash, length(text) AS chars FROM documents WHERE text NOT IN (SELECT text FROM benchmark)
    AND text NOT IN (SELECT html FROM pages)""",
)
HOST = r"^https?://([^/]+)"
add(
    "upsert_targets",
    lambda spark, sf: W.upsert_targets(
        t.read(spark, sf, "pages").select(F.regexp_extract("url", HOST, 1).alias("domain")),
        targets(spark, sf).select("domain"),
    ).select("domain"),
    f"SELECT DISTINCT regexp_extract(url, {q(HOST)}, 1) AS domain FROM pages WHERE regexp_extract(url, {q(HOST)}, 1) "
    "NOT IN (SELECT source FROM documents)",
)
add(
    "link_assets",
    lambda spark, sf: W.link_assets(submissions(spark, sf), "scan-1").select("url", "source_hash"),
    "SELECT concat('doc', doc_id) AS url, sha256(text) AS source_hash FROM documents",
)
add(
    "duplicate_sources",
    lambda spark, sf: W.duplicate_sources(assets(spark, sf)),
    with_stored(
        "SELECT source_hash, count(*) AS copies, min(url) AS first_url, max(url) AS last_url FROM assets GROUP BY source_hash"
    ),
)
add(
    "target_findings",
    lambda spark, sf: W.newest(W.target_findings(stored_findings(spark, sf), assets(spark, sf)), "finding_id"),
    with_stored("SELECT f.*, target_id, url FROM findings f JOIN assets a USING (asset_id) ORDER BY finding_id DESC"),
)
add(
    "newest_targets",
    lambda spark, sf: W.newest(targets(spark, sf), "target_id"),
    with_stored("SELECT * FROM targets ORDER BY target_id DESC"),
)
add(
    "newest_findings",
    lambda spark, sf: W.newest(stored_findings(spark, sf), "finding_id", 100),
    with_stored("SELECT * FROM findings ORDER BY finding_id DESC LIMIT 100"),
)
add(
    "source_lookup",
    lambda spark, sf: W.source_lookup(source_files(spark, sf), assets(spark, sf), targets(spark, sf)),
    with_stored(
        "SELECT domain, url, content FROM (SELECT domain, url, max_by(source_hash, asset_id) AS hash FROM assets "
        "JOIN targets USING (target_id) GROUP BY ALL) JOIN source_files USING (hash)"
    ),
)
FETCHED = [(DOMAIN, f"/{lang}/{n}") for lang in ("en", "fr") for n in (0, 20, 40)] + [(DOMAIN, "/none"), ("none.example", "/en/0")]


def fetched(spark, sf):
    """Stored and missing assets, one after the other."""
    one = lambda domain, url: W.fetch_source(source_files(spark, sf), assets(spark, sf), targets(spark, sf), domain, url)
    return N.all_findings([one(d, u).withColumns({"domain": F.lit(d), "url": F.lit(u)}) for d, u in FETCHED])


add(
    "fetch_source",
    fetched,
    with_stored(f""", asked(domain, url) AS (VALUES {', '.join(f"({q(d)}, {q(u)})" for d, u in FETCHED)}),
      latest AS (SELECT domain, url, max_by(source_hash, asset_id) AS hash FROM assets JOIN targets USING (target_id) GROUP BY ALL)
      SELECT domain, url, coalesce(content, {q(W.NO_SOURCE)}) AS content FROM asked LEFT JOIN latest USING (domain, url)
      LEFT JOIN source_files USING (hash)""").replace("\n,", ",", 1),
)
add(
    "target_metrics",
    lambda spark, sf: N.target_metrics(W.target_findings(stored_findings(spark, sf), assets(spark, sf)), ["target_id"]),
    with_stored(
        "SELECT target_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (type = 'INTEL_MATCH') AS intel, "
        "count(*) FILTER (contains(type, 'SHADOW')) AS shadow FROM findings JOIN assets USING (asset_id) GROUP BY target_id"
    ),
)
OF_TARGET = f"asset_id IN (SELECT asset_id FROM assets WHERE target_id = {domain_id(DOMAIN)})"
add(
    "findings_of_target_semi",
    lambda spark, sf: W.findings_of_target_semi(stored_findings(spark, sf), assets(spark, sf), domain_id(DOMAIN)),
    with_stored(f"SELECT * FROM findings WHERE {OF_TARGET}"),
)
add(
    "clear_target",
    lambda spark, sf: W.clear_target(stored_findings(spark, sf), assets(spark, sf), domain_id(DOMAIN)),
    with_stored(f"SELECT * FROM findings WHERE NOT {OF_TARGET}"),
)
add(
    "delete_finding",
    lambda spark, sf: W.delete_finding(stored_findings(spark, sf), 17),
    with_stored("SELECT * FROM findings WHERE finding_id <> 17"),
)


def written(spark, sf):
    store = W.Store(spark, t.scratch(spark, "findings"))
    W.write_findings(store, stored_findings(spark, sf), "scan-1")
    W.write_findings(store, stored_findings(spark, sf), "scan-1")  # a repeated scan replaces itself
    return store.read("findings").groupBy("severity", "type").agg(F.count("*").alias("n"), F.max("line").alias("line"))


add(
    "write_findings",
    written,
    with_stored("SELECT severity, type, count(*) AS n, max(line) AS line FROM findings GROUP BY ALL"),
)


def wiped(spark, sf):
    store = W.Store(spark, t.scratch(spark, "wipe"))
    now = F.current_timestamp()
    store.append("targets", targets(spark, sf).withColumn("created_at", now))
    store.append("source_files", source_files(spark, sf).withColumn("created_at", now))
    store.write_scan("assets", assets(spark, sf), "scan-1")
    W.write_findings(store, stored_findings(spark, sf), "scan-1")
    W.wipe(store)
    counts = [store.read(n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in W.TABLES]
    return N.all_findings(counts)


add(
    "wipe",
    wiped,
    with_stored("SELECT 'source_files' AS name, count(*) AS n FROM source_files UNION ALL "
                "SELECT unnest(['targets', 'assets', 'findings']), 0"),
)


def deleted(spark, sf):
    """Deleting is noted: one finding, then those of a target, which are written again by a later scan of theirs."""
    store = W.Store(spark, t.scratch(spark, "deleted"))
    store.write_scan("assets", assets(spark, sf), "scan-1")
    W.write_findings(store, stored_findings(spark, sf), "scan-1")
    rows = store.read("findings")
    W.delete_from(store, rows.filter("line % 5 = 0").select("finding_id"))
    W.clear_target_from(store, domain_id(DOMAIN))
    left = store.read("findings").drop("created_at").withColumn("again", F.lit(False))
    theirs = W.findings_of_target_semi(rows, assets(spark, sf), domain_id(DOMAIN))
    back = W.Store(spark, t.scratch(spark, "deleted-again"))
    W.write_findings(back, theirs.limit(0), "scan-1")
    W.wipe(back)
    W.write_findings(back, stored_findings(spark, sf), "scan-1")
    shown = W.findings_of_target_semi(back.read("findings"), assets(spark, sf), domain_id(DOMAIN))
    both = left.unionByName(shown.drop("created_at").withColumn("again", F.lit(True)))
    return both.groupBy("again", "severity", "type").agg(F.count("*").alias("n"), F.max("line").alias("line"))


add(
    "delete_from_store",
    deleted,
    with_stored(f"""SELECT false AS again, severity, type, count(*) AS n, max(line) AS line FROM findings
    WHERE NOT {OF_TARGET} AND finding_id NOT IN (SELECT finding_id FROM findings WHERE line % 5 = 0) GROUP BY ALL
    UNION ALL SELECT true, severity, type, count(*), max(line) FROM findings WHERE {OF_TARGET} GROUP BY ALL"""),
)


def reported(spark, sf):
    path = t.scratch(spark, "report")
    W.write_report(findings(spark, sf).select("file", "line", "type", "severity"), path)
    return spark.read.schema("file STRING, line INT, type STRING, severity STRING").json(path)


add("write_report", reported, f"WITH {FOUND} SELECT file, line, type, severity FROM found")

# ── whole scans; their parts have SQL checks, tests compare the whole on small files ───────────
NEGATIVE_ROWS = "\nUNION ALL ".join(
    f"SELECT file, line, text, {q(r.rule_id)} AS type, {q(R.base_severity(r.rule_id))} AS b, NULL::VARCHAR AS m "
    f"FROM picked WHERE {negative_condition(r)}"
    for r in K.negative(K.default_rules())
)
NEAR_LINES = NEAR_TEXT.replace("near AS MATERIALIZED", "near_text AS MATERIALIZED")
V2 = f"""WITH RECURSIVE {t.CODE_LINES}, {SINGLE.replace("READ_AS", "read_lines")}, picked AS MATERIALIZED (SELECT * FROM code_lines WHERE {ELIGIBLE})
    {CONTEXT_SQL}, hits AS ({rule_rows()}
    UNION ALL {NEGATIVE_ROWS}), {RATED}{NEAR_LINES}, v2_found AS MATERIALIZED (
    SELECT file, line, type, severity, evidence, 0 AS phase FROM ({SINGLE_FLOWS.replace("READ_AS", "read_lines")})
    UNION ALL SELECT file, line, type, severity, evidence, 1 FROM ({SHOWN})
    UNION ALL SELECT file, line, type, severity, evidence, 2 FROM ({FIRST_CHAIN.replace("FROM near", "FROM near_text")}
      UNION ALL {OTHER_CHAINS.replace("FROM near", "FROM near_text")}))
    SELECT * FROM v2_found UNION ALL SELECT file, line, 'INTEL_KEYWORD', 'INFO', concat(chr(128270), ' \'\'', word, '\'\': ', {BARE}), 3
    FROM (SELECT *, {t.first_word('lower(text)', sorted(C.SECURITY_WORDS))} AS word FROM picked WHERE {t.matched('text', C.ASSIGNS)}) n
    WHERE word IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v2_found s WHERE s.file = n.file AND s.line = n.line)"""
add("scan_v2", lambda spark, sf: P.scan_v2(t.code_files(spark, sf)), V2)
add(
    "scan",
    lambda spark, sf: P.scan(t.code_files(spark, sf)).withColumn("path", F.array_join("path", ",")),
)


def code_submissions(spark, sf):
    return t.code_files(spark, sf).select(
        F.lit("code.example").alias("domain"), F.col("file").alias("filename"), F.col("text").alias("code")
    )


def stored_counts(store: W.Store) -> DataFrame:
    return N.all_findings(
        [store.read(n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("targets", "source_files", "assets")]
    )


def job(spark, sf):
    store = W.Store(spark, t.scratch(spark, "job"))
    P.run_job(code_submissions(spark, sf), store, "scan-1", engine="v2")
    return stored_counts(store)


add(
    "run_job",
    job,
    t.with_files("SELECT 'targets' AS name, 1 AS n UNION ALL SELECT 'source_files', count(DISTINCT text) FROM code_files "
                 "UNION ALL SELECT 'assets', count(*) FROM code_files"),
)

def found_by_url(store: W.Store) -> DataFrame:
    found = W.target_findings(store.read("findings"), store.read("assets"))
    return found.select(F.col("url").alias("file"), "line", "type", "severity", "evidence")


def job_findings(spark, sf):
    store = W.Store(spark, t.scratch(spark, "job-findings"))
    P.run_job(code_submissions(spark, sf), store, "scan-1", engine="v2")
    return found_by_url(store)


V2_SHOWN = f"SELECT file, line, type, severity, evidence FROM ({V2}) v"
add("run_job_findings", job_findings, V2_SHOWN)


# ── streams ────────────────────────────────────────────────────────────────────────────────────
def document_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet")
    return docs.select(F.col("source").alias("domain"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"),
                       F.col("text").alias("code"))


def ingested(spark, sf):
    store = W.Store(spark, t.scratch(spark, "ingest"))
    I.stream_ingest(document_stream(spark, sf), store, t.scratch(spark, "ingest-log"), engine="v2").awaitTermination()
    return stored_counts(store)


def ingested_findings(spark, sf):
    """Submissions of code as files of a stream, several batches of them."""
    folder = t.scratch(spark, "code-in")
    code_submissions(spark, sf).repartition(3, "filename").write.json(folder)
    store = W.Store(spark, t.scratch(spark, "ingest-code"))
    stream = I.read_submission_stream(spark, folder, files_per_batch=2)
    I.stream_ingest(stream, store, t.scratch(spark, "ingest-code-log"), engine="v2").awaitTermination()
    return found_by_url(store)


add("stream_ingest_findings", ingested_findings, V2_SHOWN)
INGESTED = """SELECT 'targets' AS name, count(DISTINCT source) AS n FROM documents UNION ALL SELECT 'source_files',
count(DISTINCT text) FROM documents UNION ALL SELECT 'assets', {copies}count(*) FROM documents"""
add("stream_ingest", ingested, INGESTED.format(copies=""))


def new_only(spark, sf):
    """The same texts twice: the second stream brings assets, but nothing that has to be scanned."""
    store = W.Store(spark, t.scratch(spark, "new"))
    I.stream_new_sources(document_stream(spark, sf), store, t.scratch(spark, "new-log")).awaitTermination()
    before = store.read("findings").count()
    again = document_stream(spark, sf).withColumn("domain", F.concat(F.lit("again."), "domain"))
    P_store = W.Store(spark, store.path)
    query = again.writeStream.foreachBatch(
        lambda batch, number: P.run_job(batch, P_store, f"again-{number}", new_only=True)
    )
    query.option("checkpointLocation", t.scratch(spark, "again-log")).trigger(availableNow=True).start().awaitTermination()
    added = store.read("findings").count() - before
    return stored_counts(store).unionByName(
        spark.range(1).select(F.lit("added_findings").alias("name"), F.lit(added).cast("long").alias("n"))
    )


add(
    "stream_new_sources",
    new_only,
    """SELECT 'targets' AS name, 2 * count(DISTINCT source) AS n FROM documents UNION ALL SELECT 'source_files',
    count(DISTINCT text) FROM documents UNION ALL SELECT 'assets', 2 * count(*) FROM documents
    UNION ALL SELECT 'added_findings', 0""",
)


def streamed_metrics(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    rows = events.select(
        F.col("user_id").alias("target_id"), F.upper("event_type").alias("type"),
        F.when(F.col("value") > 50, "CRITICAL").otherwise("LOW").alias("severity"),
    ).withColumn("type", F.when(F.col("type") == "VIEW", "SHADOW_API").otherwise(F.col("type")))
    folder = t.scratch(spark, "metrics")
    I.stream_target_metrics(rows, folder, t.scratch(spark, "metrics-log"), ["target_id"]).awaitTermination()
    return I.latest_metrics(spark, folder)


add(
    "stream_target_metrics",
    streamed_metrics,
    """SELECT user_id AS target_id, count(*) FILTER (value > 50) AS critical, 0 AS intel,
    count(*) FILTER (event_type = 'view') AS shadow FROM events GROUP BY user_id""",
)
