"""Queries over lines: shaping, rules, surroundings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernsift.functions import text as T
from fernsift.operators import context as C
from fernsift.operators import lines as L
from fernsift.operators import rules as R
from fernsift.operators import rule_catalog as K
from fernsift.sources import submissions as S
from registry import tables as t
from registry.tables import first_word, has_any, matched, q, re2, stripped, with_lines

QUERIES: dict[str, tuple] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = (query, sql)


SPLIT = """SELECT file, unnest(range(1, len(parts) + 1))::INT AS line, unnest(parts) AS text
FROM (SELECT {key}::VARCHAR AS file, {parts} AS parts FROM {table})"""

add(
    "explode_lines",
    lambda spark, sf: L.explode_lines(t.documents(spark, sf)),
    SPLIT.format(key="doc_id", parts="string_split(text, chr(10))", table="documents"),
)
add(
    "explode_lines_universal",
    lambda spark, sf: L.explode_lines(t.documents(spark, sf), mode="universal"),
    SPLIT.format(
        key="doc_id",
        parts="CASE WHEN raw[-1] = '' THEN raw[:-2] ELSE raw END",
        table="(SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}"
        "\\x{2028}\\x{2029}]') AS raw FROM documents)",
    ),
)

ELIGIBLE = (
    f"{stripped('text')} <> '' AND NOT regexp_matches({stripped('text')}, "
    f"'^(//|/\\*|\\*|#)') AND NOT {has_any('text', L.NOISE_WORDS, True)}"
)
CODE = f"NOT regexp_matches({stripped('text')}, '^(//|/\\*)')"
add(
    "eligible_lines",
    lambda spark, sf: L.eligible_lines(t.code_lines(spark, sf)),
    with_lines(f"SELECT * FROM code_lines WHERE {ELIGIBLE}"),
)
add(
    "code_lines",
    lambda spark, sf: L.code_lines(t.code_lines(spark, sf)),
    with_lines(f"SELECT * FROM code_lines WHERE {CODE}"),
)

# values of every length from 0 to 23
VALUES = "SELECT event_id, substr(md5(CAST(event_id AS STRING)), 1, CAST(event_id % 24 AS INT)) AS value FROM events"


def values(spark, sf):
    t.read(spark, sf, "events").createOrReplaceTempView("fernsift_events")
    return spark.sql(VALUES.replace("FROM events", "FROM fernsift_events"))


MASK = (
    "CASE WHEN length({v}) <= 8 THEN repeat('*', length({v})) ELSE concat(substr({v}, 1, 4), "
    "repeat('*', length({v}) - 8), right({v}, 4)) END"
)
add(
    "mask_secret",
    lambda spark, sf: values(spark, sf).select("event_id", T.mask_secret(F.col("value")).alias("masked")),
    f"SELECT event_id, {MASK.format(v='value')} AS masked FROM ({VALUES})",
)
add(
    "mask_match",
    lambda spark, sf: t.code_lines(spark, sf).select(
        "file", "line",
        L.mask_match(F.regexp_extract("text", r"[\"'].*[\"']", 0), T.strip(F.col("text"))).alias("evidence"),
    ),
    with_lines(
        f"SELECT file, line, CASE WHEN length(m) > 15 THEN concat(chr(128272), ' ', substr(m, 1, 8), '...', "
        f"right(m, 4), ' | ', bare) ELSE bare END AS evidence FROM (SELECT file, line, "
        f"regexp_extract(text, '[\"''].*[\"'']', 0) AS m, {stripped('text')} AS bare FROM code_lines)"
    ),
)
add(
    "evidence_flags",
    lambda spark, sf: t.read(spark, sf, "events").select(
        "event_id",
        L.evidence_flags(
            F.when(F.col("event_id") % 3 == 0, "HIGH").when(F.col("event_id") % 3 == 1, "CRITICAL").otherwise("LOW"),
            F.col("value") > 50, F.col("event_type") == "view", F.col("props"),
        ).alias("evidence"),
    ),
    """SELECT event_id, CASE WHEN event_id % 3 < 2 AND (value > 50 OR event_type <> 'view')
       THEN concat('[', concat_ws(', ', CASE WHEN value > 50 THEN 'USER_INPUT' END,
                                        CASE WHEN event_type <> 'view' THEN 'NO_SANITIZE' END), '] ', props)
       ELSE props END AS evidence FROM events""",
)


def shaped_findings(spark, sf):
    e = t.read(spark, sf, "events")
    steps = F.transform(F.sequence(F.lit(1), F.col("event_id") % 5 + 1), lambda i: F.concat(F.lit("v"), i.cast("string")))
    return e.select(
        "event_id",
        F.when(F.col("value") > 20, "HIGH").otherwise("LOW").alias("confidence"),
        F.col("props").alias("evidence"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("source"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise("eval").alias("sink"),
        F.when(F.col("event_id") % 3 != 0, steps).alias("path"),
        F.when(F.col("event_id") % 2 == 0, "CWE-79").alias("cwe"),
    )


add(
    "format_evidence",
    lambda spark, sf: L.format_evidence(shaped_findings(spark, sf)).select("event_id", "evidence"),
    """SELECT event_id, concat_ws(' | ',
         concat('[', CASE WHEN value > 20 THEN 'HIGH' ELSE 'LOW' END, '] ', props),
         CASE WHEN event_type <> 'error' AND event_id % 4 <> 0 THEN concat(event_type, ' → eval') END,
         CASE WHEN event_id % 3 <> 0 THEN concat('Path: ', array_to_string(
           list_transform(range(1, event_id % 5 + 2), lambda i: concat('v', i)), ' → ')) END,
         CASE WHEN event_id % 2 = 0 THEN 'CWE-79' END) AS evidence FROM events""",
)
add(
    "tag_language",
    lambda spark, sf: t.code_files(spark, sf).select(
        F.regexp_replace(
            "file", r"\.js$",
            F.get(F.array(*[F.lit(x) for x in (".js", ".JSX", ".ts", ".tsx", ".mjs", ".vue", "")]),
                  (F.length("text") % 7)),
        ).alias("name")
    ).select("name", S.tag_language(F.col("name")).alias("language")),
    t.with_files(
        "SELECT name, CASE lower(regexp_extract(name, '(\\.[^./]+)$', 1)) WHEN '.ts' THEN 'typescript' "
        "WHEN '.tsx' THEN 'tsx' ELSE 'javascript' END AS language FROM (SELECT regexp_replace(file, '\\.js$', "
        "['.js', '.JSX', '.ts', '.tsx', '.mjs', '.vue', ''][length(text) % 7 + 1]) AS name FROM code_files)"
    ),
)

# ── rules ──────────────────────────────────────────────────────────────────────────────────────
RULES = K.positive(K.default_rules())


def rule_sql(rules, where: str, columns: str = "file, line, {id} AS rule_id") -> str:
    """One scan of the lines per rule; DuckDB compiles a constant pattern once."""
    return "\nUNION ALL ".join(
        f"SELECT {columns.format(id=q(r.rule_id), sev=q(r.severity or R.base_severity(r.rule_id)))} "
        f"FROM picked WHERE {matched('text', K.FLAGS + r.pattern)}"
        for r in rules
    ) if where is None else (
        f", picked AS MATERIALIZED (SELECT * FROM code_lines WHERE {where})\n" + rule_sql(rules, None, columns)
    )


add(
    "scan_rules",
    lambda spark, sf: R.scan_rules(t.code_lines(spark, sf), RULES).select("file", "line", "rule_id", "base_severity"),
    with_lines(rule_sql(RULES, ELIGIBLE, "file, line, {id} AS rule_id, {sev} AS base_severity"))
    .replace("code_lines\n, picked", "code_lines, picked"),
)
add(
    "scan_rules_table",
    lambda spark, sf: R.scan_rules(t.code_lines(spark, sf), R.literal_table(spark, RULES)).select(
        "file", "line", "rule_id", "base_severity"
    ),
    with_lines(rule_sql(RULES, ELIGIBLE, "file, line, {id} AS rule_id, {sev} AS base_severity"))
    .replace("code_lines\n, picked", "code_lines, picked"),
)
add(
    "scan_rules_documents",
    lambda spark, sf: R.scan_rules(L.explode_lines(t.documents(spark, sf)), RULES)
    .groupBy("rule_id").agg(F.count("*").alias("hits")),
    "WITH split AS (" + SPLIT.format(key="doc_id", parts="string_split(text, chr(10))", table="documents")
    + f"), picked AS MATERIALIZED (SELECT * FROM split WHERE {ELIGIBLE}) SELECT rule_id, count(*) AS hits FROM ("
    + rule_sql(RULES, None, "{id} AS rule_id") + ") GROUP BY rule_id",
)
add(
    "scan_rules_pages",
    lambda spark, sf: R.scan_rules(L.explode_lines(t.pages(spark, sf)), RULES, eligible_only=False)
    .groupBy("rule_id").agg(F.count("*").alias("hits")),
    "WITH picked AS MATERIALIZED (" + SPLIT.format(key="page_id", parts="string_split(html, chr(10))", table="pages")
    + ") SELECT rule_id, count(*) AS hits FROM (" + rule_sql(RULES, None, "{id} AS rule_id") + ") GROUP BY rule_id",
)
# RE2 has no look-around: a rule becomes what must match and what must not. That is the same on lines
# in which the first part occurs once; tests compare all 25 rules with Python's regexes.

LOCAL_URL = r"['\"]https?://(?:localhost|127\.0\.0\.1)"
NEGATIVE_SQL = {
    "XSS_INNERHTML_DIRECT": (r"\.innerHTML\s*=", r"\.innerHTML\s*=['\"]<?\s*['\"]"),
    "EVAL_FUNCTION_DIRECT": (r"Function\s*\(\s*['\"`]", r"new\sFunction\s*\(\s*['\"`]"),
    "EVAL_SCRIPT_SRC": (r"script\.src\s*=", r"script\.src\s*=['\"]https?://"),
    "REDIRECT_LOCATION": (r"(?:window\.)?location\s*=", r"location\s*=" + LOCAL_URL),
    "REDIRECT_LOCATION_HREF": (r"location\.href\s*=", r"location\.href\s*=" + LOCAL_URL),
    "REDIRECT_LOCATION_REPLACE": (r"location\.replace\s*\(", r"location\.replace\s*\(" + LOCAL_URL),
    "REDIRECT_LOCATION_ASSIGN": (r"location\.assign\s*\(", r"location\.assign\s*\(" + LOCAL_URL),
    "REDIRECT_WINDOW_OPEN": (r"window\.open\s*\(", rf"window\.open\s*\((?:{LOCAL_URL}|['\"]_)"),
    "COOKIE_NO_SECURE": (r"document\.cookie\s*=\s*['\"]", None),
}


def negative_condition(rule) -> str:
    must, must_not = NEGATIVE_SQL.get(rule.rule_id) or (
        rule.pattern[: rule.pattern.rindex("(?!")],
        rule.pattern.replace("(?!", "(?:"),
    )
    condition = matched("text", K.FLAGS + must)
    if must_not:
        condition += f" AND NOT {matched('text', K.FLAGS + must_not)}"
    return condition


def negative_sql(rule) -> str:
    return f"SELECT file, line, {q(rule.rule_id)} AS rule_id FROM picked WHERE {negative_condition(rule)}"


add(
    "scan_rules_negative",
    lambda spark, sf: R.scan_rules(t.code_lines(spark, sf), K.negative(K.default_rules())).select("file", "line", "rule_id"),
    f"WITH {t.CODE_LINES}, picked AS MATERIALIZED (SELECT * FROM code_lines WHERE {ELIGIBLE})\n"
    + "\nUNION ALL ".join(map(negative_sql, K.negative(K.default_rules()))),
)
SPANNING = [r for r in RULES if r"[\s\S]" in r.pattern and r.family in ("POSTMSG", "WS", "STORAGE", "DESER")]
add(
    "scan_texts",
    lambda spark, sf: R.scan_texts(t.code_files(spark, sf), SPANNING).select("file", "rule_id").distinct(),
    t.with_files(
        "\nUNION ALL ".join(
            f"SELECT file, {q(r.rule_id)} AS rule_id FROM code_files WHERE {matched('text', K.FLAGS + r.pattern)}"
            for r in SPANNING
        )
    ),
)

NOT_IN_NAME = r"(?:^|[^\w$.])"
STRUCTURAL_SQL = {
    "TS_DANGEROUS_EVAL": "regexp_matches(regexp_replace(text, '(?i)new\\s(eval|Function)', 'x.f', 'g'), "
    + q("(?i)" + NOT_IN_NAME + r"(?:eval|Function)\s*\(") + ")",
    "TS_DANGEROUS_INNERHTML": matched("text", r"(?i)\.(?:innerHTML|outerHTML)\s*=(?:[^=]|$)"),
    "TS_DOCUMENT_WRITE": matched("text", "(?i)" + NOT_IN_NAME + r"document\.(?:write|writeln)\s*\("),
    "TS_LOCATION_ASSIGNMENT": matched(
        "text", "(?i)" + NOT_IN_NAME + r"(?:location|(?:location|window)\.(?:href|assign|replace))\s*=(?:[^=]|$)"
    ),
    "TS_SETTIMEOUT_STRING": matched("text", "(?i)" + NOT_IN_NAME + r"(?:setTimeout|setInterval)\s*\(\s*['\"]"),
    "TS_POSTMESSAGE_HANDLER": matched("text", r"(?i)\.addEventListener\s*\(\s*['\"][^'\"]*message"),
    "TS_FETCH_CALL": matched("text", "(?i)" + NOT_IN_NAME + r"(?:fetch|axios)\s*\(\s*[^)\s]"),
    "TS_PROTOTYPE_ACCESS": matched("text", r"(?i)\.(?:__proto__|prototype|constructor)\b"),
}
STRUCTURAL_PARTS = "\nUNION ALL ".join(
    f"SELECT file, line, {q(r.rule_id)} AS type, {q(r.severity)} AS severity, "
    f"{stripped('text')} AS evidence, 'MEDIUM' AS confidence FROM code_lines "
    f"WHERE {STRUCTURAL_SQL[r.rule_id]}"
    for r in K.STRUCTURAL_RULES
)
add(
    "scan_structural_rules",
    lambda spark, sf: R.scan_structural_rules(t.code_lines(spark, sf)),
    with_lines(STRUCTURAL_PARTS),
)
add(
    "custom_scan",
    lambda spark, sf: R.custom_scan(t.code_lines(spark, sf), r"total\d\s*\+=", "SUMS", "LOW")
    .select("file", "line", "rule_id", "base_severity"),
    with_lines("SELECT file, line, 'SUMS' AS rule_id, 'LOW' AS base_severity FROM code_lines "
               "WHERE regexp_matches(text, '(?i)total\\d\\s*\\+=')"),
)
USER_RULES = [K.Rule("ORG_DRAW", r"\bdraw\("), K.Rule("ORG_ROLE", r"role\d", "HIGH")]
add(
    "user_rules",
    lambda spark, sf: R.scan_rules(t.code_lines(spark, sf), USER_RULES).select("file", "line", "rule_id", "base_severity"),
    with_lines(rule_sql(USER_RULES, ELIGIBLE, "file, line, {id} AS rule_id, {sev} AS base_severity"))
    .replace("code_lines\n, picked", "code_lines, picked"),
)
CLASSES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
add(
    "classify_severity",
    lambda spark, sf: t.read(spark, sf, "events").select(
        "event_id",
        R.classify_severity(
            F.get(F.array(*map(F.lit, CLASSES)), (F.col("event_id") % 4).cast("int")),
            F.when(F.col("event_id") % 5 == 0, "const Auth = 1").otherwise(F.col("props")),
            F.col("value") > 30, F.col("event_type").isin("view", "click"), F.col("user_id") % 2 == 0,
        ).alias("severity"),
    ),
    """SELECT event_id, CASE WHEN u2 = 'HIGH' AND v AND s THEN 'MEDIUM' WHEN u2 = 'CRITICAL' AND v AND s THEN 'HIGH'
         ELSE u2 END AS severity FROM (
       SELECT *, CASE WHEN a AND u1 = 'LOW' THEN 'MEDIUM' WHEN a AND u1 = 'MEDIUM' THEN 'HIGH' ELSE u1 END AS u2 FROM (
       SELECT *, CASE WHEN i AND NOT s AND b = 'LOW' THEN 'MEDIUM' WHEN i AND NOT s AND b = 'MEDIUM' THEN 'HIGH'
         ELSE b END AS u1 FROM (
       SELECT event_id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][event_id % 4 + 1] AS b, event_id % 5 = 0 AS a,
         value > 30 AS i, event_type IN ('view', 'click') AS s, user_id % 2 = 0 AS v FROM events)))""",
)
add(
    "dedup_line_findings",
    lambda spark, sf: (
        lambda hits: R.dedup_line_findings(hits.unionByName(hits)).select("file", "line", "rule_id", "finding_key")
    )(R.scan_rules(t.code_lines(spark, sf), K.STRUCTURAL_RULES, eligible_only=False)),
    with_lines(
        f"SELECT DISTINCT s.file, s.line, type AS rule_id, md5(concat(type, ':', s.line, ':', "
        f"{stripped('c.text')})) AS finding_key FROM ({STRUCTURAL_PARTS}) s "
        "JOIN code_lines c ON c.file = s.file AND c.line = s.line"
    ),
)

# ── surroundings ───────────────────────────────────────────────────────────────────────────────
FRAME = "(PARTITION BY file ORDER BY line ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)"
FLAGS_SQL = {
    "has_user_input": has_any("text", C.USER_INPUT_WORDS, True),
    "has_sanitization": has_any("text", C.SANITIZER_WORDS, True),
    "has_validation": matched("text", C.VALIDATES),
    "in_try_catch": matched("text", C.TRIES),
    "in_auth_function": matched("text", C.AUTHENTICATES),
    "async_context": matched("text", C.AWAITS),
}
FRAMEWORK_SQL = "CASE " + " ".join(f"WHEN {matched('text', p)} THEN '{n}'" for n, p in C.FRAMEWORKS.items()) + " END"
VAR_SQL = f"CASE WHEN {FLAGS_SQL['has_user_input']} THEN nullif(regexp_extract(text, {re2(C.DECLARES)}, 1), '') END"
CONTEXT_SQL = (
    ", marked AS MATERIALIZED (SELECT file, line, "
    + ", ".join(f"{sql} AS f_{n}" for n, sql in FLAGS_SQL.items())
    + f", {FRAMEWORK_SQL} AS f_framework, {VAR_SQL} AS f_var FROM code_lines), near AS (SELECT file, line, "
    + ", ".join(f"bool_or(f_{n}) OVER {FRAME} AS {n}" for n in FLAGS_SQL)
    + f", first_value(f_framework IGNORE NULLS) OVER {FRAME} AS framework,"
    + f" array_agg(f_var) OVER {FRAME} AS names FROM marked)"
)
add(
    "line_context",
    lambda spark, sf: C.line_context(t.code_lines(spark, sf))
    .withColumn("tainted_vars", F.array_join("tainted_vars", ",")),
    with_lines(
        "SELECT file, line, " + ", ".join(FLAGS_SQL)
        + ", framework, array_to_string(list_sort(list_distinct(names)), ',') AS tainted_vars FROM near"
    ).replace("\nSELECT file, line, has", CONTEXT_SQL + "\nSELECT file, line, has", 1),
)
add(
    "context_tainted_vars",
    lambda spark, sf: C.context_tainted_vars(t.code_lines(spark, sf)),
    with_lines("SELECT DISTINCT file, line, unnest(list_distinct(names)) AS name FROM near")
    .replace("\nSELECT DISTINCT", CONTEXT_SQL + "\nSELECT DISTINCT", 1),
)
add(
    "line_context_conversations",
    lambda spark, sf: C.line_context(
        t.read(spark, sf, "conversations").select(
            F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("int").alias("line"), "text"
        ),
        window=2, user_input=["the", "und", "que"],
    ).select("file", "line", "has_user_input"),
    """SELECT conv_id::VARCHAR AS file, turn::INT AS line, bool_or(lower(text) LIKE '%the%' OR lower(text) LIKE '%und%'
         OR lower(text) LIKE '%que%') OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 2 PRECEDING
         AND 2 FOLLOWING) AS has_user_input FROM conversations""",
)
NEAR_TEXT = f""", kept AS (SELECT * FROM code_lines WHERE {ELIGIBLE}),
near AS MATERIALIZED (SELECT file, line, text, array_to_string(array_agg(text) OVER (PARTITION BY file ORDER BY line
  ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), ' ') AS near FROM kept)
"""
OTHER_CHAINS = "\nUNION ALL ".join(
    f"SELECT file, line, {q(name)} AS type, {q(severity)} AS severity, concat(chr(128279), ' ', {q(what + ': ')},"
    f" text) AS evidence FROM near WHERE {matched('near', '(?is)' + pattern)}"
    for pattern, name, severity, what in C.CHAINS[1:]
)
add(
    "detect_chains",
    lambda spark, sf: C.detect_chains(t.code_lines(spark, sf), C.CHAINS[1:]),
    with_lines(NEAR_TEXT + OTHER_CHAINS).replace("code_lines)\n,", "code_lines),", 1),
)
# RE2 has no back-references. A repeated name repeats its first character, and the pattern is content with that, so the
# first chain holds exactly where some word character comes again.
AGAIN = "|".join(f"{c}[^\\n]*{c}" for c in "abcdefghijklmnopqrstuvwxyz0123456789_")
REPEATED = C.CHAINS[0][0].replace(r"(\w+)[^\n]*\1", f"(?:{AGAIN})")
FIRST_CHAIN = (
    f"SELECT file, line, {q(C.CHAINS[0][1])} AS type, {q(C.CHAINS[0][2])} AS severity, concat(chr(128279), ' ', "
    f"{q(C.CHAINS[0][3] + ': ')}, text) AS evidence FROM near WHERE {matched('near', '(?is)' + REPEATED)}"
)
add(
    "detect_chains_repeated_name",
    lambda spark, sf: C.detect_chains(t.code_lines(spark, sf), C.CHAINS[:1]),
    with_lines(NEAR_TEXT + FIRST_CHAIN).replace("code_lines)\n,", "code_lines),", 1),
)
add(
    "intel_keywords",
    lambda spark, sf: C.intel_keywords(t.code_lines(spark, sf), R.scan_structural_rules(t.code_lines(spark, sf))),
    with_lines(
        f"""SELECT file, line, 'INTEL_KEYWORD' AS type, 'INFO' AS severity,
        concat(chr(128270), ' ''', word, ''': ', {stripped('text')}) AS evidence FROM (
        SELECT *, {first_word('lower(text)', sorted(C.SECURITY_WORDS))} AS word FROM code_lines
        WHERE {ELIGIBLE} AND {matched('text', C.ASSIGNS)}) n
        WHERE word IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({STRUCTURAL_PARTS}) s
          WHERE s.file = n.file AND s.line = n.line)"""
    ),
)
