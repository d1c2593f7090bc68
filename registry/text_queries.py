"""Queries over whole texts: credentials, messages, encoded literals, short names."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fernsift.functions import text as T
from fernsift.operators import decode as D
from fernsift.operators import messaging as M
from fernsift.operators import naming as N
from fernsift.operators import secrets as S
from registry import tables as t
from registry.line_queries import MASK
from registry.tables import has_any, matched, q, re2, stripped, with_files, with_lines

QUERIES: dict[str, tuple] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = (query, sql)


def entropy(v: str) -> str:
    p = f"((length({v}) - length(replace({v}, c, ''))) / length({v})::DOUBLE)"
    return (
        f"CASE WHEN {v} = '' THEN 0.0 ELSE coalesce(list_sum(list_transform(list_distinct("
        f"string_split({v}, '')), lambda c: -{p} * log2({p}))), 0.0) END"
    )


def rounded(df):
    return df.withColumn("entropy", F.round("entropy", 4))


def extracted(source: str, patterns: dict[str, str], flags: str, keep: str) -> str:
    """All matches per pattern; the match number orders the matches of one line."""
    return "\nUNION ALL ".join(
        f"SELECT {keep}, {i} AS kind, {q(kind)} AS type, text, unnest(regexp_extract_all(text, "
        f"{q(flags + p)}, {min(re.compile(p).groups, 1)})) AS value FROM {source} WHERE regexp_matches(text, {q(flags + p)})"
        for i, (kind, p) in enumerate(patterns.items())
    )


PLACEHOLDER = has_any("value", S.PLACEHOLDER_WORDS, True)
LIKELY_CODE = (
    f"({has_any('value', S.CODE_WORDS, True)} OR len(list_distinct(string_split(value, ''))) < length(value) / 4)"
)
SHAPED = (
    f"file, line, type, {{value}} AS value, round({entropy('value')}, 4) AS entropy, {{confidence}} AS confidence, "
    f"{stripped('text')} AS context"
)
CONFIDENCE = f"CASE WHEN {entropy('value')} > 4.0 THEN 'HIGH' ELSE 'MEDIUM' END"
SECRETS_SQL = (
    f"SELECT {SHAPED.format(value=MASK.format(v='value'), confidence=CONFIDENCE)} FROM ("
    + extracted("code_lines", S.SECRET_PATTERNS, "(?i)", "file, line") + f") WHERE NOT {PLACEHOLDER}"
)
CONFIGS_SQL = f"SELECT {SHAPED.format(value='value', confidence=q('LOW'))} FROM (" + extracted(
    "code_lines", S.CONFIG_PATTERNS, "", "file, line"
) + ")"


def quoted_sql(source: str, threshold: float) -> str:
    found = (
        f"SELECT file, line, text, unnest(vs) AS value, unnest(range(len(vs))) AS nth, 'HIGH_ENTROPY_STRING' AS type "
        f"FROM (SELECT file, line, text, regexp_extract_all(text, {q(S.QUOTED)}, 1) AS vs FROM {source})"
    )
    return (
        f"SELECT {SHAPED.format(value=MASK.format(v='value'), confidence=q('MEDIUM'))} FROM ({found}) "
        f"WHERE NOT {PLACEHOLDER} AND NOT {LIKELY_CODE} AND {entropy('value')} > {threshold} "
        "QUALIFY row_number() OVER (PARTITION BY file, line ORDER BY nth) = 1"
    )


DOC_LINES = """doc_lines AS MATERIALIZED (SELECT file, unnest(range(1, len(parts) + 1))::INT AS line,
unnest(parts) AS text FROM (SELECT doc_id::VARCHAR AS file, string_split(text, chr(10)) AS parts FROM documents))"""

add(
    "scan_secrets",
    lambda spark, sf: rounded(S.scan_secrets(t.code_files(spark, sf))).drop("nth"),
    with_lines(SECRETS_SQL),
)
add(
    "scan_secrets_documents",
    lambda spark, sf: rounded(S.scan_secrets(t.documents(spark, sf))).drop("nth", "line", "context"),
    f"SELECT file, type, {MASK.format(v='value')} AS value, round({entropy('value')}, 4) AS entropy, "
    f"{CONFIDENCE} AS confidence FROM ("
    + extracted("(SELECT doc_id::VARCHAR AS file, text FROM documents)", S.SECRET_PATTERNS, "(?i)", "file")
    + f") WHERE NOT {PLACEHOLDER}",
)
add(
    "scan_secrets_corrected",
    lambda spark, sf: S.scan_secrets(t.code_files(spark, sf), compat=False).groupBy("type").agg(F.count("*").alias("hits")),
    with_lines(
        "SELECT type, count(*) AS hits FROM ("
        + extracted("code_lines", S.SECRET_PATTERNS | S.CORRECTED_PATTERNS, "(?i)", "file, line")
        + ") WHERE NOT (" + has_any("value", ["your_", "example", "placeholder", "changeme", "insert", "replace", "todo"], True)
        + " OR lower(value) IN ('secret', 'password', 'key', 'test')) GROUP BY type"
    ),
)
add(
    "scan_high_entropy",
    lambda spark, sf: (lambda f: rounded(S.scan_high_entropy(f, S.scan_secrets(f))).drop("nth"))(t.code_files(spark, sf)),
    with_lines(
        f"SELECT * FROM ({quoted_sql('code_lines', 4.5)}) h WHERE NOT EXISTS (SELECT 1 FROM ({SECRETS_SQL}) s "
        "WHERE s.file = h.file AND s.line = h.line)"
    ),
)
add(
    "scan_high_entropy_documents",
    lambda spark, sf: rounded(S.scan_high_entropy(t.documents(spark, sf), threshold=3.0)).drop("nth"),
    f"WITH {DOC_LINES} {quoted_sql('doc_lines', 3.0)}",
)
add(
    "secret_lines_anti",
    lambda spark, sf: (
        lambda f: rounded(S.secret_lines_anti(S.scan_configs(f), S.scan_secrets(f))).drop("nth")
    )(t.code_files(spark, sf)),
    with_lines(
        f"SELECT * FROM ({CONFIGS_SQL}) h WHERE NOT EXISTS (SELECT 1 FROM ({SECRETS_SQL}) s "
        "WHERE s.file = h.file AND s.line = h.line)"
    ),
)
add(
    "scan_configs",
    lambda spark, sf: rounded(S.scan_configs(t.code_files(spark, sf))).drop("nth"),
    with_lines(CONFIGS_SQL),
)
WORDS = "SELECT DISTINCT unnest(string_split(text, ' ')) AS value FROM documents"


def words(spark, sf):
    split = F.explode(F.split("text", " ")).alias("value")
    return t.spread(t.read(spark, sf, "documents").select("text")).select(split).distinct()


add(
    "shannon_entropy",
    lambda spark, sf: words(spark, sf).select("value", F.round(T.entropy(F.col("value")), 4).alias("entropy")),
    f"SELECT value, round({entropy('value')}, 4) AS entropy FROM ({WORDS})",
)
add(
    "is_placeholder",
    lambda spark, sf: words(spark, sf).select("value", S.is_placeholder(F.col("value")).alias("placeholder")),
    f"SELECT value, {PLACEHOLDER} AS placeholder FROM ({WORDS})",
)
add(
    "is_likely_code",
    lambda spark, sf: words(spark, sf).select("value", S.is_likely_code(F.col("value")).alias("code")),
    f"SELECT value, {LIKELY_CODE} AS code FROM ({WORDS})",
)
ENV_SQL = " UNION ".join(
    f"SELECT file, unnest(regexp_extract_all(text, {q(p)}, {min(re.compile(p).groups, 1)})) AS name FROM code_lines"
    for p in S.ENV_PATTERNS
)
add("extract_env_vars", lambda spark, sf: S.extract_env_vars(t.code_files(spark, sf)), with_lines(ENV_SQL))
add(
    "distinct_env_vars",
    lambda spark, sf: S.extract_env_vars(t.code_files(spark, sf)).select("name").distinct(),
    with_lines(f"SELECT DISTINCT name FROM ({ENV_SQL})"),
)
PROMOTED_SQL = f"""SELECT file, line, concat('SECRET_', type) AS type,
CASE WHEN contains(type, 'KEY') OR contains(type, 'TOKEN') THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
printf('%s: %s (entropy: %.2f)', type, value, full_entropy) AS evidence, confidence
FROM ({SECRETS_SQL.replace('SELECT file', f"SELECT {entropy('value')} AS full_entropy, file", 1)}) WHERE confidence = 'HIGH'"""
add(
    "promote_secrets",
    lambda spark, sf: S.promote_secrets(S.scan_secrets(t.code_files(spark, sf))),
    with_lines(PROMOTED_SQL),
)

# ── messages ───────────────────────────────────────────────────────────────────────────────────
# a body of up to two levels of braces, which is what the derived files have
BODY = r"([^{}]*\{(?:[^{}]|\{[^{}]*\})*\})"
HANDLERS_SQL = "\nUNION ALL ".join(
    f"SELECT file, line, {i} AS pattern, regexp_extract(text, {q(p + BODY)}, 1) AS body "
    f"FROM code_lines WHERE {matched('text', p)}"
    for i, p in enumerate(M.HANDLER_PATTERNS)
)
add(
    "postmessage_handlers",
    lambda spark, sf: M.postmessage_handlers(t.code_files(spark, sf)),
    with_lines(HANDLERS_SQL),
)


def advice(kind: str) -> str:
    return q(M.ADVICE[kind])


ORIGIN = """((contains(body, 'origin') AND (contains(body, '==') OR contains(body, 'includes')))
 OR (contains(body, '.origin') AND contains(body, 'if')) OR contains(body, 'e.origin'))"""
ISSUES = [
    (f"NOT {ORIGIN}", "NO_ORIGIN_CHECK", "CRITICAL",
     "concat('Message handler at line ', line, ' does not verify event.origin')"),
    (matched("body", r"origin\s*===?\s*['\"]?\*['\"]?"), "WILDCARD_ORIGIN", "CRITICAL",
     "'Message handler accepts messages from any origin (*)'"),
    (f"NOT {ORIGIN} AND NOT (contains(body, 'source') AND contains(body, '=='))", "NO_SOURCE_CHECK", "HIGH",
     "'Message handler does not verify event.source'"),
] + [
    (matched("body", p), "DANGEROUS_DATA_HANDLING", "CRITICAL", q(f"Message data used in dangerous sink: {use}"))
    for p, use in M.DANGEROUS_USES.items()
]
CHECKS_SQL = "\nUNION ALL ".join(
    f"SELECT file, line, {q(kind)} AS type, {q(severity)} AS severity, {evidence} AS evidence, "
    f"{advice(kind)} AS recommendation FROM ({HANDLERS_SQL}) WHERE {when}"
    for when, kind, severity, evidence in ISSUES
)
add(
    "check_handlers",
    lambda spark, sf: M.check_handlers(M.postmessage_handlers(t.code_files(spark, sf))),
    with_lines(CHECKS_SQL),
)
CALLS_SQL = f"""SELECT file, line, regexp_extract(text, {q(M.CALL_PATTERN)}, 1) AS target,
{stripped(f"regexp_extract(text, {q(M.CALL_PATTERN)}, 2)")} AS data,
{stripped(f"regexp_extract(text, {q(M.CALL_PATTERN)}, 3)")} AS origin
FROM code_lines WHERE {matched('text', M.CALL_PATTERN)}"""
add("postmessage_calls", lambda spark, sf: M.postmessage_calls(t.code_files(spark, sf)), with_lines(CALLS_SQL))
add(
    "check_calls",
    lambda spark, sf: M.check_calls(M.postmessage_calls(t.code_files(spark, sf))),
    with_lines(
        f"""SELECT file, line, 'WILDCARD_TARGET_ORIGIN' AS type,
        CASE WHEN {has_any('data', M.SENSITIVE_WORDS, True)} THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
        concat('postMessage uses ''*'' as target origin', CASE WHEN {has_any('data', M.SENSITIVE_WORDS, True)}
          THEN ' with sensitive data' ELSE '' END) AS evidence, {advice('WILDCARD_TARGET_ORIGIN')} AS recommendation
        FROM ({CALLS_SQL}) WHERE trim(origin, '''"') = '*'
        UNION ALL SELECT file, line, 'DYNAMIC_TARGET_ORIGIN', 'MEDIUM',
        concat('postMessage target origin is dynamic: ', origin), {advice('DYNAMIC_TARGET_ORIGIN')}
        FROM ({CALLS_SQL}) WHERE NOT regexp_matches(origin, '^[''"`]')"""
    ),
)

# ── encoded literals ───────────────────────────────────────────────────────────────────────────
ASCII_HEX = (
    "array_to_string(list_transform(regexp_extract_all(raw, '(?:x|u00)([0-9a-fA-F]{2})', 1), "
    "lambda h: chr(('0x' || h)::INT)), '')"
)
KIND_SQL = {
    "hex": (D.HEX, f"""concat('"', {ASCII_HEX}, '"')"""),
    "unicode": (D.UNICODE, f"concat(raw[1], {ASCII_HEX}, raw[-1])"),
    "bracket": (
        r"\w+\[(?:'\w+'|\"\w+\")\]",
        r"""regexp_replace(raw, '(\w+)\[[''"](\w+)[''"]\]', '\1.\2')""",
    ),
    "concat": (
        D.CHAIN,
        r"""concat('"', array_to_string(list_transform(regexp_extract_all(raw, '''[^''"]*''|"[^''"]*"'), """
        r"""lambda x: x[2:-2]), ''), '"')""",
    ),
    "base64": (D.BASE64, f"""concat('"', decode(from_base64(regexp_extract(raw, {q(D.BASE64)}, 1))), '"')"""),
    "charcode": (
        D.CHAR_CODES,
        r"""concat('"', array_to_string(list_transform(regexp_extract_all(raw, '\d+'), lambda c: chr(c::INT)), ''), '"')""",
    ),
}


def literal_rows(kind: str) -> str:
    pattern, decoded = KIND_SQL[kind]
    return (
        f"SELECT file, line, '{kind}' AS kind, raw, {decoded} AS decoded FROM (SELECT file, line, "
        f"unnest(regexp_extract_all(text, {re2(pattern)})) AS raw FROM code_lines)"
    )


def literals(kind: str):
    return lambda spark, sf: D.decode_literals(t.code_files(spark, sf)).filter(F.col("kind") == kind)


for _kind in KIND_SQL:
    add(f"decode_{_kind}", literals(_kind), with_lines(literal_rows(_kind)))
ARRAYS_SQL = f""", declared AS (SELECT file, regexp_extract(text, {re2(D.ARRAY)}, 1) AS name, max_by(regexp_extract_all(
  regexp_extract(text, {re2(D.ARRAY)}, 2), '[''"]([^''"]*)[''"]', 1), line) AS elements
  FROM code_lines WHERE {matched('text', re2(D.ARRAY)[1:-1].replace("''", "'"))} GROUP BY ALL),
used AS (SELECT file, line, unnest(regexp_extract_all(text, '\\w+\\[(?:0x)?\\d+\\]')) AS raw FROM code_lines)"""
ARRAY_ROWS = r"""SELECT u.file, u.line, 'array' AS kind, raw, concat('"', elements[regexp_extract(raw, '(\d+)\]', 1)::INT + 1],
 '"') AS decoded FROM used u JOIN declared d ON d.file = u.file AND d.name = regexp_extract(raw, '^(\w+)', 1)
 AND regexp_extract(raw, '(\d+)\]', 1)::INT < len(elements)"""
add("decode_array", literals("array"), f"WITH {t.CODE_LINES}{ARRAYS_SQL} {ARRAY_ROWS}")
add(
    "decode_literals",
    lambda spark, sf: D.decode_literals(t.code_files(spark, sf)),
    f"WITH {t.CODE_LINES}{ARRAYS_SQL} {ARRAY_ROWS} UNION ALL "
    + "\nUNION ALL ".join(literal_rows(kind) for kind in KIND_SQL),
)
# the seven steps in a row: each splits a text at its matches and puts what they decode to in between


def put_in(pattern: str, decoded: str, text: str) -> str:
    """The text with every match (``raw``) replaced by ``decoded``."""
    gaps, hits = f"regexp_split_to_array({text}, {re2(pattern)})", f"list_transform(regexp_extract_all({text}, {re2(pattern)}), lambda raw: {decoded})"
    return (
        f"CASE WHEN regexp_matches({text}, {re2(pattern)}) THEN array_to_string(list_transform(list_zip({gaps}, {hits}), "
        f"lambda z: concat(z[1], coalesce(z[2], ''))), '') ELSE {text} END"
    )


ACCESS_RAW = r"\w+\[(?:0x)?\d+\]"
FOUND_ARRAYS = f"""list_transform(list_zip(regexp_extract_all(text, {re2(D.ARRAY)}, 1), regexp_extract_all(text, {re2(D.ARRAY)}, 2)),
  lambda z: struct_pack(name := z[1], elements := regexp_extract_all(z[2], '[\'\'"]([^\'\'"]*)[\'\'"]', 1)))"""
LAST_ARRAYS = "list_filter(found, lambda a, i: NOT list_contains(list_transform(found[i + 1:], lambda b: b.name), a.name))"
ELEMENT = r"""(list_filter(arrays, lambda a: ends_with(regexp_extract(raw, '^(\w+)', 1), a.name) AND regexp_extract(raw, '(\d+)\]', 1)::INT < len(a.elements)))[1]"""
DECODED_ACCESS = rf"""CASE WHEN {ELEMENT} IS NULL THEN raw ELSE concat(left(regexp_extract(raw, '^(\w+)', 1),
  length(regexp_extract(raw, '^(\w+)', 1)) - length(({ELEMENT}).name)), '"', ({ELEMENT}).elements[regexp_extract(raw, '(\d+)\]', 1)::INT + 1], '"') END"""


def decoded_steps(source: str) -> str:
    """CTEs from ``source(file, text)`` to ``decoded(file, text)``."""
    out, at = [], source
    for kind in ["hex", "unicode", "array", "bracket", "concat", "base64", "charcode"]:
        if kind == "array":
            out.append(f"with_arrays AS MATERIALIZED (SELECT file, text, {LAST_ARRAYS} AS arrays FROM (SELECT file, text, {FOUND_ARRAYS} AS found FROM {at}))")
            pattern, decoded, at = ACCESS_RAW, DECODED_ACCESS, "with_arrays"
        else:
            pattern, decoded = KIND_SQL[kind]
        name = "decoded" if kind == "charcode" else f"after_{kind}"
        out.append(f"{name} AS MATERIALIZED (SELECT file, {put_in(pattern, decoded, 'text')} AS text FROM {at})")
        at = name
    return ",\n".join(out)


DECODED = f"WITH {t.CODE_FILES},\n{decoded_steps('code_files')}\n"
add("apply_decoded", lambda spark, sf: D.apply_decoded(t.code_files(spark, sf)), DECODED + "SELECT file, text FROM decoded")
add(
    "obfuscation_stats",
    lambda spark, sf: (lambda f: D.obfuscation_stats(f, D.apply_decoded(f)))(t.code_files(spark, sf)),
    DECODED + "SELECT file, c.text <> d.text AS changed, abs(length(c.text) - length(d.text))::INT AS chars_changed FROM code_files c JOIN decoded d USING (file)",
)

# ── short names ────────────────────────────────────────────────────────────────────────────────
SCORE_PARTS = []
for _usage, (_followers, _, _position) in N.USAGE_CLASSES.items():
    for _follower in _followers:
        SCORE_PARTS.append(
            f"SELECT file, '{_usage}' AS usage, 10 AS points, unnest(regexp_extract_all(text, "
            f"{q(rf'\b([a-z][a-z0-9]?){re.escape(_follower)}')}, 1)) AS name FROM code_files WHERE contains(text, {q(_follower)})"
        )
    if _position is not None:
        SCORE_PARTS.append(
            f"SELECT file, '{_usage}', 5, unnest(regexp_extract_all(text, {q(N.PARAMETER_LIST)}, {_position + 1})) FROM code_files"
        )
NOT_NAMES_SQL = ", ".join(q(n) for n in N.NOT_NAMES)
SCORES_SQL = (
    ", names AS (SELECT DISTINCT file, unnest(regexp_extract_all(text, '\\b([a-z][a-z0-9]?)\\b', 1)) AS name FROM code_files),\n"
    "scores AS MATERIALIZED (SELECT file, name, usage, sum(points)::BIGINT AS score FROM (" + "\nUNION ALL ".join(SCORE_PARTS)
    + f") JOIN names USING (file, name) WHERE name NOT IN ({NOT_NAMES_SQL}) GROUP BY ALL)"
)
add(
    "score_identifiers",
    lambda spark, sf: N.score_identifiers(t.code_files(spark, sf)),
    f"WITH {t.CODE_FILES}{SCORES_SQL} SELECT * FROM scores",
)
ORDER_SQL = "CASE usage " + " ".join(f"WHEN '{u}' THEN {i}" for i, u in enumerate(N.USAGE_CLASSES)) + " END"
POOL_SQL = "CASE usage " + " ".join(
    f"WHEN '{u}' THEN [{', '.join(q(n) for n in names)}]" for u, (_, names, _p) in N.USAGE_CLASSES.items()
) + " END"
add(
    "suggest_names",
    lambda spark, sf: N.suggest_names(N.score_identifiers(t.code_files(spark, sf))),
    f"""WITH {t.CODE_FILES}{SCORES_SQL}, best AS (SELECT * FROM scores
      QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY score DESC, {ORDER_SQL}) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY file, usage ORDER BY name) AS n FROM best WHERE score >= 5),
    clash AS (SELECT file, min(CASE WHEN usage = 'error' AND n = 3 THEN name END) AS e3,
      min(CASE WHEN usage = 'event' AND n = 1 THEN name END) AS v1 FROM ranked GROUP BY file),
    placed AS (SELECT r.*, coalesce(e3 IS NOT NULL AND (v1 IS NULL OR e3 < v1), false) AS taken FROM ranked r JOIN clash USING (file))
    SELECT file, name, usage, score, ({POOL_SQL})[CASE WHEN usage = 'event' AND taken THEN n + 1 ELSE n END] AS suggestion
    FROM placed WHERE NOT (usage = 'error' AND n = 3 AND NOT taken)
      AND ({POOL_SQL})[CASE WHEN usage = 'event' AND taken THEN n + 1 ELSE n END] IS NOT NULL""",
)
