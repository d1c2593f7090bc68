"""Queries over assignments, calls and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernsift.operators import assignments as A
from fernsift.operators import backtrack as B
from fernsift.operators import cspt as P
from fernsift.operators import dom as D
from fernsift.operators import single_pass as S
from fernsift.operators import taint as X
from fernsift.operators.context import SANITIZER_WORDS, USER_INPUT_WORDS
from fernsift.operators.findings import as_findings
from fernsift.operators.lines import explode_lines
from fernsift.functions import text as T
from fernsift.functions.fixpoint import pin
from registry import tables as t
from registry.line_queries import CODE
from registry.taint_sql import SYMBOLS
from registry.tables import first_word, has_any, matched, q, re2, stripped, with_files, with_lines

QUERIES: dict[str, tuple] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = (query, sql)


def group(column: str, pattern: str, i: int) -> str:
    return f"regexp_extract({column}, {re2(pattern)}, {i})"


PAIRS = q(r"(\w+)(?:\s*:\s*(\w+))?")
ASSIGNMENTS = f"""bare AS MATERIALIZED (SELECT file, line, {stripped('text')} AS b FROM code_lines WHERE {CODE}),
assigned AS MATERIALIZED (
SELECT file, line, 'declare' AS kind, {group('b', A.DECLARATION, 1)} AS name, NULL::VARCHAR AS prop,
  {group('b', A.DECLARATION, 2)} AS rhs FROM bare WHERE {matched('b', A.DECLARATION)}
UNION ALL SELECT file, line, 'assign', {group('b', A.ASSIGNMENT, 1)}, NULL, {group('b', A.ASSIGNMENT, 2)}
  FROM bare WHERE {matched('b', A.ASSIGNMENT)} AND NOT {matched('b', A.STATEMENT_STARTS)}
UNION ALL SELECT file, line, 'destructure', coalesce(nullif(al, ''), prop), prop, concat(src, '.', prop) FROM (
  SELECT file, line, src, unnest(regexp_extract_all(vs, {PAIRS}, 1)) AS prop, unnest(regexp_extract_all(vs, {PAIRS}, 2)) AS al
  FROM (SELECT file, line, {group('b', A.DESTRUCTURING, 1)} AS vs, {group('b', A.DESTRUCTURING, 2)} AS src
        FROM bare WHERE {matched('b', A.DESTRUCTURING)})))"""


def with_assigned(sql: str, more: str = "") -> str:
    return f"WITH {t.CODE_LINES}, {ASSIGNMENTS}{more}\n{sql}"


add(
    "extract_assignments",
    lambda spark, sf: A.extract_assignments(t.code_lines(spark, sf)),
    with_assigned("SELECT * FROM assigned"),
)
PARAMS = "list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '')"
FUNCTIONS = (
    f"functions AS MATERIALIZED (SELECT file, line, {group('b', A.FUNCTION, 1)} AS name, 'function' AS kind, "
    + PARAMS.format(c=group("b", A.FUNCTION, 2)) + f" AS params FROM bare WHERE {matched('b', A.FUNCTION)} UNION ALL "
    f"SELECT file, line, {group('b', A.ARROW, 1)}, 'arrow', " + PARAMS.format(c=group("b", A.ARROW, 2))
    + f" FROM bare WHERE {matched('b', A.ARROW)})"
)
add(
    "extract_functions",
    lambda spark, sf: A.extract_functions(t.code_lines(spark, sf)).withColumn("params", F.array_join("params", ",")),
    with_assigned("SELECT file, line, name, kind, array_to_string(params, ',') AS params FROM functions", ", " + FUNCTIONS),
)
add(
    "function_params",
    lambda spark, sf: A.function_params(A.extract_functions(t.code_lines(spark, sf))),
    with_assigned(
        "SELECT file, line, name, kind, unnest(params) AS param, unnest(range(len(params)))::INT AS position FROM functions",
        ", " + FUNCTIONS,
    ),
)
add(
    "assign_scopes",
    lambda spark, sf: A.assign_scopes(t.code_lines(spark, sf), block=16),
    with_lines(
        f"SELECT file, line, (count(*) FILTER ({CODE} AND {matched(stripped('text'), A.FUNCTION)}) "
        "OVER (PARTITION BY file ORDER BY line))::INT AS scope_ord FROM code_lines"
    ),
)
add(
    "extract_calls",
    lambda spark, sf: A.extract_calls(t.code_files(spark, sf)).withColumn("args", F.array_join("args", "|")),
    with_files(
        f"""SELECT file, nth::INT AS nth, name, array_to_string({PARAMS.format(c='inside').replace('trim(x)', stripped('x'))}, '|') AS args
        FROM (SELECT file, unnest(range(len(ns))) AS nth, unnest(ns) AS name, unnest(xs) AS inside FROM (SELECT file,
          regexp_extract_all(text, {q(A.CALL)}, 1) AS ns, regexp_extract_all(text, {q(A.CALL)}, 2) AS xs FROM code_files))
        WHERE name NOT IN ({', '.join(q(w) for w in A.NOT_CALLS)})"""
    ),
)

# ── taint ──────────────────────────────────────────────────────────────────────────────────────
SEEDS = f""", seeds AS MATERIALIZED (
SELECT file, line, name, {first_word('rhs', X.TAINT_SOURCES)} AS source FROM assigned WHERE kind = 'declare'
  AND {has_any('rhs', X.TAINT_SOURCES)}
UNION SELECT file, line, prop, rhs FROM (SELECT *, regexp_extract(rhs, '^(.*)\\.\\w+$', 1) AS src FROM assigned
  WHERE kind = 'destructure') WHERE {has_any('src', X.TAINT_SOURCES)}),
seeded AS MATERIALIZED (SELECT file, name, max_by(source, line) AS source, max(line) AS source_line FROM seeds GROUP BY ALL)"""


def tainted(spark, sf):
    """Visible tainted names after propagation, as input of the operators that come after it."""
    return X.tainted_symbols(X.analyze(t.code_files(spark, sf)).symbols).filter("visible")


def with_symbols(sql: str, more: str = "") -> str:
    return f"WITH RECURSIVE {t.CODE_FILES}, {ASSIGNMENTS}, {FUNCTIONS}{SYMBOLS}{more}\n{sql}"


def seeded(spark, sf):
    """Symbols by their latest seed alone."""
    return (
        X.seed_taint(t.code_lines(spark, sf))
        .groupBy("file", "name")
        .agg(F.max_by("source", "line").alias("source"), F.max("line").alias("source_line"))
        .withColumns(
            {"state": F.lit("TAINTED"), "visible": F.lit(True), "steps": F.array().cast("array<string>"),
             "scope_ord": F.lit(0)}
        )
    )


add(
    "seed_taint",
    lambda spark, sf: X.seed_taint(t.code_lines(spark, sf)),
    with_assigned("SELECT * FROM seeds", SEEDS),
)
add(
    "propagate_taint",
    lambda spark, sf: X.propagate_taint(t.code_files(spark, sf)).withColumn("steps", F.array_join("steps", "; ")),
    with_symbols("SELECT * FROM symbols"),
)
add(
    "mark_sanitized",
    lambda spark, sf: X.mark_sanitized(t.code_files(spark, sf)),
    with_symbols("SELECT file, scope_ord, name, visible FROM symbols WHERE state = 'SANITIZED'"),
)
add(
    "tainted_symbols",
    lambda spark, sf: X.tainted_symbols(X.analyze(t.code_files(spark, sf)).symbols)
    .select("file", "scope_ord", "name", "source", "source_line"),
    with_symbols("SELECT file, scope_ord, name, source, source_line FROM symbols WHERE state = 'TAINTED'"),
)


def calls_alone(spark, sf):
    """Taint through calls only: names of one seed each, functions and calls of the files."""
    files = pin(t.code_files(spark, sf))
    lines = explode_lines(files)
    symbols = pin(
        A.function_params(A.extract_functions(lines)).select("file", F.col("param").alias("name")).distinct()
        .join(seeded(spark, sf).drop("visible", "scope_ord"), ["file", "name"], "full")
        .select(
            "file", F.lit(0).alias("scope_ord"), "name", F.coalesce("state", F.lit("UNKNOWN")).alias("state"),
            "source", "source_line", F.coalesce("steps", F.array().cast("array<string>")).alias("steps"),
            F.lit(True).alias("visible"),
        )
    )
    scopes = lines.select("file", "line", F.lit(0).alias("scope_ord"))
    return X.propagate_calls(files, A.extract_functions(lines), scopes, symbols, 64)


CALLS = f"""reached AS (
SELECT file, name, -1::BIGINT AS moment FROM seeded
UNION SELECT r.file, h.name, h.moment FROM reached r JOIN hands h ON h.file = r.file AND h.arg = r.name
  AND h.moment > r.moment)"""
add(
    "propagate_calls",
    lambda spark, sf: calls_alone(spark, sf).filter("state = 'TAINTED'").select("file", "name"),
    f"""WITH RECURSIVE {t.CODE_FILES}, {ASSIGNMENTS}, {FUNCTIONS}{SEEDS},
    latest AS (SELECT file, name, max_by(params, line) AS params FROM functions GROUP BY ALL),
    called AS (SELECT file, nth, name AS fn, unnest(args) AS arg, unnest(range(len(args))) AS pos FROM (
      SELECT file, nth, name, {PARAMS.format(c='inside').replace('trim(x)', stripped('x'))} AS args FROM (
        SELECT file, unnest(range(len(ns))) AS nth, unnest(ns) AS name, unnest(xs) AS inside FROM (SELECT file,
          regexp_extract_all(text, {q(A.CALL)}, 1) AS ns, regexp_extract_all(text, {q(A.CALL)}, 2) AS xs FROM code_files))
      WHERE name NOT IN ({', '.join(q(w) for w in A.NOT_CALLS)}))),
    hands AS MATERIALIZED (SELECT c.file, arg, params[pos + 1] AS name, nth * 65536 + pos AS moment FROM called c
      JOIN latest l ON l.file = c.file AND l.name = c.fn WHERE pos < len(params) AND arg <> params[pos + 1]),
    {CALLS} SELECT DISTINCT file, name FROM reached""",
)
WORDS_ON = "unnest(list_distinct(regexp_extract_all(text, '\\w+')))"
FLOWS = f""", used AS (SELECT file, line, text, {WORDS_ON} AS name FROM code_lines WHERE {has_any('text', X.SINKS)}),
flows AS MATERIALIZED (SELECT u.file, k.sink, u.line AS sink_line, s.source, s.source_line, s.steps, u.name AS variable, u.text,
  {stripped('u.text')} AS evidence, len(list_filter(regexp_extract_all(u.text, '\\w+'),
  lambda w: w = u.name))::INT AS uses FROM used u JOIN seeded s ON s.file = u.file AND s.name = u.name
  JOIN (SELECT unnest([{', '.join(q(s) for s in X.SINKS)}]) AS sink) k ON contains(u.text, k.sink))"""


def flows(spark, sf):
    return X.analyze(t.code_files(spark, sf)).flows


add(
    "taint_flows",
    lambda spark, sf: flows(spark, sf).withColumn("steps", F.array_join("steps", "; ")).drop("text"),
    with_symbols("SELECT file, sink, sink_line, source, source_line, variable, steps, evidence, uses FROM flows", FLOWS),
)
add(
    "match_sinks",
    lambda spark, sf: X.match_sinks(t.code_lines(spark, sf), tainted(spark, sf)).drop("steps", "text"),
    with_symbols("SELECT file, sink, sink_line, source, source_line, variable, evidence, uses FROM flows", FLOWS),
)
add(
    "tainted_on_lines",
    lambda spark, sf: X.tainted_on_lines(t.code_lines(spark, sf), tainted(spark, sf)),
    with_symbols(
        f"SELECT w.file, w.line, w.name, s.source FROM (SELECT file, line, {WORDS_ON} AS name FROM code_lines) w "
        "JOIN seeded s ON s.file = w.file AND s.name = w.name"
    ),
)
add(
    "flows_with_line",
    lambda spark, sf: D.flows_with_line(flows(spark, sf).drop("text"), t.code_lines(spark, sf))
    .select("file", "sink_line", "sink", "variable", "text"),
    with_symbols("SELECT file, sink_line, sink, variable, text FROM flows", FLOWS),
)
SCRIPT = """, script AS (SELECT file, line, sum(len(regexp_extract_all(text, '(?i)<script[^>]*>'))
  - len(regexp_extract_all(text, '(?i)</script>'))) OVER (PARTITION BY file ORDER BY line) > 0 AS in_script FROM {lines})"""
CONTEXT = """CASE WHEN sink IN ('innerHTML', 'outerHTML') THEN CASE WHEN in_script THEN 'SCRIPT_CODE'
    WHEN lower(text) LIKE '%textarea%' THEN 'TEXTAREA' ELSE 'HTML_TEXT' END
  WHEN sink IN ('document.write', 'document.writeln') THEN CASE WHEN lower(text) LIKE '%<script%' THEN 'SCRIPT_CODE' ELSE 'HTML_TEXT' END
  WHEN sink IN ('eval', 'Function', 'setTimeout', 'setInterval') THEN CASE WHEN
    regexp_matches(text, '(setTimeout|setInterval)\\s*\\(\\s*[''"]') THEN 'SCRIPT_STRING' ELSE 'SCRIPT_CODE' END
  WHEN contains(sink, 'location') THEN CASE WHEN contains(text, '?') OR contains(text, 'search') THEN 'URL_PARAM' ELSE 'URL_PATH' END
  WHEN contains(text, '=') OR contains(text, '.setAttribute') THEN CASE WHEN regexp_matches(text, '=\\s*\\w')
    AND NOT regexp_matches(text, '=[''"]') THEN 'HTML_ATTR_UNQUOTED' ELSE 'HTML_ATTR' END
  WHEN lower(text) LIKE '%style%' THEN 'STYLE' ELSE 'UNKNOWN' END"""


def rated(i: int) -> str:
    cases = " ".join(
        f"WHEN '{name}' THEN {'NULL' if v[i] is None else (q(v[i]) if isinstance(v[i], str) else str(v[i]))}"
        for name, v in D.CONTEXTS.items()
    )
    return f"CASE context {cases} END"


DOM = f"""{SCRIPT.format(lines='code_lines')}, placed AS MATERIALIZED (SELECT f.*, {CONTEXT} AS context FROM flows f
  JOIN script s ON s.file = f.file AND s.line = f.sink_line),
dom AS (SELECT file, sink_line AS line, concat('XSS_', context) AS type, {rated(0)} AS severity, evidence, source, sink, context,
  {rated(1)} AS exploitable, {rated(2)} AS bypass_needed, 'CWE-79' AS cwe FROM placed)"""
add(
    "dom_context",
    lambda spark, sf: D.dom_context(flows(spark, sf), t.code_files(spark, sf)),
    with_symbols("SELECT * FROM dom", FLOWS + DOM),
)
add(
    "in_script_tag",
    lambda spark, sf: D.in_script_tag(t.code_files(spark, sf), block=16),
    with_lines("SELECT * FROM script").replace("\nSELECT * FROM script", SCRIPT.format(lines="code_lines") + "\nSELECT * FROM script"),
)
add(
    "in_script_tag_pages",
    lambda spark, sf: D.in_script_tag(t.pages(spark, sf)).groupBy("in_script").agg(F.count("*").alias("lines")),
    "WITH split AS (SELECT page_id AS file, unnest(range(len(parts))) AS line, unnest(parts) AS text FROM (SELECT page_id, "
    "string_split(html, chr(10)) AS parts FROM pages))" + SCRIPT.format(lines="split")
    + " SELECT in_script, count(*) AS lines FROM script GROUP BY in_script",
)

# ── requests ───────────────────────────────────────────────────────────────────────────────────
PART = "SELECT file, line, bare, text, {shape} AS shape, {nth} AS nth, {part} AS part, {url} AS url FROM c WHERE " + "{when}"
CSPT = f""", c AS MATERIALIZED (SELECT file, line, text, {stripped('text')} AS bare FROM code_lines WHERE {has_any('text', P.URL_SINKS)}),
parts AS MATERIALIZED ({PART.format(shape=0, nth=0, part=group('bare', P.CONCAT, 3),
  url=f"concat({group('bare', P.CONCAT, 2)}, ' + ', {group('bare', P.CONCAT, 3)})", when=matched('bare', P.CONCAT))}
UNION ALL SELECT file, line, bare, text, 1, unnest(range(len(xs))), unnest(xs), url FROM (SELECT *,
  {group('bare', P.TEMPLATE, 2)} AS url, regexp_extract_all({group('bare', P.TEMPLATE, 2)}, '\\$\\{{([^}}]+)\\}}', 1) AS xs
  FROM c WHERE {matched('bare', P.TEMPLATE)})
UNION ALL {PART.format(shape=2, nth=0, part=group('bare', P.DIRECT, 2),
  url=f"concat('Direct: ', {group('bare', P.DIRECT, 2)})", when=matched('bare', P.DIRECT))}),
named AS (SELECT p.file, p.line, p.shape, p.nth, min(s.name) AS name FROM parts p JOIN seeded s ON s.file = p.file
  AND CASE WHEN shape = 2 THEN p.part = s.name ELSE contains(p.part, s.name) END GROUP BY ALL),
judged AS (SELECT p.*, coalesce(CASE WHEN p.shape < 2 THEN {first_word('part', P.PATH_SOURCES)} END, n.name) AS source
  FROM parts p LEFT JOIN named n USING (file, line, shape, nth)
  QUALIFY source IS NOT NULL AND row_number() OVER (PARTITION BY file, line, source IS NULL ORDER BY p.shape, p.nth) = 1)"""
add(
    "cspt_scan",
    lambda spark, sf: P.cspt_scan(t.code_lines(spark, sf), tainted(spark, sf)).drop("recommendation", "cwe"),
    with_symbols(
        f"""SELECT file, line, concat('CSPT_', replace(upper(k.name), ' ', '_')) AS type,
        CASE shape WHEN 0 THEN CASE WHEN {has_any('bare', ['startsWith', 'indexOf', 'includes'])} THEN 'MEDIUM' ELSE 'HIGH' END
          WHEN 1 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, bare AS evidence, source, k.name AS sink,
        url AS url_construction, CASE shape WHEN 0 THEN CASE WHEN {has_any('bare', ['startsWith', 'indexOf', 'includes'])}
          THEN 'Concatenation with partial validation' ELSE 'String concatenation without validation' END
          WHEN 1 THEN 'Template literal interpolation' ELSE 'Direct user input as URL' END AS vulnerable_pattern
        FROM judged JOIN (SELECT unnest([{', '.join(q(k) for k in P.URL_SINKS)}]) AS sink,
          unnest([{', '.join(q(v) for v in P.URL_SINKS.values())}]) AS name) k ON contains(text, k.sink)""",
        CSPT,
    ),
)

# ── backtracking ───────────────────────────────────────────────────────────────────────────────
def sink_var(sink: str) -> str:
    word = T.alternation([sink])
    ways = [rf"{word}\s*=\s*(\w+)", rf"{word}\s*\(\s*(\w+)", rf"{word}(\w+)\s*\)"]
    found = ", ".join(f"nullif({group('text', w, 1)}, '')" for w in ways)
    return (
        f"SELECT file, {q(sink)} AS sink, line AS sink_line, coalesce({found}) AS variable FROM code_lines "
        f"WHERE contains(text, {q(sink)})"
    )


SINK_VARS = "sink_vars AS MATERIALIZED (SELECT * FROM (" + "\nUNION ALL ".join(map(sink_var, B.BACKTRACK_SINKS)) + ") WHERE variable IS NOT NULL)"
add(
    "find_sink_vars",
    lambda spark, sf: B.find_sink_vars(t.code_lines(spark, sf)),
    f"WITH {t.CODE_LINES}, {SINK_VARS} SELECT * FROM sink_vars",
)
TAILS = list(dict.fromkeys(s.split(".")[-1] for s in B.BACKTRACK_SOURCES))
DIRECT = "(" + has_any("name", B.BACKTRACK_SOURCES) + " OR " + " OR ".join(f"contains({q(x)}, name)" for x in TAILS) + ")"
BACKTRACK = f""", uses AS MATERIALIZED (SELECT DISTINCT file, name, ref, {has_any('rhs', B.BACKTRACK_SOURCES)} AS ends FROM (
  SELECT file, name, rhs, unnest(regexp_extract_all(rhs, '\\w+')) AS ref FROM assigned
  WHERE NOT (kind = 'assign' AND regexp_matches(name, '^(if|for)')))),
longest AS MATERIALIZED (SELECT file, count(DISTINCT name) AS n FROM uses GROUP BY file),
back AS (SELECT file, name, 0 AS depth FROM (SELECT file, variable AS name FROM sink_vars UNION SELECT file, ref FROM uses
    WHERE ref NOT IN ({', '.join(q(w) for w in B.SKIPPED_WORDS)}) AND NOT regexp_matches(ref, '^[0-9]')
    UNION SELECT file, name FROM uses WHERE ends) n WHERE {DIRECT} OR EXISTS (SELECT 1 FROM uses u WHERE u.file = n.file AND u.name = n.name AND u.ends)
  UNION SELECT u.file, u.name, b.depth + 1 FROM back b JOIN uses u ON u.file = b.file AND u.ref = b.name AND u.name <> u.ref
    JOIN longest l ON l.file = b.file WHERE b.depth < l.n AND u.ref NOT IN ({', '.join(q(w) for w in B.SKIPPED_WORDS)})),
depths AS (SELECT file, name, min(depth) AS depth FROM back GROUP BY ALL)"""
add(
    "backtrack",
    lambda spark, sf: B.backtrack(t.code_files(spark, sf)).select(
        "file", "sink", "sink_line", "variable", "is_tainted", F.size("path").alias("steps")
    ),
    f"""WITH RECURSIVE {t.CODE_LINES}, {ASSIGNMENTS}, {SINK_VARS}{BACKTRACK}
    SELECT v.file, v.sink, v.sink_line, v.variable, d.depth IS NOT NULL AS is_tainted, (coalesce(d.depth, 0) + 1)::INT AS steps
    FROM sink_vars v LEFT JOIN depths d ON d.file = v.file AND d.name = v.variable""",
)
NAMED = " ".join(
    f"WHEN contains(name, {q(x)}) OR contains({q(x.split('.')[-1])}, name) THEN {q(x)}" for x in B.BACKTRACK_SOURCES
)
READ = "NOT (kind = 'assign' AND regexp_matches(name, '^(if|for)'))"
WORDS = f"ref NOT IN ({', '.join(q(w) for w in B.SKIPPED_WORDS)}) AND NOT regexp_matches(ref, '^[0-9]')"
WAYS = f""", used AS MATERIALIZED (SELECT DISTINCT file, line, name, ref FROM (SELECT file, line, name, unnest(regexp_extract_all(rhs, '\\w+')) AS ref
  FROM assigned WHERE {READ}) WHERE {WORDS}),
direct AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT file, name, CASE {NAMED} END AS source FROM
  (SELECT file, variable AS name FROM sink_vars UNION SELECT file, ref FROM used) WHERE name <> '') WHERE source IS NOT NULL),
valued AS (SELECT file, name, arg_min(struct_pack(source := source, line := line, rhs := rhs), line) AS s FROM
  (SELECT file, name, line, rhs, {t.first_word('rhs', B.BACKTRACK_SOURCES)} AS source FROM assigned WHERE {READ}) v
  WHERE source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.file = v.file AND d.name = v.name) GROUP BY ALL),
ends AS MATERIALIZED (SELECT file, name, source, NULL::INT AS line, NULL::VARCHAR AS rhs FROM direct
  UNION ALL SELECT file, name, s.source, s.line, s.rhs FROM valued),
onward AS MATERIALIZED (SELECT u.file, u.name, min(struct_pack(line := u.line, ref := u.ref)) AS o FROM used u
  JOIN depths d ON d.file = u.file AND d.name = u.name AND d.depth > 0
  JOIN depths e ON e.file = u.file AND e.name = u.ref AND e.depth = d.depth - 1 GROUP BY ALL),
way AS (SELECT DISTINCT file, variable AS start, variable AS here, [variable] AS path, []::INT[] AS lines FROM sink_vars
  UNION ALL SELECT w.file, w.start, n.o.ref, list_append(w.path, n.o.ref), list_append(w.lines, n.o.line)
  FROM way w JOIN onward n ON n.file = w.file AND n.name = w.here),
found AS (SELECT w.file, w.start, w.path, CASE WHEN e.line IS NULL THEN w.lines ELSE list_append(w.lines, e.line) END AS lines, e.source, e.line, e.rhs
  FROM way w JOIN ends e ON e.file = w.file AND e.name = w.here)"""
LABELS = "concat_ws(',', " + ", ".join(f"CASE WHEN contains(rhs, {q(w)}) THEN {q(label)} END" for w, label in B.TRANSFORMATIONS.items()) + ")"
add(
    "backtrack_paths",
    lambda spark, sf: B.backtrack(t.code_files(spark, sf)).withColumns(
        {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("path", "path_lines", "transformations")}
    ),
    f"""WITH RECURSIVE {t.CODE_LINES}, {ASSIGNMENTS}, {SINK_VARS}{BACKTRACK}{WAYS}
    SELECT v.file, v.sink, v.sink_line, v.variable, f.file IS NOT NULL AS is_tainted, f.source,
      CASE WHEN f.file IS NULL THEN 0 ELSE coalesce(f.line, list_append(f.lines, v.sink_line)[1]) END AS source_line,
      array_to_string(coalesce(f.path, [v.variable]), ',') AS path,
      CASE WHEN f.file IS NULL THEN '' ELSE array_to_string(CASE WHEN f.line IS NULL THEN list_append(f.lines, v.sink_line) ELSE f.lines END, ',') END AS path_lines,
      CASE WHEN f.rhs IS NULL THEN '' ELSE {LABELS} END AS transformations
    FROM sink_vars v LEFT JOIN found f ON f.file = v.file AND f.start = v.variable""",
)
add(
    "enrich_with_backtrack",
    lambda spark, sf: B.enrich_with_backtrack(
        as_findings(D.dom_context(flows(spark, sf), t.code_files(spark, sf)), 6, "MEDIUM"),
        B.backtrack(t.code_files(spark, sf)),
    ).select("file", "line", "type", "sink", "confidence", F.col("path").isNotNull().alias("has_path")),
    f"""WITH RECURSIVE {t.CODE_FILES}, {ASSIGNMENTS}, {FUNCTIONS}{SYMBOLS}, {SINK_VARS}{BACKTRACK}{FLOWS}{DOM},
    ways AS (SELECT DISTINCT v.file, v.sink_line AS line, v.sink FROM sink_vars v
      JOIN depths d ON d.file = v.file AND d.name = v.variable)
    SELECT f.file, f.line, f.type, f.sink, CASE WHEN w.file IS NULL THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
      w.file IS NOT NULL AS has_path FROM dom f LEFT JOIN ways w ON w.file = f.file AND w.line = f.line AND w.sink = f.sink
    UNION ALL SELECT file, line, concat('TAINT_FLOW_', replace(upper(sink), '.', '_')), sink, 'HIGH', true FROM ways w
      WHERE NOT EXISTS (SELECT 1 FROM dom f WHERE f.file = w.file AND f.line = w.line AND f.sink = w.sink)""",
)
add(
    "label_transformations",
    lambda spark, sf: t.code_lines(spark, sf).select(
        "file", "line", F.array_join(B.label_transformations(F.col("text")), ",").alias("transformations")
    ),
    with_lines(
        "SELECT file, line, concat_ws(',', " + ", ".join(
            f"CASE WHEN contains(text, {q(w)}) THEN {q(label)} END" for w, label in B.TRANSFORMATIONS.items()
        ) + ") AS transformations FROM code_lines"
    ),
)

# ── the single-pass scan ───────────────────────────────────────────────────────────────────────
SINGLE = f"""READ_AS AS MATERIALIZED (SELECT file, line, text, coalesce(last_value(CASE WHEN {matched('text', S.HEADER)} THEN
    coalesce(nullif({group('text', S.HEADER, 1)}, ''), {group('text', S.HEADER, 2)}) END IGNORE NULLS)
    OVER (PARTITION BY file ORDER BY line), 'global') AS fn FROM code_lines WHERE {stripped('text')} <> '' AND {CODE}),
params AS (SELECT * FROM (SELECT file, line, fn, {stripped("string_split(split_part(regexp_replace(p, '[{{}}\\[\\]]|\\.\\.\\.', '', 'g'), '=', 1), ':')[-1]")} AS name FROM (SELECT file, line, fn,
    unnest(string_split({group('text', S.HEADER, 3)}, ',')) AS p FROM READ_AS WHERE {matched('text', S.HEADER)}))
    WHERE regexp_matches(name, '^\\w+$') AND {has_any('name', S.PARAMETER_WORDS, True)}),
declared AS MATERIALIZED (SELECT *, {has_any('value', USER_INPUT_WORDS, True)} AS outside, {has_any('value', SANITIZER_WORDS, True)} AS clean
    FROM (SELECT file, line, fn, {group('text', S.DECLARED, 1)} AS name, {group('text', S.DECLARED, 2)} AS value
    FROM READ_AS WHERE {matched('text', S.DECLARED)})),
reads AS MATERIALIZED (SELECT DISTINCT file, name, line * 2 + 1 AS moment, unnest(regexp_extract_all(value, '\\w+')) AS ref FROM declared),
reach AS (SELECT file, name, line * 2 + 1 AS moment FROM declared WHERE outside UNION SELECT file, name, line * 2 FROM params
    UNION SELECT e.file, e.name, e.moment FROM reach r JOIN reads e ON e.file = r.file AND e.ref = r.name AND e.moment > r.moment),
tainted AS MATERIALIZED (SELECT file, fn, name, line * 2 + 1 AS moment, line, value AS source, clean FROM declared d
    WHERE outside OR EXISTS (SELECT 1 FROM reach r WHERE r.file = d.file AND r.name = d.name AND r.moment = d.line * 2 + 1)
    UNION ALL SELECT file, fn, name, line * 2, line, concat('parameter: ', name), false FROM params),
active AS (SELECT *, lead(line) OVER (PARTITION BY file, fn, name ORDER BY moment) AS until FROM tainted),
places AS (SELECT file, line, text, fn, {WORDS_ON} AS name FROM READ_AS)"""
SINGLE_FLOWS = f"""SELECT p.file, p.line, 'TAINT_FLOW_HIGH' AS type, 'CRITICAL' AS severity, concat('Tainted ''', p.name, ''' → ', k.sink,
      ' | L', a.line, '→L', p.line, ' | ', {stripped('p.text')}) AS evidence, p.name AS variable, k.sink,
      a.source, a.line AS source_line, p.fn AS function, a.fn AS declared_in
    FROM places p JOIN active a ON a.file = p.file AND a.name = p.name AND a.line <= p.line AND (until IS NULL OR p.line < until)
    JOIN (SELECT unnest([{', '.join(q(s) for s in S.FLOW_SINKS)}]) AS sink) k ON contains(lower(p.text), lower(k.sink))
    WHERE NOT clean"""
add(
    "flow_scan_single_pass",
    lambda spark, sf: S.flow_scan_single_pass(t.code_lines(spark, sf)),
    f"""WITH RECURSIVE {t.CODE_LINES}, {SINGLE}
    {SINGLE_FLOWS}""".replace("READ_AS", "read_lines"),
)
