"""SQL check of the forward flow of untrusted values: a recursive query that reads each file in order.

The operators are joins over edge tables and fixpoints; this reads one statement of a file at a time and carries the file's symbols
along, so it shares no step with them. Every statement is an event with a place: phase 1 are declarations and function heads in
line order, phase 2 plain assignments, read again from the first as long as a reading changes something, phase 3 arguments of
calls in text order. The last event of a phase only moves on.
"""

from __future__ import annotations

from fernsift.operators import assignments as A
from fernsift.operators import taint as X
from registry.tables import first_word, has_any, q, re2, stripped

SYMBOL = "STRUCT(k INT, name VARCHAR, state VARCHAR, source VARCHAR, line INT, steps VARCHAR[])"
LAST = 2**31 - 1


def params(inside: str) -> str:
    return f"list_filter(list_transform(string_split({inside}, ','), lambda x: {stripped('x')}), lambda x: x <> '')"


def event(source: str, where: str = "true", **columns: str) -> str:
    """One kind of event; columns that are not given are empty."""
    empty = {
        "phase": "1", "line": "line", "sub": "0", "kind": "''", "name": "''", "word": "NULL::VARCHAR", "washes": "false",
        "own": "false", "refs": "[]::VARCHAR[]", "heads": "[]::VARCHAR[]", "home": f"{LAST}",
    }
    return f"SELECT file, {', '.join(f'{v} AS {k}' for k, v in (empty | columns).items())} FROM {source} WHERE {where}"


WORDS = "regexp_extract_all(rhs, '\\w+')"
VALUE = r"regexp_extract(rhs, '^(.*)\.\w+$', 1)"
EVENTS = "\nUNION ALL ".join(
    [
        event("functions", "kind = 'function'", kind="'enter'", heads="list_distinct(params)"),
        event("assigned", "kind = 'declare'", kind="'declare'", name="name", word=first_word("rhs", X.TAINT_SOURCES),
              washes=has_any("rhs", X.SANITIZERS), own=f"list_contains({WORDS}, name)", refs=f"list_filter({WORDS}, lambda r: r <> name)"),
        event("assigned", "kind = 'destructure'", kind="'declare'", sub="1", name="prop",
              word=f"CASE WHEN {has_any(VALUE, X.TAINT_SOURCES)} THEN rhs END"),
        event("assigned", "kind = 'assign'", phase="2", kind="'assign'", name="name", washes=has_any("rhs", X.SANITIZERS), refs=WORDS),
        event("handed", phase="3", line="nth", sub="place", kind="'call'", name="param", refs="[arg]", home="home"),
        event("live, (SELECT unnest([1, 2, 3]) AS p)", phase="p", line=f"{LAST}", kind="'end'"),
    ]
)
# what the references of an event mean now, and the symbol that it may change
SEEN = """SELECT s.file, s.phase, s.pos, s.moved, s.k, s.syms, e.kind, e.name, e.line, e.word, e.washes, e.own, e.heads,
  list_filter(list_transform(e.refs, lambda r: list_filter(s.syms, lambda x: x.name = r)[-1]), lambda x: x.state = 'TAINTED') AS hits,
  list_filter(s.syms, lambda x: x.name = e.name AND x.k <= e.home)[-1] AS old
FROM state s JOIN events e ON e.file = s.file AND e.phase = s.phase AND e.pos = s.pos"""


def symbol(k: str, name: str, state: str = "'UNKNOWN'", source: str = "NULL::VARCHAR", line: str = "NULL::INT", steps: str = "[]::VARCHAR[]") -> str:
    return f"struct_pack(k := {k}, name := {name}, state := {state}, source := {source}, line := {line}, steps := {steps})"


def from_hit(at: str) -> dict[str, str]:
    hit = f"hits[{at}]"
    return {"source": f"{hit}.source", "line": f"{hit}.line",
            "steps": f"list_append({hit}.steps, concat('from ', {hit}.name, ' at L', line::VARCHAR))"}


CLEAN = "washes AND (len(hits) > 0 OR (own AND word IS NOT NULL))"
DECLARED = f"""CASE WHEN {CLEAN} THEN {symbol('k', 'name', "'SANITIZED'")}
    WHEN len(hits) > 0 THEN {symbol('k', 'name', "'TAINTED'", **from_hit('-1'))}
    WHEN word IS NOT NULL THEN {symbol('k', 'name', "'TAINTED'", 'word', 'line::INT')} ELSE {symbol('k', 'name')} END"""
HOME = "coalesce(old.k, k)"
ASSIGNED = f"""CASE WHEN len(hits) = 0 THEN {symbol(HOME, 'name')} WHEN washes THEN {symbol(HOME, 'name', "'SANITIZED'")}
    ELSE {symbol(HOME, 'name', "'TAINTED'", **from_hit('1'))} END"""
HANDED = symbol("old.k", "old.name", "'TAINTED'", "hits[1].source", "hits[1].line", "hits[1].steps")


def replaced(new: str) -> str:
    return f"list_transform(syms, lambda x: CASE WHEN x.name = old.name AND x.k = old.k THEN {new} ELSE x END)"


STATE = f"""state AS (SELECT file, 1 AS phase, 1::BIGINT AS pos, false AS moved, 0 AS k, []::{SYMBOL}[] AS syms FROM live
UNION ALL SELECT file,
  CASE WHEN kind <> 'end' OR (phase = 2 AND moved) THEN phase ELSE phase + 1 END,
  CASE WHEN kind = 'end' THEN 1 ELSE pos + 1 END,
  CASE kind WHEN 'end' THEN false WHEN 'assign' THEN moved OR (len(hits) > 0 AND (old IS NULL OR old.state = 'UNKNOWN'
    OR (old.state = 'SANITIZED' AND NOT washes))) ELSE moved END,
  CASE kind WHEN 'enter' THEN k + 1 ELSE k END,
  CASE kind WHEN 'enter' THEN list_concat(syms, list_transform(heads, lambda h: {symbol('k + 1', 'h')}))
    WHEN 'declare' THEN list_append(list_filter(syms, lambda x: NOT (x.name = name AND x.k = k)), {DECLARED})
    WHEN 'assign' THEN CASE WHEN old IS NULL THEN list_append(syms, {ASSIGNED})
      WHEN old.state = 'TAINTED' OR len(hits) = 0 THEN syms ELSE {replaced(ASSIGNED)} END
    WHEN 'call' THEN CASE WHEN old IS NULL OR len(hits) = 0 OR (old.name = hits[1].name AND old.k = hits[1].k) THEN syms
      ELSE {replaced(HANDED)} END
    ELSE syms END
FROM ({SEEN}))"""

#: CTEs after ``code_files``, ``assigned`` and ``functions``, up to ``symbols`` and ``seeded`` (visible tainted names)
SYMBOLS = f""", live AS MATERIALIZED (SELECT file FROM code_files WHERE {has_any('text', X.TAINT_SOURCES)}),
scopes AS (SELECT file, line, (sum(enters) OVER (PARTITION BY file ORDER BY line RANGE UNBOUNDED PRECEDING))::INT AS k
  FROM (SELECT file, line, max((kind = 'function')::INT) AS enters FROM functions GROUP BY ALL)),
homes AS MATERIALIZED (SELECT f.file, f.name, max_by(struct_pack(params := params, home := k), f.line) AS h FROM functions f
  JOIN scopes s ON s.file = f.file AND s.line = f.line GROUP BY ALL),
called AS (SELECT file, nth, name, unnest(args) AS arg, unnest(range(len(args))) AS place FROM (
  SELECT file, nth, name, {params('inside')} AS args FROM (SELECT file, unnest(range(len(ns))) AS nth, unnest(ns) AS name, unnest(xs) AS inside
    FROM (SELECT file, regexp_extract_all(text, {re2(A.CALL)}, 1) AS ns, regexp_extract_all(text, {re2(A.CALL)}, 2) AS xs FROM code_files))
  WHERE name NOT IN ({', '.join(q(w) for w in A.NOT_CALLS)}))),
handed AS (SELECT c.file, nth, place, arg, h.params[place + 1] AS param, h.home AS home FROM called c
  JOIN homes h ON h.file = c.file AND h.name = c.name WHERE place < len(h.params)),
events AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY file, phase ORDER BY line, sub) AS pos FROM ({EVENTS})
  WHERE file IN (SELECT file FROM live)),
{STATE},
symbols AS MATERIALIZED (SELECT file, x.k AS scope_ord, x.name AS name, x.state AS state, x.source AS source, x.line AS source_line,
  array_to_string(x.steps, '; ') AS steps, x.k = max(x.k) OVER (PARTITION BY file, x.name) AS visible
  FROM (SELECT file, unnest(syms) AS x FROM state WHERE phase = 4)),
seeded AS MATERIALIZED (SELECT * FROM symbols WHERE visible AND state = 'TAINTED')"""
