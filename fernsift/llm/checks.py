"""DuckDB SQL for those queries whose results SQL can express. Small whole tables only: pairs are found by plain joins."""

from __future__ import annotations

from fernsift.llm import line_templates, mixing, quality_cascade, url_vocabulary

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_BLANK = r"[ \t\n\x0b\f\r]+"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{_BLANK}'), lambda w: w <> '')"


def _hits(terms: tuple[str, ...]) -> str:
    """How many of the terms stand in the url as whole words."""
    return " + ".join(f"CAST(regexp_matches(low, '(^|[^\\pL\\pN]){t}([^\\pL\\pN]|$)') AS INT)" for t in terms)


MIXING = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({_words("text")}) AS size,
    -ln((CAST('0x' || substr(md5(concat('{mixing.SEED}:', doc_id)), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)!r})
      / (1.0 / (1 + 10 * len(regexp_extract_all(coalesce(text, ''), '[^\\p{{L}} \\t\\n\\x0b\\f\\r]')) / greatest(length(coalesce(text, '')), 1))) AS e
  FROM documents),
s AS MATERIALIZED (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (ARRAY[5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
-- sources by the level that fills them to their cap: the level holds where it is below that of the first left open
o AS (SELECT *, 2.0 * source_size / weight AS edge FROM s),
t AS (SELECT (1.5 * sum(source_size)) AS words FROM s),
g AS (SELECT o.source, o.edge, (t.words - coalesce(sum(2.0 * p.source_size) FILTER (WHERE p.edge < o.edge), 0))
        / sum(p.weight) FILTER (WHERE p.edge >= o.edge) AS level FROM o, o AS p, t GROUP BY o.source, o.edge, t.words),
l AS (SELECT coalesce(arg_min(level, edge) FILTER (WHERE level <= edge), 1e300) AS level FROM g),
targets AS (SELECT s.source, s.source_size, least(l.level * s.weight, 2.0 * s.source_size) AS target FROM s, l),
w AS (SELECT targets.*, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
r AS (SELECT d.doc_id, d.size, w.source_size, w.target, w.epochs, w.target - w.epochs * w.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.e, d.doc_id) AS upto
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND size > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

_REACH = """reach AS (SELECT id, id AS other FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
labelled AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

VECTORS = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x, v y WHERE x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
nodes AS (SELECT vec_id AS id FROM embeddings),
{_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM labelled
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(f"translate(text, {_UPPER}, {_LOWER})")} AS words FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id,
  unnest(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i : i + 3], ' '))) AS shingle
  FROM w WHERE len(words) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y USING (shingle)
  WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
nodes AS (SELECT doc_id AS id FROM documents),
{_REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept
FROM labelled LEFT JOIN sizes ON sizes.doc_id = id
"""

_RULES = ", ".join(f"({r.host!r}, {r.path!r}, {r.verdict!r})" for r in url_vocabulary.RULES)
URLS = f"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, coalesce(translate(url, {_UPPER}, {_LOWER}), '') AS low, translate(raw, {_UPPER}, {_LOWER}) AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}),
fits AS (SELECT page_id, arg_max(struct_pack(rule := rule_host || rule_path, verdict := rule_verdict), length(rule_host || rule_path)) AS best
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
hits AS (SELECT page_id, {_hits(url_vocabulary.STRICT)} AS hard, {_hits(url_vocabulary.SOFT)} AS mild FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict,
  CASE WHEN coalesce(hard, 0) > 0 OR coalesce(mild, 0) >= {url_vocabulary.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits USING (page_id) LEFT JOIN hits USING (page_id)
"""

_W = quality_cascade.WINDOW
QUALITY = f"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, {_words("text")} AS words FROM documents),
runs AS MATERIALIZED (SELECT doc_id, i, array_to_string(words[i : i + {_W - 1}], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {_W - 2})) AS i FROM w WHERE len(words) >= {_W})),
again AS (SELECT runs.doc_id, i FROM runs JOIN (SELECT doc_id, run FROM runs GROUP BY ALL HAVING count(*) > 1) USING (doc_id, run)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range({_W}) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^ \\t\\n\\x0b\\f\\r]') GROUP BY ALL),
equal AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n FROM lines GROUP BY doc_id),
top AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM w) GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, CAST(coalesce(equal.n, 0) AS BIGINT) AS n_dup_lines,
  coalesce(n_lines, 0) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(top.n, 0) AS n_top,
  strlen(regexp_replace(text, '[^a-zA-Z\\x{{80}}-\\x{{10FFFF}}]', '', 'g')) AS n_letters, strlen(regexp_replace(text, '{_BLANK}', '', 'g')) AS n_visible
  FROM w LEFT JOIN equal USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN top USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 16 * n_words
    OR 3 * n_top > n_words OR 10 * n_letters < 6 * n_visible) AS kept
FROM b
"""


_LEAST = line_templates.LEAST_DOCUMENTS
_DEPTH, _AGREE = line_templates.DEPTH, f"{line_templates.AGREE}::DOUBLE"


def _line_round(i: int) -> str:
    """Lines that agree with the template of their stretch, where that recurs; and what is left for the next round."""
    end = lambda k: f"CAST({_DEPTH} + floor((n - {_DEPTH}) * {k} / parts) AS INT)"
    return f"""each{i} AS MATERIALIZED (SELECT n, head, words, need, docs, k, CASE WHEN n <= {_DEPTH} THEN [] ELSE words[{end("k")} + 1 : {end("(k + 1)")}] END AS stretch
  FROM (SELECT *, unnest(range(CASE WHEN n <= {_DEPTH} THEN 1 ELSE parts END)) AS k FROM (SELECT *, CAST(n - ceil({_AGREE} * n) + 1 AS INT) AS parts FROM left{i}))),
weight{i} AS (SELECT n, head, k, stretch, sum(docs) AS weight FROM each{i} GROUP BY ALL HAVING sum(docs) > 1),
chosen{i} AS (SELECT n, words, need, docs, (arg_max(struct_pack(w := weight, g := concat_ws('|', n, head::VARCHAR, k, stretch::VARCHAR)), struct_pack(w := weight, k := -k))) AS top
  FROM each{i} JOIN weight{i} USING (n, head, k, stretch) GROUP BY n, words, need, docs),
grouped{i} AS MATERIALIZED (SELECT n, words, docs, concat('{i}|', top.g) AS template FROM chosen{i} WHERE top.w >= need),
fixed{i} AS (SELECT template, list(CASE WHEN 2 * top.docs >= every THEN top.word END ORDER BY i) AS fixed FROM (SELECT template, i, max(struct_pack(docs := docs, word := word)) AS top, sum(docs) AS every
  FROM (SELECT template, i, word, sum(docs) AS docs FROM (SELECT template, docs, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM grouped{i}) GROUP BY ALL) GROUP BY ALL) GROUP BY template),
agreed{i} AS MATERIALIZED (SELECT words, template FROM grouped{i} JOIN fixed{i} USING (template)
  WHERE len(list_filter(list_zip(words, fixed), lambda z: coalesce(z[1] = z[2], false))) >= {_AGREE} * n),
new{i} AS MATERIALIZED (SELECT words, template FROM agreed{i} SEMI JOIN (SELECT template FROM agreed{i} JOIN of_text USING (words) GROUP BY template, need HAVING count(DISTINCT body) >= need) USING (template)),
rest{i} AS MATERIALIZED (SELECT * FROM left{i} ANTI JOIN new{i} USING (words)),
left{i + 1} AS MATERIALIZED (SELECT * FROM rest{i} SEMI JOIN (SELECT n, head FROM rest{i} JOIN of_text USING (words, n, head, need) GROUP BY n, head, need HAVING count(DISTINCT body) >= need) USING (n, head))"""


_ROUNDS = 4  # further ones find nothing in these tables

LINES = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT DISTINCT CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS body, text FROM documents WHERE text IS NOT NULL),
l AS MATERIALIZED (SELECT body, place, line, list_transform({_words("line")}, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{line_templates.FIELD}' ELSE x END) AS words
  FROM (SELECT body, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM t)),
m AS MATERIALIZED (SELECT body, place, line, length(line) AS chars, words, len(words) AS n, words[1 : {_DEPTH}] AS head,
    CASE WHEN len(words) >= {line_templates.LONG_WORDS} THEN {min(line_templates.LONG_DOCUMENTS, _LEAST)} WHEN len(words) < {line_templates.SHORT_WORDS} THEN {line_templates.SHORT_DOCUMENTS} ELSE {_LEAST} END AS need
  FROM l WHERE len(words) > 0),
held AS MATERIALIZED (SELECT * FROM m SEMI JOIN (SELECT n, head FROM m GROUP BY n, head, need HAVING count(DISTINCT body) >= need) USING (n, head)),
of_text AS MATERIALIZED (SELECT DISTINCT n, head, words, need, body FROM held),
equal AS MATERIALIZED (SELECT n, head, words, need, count(*) AS docs FROM of_text GROUP BY ALL),
left0 AS MATERIALIZED (SELECT * FROM equal WHERE n >= {line_templates.SHORT_WORDS}),
{", ".join(_line_round(i) for i in range(_ROUNDS))},
one AS MATERIALIZED (SELECT words, arg_min(template, own) AS template FROM (SELECT words, concat('own|', words::VARCHAR) AS template, 1 AS own FROM equal WHERE docs >= need
  {" ".join(f"UNION ALL SELECT words, template, 0 FROM new{i}" for i in range(_ROUNDS))}) GROUP BY words),
recurring AS MATERIALIZED (SELECT body, place, chars, need, template FROM held JOIN one USING (words)),
beside AS MATERIALIZED (SELECT body, place, chars, line FROM m SEMI JOIN recurring USING (body)),
lengths AS MATERIALIZED (SELECT body, sum(chars) AS whole, log2(greatest(sum(chars), 1)) AS octave FROM beside GROUP BY body),
sized AS MATERIALIZED (SELECT recurring.*, unnest([2 * floor(octave), 2 * floor(octave + 0.5) + 1]) AS size FROM recurring JOIN lengths USING (body)),
led AS (SELECT DISTINCT body, other, place, chars FROM sized JOIN (SELECT template, size, min(body) AS other FROM sized GROUP BY ALL) USING (template, size) WHERE other <> body),
pairs AS MATERIALIZED (SELECT body, max(struct_pack(chars := chars, other := other)).other AS other FROM (SELECT body, other, sum(chars) AS chars FROM led GROUP BY ALL) GROUP BY body),
marks AS MATERIALIZED (SELECT DISTINCT body, place, chars, concat('w', line) AS mark FROM beside UNION SELECT body, place, chars, concat('t', template) FROM recurring),
shared AS (SELECT body, other, sum(chars) AS shared FROM (SELECT DISTINCT a.body, other, a.place, a.chars FROM pairs JOIN marks a USING (body) JOIN marks b ON b.body = other AND b.mark = a.mark) GROUP BY ALL),
links AS MATERIALIZED (SELECT s.body AS a, s.other AS b FROM shared s JOIN lengths x ON x.body = s.body JOIN lengths y ON y.body = s.other WHERE shared >= {line_templates.COPY}::DOUBLE * greatest(x.whole, y.whole)),
either AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM either UNION SELECT id, b FROM reach JOIN either ON other = a),
counted AS MATERIALIZED (SELECT recurring.*, coalesce(copy_of, body) AS text_id FROM recurring LEFT JOIN (SELECT id AS body, min(other) AS copy_of FROM reach GROUP BY id) USING (body)),
drops AS MATERIALIZED (SELECT DISTINCT body, place FROM recurring SEMI JOIN (SELECT template FROM counted GROUP BY template, need HAVING count(DISTINCT text_id) >= need) USING (template)),
kept AS (SELECT body, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE drops.place IS NULL), '') AS text, count(drops.place) AS n_dropped
  FROM l LEFT JOIN drops USING (body, place) GROUP BY body)
SELECT doc_id, coalesce(n_dropped, 0) AS n_dropped, kept.text FROM documents LEFT JOIN t ON t.text = documents.text LEFT JOIN kept USING (body)
"""

NEGATIVES = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5
"""

# CRC-32 byte by byte; its table is made by the rule of the polynomial
SPELLING = """
WITH RECURSIVE bits AS (SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END))),
    lambda x, b: xor(x >> 8, t[1 + (xor(x, b) & 255)]))) AS h FROM runs, crc WHERE doc_id IS NOT NULL
  UNION ALL SELECT run, times, 1 FROM runs WHERE doc_id IS NULL),
v AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT times,
    CASE WHEN h % 199 = 0 THEN concat(left(run, CAST(h % length(run) AS INT)), substr(run, CAST(h % length(run) AS INT) + 2)) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cut AS MATERIALIZED (SELECT DISTINCT word, n, i, concat(left(word, i), substr(word, i + 2)) AS short FROM (SELECT word, n, unnest(range(CAST(length(word) AS INT))) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.short = b.short AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON cut.short = v.word
  UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON cut.short = v.word),
best AS (SELECT word, count(*) AS n_near, first(struct_pack(w := other, n := other_n) ORDER BY other_n DESC, other) AS b FROM near GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * v.n THEN b.w END AS form, CASE WHEN b.n >= 5 * v.n THEN b.n END AS form_n
  FROM v LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT ways.word, f.word, f.form FROM ways JOIN f ON ways.further = f.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM ways WHERE further IS NULL) USING (word)
"""
