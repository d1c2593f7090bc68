"""Input tables of the registered queries, as one SQL text that Spark and DuckDB both run.

The driver's tables hold no source code, so code is derived from ``events``: every event becomes one
line, and 64 neighbouring events make one file, which bounds the size of a file at any scale.
In the templates ``{n}`` and ``{p}`` are small numbers, ``{h}`` is a hash, ``~`` a single quote and
``^`` a backslash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_FILE = 64

TEMPLATES = [
    "const v{n} = location.hash;",
    "const v{n} = v{p}.trim();",
    "v{n} = v{p};",
    "v{n} = DOMPurify.sanitize(v{p});",
    "el.innerHTML = v{n};",
    "fetch(\"/api/\" + v{n});",
    "const k = \"ghp_{h}{H}\";",
    "const a = \"AKIA{H}\";",
    "w.postMessage(token{n}, \"*\");",
    "function load{n}(a, v{p}) {",
    "  load{p}(v{n}, 1);",
    "const { v{n}, id: v{p} } = req.query;",
    "window.addEventListener(~message~, function(e) { el.innerHTML = e.data; });",
    "window.onmessage = function(e) { if (e.origin === ~https://a.b~) { go(e.data); } };",
    "parent.postMessage({ id: v{n} }, target{p});",
    "const s{n} = \"^x65^x76^x61^x6c\";",
    "const u{n} = ~^u0065^u0076~;",
    "var _0x{n} = [~eval~, \"alert{p}\", ~innerHTML~];",
    "window[_0x{n}[{p}]](v{p});",
    "const c{n} = ~ev~ + ~al~ + \"{p}\";",
    "const b{n} = atob(~ZXZhbA==~);",
    "const d{n} = String.fromCharCode(101, 118, 97, 10{p});",
    "try {",
    "const [s{n}, set{n}] = React.useState({p});",
    "if (typeof v{n} === ~string~) { v{p} = v{n}; }",
    "// password of v{n} = location.hash",
    "import x{n} from ~node_modules/x~;",
    "  document.write(v{n});",
    "setTimeout(~run({p})~, 10);",
    "eval(v{n});",
    "location.href = ~/x?next=~ + v{n};",
    "fetch(`/api/${v{n}}/x`);",
    "axios.get(v{n});",
    "const cfg{n} = { password: ~hunter2{h}~ };",
    "const db{n} = \"postgres://u:p4ss{n}@db.internal:5432/x\";",
    "const dev = process.env.API_URL_{n} || ~http://localhost:8080~;",
    "const g{n} = (a, v{p}) => { return a.body; };",
    "localStorage.setItem(~auth_token~, v{n});",
    "const o{n} = JSON.parse(v{p});",
    "Object.assign(cfg{n}, JSON.parse(req.body));",
    "el.setAttribute(~onclick~, v{n});",
    "const t{n} = \"{m}\";",
    "db.query(\"SELECT * FROM t WHERE id = \" + v{n});",
    "async function checkAuth{n}(req, res) {",
    "",
    "<script src=\"/s{n}.js\">",
    "</script>",
    "const cache{p} = v{n};",
    "$(~#out~).html(v{n});",
    "const { v{p} } = data.body;",
    "  g{p}(v{n}, v{p});",
    "el.style.cssText = `color: ${v{n}}`;",
    "const title{n} = document.title;",
    "const account{n} = \"a{p}\";",
    "let total{n} = {p};",
    "total{n} += {p};",
    "}",
    "const list{n} = [{n}, {p}];",
    "list{n}.sort();",
    "return total{n};",
    "const size{n} = list{n}.length;",
    "const day{n} = {p};",
    "const role{n} = \"viewer\";",
    "const left{n} = size{p};",
    "draw(total{n});",
    "const bank{n} = \"b{p}\";",
    "window[~eval~](v{n}); cfg[\"name{p}\"] = total{n};",
    "call(_0x{n}[0], _0x{p}[1], _0x0[2], _0x1[2], _0x2[0], _0x3[0x1]);",
]


def _sql_text(template: str) -> str:
    """A SQL expression for one template."""
    parts = {"n": "n", "p": "p", "h": "h", "H": "upper(substr(h, 1, 16))", "m": "m"}
    out, rest = [], template
    while rest:
        at = min((rest.find("{%s}" % k) for k in parts if "{%s}" % k in rest), default=-1)
        if at < 0:
            out.append("'" + rest + "'")
            break
        if at:
            out.append("'" + rest[:at] + "'")
        out.append(parts[rest[at + 1]])
        rest = rest[at + 3 :]
    return "concat(" + ", ".join(out or ["''"]) + ")"


def code_lines_sql(events: str = "events") -> str:
    cases = "\n".join(f"WHEN {i} THEN {_sql_text(t)}" for i, t in enumerate(TEMPLATES))
    step = len(TEMPLATES)
    return f"""
SELECT file, line, translate(raw, '~^', concat(chr(39), chr(92))) AS text FROM (
SELECT concat('f', CAST(CAST(floor(event_id / {LINES_PER_FILE}) AS BIGINT) AS STRING), '.js') AS file,
       CAST(event_id % {LINES_PER_FILE} + 1 AS INT) AS line,
       CASE (event_id + CAST(floor(event_id / {step}) AS BIGINT) * 5) % {step} {cases} END AS raw
FROM (SELECT event_id, md5(CAST(event_id AS STRING)) AS h,
             concat(translate(substr(md5(CAST(event_id AS STRING)), 1, 14), '0123456789abcdef', 'gh1jZkVm7nQpwRtX'),
                    translate(substr(md5(CAST(event_id AS STRING)), 15, 14), '0123456789abcdef', 'KyuLsWBDF3G5HJ8a'),
                    translate(substr(md5(CAST(event_id + 1 AS STRING)), 1, 14), '0123456789abcdef', 'CNvxTEM2zbcdfq6P')) AS m,
             CAST((event_id * 7 + CAST(floor(event_id / 11) AS BIGINT)) % 6 AS STRING) AS n,
             CAST((event_id * 3 + CAST(floor(event_id / 7) AS BIGINT)) % 6 AS STRING) AS p
      FROM {events}) e) x"""


def _made_sql(events: str) -> str:
    """The rows of ``code_lines_sql`` for Spark: the template of a line is looked up by its number and its parts are put in.

    One branch per template is more code than the JVM compiles. ``$`` becomes ``!``, as Spark puts variables in for ``${...}`` in SQL.
    """
    quoted = ", ".join("'" + x.replace("$", "!") + "'" for x in TEMPLATES)
    of = lambda part: ", ".join(str(i) for i, x in enumerate(TEMPLATES) if "{%s}" % part in x)
    step = len(TEMPLATES)
    translated = lambda of, start, to: f"translate(substr(md5(CAST({of} AS STRING)), {start}, 14), '0123456789abcdef', '{to}')"
    m = ", ".join([translated("event_id", 1, "gh1jZkVm7nQpwRtX"), translated("event_id", 15, "KyuLsWBDF3G5HJ8a"),
                   translated("event_id + 1", 1, "CNvxTEM2zbcdfq6P")])
    hashed = "replace(replace(t, '{h}', md5(CAST(event_id AS STRING))), '{H}', upper(substr(md5(CAST(event_id AS STRING)), 1, 16)))"
    return f"""
SELECT concat('f', CAST(CAST(floor(event_id / {LINES_PER_FILE}) AS BIGINT) AS STRING), '.js') AS file,
       CAST(event_id % {LINES_PER_FILE} + 1 AS INT) AS line,
       translate(CASE WHEN k IN ({of('h')}, {of('H')}) THEN {hashed} WHEN k IN ({of('m')}) THEN replace(t, '{{m}}', concat({m})) ELSE t END,
                 '~^!', concat(chr(39), chr(92), '$')) AS text
FROM (SELECT event_id, k, replace(replace(get(array({quoted}), CAST(k AS INT)),
             '{{n}}', CAST((event_id * 7 + CAST(floor(event_id / 11) AS BIGINT)) % 6 AS STRING)),
             '{{p}}', CAST((event_id * 3 + CAST(floor(event_id / 7) AS BIGINT)) % 6 AS STRING)) AS t
      FROM (SELECT event_id, (event_id + CAST(floor(event_id / {step}) AS BIGINT) * 5) % {step} AS k FROM {events}) e) x"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input of fewer splits than cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(read(spark, sf_dir, "events").select("event_id")).createOrReplaceTempView("fernsift_events")
    made = spark.sql(_made_sql("fernsift_events"))
    # a stored table has its text as a column; the one-element array keeps filters from copying
    # the long expression that makes it here
    return made.select("file", "line", F.explode(F.array("text")).alias("text"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sources(file, text)``: at most ``LINES_PER_FILE`` lines are put together per file."""
    ordered = F.sort_array(F.collect_list(F.struct("line", "text")))
    return (
        code_lines(spark, sf_dir)
        .groupBy("file")
        .agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("file"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "pages").select("page_id", "html")).select(
        F.col("page_id").cast("string").alias("file"), F.col("html").alias("text")
    )


# DuckDB side of the same tables.
CODE_LINES = f"code_lines AS MATERIALIZED ({code_lines_sql()})"
CODE_FILES = f"""{CODE_LINES},
code_files AS MATERIALIZED (SELECT file, string_agg(text, chr(10) ORDER BY line) AS text FROM code_lines GROUP BY file)"""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes, in the shared folder that the cluster names."""
    import uuid

    from fernsift.functions.fixpoint import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def q(text: str) -> str:
    """A DuckDB string literal."""
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern without what RE2 does not know: possessive loops and the Unix-lines flag."""
    plain = pattern.replace("++", "+").replace("*+", "*")
    for flags, without in (("(?d)", ""), ("(?id)", "(?i)"), ("(?ismd)", "(?ism)"), ("(?isd)", "(?is)")):
        plain = plain.replace(flags, without)
    return q(plain)


def matched(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {re2(pattern)})"


def has_any(column: str, words, ignore_case: bool = False) -> str:
    if ignore_case:
        column, words = f"lower({column})", [w.lower() for w in words]
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def first_word(column: str, words) -> str:
    cases = " ".join(f"WHEN contains({column}, {q(w)}) THEN {q(w)}" for w in words)
    return f"CASE {cases} END"


def stripped(column: str) -> str:
    return f"trim({column}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))"


def with_lines(sql: str) -> str:
    return f"WITH {CODE_LINES}\n{sql}"


def with_files(sql: str) -> str:
    return f"WITH {CODE_FILES}\n{sql}"
