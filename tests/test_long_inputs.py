"""No limits by default: long lines, files, handlers, ways and evidence."""

import re

from pyspark.sql import functions as F

from fernsift.functions import text as T
from fernsift.operators import backtrack as B
from fernsift.operators import rule_catalog as K
from fernsift.operators.cspt import cspt_scan
from fernsift.operators.lines import eligible_lines, explode_lines
from fernsift.operators.messaging import check_handlers, postmessage_handlers
from fernsift.operators.rules import scan_rules
from fernsift.operators.secrets import scan_configs
from fernsift.operators.single_pass import flow_scan_single_pass
from fernsift.operators.taint import match_sinks
from fernsift.sources.store import finding_rows


def test_long_handler_is_read_to_its_end(sources):
    body = "var a = { b: 1 }; " * 700 + "if (e.origin !== 'https://a.b') return; go(e.data);"
    found = check_handlers(postmessage_handlers(sources(f="window.onmessage = function(e) {" + body + "};")))
    assert not [r for r in found.collect() if r.type == "NO_ORIGIN_CHECK"]


def test_one_line_bundle_is_scanned(sources):
    lines = explode_lines(sources(f="var x=1;" * 5000 + "el.innerHTML = y;" + "z();" * 20_000))
    assert eligible_lines(lines).count() == 1
    assert {"XSS_INNERHTML_VAR"} <= {r.rule_id for r in scan_rules(lines).collect()}


def test_long_way_back(sources):
    steps = ["const k0 = location.hash;"] + [f"const k{i + 1} = k{i};" for i in range(60)]
    rows = B.backtrack(sources(f="\n".join([*steps, "eval(k60)"]))).filter("sink = 'eval'").collect()
    assert [len(r.path) for r in rows if r.variable == "k60"] == [61]


def test_long_file_and_odd_parameters(sources):
    filler = "\n".join(["let pad = 1;"] * 6000)
    text = f"{filler}\nfunction run({{ id: query }}, ...body) {{\neval(query);\neval(body);\n}}"
    got = {(r.variable, r.line, r.function) for r in flow_scan_single_pass(explode_lines(sources(f=text))).filter("sink = 'eval'").collect()}
    assert got == {("query", 6002, "run"), ("body", 6003, "run")}


def test_id_is_of_the_whole_evidence(spark):
    rows = [(1, "T", "LOW", "x" * 2000 + end, 3) for end in "ab"]
    stored = finding_rows(spark.createDataFrame(rows, "asset_id LONG, type STRING, severity STRING, evidence STRING, line INT"), limit=100)
    assert stored.select("finding_id").distinct().count() == 2
    assert {len(r.evidence) for r in stored.collect()} == {100}


def test_places_of_many_matches(spark):
    text = "".join(f"a{i}\n" if i % 3 else f"a{i} " for i in range(3000))
    df = spark.createDataFrame([(text,), ("none here",), ("",)], "text STRING")
    got = df.select(F.transform(T.matches(F.col("text"), r"a(\d+)", (1,)), lambda m: F.concat_ws(":", m["line"], m["stop"], m["g1"])).alias("m")).collect()
    wanted = [f"{text.count(chr(10), 0, m.start()) + 1}:{m.end()}:{m[1]}" for m in re.finditer(r"a(\d+)", text)]
    assert sorted(map(tuple, (r.m for r in got)), key=len) == [(), (), tuple(wanted)]


def test_many_configs_keep_their_lines(sources):
    text = "\n".join(f"url{i} = 'http://localhost:{8000 + i}/x'" for i in range(2000))
    rows = scan_configs(sources(f=text)).collect()
    assert rows and all(r.value in r.context and r.context == text.split("\n")[r.line - 1] for r in rows)


def test_long_words_do_not_multiply(spark, sources):
    word = "q" * 20_000
    lines = explode_lines(sources(f=f"fetch('/api/' + {word}tok1{word})"))
    names = spark.createDataFrame([("f", "tok1"), ("f", "absent")], "file STRING, name STRING")
    assert [r.source for r in cspt_scan(lines, names).collect()] == ["tok1"]


def test_many_words_on_a_line(spark, sources):
    lines = explode_lines(sources(f="eval(" + " + ".join(f"w{i}" for i in range(30_000)) + " + w7)"))
    symbols = spark.createDataFrame([("f", "w7", "TAINTED", "location", 1, ["s"], True)], "file STRING, name STRING, state STRING, source STRING, source_line INT, steps ARRAY<STRING>, visible BOOLEAN")
    assert {(r.sink, r.variable, r.uses) for r in match_sinks(lines, symbols).collect()} == {("eval", "w7", 2)}


def test_rules_as_a_table(spark):
    table = K.rules_table(spark)
    assert table.count() == len(K.RULE_TABLE) == len({r for r, _ in K.RULE_TABLE}) == 338
    assert {r.scope for r in table.select("scope").distinct().collect()} == {"line", "file"}


def test_spanning_rules_in_a_whole_scan(sources):
    from fernsift.plans.scan import scan_v2

    df = sources(f="a\nx.onmessage = go;\nfoo();\neval(z)\n")
    rules = [r for r in K.default_rules() if r.rule_id in ("WS_MSG_EVAL", "EVAL_DIRECT")]
    found = {s: {(r.type, r.line) for r in scan_v2(df, rules, scope=s).filter("phase = 1").collect()} for s in ("line", "rule")}
    assert found == {"line": {("EVAL_DIRECT", 4)}, "rule": {("EVAL_DIRECT", 4), ("WS_MSG_EVAL", 2)}}


def test_metrics_of_several_batches(spark, tmp_path):
    from fernsift.streaming.ingest import _versions, latest_metrics, stream_target_metrics

    schema = "target_id LONG, type STRING, severity STRING"
    for rows in [[(1, "A", "CRITICAL"), (2, "SHADOW_X", "LOW")], [(1, "A", "CRITICAL")], [(3, "A", "CRITICAL")]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream_target_metrics(stream, str(tmp_path / "out"), str(tmp_path / "log"), ["target_id"]).awaitTermination()
        assert all(len(v) <= 2 for v in _versions(spark, str(tmp_path / "out")).values())
    got = {r.target_id: (r.critical, r.shadow) for r in latest_metrics(spark, str(tmp_path / "out")).collect()}
    assert got == {1: (2, 0), 2: (0, 1), 3: (1, 0)}
