"""The rules against Python's regex engine, and the literals that stand before them."""

import re

import pytest

from fernsift.operators import lines as L
from fernsift.operators import rule_catalog as K
from fernsift.operators import rules as R
from registry import tables as t
from tests.conftest import SMALL

SNIPPETS = [
    'el.innerHTML = ""', "el.innerHTML=''", "el.innerHTML = '<b>' + x", "new Function('return 1')", "Function('x')",
    "script.src = 'https://cdn.example'", "script.src = u", "location = 'http://localhost/x'", "location = next",
    "window.open('_blank')", "jwt.decode(t)", "jwt.decode(t); verify(t)",
    "addEventListener('message', f)", "addEventListener('message', e => e.origin)", "new WebSocket('ws://localhost')",
    "new WebSocket('ws://evil.example')", "new WebSocket(u); send(token)", "fetch('/a', {method: 'POST'})",
    "fetch('/a', {method: 'POST', headers: {csrf: 1}})", "<form method='post'>", "<form method='post'><input name=csrf>",
    "fetch('/transfer')", "new FileReader()", "new FileReader(); f.type", "<input type='file'>",
    "<input type='file' accept='.png'>", "document.cookie = 'a=b'", "document.cookie = 'a=b; Secure'",
    "if (balance > 1) update(x)", "if (stock > 1) update(x, lock)", "onclick fetch", "onclick fetch disabled",
    "crypto.createCipher('aes')", "crypto.createCipheriv('aes')", "setInterval(f)", "setInterval(f); clearInterval(i)",
    "new MutationObserver(f)", "new MutationObserver(f); o.disconnect()", "on" + "x" * 50 + " = '{{'", "<a href='{{x}}'>",
    "(window|global|globalThis|self)['eval']", "SELECT a FROM b WHERE c = ' + d", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIx",
    "x" * 3000 + "eval(" + "y" * 3000, "É.innerHTML = é", "K.postMessage(a, '*')", "",
]


@pytest.fixture(scope="module")
def lines(spark):
    made = spark.createDataFrame([("s", i + 1, s) for i, s in enumerate(SNIPPETS)], "file STRING, line INT, text STRING")
    return made.unionByName(t.code_lines(spark, SMALL))


def by_python(lines, rules):
    compiled = [(r.rule_id, re.compile(r.pattern, re.I | re.S | re.M | re.A)) for r in rules]
    return {(x.file, x.line, name) for x in lines.collect() for name, p in compiled if p.search(x.text)}


@pytest.mark.parametrize("rules", [K.default_rules(), K.negative(K.default_rules()), K.STRUCTURAL_RULES])
def test_scan_equals_python(lines, rules):
    got = R.scan_rules(lines, rules, eligible_only=False).select("file", "line", "rule_id").collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == by_python(lines, rules)


def test_rules_as_a_table(lines, spark):
    """All rules as a table give the rows of the rules in the plan, whatever joins the index."""
    rules = K.default_rules() + K.STRUCTURAL_RULES + [K.Rule("ONE_OR_TWO", "q|zz"), K.Rule("ANY", r"\w{9}")]
    columns = ["file", "line", "text", "rule_id", "family", "base_severity", "matched"]
    want = sorted(map(repr, R.scan_rules(lines, rules, eligible_only=False).select(*columns).collect()))
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = R.scan_rules(lines, K.rules_table(spark, rules), eligible_only=False).select(*columns).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sorted(map(repr, got)) == want
    read = R.scan_rules(lines, R.literal_table(spark, rules), eligible_only=False).select(*columns).collect()
    assert sorted(map(repr, read)) == want


def test_awkward_rule_tables(spark):
    """Empty tables, repeated rows, nulls, ids alone, clashing names of the lines' own columns, null and empty lines."""
    lines = spark.createDataFrame(
        [("f", 1, "eval(x)", "a"), ("f", 2, None, "b"), ("f", 3, "", "c"), ("f", 4, "EVAL(eval(" + "x" * 50_000, None)],
        "file STRING, line INT, text STRING, _word STRING")
    table = spark.createDataFrame(
        [("EVAL_A", r"eval\("), ("EVAL_A", r"eval\("), (None, "x"), ("NONE", None), ("EMPTY", r"\A\z")], "rule_id STRING, pattern STRING")
    got = R.scan_rules(lines, table, eligible_only=False).select("line", "_word", "rule_id", "base_severity", "matched").collect()
    assert sorted(map(tuple, got)) == [
        (1, "a", "EVAL_A", "CRITICAL", None), (3, "c", "EMPTY", "LOW", None), (4, None, "EVAL_A", "CRITICAL", None)]
    assert R.scan_rules(lines, table.limit(0)).count() == R.scan_rules(lines.limit(0), table).count() == 0
    own = table.limit(1).selectExpr("rule_id", "pattern", "'INFO' AS severity", "'SECRET' AS family")
    assert R.scan_rules(lines.limit(1), own).select("base_severity", "family", "matched").first() == ("INFO", "SECRET", "eval(")


def test_many_rules(spark):
    """10,000 rules are data: the plan does not grow with them."""
    lines = spark.range(2000).selectExpr("'f' AS file", "CAST(id AS INT) AS line", "concat('call word', id * 7, '(x)') AS text")
    table = spark.range(10_000).selectExpr("concat('R_', id) AS rule_id", "concat('word', id, r'\\(x\\)') AS pattern")
    found = R.scan_rules(lines, table)
    assert len(found._jdf.queryExecution().toString()) < 60_000
    assert {(r.line, r.rule_id) for r in found.collect()} == {(n, f"R_{7 * n}") for n in range(2000) if 7 * n < 10_000}


def test_rules_of_a_whole_scan_as_a_table(sources, spark):
    from fernsift.plans.scan import scan_v2

    df = sources(f="const x = location.hash;\nel.innerHTML = x;\neval(x)\n")
    rows = lambda rules: sorted(map(tuple, scan_v2(df, rules).collect()))
    assert rows(K.rules_table(spark)) == rows(None)
    with pytest.raises(ValueError):
        scan_v2(df, K.rules_table(spark), scope="rule")


def test_only_eligible_lines(lines):
    got = {(r.file, r.line) for r in R.scan_rules(lines).collect()}
    assert got <= {(r.file, r.line) for r in L.eligible_lines(lines).collect()}


def test_catalog_shape():
    rules = K.default_rules()
    assert len(rules) == len({r.rule_id for r in rules}) == 338
    assert len({r.family for r in rules}) == 36
    assert len(K.negative(rules)) == 25


@pytest.mark.parametrize("rule", K.default_rules(), ids=lambda r: r.rule_id)
def test_anchors_are_necessary(rule):
    """A line that matches has one literal of every set."""
    p = re.compile(rule.pattern, re.I | re.S | re.M | re.A)
    for s in SNIPPETS:
        if p.search(s):
            assert all(any(w in s.lower() for w in words) for words in R.anchors(rule.pattern))


def test_file_scope_reaches_over_lines(sources):
    df = sources(f="a\nx.onmessage = go;\nfoo();\neval(z)\n")
    rules = [r for r in K.default_rules() if r.rule_id == "WS_MSG_EVAL"]
    found = R.scan_texts(df, rules).collect()
    assert [(r.line, r.rule_id) for r in found] == [(2, "WS_MSG_EVAL")]
    assert R.scan_rules(L.explode_lines(df), rules).count() == 0


@pytest.mark.parametrize(
    "rule_id,level",
    [("EVAL_DIRECT", "CRITICAL"), ("XSS_INNERHTML_VAR", "CRITICAL"), ("XSS_SRCDOC", "HIGH"), ("CORS_NULL", "MEDIUM"),
     ("CORS_WILDCARD", "HIGH"), ("BYPASS_NULL", "LOW"), ("BIZLOGIC_ROLE", "HIGH"), ("BIZLOGIC_PRICE", "LOW")],
)
def test_base_severity(rule_id, level):
    assert R.base_severity(rule_id) == level


def test_lines_stay_where_they_are_for_a_rule_table(lines, spark):
    """Neither a small table nor one beyond the threshold shuffles the grams of lines that no rule has."""
    table = R.literal_table(spark, K.default_rules())
    small = R.scan_rules(lines, table)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in small and "ShuffledHashJoin" not in small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = R.scan_rules(lines, table)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi" in large.split("SortMergeJoin", 1)[1]
