"""Every rule, credential type, setting type and chain finds a text made from its own pattern."""

from fernsift.operators import context as C
from fernsift.operators import rule_catalog as K
from fernsift.operators import rules as R
from fernsift.operators import secrets as S
from fernsift.operators.lines import explode_lines
from tests.examples import example


def test_every_rule_hits(spark):
    for rules in (K.default_rules(), K.STRUCTURAL_RULES):
        lines = spark.createDataFrame([(r.rule_id, 1, example(r.pattern)) for r in rules], "file STRING, line INT, text STRING")
        hits = R.scan_rules(lines, rules, eligible_only=False).filter("file = rule_id").select("rule_id").collect()
        assert {r.rule_id for r in rules} - {h.rule_id for h in hits} == set()
    indirect = spark.createDataFrame([("f", 1, "window['eval'](x)")], "file STRING, line INT, text STRING")
    for compat in (False, True):
        found = {r.rule_id for r in R.scan_rules(indirect, K.default_rules(compat)).collect()}
        assert ("EVAL_INDIRECT" in found) is not compat


def test_every_spanning_rule_hits_texts(spark):
    spanning = [r for r in K.default_rules() if r.scope == "file"]
    assert len(spanning) == 46
    texts = spark.createDataFrame([(r.rule_id, "first line\n" + example(r.pattern)) for r in spanning], "file STRING, text STRING")
    hits = R.scan_texts(texts, spanning).filter("file = rule_id").collect()
    assert {(h.rule_id, h.line) for h in hits} >= {(r.rule_id, 2) for r in spanning}


def test_every_credential_and_setting_type_hits(spark):
    patterns = S.SECRET_PATTERNS | S.CONFIG_PATTERNS
    texts = spark.createDataFrame([(k, "\n" + example(p)) for k, p in patterns.items()], "file STRING, text STRING")
    found = S._found(texts, S.SECRET_PATTERNS, "(?id)").unionByName(S._found(texts, S.CONFIG_PATTERNS, "(?id)"))
    assert {(k, 2) for k in patterns} - {(r.type, r.line) for r in found.filter("file = type").collect()} == set()


def test_every_chain_hits(spark):
    texts = [(name, example(pattern.replace("(?d)", ""))) for pattern, name, _, _ in C.CHAINS]
    hits = C.detect_chains(explode_lines(spark.createDataFrame(texts, "file STRING, text STRING"))).collect()
    assert {name for name, _ in texts} - {r.type for r in hits if r.file == r.type} == set()
