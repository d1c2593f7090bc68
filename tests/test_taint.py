"""Flows against the small interpreter, on the derived files and on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from fernsift.operators import backtrack as B
from fernsift.operators import taint as X
from registry import tables as t
from tests.conftest import SMALL
from tests.taint_model import Model


def check(sources, block):
    result = X.analyze(sources, block=block)
    texts = [r for r in sources.collect() if any(s in r.text for s in X.TAINT_SOURCES)]
    symbols = {
        (r.file, r.scope_ord, r.name, r.state,
         *((r.source, r.source_line, tuple(r.steps)) if r.state == "TAINTED" else (None, None, ())))
        for r in result.symbols.collect()
    }
    assert symbols == {(r.file, *s) for r in texts for s in Model(r.text).symbols()}
    flows = [
        (r.file, r.sink, r.sink_line, r.source, r.source_line, r.variable, tuple(r.steps))
        for r in result.flows.collect()
    ]
    assert len(flows) == len(set(flows))
    assert set(flows) == {(r.file, *f) for r in texts for f in Model(r.text).flows()}


@pytest.mark.parametrize("block", [5, 8192])
def test_derived_files(spark, block):
    check(t.code_files(spark, SMALL), block)


def random_text(seed, names="abcdef"):
    rnd = random.Random(seed)
    name = lambda: rnd.choice(names)
    make = [
        lambda: f"const {name()} = location.hash;",
        lambda: f"let {name()} = {name()} + {name()};",
        lambda: f"var {name()} = escape({name()}) + location.search",
        lambda: f"const {name()} = encodeURI({name()});",
        lambda: f"{name()} = {name()}.x + {name()};",
        lambda: f"  {name()} = escape({name()});",
        lambda: f"function f{rnd.randint(0, 2)}({name()}, {name()}) {{",
        lambda: f"const g{rnd.randint(0, 1)} = ({name()}, {name()}) => {name()};",
        lambda: f"f{rnd.randint(0, 2)}({name()}, {name()}); g{rnd.randint(0, 1)}({name()});",
        lambda: f"const {{ {name()}, {name()}: {name()} }} = req.query;",
        lambda: f"const {{ {name()} }} = {name()};",
        lambda: f"el.innerHTML = {name()}; eval({name()})",
        lambda: f"// {name()} = location.hash",
        lambda: f"f{rnd.randint(0, 2)}({name()},",
        lambda: f"  {name()});",
        lambda: "",
    ]
    return "\n".join(rnd.choice(make)() for _ in range(rnd.randint(1, 40)))


def test_random_files(sources):
    check(sources(**{f"r{i}": random_text(i) for i in range(150)}), 8)


def test_long_chain(sources):
    """Longer than any fixed number of rounds, forwards in one file and backwards in the other."""
    forward = ["const a0 = location.hash;"] + [f"const a{i + 1} = a{i};" for i in range(40)]
    backward = [f"b{i + 1} = b{i};" for i in reversed(range(12))] + ["const b0 = location.hash;"]
    check(sources(f="\n".join(forward + ["eval(a40)"]), b="\n".join(backward + ["eval(b12)"])), 4)


def test_order_and_partitions_do_not_matter(sources, spark):
    df = sources(**{f"r{i}": random_text(1000 + i) for i in range(20)})
    one = X.analyze(df.coalesce(1)).flows.drop("text").toPandas().astype(str)
    many = X.analyze(df.orderBy(F.desc("file")).repartition(13)).flows.drop("text").toPandas().astype(str)
    key = list(one.columns)
    assert one.sort_values(key).values.tolist() == many.sort_values(key).values.tolist()


def test_request_value_reaches_a_command(sources):
    df = sources(f="function handler(req) {\n  const userInput = req.query.cmd;\n  require('child_process').exec(userInput);\n}")
    flows = {(r.sink, r.sink_line, r.source, r.variable) for r in X.analyze(df).flows.collect()}
    assert ("exec", 3, "req.query", "userInput") in flows


def test_sanitized_value_is_clean(sources):
    df = sources(
        f="function update(req) {\n const bio = req.body.bio;\n const cleanBio = sanitize(bio);\n"
          " const html = cleanBio;\n div.innerHTML = html;\n}"
    )
    result = X.analyze(df)
    assert not [r for r in result.flows.collect() if r.sink == "innerHTML"]
    assert {(r.name, r.state) for r in result.symbols.collect()} >= {("bio", "TAINTED"), ("cleanBio", "SANITIZED")}


def shortest(text):
    """Length of the shortest way from every name to a source, by plain search."""
    import re

    from fernsift.operators import assignments as A

    uses, depth = [], {}
    for raw in text.split("\n"):
        line = raw.strip()
        m = re.match(A.DECLARATION.replace("(?d)", ""), line, re.A) or (
            not re.match(A.STATEMENT_STARTS + "|^(?:if|for)", line) and re.match(A.ASSIGNMENT.replace("(?d)", ""), line, re.A)
        )
        if line.startswith("//") or not m:
            m = None
        rows = [(m[1], m[2])] if m else []
        d = re.match(A.DESTRUCTURING, line, re.A)
        if d and not line.startswith("//"):
            rows += [(b or a, f"{d[2]}.{a}") for a, b in re.findall(r"(\w+)(?:\s*:\s*(\w+))?", d[1])]
        uses += [(n, rhs, re.findall(r"\b[a-zA-Z_]\w*\b", rhs, re.A)) for n, rhs in rows]
    names = {n for n, _, _ in uses} | {w for _, _, ws in uses for w in ws}
    own = lambda n: any(s in n or n in s.split(".")[-1] for s in B.BACKTRACK_SOURCES)
    for n in names:
        if own(n) or any(n == v and any(s in rhs for s in B.BACKTRACK_SOURCES) for v, rhs, _ in uses):
            depth[n] = 0
    while True:
        more = {}
        for n, _, ws in uses:
            near = [depth[w] + 1 for w in ws if w in depth and w not in B.SKIPPED_WORDS and w != n]
            if near and min(near) < depth.get(n, 10**6):
                more[n] = min(min(near), more.get(n, 10**6))
        if not more:
            return depth
        depth.update(more)


def test_backtrack_is_shortest(sources):
    names = "kqwzjv"  # no part of any source word's last segment
    texts = {f"r{i}": random_text(i + 500, names) for i in range(40)}
    rows = B.backtrack(sources(**texts)).collect()
    assert rows
    for r in rows:
        depth = shortest(texts[r.file]).get(r.variable)
        if r.is_tainted and depth is None:
            assert r.path == [r.variable]  # the name itself is a source word
            continue
        assert r.is_tainted == (depth is not None)
        if r.is_tainted:
            assert len(r.path) == depth + 1 and r.path[0] == r.variable


def test_backtrack_chain_and_cycle(sources):
    chain = "\n".join(["const w0 = document.cookie.split('x');"] + [f"w{i + 1} = w{i};" for i in range(25)])
    df = sources(f=chain + "\neval(w3)\neval(w25)", g="z1 = z2;\nz2 = z1;\nz1 = z1;\neval(z1)")
    rows = {(r.file, r.variable): r for r in B.backtrack(df).collect()}
    hit = rows["f", "w3"]
    assert (hit.source, hit.path, hit.path_lines, hit.source_line) == (
        "document.cookie", ["w3", "w2", "w1", "w0"], [4, 3, 2, 1], 1)
    assert hit.transformations == ["split"]
    far = rows["f", "w25"]  # ways have no longest length
    assert far.is_tainted and far.path == [f"w{i}" for i in range(25, -1, -1)] and far.path_lines == list(range(26, 0, -1))
    short = {(r.file, r.variable): r.is_tainted for r in B.backtrack(df, max_depth=20).collect()}
    assert short["f", "w3"] and not short["f", "w25"]
    assert not rows["g", "z1"].is_tainted
