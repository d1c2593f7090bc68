"""Chains, handlers and string arrays: equal to a plain version, and in time proportional to the text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fernsift.functions import text as T
from fernsift.operators import assignments as A
from fernsift.operators import chains
from fernsift.operators import context as C
from fernsift.operators import decode as D
from fernsift.operators import messaging as M
from fernsift.operators.lines import explode_lines


def seconds(df) -> float:
    started = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


WORDS = [
    "location", "params", "cookie", "query", "innerHTML", "fetch", "axios", ".then", "localStorage.getItem", "sessionStorage.getItem",
    "postMessage", "event.data", "JSON.parse", "Object.assign", "role", "if", "admin", "atob", "split", "body", "exec", "spawn", ".query",
    ".raw", ".execute", "=", "= ", "=\t", "a", "b1", "PARAMS", "innerhtml", " ", ";", "_x", "=a", "=é",
]


def by_regex(text: str, look_back: int = 10):
    """The chains of each line, by their patterns on the joined lines."""
    noise = re.compile("|".join(map(re.escape, C.__dict__.get("NOISE", ["\0"]))))
    lines = [(i + 1, x) for i, x in enumerate(text.split("\n")) if x.strip(" \t\n\r\f\v") and not noise.search(x)]
    out = set()
    for at, (number, _) in enumerate(lines):
        near = " ".join(x for _, x in lines[max(0, at - look_back) : at + 1])
        out |= {(number, name) for pattern, name, *_ in C.CHAINS if re.search(pattern, near, re.I | re.S | re.A)}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_equal_their_patterns(sources, seed):
    rng = random.Random(seed)
    texts = {
        f"f{k}": "\n".join("".join(rng.choice(WORDS) + rng.choice(["", "", " ", "x"]) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 30)))
        for k in range(60)
    }
    found = C.detect_chains(explode_lines(sources(**texts)), block=8)
    got = {}
    for r in found.collect():
        got.setdefault(r.file, set()).add((r.line, r.type))
        assert r.evidence.endswith(texts[r.file].split("\n")[r.line - 1])
    wanted = {f: by_regex(x) for f, x in texts.items()}
    assert got == {f: w for f, w in wanted.items() if w}
    assert sum(map(len, wanted.values())) > 100


def test_chains_of_your_own(sources):
    lines = explode_lines(sources(f="one\ntwo\nTHREE", g="three\ntwo\none"))
    found = C.detect_chains(lines, [(r"one[^\n]*t(?:w)o[^\n]*three", "MINE", "LOW", "mine")])
    assert [(r.file, r.line, r.type, r.evidence) for r in found.collect()] == [("f", 3, "MINE", "\U0001f517 mine: THREE")]
    with pytest.raises(ValueError):
        chains.steps_of(r"(\w)[^\n]*\1")
    with pytest.raises(ValueError):
        chains.steps_of(r"params[^\n]*=\s*(\w+)[^\n]*\1[^\n]*a|b")


def test_chain_of_one_long_line(sources):
    """A megabyte on which the patterns themselves would go back and forth for hours."""
    text = "innerHTML; " + "params = a1; b2 params = q7; " * 36_000
    lines = explode_lines(sources(f=text))
    assert seconds(C.detect_chains(lines)) < 60
    assert not [r for r in C.detect_chains(lines).collect() if r.type == "XSS_CHAIN_DOM"]
    hit = explode_lines(sources(f=text + "\nel.innerHTML = x"))
    assert {(r.line, r.type) for r in C.detect_chains(hit).collect() if "DOM" in r.type} == {(2, "XSS_CHAIN_DOM")}


def test_chains_shuffle_no_text(sources):
    """What goes into the windows is numbers; texts are only joined to the lines on which a chain holds."""
    lines = explode_lines(sources(f="fetch(x)"))
    plan = C.detect_chains(lines)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert windows and not [x for x in windows if re.search(r"\btext#", x)]


def body_of(rest: str) -> str:
    depth, started = 0, False
    for i, c in enumerate(rest):
        if c == "{":
            depth, started = depth + 1, True
        elif c == "}":
            depth -= 1
            if started and depth == 0:
                return rest[: i + 1]
    return ""


@pytest.mark.parametrize("seed", [1, 2])
def test_handlers_equal_a_plain_reading(sources, seed):
    rng = random.Random(seed)
    parts = ["{", "}", "{", "}", " x ", "é\n", "onmessage = ", "window.onmessage=", "addEventListener('message'", "😀"]
    texts = {f"f{k}": "".join(rng.choice(parts) for _ in range(rng.randrange(60))) for k in range(80)}
    got = sorted((r.file, r.pattern, r.line, r.body) for r in M.postmessage_handlers(sources(**texts)).collect())
    wanted = sorted(
        (f, k, x.count("\n", 0, m.start()) + 1, body_of(x[m.end() :]))
        for f, x in texts.items() for k, p in enumerate(M.HANDLER_PATTERNS) for m in re.finditer(p, x)
    )
    assert got == wanted and sum(w[3] != "" for w in wanted) > 20


def test_many_handlers_in_proportion(sources):
    one = "window.addEventListener('message', function (e) { if (e.origin) { go(e.data) } });\n"
    seconds(M.postmessage_handlers(sources(f=one * 10)))
    few, many = (seconds(M.postmessage_handlers(sources(f=one * n))) for n in (2_000, 16_000))
    assert many < 60 and many < 16 * max(few, 1)
    assert {r.body for r in M.postmessage_handlers(sources(f=one * 1_000)).collect()} == {", function (e) { if (e.origin) { go(e.data) } }"}


def test_many_string_arrays_in_proportion(sources):
    def text(n):
        return "\n".join(f"var _0x{i:x} = ['a{i}', 'b{i}'];" for i in range(n)) + "\n" + "\n".join(f"f(_0x{i:x}[1], _0x{i:x}[7]);" for i in range(n))

    seconds(D.apply_decoded(sources(f=text(10))))
    few, many = (seconds(D.apply_decoded(sources(f=text(n)))) for n in (2_500, 10_000))
    assert many < 90 and many < 10 * max(few, 1)
    out = D.apply_decoded(sources(f=text(300))).first().text
    assert all(f'f("b{i}", _0x{i:x}[7]);' in out or any(f"_0x{i:x}".endswith(f"_0x{j:x}") for j in range(i)) for i in range(300))


def test_arrays_by_their_ends(sources):
    """The first array in the text whose name ends the word and which has the element; of two with one name the last."""
    text = "var ab = ['1'];\nvar b = ['2', '3'];\nvar b = ['4', '5'];\nf(ab[0], ab[1], xab[0], b[0], c[0], ab[2])"
    assert D.apply_decoded(sources(f=text)).first().text.split("\n")[-1] == 'f("1", a"5", x"1", "4", c[0], ab[2])'


def test_running_and_halving(spark):
    values = [random.Random(1).randrange(-3, 9) for _ in range(1000)]
    df = spark.createDataFrame([(values,), ([],), ([4],)], "v ARRAY<INT>")
    sums = sorted((r.s for r in df.select(T.running(F.col("v")).alias("s")).collect()), key=len)
    total, wanted = 0, []
    for v in values:
        total += v
        wanted.append(total)
    assert sums == [[], [4], wanted]
    ordered = sorted(set(values))
    found = spark.createDataFrame([(ordered, x) for x in range(-5, 12)], "o ARRAY<INT>, x INT").select("x", T.first_at_least(F.col("o"), F.col("x")).alias("k")).collect()
    assert {r.x: r.k for r in found} == {x: sum(o < x for o in ordered) for x in range(-5, 12)}
    assert spark.createDataFrame([([], 1)], "o ARRAY<INT>, x INT").select(T.first_at_least(F.col("o"), F.col("x")).alias("k")).first().k == 0


def test_more_chains_than_one_number_marks(sources, monkeypatch):
    """Which chains a window may hold is kept in numbers of a few chains each; a window without both ends is not gone through."""
    monkeypatch.setattr(C, "MARKS", 2)
    own = [(rf"a{i}[^\n]*b{i}[^\n]*c{i}", f"C{i}", "LOW", "mine") for i in range(5)]
    lines = explode_lines(sources(f="a0 a3\nb0 b3 c4\nc0 c3 // a4", g="c1\nb1\na1", h="a2 c2", i="a2\n\nb2\nwww.w3.org\nc2"))
    found = C.detect_chains(lines, own)
    assert sorted((r.file, r.line, r.type) for r in found.collect()) == [("f", 3, "C0"), ("f", 3, "C3"), ("i", 5, "C2")]


@pytest.mark.parametrize("name", ["analyze", "scan_v2"])
def test_texts_are_made_once(spark, sources, name):
    """Texts that are derived, not stored, are made once, however many steps read them."""
    from fernsift.operators import taint as X
    from fernsift.plans.scan import scan_v2

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def derived(text):
        made.add(1)
        return text

    texts = sources(f="const a = location.hash;\nfunction g(b) {\neval(a);\ng(a)", h="let c = location.hash;\nc1 = c;\nel.innerHTML = c1;")
    derived_texts = texts.select("file", derived.asNondeterministic()("text").alias("text"))
    {"analyze": lambda s: X.analyze(s).flows, "scan_v2": scan_v2}[name](derived_texts).collect()
    assert made.value == 2


@pytest.mark.parametrize("pattern", [A.CALL, M.CALL_PATTERN, D.ACCESS, D.ACCESS_WITH_HEX, D.BRACKET])
def test_patterns_at_word_starts_find_the_same(spark, pattern):
    rng = random.Random(pattern)
    parts = ["a", "b_1", "w", ".", ".postMessage", "postMessage", "(", ")", ",", "[", "]", "0x1", "7", "'k'", "['k']", "'k\"", " ", "\n", "é", "$"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    texts += ["a.w.postMessage(x, y)(b)", "ab(c)[0]d['k']['k']", "a[0][0x1]b.c[7]"]
    df = spark.createDataFrame([(x,) for x in texts], "text STRING")
    both = [F.transform(T.matches(F.col("text"), p), lambda m: F.concat_ws(":", m["line"], m["stop"], m["g0"])) for p in (pattern, T.at_word_starts(pattern))]
    got = df.select("text", both[0].alias("a"), both[1].alias("b")).collect()
    assert [r.text for r in got if r.a != r.b] == []
    assert sum(len(r.a) for r in got) > 5


def test_a_long_word_is_read_once(sources):
    """Patterns that begin with a word were tried at each of its characters: 4 * 10 ** 10 steps."""
    word = "a" * 300_000
    assert seconds(A.extract_calls(sources(f=word))) < 15
    assert seconds(M.postmessage_calls(sources(f=word + "; a.postMessage"))) < 15
    assert seconds(D.apply_decoded(sources(f="var a = ['x', 'y']; b[0] + " + word))) < 15


def test_matches_of_nothing(spark):
    df = spark.createDataFrame([("a\nb1",), ("",), ("c",), (None,)], "text STRING")
    got = df.select(F.transform(T.matches(F.col("text"), r"b(\d)", (1,)), lambda m: F.concat_ws(":", m["line"], m["stop"], m["g1"])).alias("m"))
    assert [r.m for r in got.collect()] == [["2:4:1"], [], [], None]
