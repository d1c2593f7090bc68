"""Rule tables against lines: one pass over the lines for all rules."""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from fernsift.functions import text as T
from fernsift.functions.fixpoint import stored
from fernsift.operators.lines import evidence_flags, is_eligible, mask_match
from fernsift.operators.rule_catalog import FLAGS, STRUCTURAL_RULES, Rule, default_rules

try:  # the parse tree of the standard regex module, used to find literals a match must contain
    from re import _constants as _c
    from re import _parser
except ImportError:  # other Python versions: no prefilter, same results
    _parser = None

# Parts of a rule name that decide its severity, checked in this order.
CRITICAL_PARTS = [
    "EVAL_", "XSS_INNERHTML", "XSS_DOCUMENT_WRITE", "XSS_REACT_DANGEROUSLY",
    "SECRET_PRIVATE_KEY", "SECRET_AWS", "SECRET_STRIPE_LIVE", "SECRET_DATABASE",
    "CMDI_", "SQLI_", "NOSQLI_", "SSTI_", "DESER_", "AUTH_JWT_NONE",
    "POSTMSG_DATA_EVAL", "WS_MSG_EVAL", "PROTO_DIRECT", "ADVANCED_",
]
HIGH_PARTS = [
    "XSS_", "SECRET_", "REDIRECT_USER_INPUT", "REDIRECT_LOCATION",
    "IDOR_", "SSRF_", "PATH_", "UPLOAD_", "CSRF_", "AUTH_",
    "POSTMSG_", "WS_", "CORS_WILDCARD", "CORS_CREDS", "BIZLOGIC_ROLE",
]
MEDIUM_PARTS = [
    "STORAGE_", "COOKIE_", "CLICKJACK_", "MEMORY_", "DEBUG_",
    "CRYPTO_WEAK", "CORS_", "CSP_", "REDOS_", "REGEX_", "SHADOW_",
]
AUTH_WORDS = ["auth", "login", "session", "admin", "password", "token", "jwt"]


def base_severity(rule_id: str) -> str:
    classes = {"CRITICAL": CRITICAL_PARTS, "HIGH": HIGH_PARTS, "MEDIUM": MEDIUM_PARTS}
    hit = (level for level, parts in classes.items() if any(p in rule_id for p in parts))
    return next(hit, "LOW")


def _required(tree) -> list[frozenset[str]]:
    """Sets of lower-case literals; a match of the parsed regex contains one literal of every set."""
    found, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op is _c.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            found.append(frozenset([run]))
        run = ""
        if op is _c.SUBPATTERN:
            found += _required(arg[-1])
        elif op is _c.BRANCH:
            options = [_required(branch) for branch in arg[1]]
            if all(options):
                best = [max(sets, key=lambda s: min(map(len, s))) for sets in options]
                found.append(frozenset().union(*best))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] >= 1:
            found += _required(arg[2])
        elif op is _c.IN and all(kind is _c.LITERAL and code < 128 for kind, code in arg):
            found.append(frozenset(chr(code).lower() for _, code in arg))
    return found


def anchors(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Cheap substring tests to run before a rule's regex: one literal of every inner tuple.

    The most selective test comes first; () where the pattern requires no literal, or only Java's engine can read it.
    """
    if _parser is None:
        return ()
    try:
        tree = _parser.parse(pattern)
    except re.error:
        return ()
    found = {tuple(sorted(s)) for s in _required(tree)}
    return tuple(sorted(found, key=lambda s: (-min(map(len, s)), len(s), s)))


def _text(value: str | None) -> str:
    """A SQL string literal. The expressions below are large, so they are handed over as one text."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _test(rule: Rule, skip: int = 0) -> str:
    """SQL condition: the line has the literals that the rule requires, and its regex matches."""
    parts = []
    for words in anchors(rule.pattern)[skip:]:
        any_word = " OR ".join(f"contains(_lower, {_text(w)})" for w in words)
        parts.append(f"({any_word})")
    return " AND ".join([*parts, f"text RLIKE {_text(FLAGS + rule.pattern)}"])


#: Characters that most rules require, the rarer in prose the earlier. Those of letters, and those that end sentences, are not among them.
MARKS = "`{}<>=$|\\^~@#*[]%&+_;/():\"'"


def _run(pattern: str) -> int:
    """The length of a run of ASCII letters and digits that every match has, by repeated classes outside of groups; 0 if there is none."""
    inside = lambda lo, hi: any(a <= lo and hi <= b for a, b in ((48, 57), (65, 90), (97, 122)))
    longest = 0
    for op, arg in _parser.parse(pattern):
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and len(arg[2]) == 1 and arg[2][0][0] is _c.IN:
            spans = [(a, a) if kind is _c.LITERAL else a if kind is _c.RANGE else (0, 0) for kind, a in arg[2][0][1]]
            longest = max(longest, arg[0] if all(inside(*x) for x in spans) else 0)
    return longest


def may_match(text: Column, rules: Iterable[Rule]) -> Column:
    """False only where no line of a text can match any of the rules.

    A rule's matches have one literal of each of its sets. Where all literals of a set have a mark in them, one mark of each stands for the
    set, and one pass looks for the marks of all rules. Rules with short literals that require a long run of letters and digits
    share a second pass, which looks for the shortest of these; the literals of the others are looked for one by one. So a line of prose
    mostly gets by without the pass over all literals, and a line of code is let through by its first mark.
    """
    marks, runs, words = set(), set(), set()
    for rule in rules:
        sets = anchors(rule.pattern)
        if not sets:
            return F.lit(True)
        marked = [{min((c for c in w if c in MARKS), key=MARKS.index, default="") for w in literals} for literals in sets]
        marked = [m for m in marked if "" not in m]
        if marked:
            marks |= min(marked, key=lambda m: max(map(MARKS.index, m)))
        elif min(map(len, sets[0])) < 4 and _run(rule.pattern) >= 12:
            runs.add(_run(rule.pattern))
        else:
            words |= set(sets[0])
    words = sorted(w for w in words if not any(o != w and o in w for o in words))
    tests = [text.rlike("[" + "".join("\\" + c for c in sorted(marks)) + "]")] if marks else []
    one = f"[{string.ascii_letters}{string.digits}]"  # Java looks up listed characters faster than ranges
    tests += [text.rlike(f"(?<!{one}){one}{{{min(runs)}}}")] if runs else []
    tests += [T.let(F.lower(text), lambda low: T.any_of(F.contains(low, F.lit(w)) for w in words))] if words else []
    return T.any_of(tests) if tests else F.lit(False)


def _grouped(rules: Iterable[Rule]) -> list[tuple[tuple[str, ...], list[Rule]]]:
    """Rules by their most selective literals; the rules without literals come under ()."""
    groups = defaultdict(list)
    for rule in rules:
        groups[next(iter(anchors(rule.pattern)), ())].append(rule)
    return sorted(groups.items())


def _present(groups: list[tuple[tuple[str, ...], list[Rule]]]) -> Column:
    """Numbers of the groups that have a literal in the line, from one pass over the line.

    The pass finds the longest literal at each position; with it come all literals it contains.
    """
    literals = sorted({w for words, _ in groups for w in words})
    if not literals:
        return F.array().cast("array<int>")
    table = []
    for word in literals:
        numbers = [i for i, (words, _) in enumerate(groups) if any(w in word for w in words)]
        table.append(f"{_text(word)}, array({', '.join(map(str, numbers))})")
    pattern = _text(f"(?=({T.one_of(literals)}))")
    return F.expr(
        f"array_distinct(flatten(transform(array_distinct(regexp_extract_all(_lower, {pattern}, 1)),"
        f" w -> map({', '.join(table)})[w])))"
    )


def _chosen(tests: list[str], first: int = 0) -> str:
    """SQL: the test of the group whose number is g, found by halving."""
    if len(tests) == 1:
        return tests[0]
    middle = len(tests) // 2
    return f"IF(g < {first + middle}, {_chosen(tests[:middle], first)}, {_chosen(tests[middle:], first + middle)})"


def _hits(groups: list[tuple[tuple[str, ...], list[Rule]]]) -> Column:
    """Array of the rules that match one line, from the columns text, _lower and _present.

    The tests are the body of a lambda, which Spark evaluates without generating code for it: some
    hundred regexes in one generated method would exceed the size limit of the JVM. A line takes the numbers of the groups that are
    present in it to their tests, so the groups that are not cost nothing.
    """
    none = "CAST(array() AS array<struct<rule_id:string,family:string,base_severity:string,matched:string>>)"
    tested = []
    for literals, members in groups:
        tests = []
        for rule in members:
            severity = rule.severity or base_severity(rule.rule_id)
            matched = "CAST(NULL AS STRING)"
            if rule.family == "SECRET":
                matched = f"regexp_extract(text, {_text(FLAGS + rule.pattern)}, 0)"
            tests.append(
                f"CASE WHEN {_test(rule, 1)} THEN named_struct('rule_id', {_text(rule.rule_id)},"
                f" 'family', {_text(rule.family)}, 'base_severity', {_text(severity)},"
                f" 'matched', {matched}) END"
            )
        tested.append(f"array_compact(array({', '.join(tests)}))")
    always = [tests for (literals, _), tests in zip(groups, tested, strict=True) if not literals]
    listed = f"flatten(transform(_present, g -> {_chosen(tested)}))" if tested else none
    found = f"CASE WHEN size(_present) > 0 THEN {listed} END"
    if always:
        plain = f"flatten(transform(array(0), x -> {always[0]}))"
        found = f"concat(coalesce({found}, {none}), {plain})"
    return F.expr(found)


GRAM = 3


def base_severity_of(rule_id: Column) -> Column:
    """As ``base_severity``, of a column."""
    level = F.when(T.contains_any(rule_id, CRITICAL_PARTS), "CRITICAL").when(T.contains_any(rule_id, HIGH_PARTS), "HIGH")
    return level.when(T.contains_any(rule_id, MEDIUM_PARTS), "MEDIUM").otherwise("LOW")


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _anchors_of(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: [list(words) for words in anchors(p)])


def rule_index(rules: DataFrame) -> DataFrame:
    """A table of rules by the literals their matches contain: one row per rule and literal.

    ``rules`` has ``rule_id`` and ``pattern``, and may have ``severity`` and ``family``, which null or missing are those
    that the id tells. ``literals`` may hold what ``literal_table`` gives; else the patterns are read in the tasks, whose Python
    must find this package. Rows without id or pattern are no rules, and equal rows are one. Of the literals of a rule the most selective set is
    posted under the first ``GRAM`` characters of each; ``_earlier`` are the ones before it, ``_needs`` the other sets. A rule
    without literals is posted under ''. The index has rows in proportion to the rules, whatever the texts are.
    """
    given = {c: F.col(c) if c in rules.columns else F.lit(None).cast("string") for c in ("severity", "family")}
    read = [F.col("literals").alias("_sets")] if "literals" in rules.columns else []
    known = rules.select("rule_id", "pattern", *[c.alias(n) for n, c in given.items()], *read).na.drop(subset=["rule_id", "pattern"])
    parsed = known.distinct() if read else known.distinct().withColumn("_sets", _anchors_of("pattern"))
    first = F.coalesce(F.get("_sets", F.lit(0)), F.array(F.lit("")))
    return (
        parsed.withColumn("_words", first)
        .select("*", F.posexplode("_words").alias("_at", "_word"))
        .select(
            "rule_id",
            F.coalesce("family", F.element_at(F.split("rule_id", "_"), 1)).alias("family"),
            F.coalesce("severity", base_severity_of(F.col("rule_id"))).alias("base_severity"),
            F.concat(F.lit(FLAGS), "pattern").alias("_pattern"),
            F.substring("_word", 1, GRAM).alias("_gram"),
            "_word",
            F.expr("slice(_words, 1, _at)").alias("_earlier"),
            F.expr("slice(_sets, 2, greatest(size(_sets) - 1, 0))").alias("_needs"),
        )
    )


def literal_table(spark: SparkSession, rules: Iterable[Rule] | None = None) -> DataFrame:
    """``rules_table`` with ``literals``, the sets of literals of each pattern: rules as a table that is read once."""
    rules = list(default_rules() if rules is None else rules)
    rows = [(r.rule_id, r.family, r.severity, r.pattern, [list(words) for words in anchors(r.pattern)]) for r in rules]
    schema = "rule_id STRING, family STRING, severity STRING, pattern STRING, literals ARRAY<ARRAY<STRING>>"
    return spark.createDataFrame(rows, schema)


def _grams(lower: str) -> str:
    """SQL: the different runs of up to GRAM characters of a line, and ''. One cut per character."""
    runs = [f"regexp_extract_all({lower}, '(?s)(?=(.{{{n}}}))', 1)" for n in range(1, GRAM + 1)]
    return f"array_distinct(concat(array(''), {', '.join(runs)}))"


def _scan_table(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines and rules meet where a line has a rule's gram; what meets is tested for its literals, then by its pattern.

    The index is stored first, so Spark knows its size and broadcasts it while it is below its threshold. The grams of lines that no
    rule has are dropped where they are made, by the index's grams, which the alphabet of literals bounds: beyond the
    threshold only grams that rules have are shuffled. A line meets a rule once: under the first of its literals that the line holds.
    """
    own = "_"
    while any(c.startswith(own) for c in lines.columns):
        own += "_"
    index = stored(rule_index(rules))
    index = index.select(*[F.col(c).alias(own + c) for c in index.columns])
    grams = F.broadcast(index.select(f"{own}_gram").distinct())
    lower, word, pattern, family = (own + c for c in ("_lower", "_word", "_pattern", "family"))
    found = (
        f"contains({lower}, {word}) AND NOT exists({own}_earlier, w -> contains({lower}, w))"
        f" AND forall({own}_needs, s -> exists(s, w -> contains({lower}, w))) AND text RLIKE {pattern}"
    )
    matched = f"CASE WHEN {family} = 'SECRET' THEN regexp_extract(text, {pattern}, 0) END"
    return (
        lines.withColumn(lower, F.lower("text"))
        .withColumn(f"{own}_gram", F.explode(F.expr(_grams(lower))))
        .join(grams, f"{own}_gram", "left_semi")
        .join(index, f"{own}_gram")
        .filter(F.expr(found))
        .select(
            *lines.columns, *[F.col(own + c).alias(c) for c in ("rule_id", "family", "base_severity")],
            F.expr(matched).alias("matched"),
        )
    )


def scan_rules(
    lines: DataFrame,
    rules: Iterable[Rule] | DataFrame | None = None,
    eligible_only: bool = True,
) -> DataFrame:
    """One row per line and rule that matches somewhere in it; the columns of ``lines`` are kept.

    Adds ``rule_id``, ``family``, ``base_severity`` and, for credential rules, ``matched``. Rules may be a table (see
    ``rule_index``): then they are data and not part of the plan, so there may be tens of thousands.
    """
    eligible = is_eligible(F.col("text")) if eligible_only else F.lit(True)
    if isinstance(rules, DataFrame):
        return _scan_table(lines.filter(eligible), rules)
    rules = list(default_rules() if rules is None else rules)
    groups = _grouped(rules)
    lines = lines.filter(may_match(F.col("text"), rules) & eligible)
    return (
        lines.withColumn("_lower", F.lower("text"))
        .withColumn("_present", _present(groups))
        .withColumn("_hit", F.explode_outer(_hits(groups)))  # not explode: it would test the array first
        .filter(F.col("_hit").isNotNull())
        .drop("_lower", "_present")
        .select("*", "_hit.*")
        .drop("_hit")
    )


def scan_texts(sources: DataFrame, rules: Iterable[Rule] | None = None) -> DataFrame:
    """File scope: every match of a rule in the whole text, with the line it starts on.

    For rules whose patterns reach over several lines.
    """
    rules = list(default_rules() if rules is None else rules)
    none = F.array().cast("array<struct<line:int,rule_id:string,base_severity:string,matched:string>>")
    parts = []

    def as_row(rule: Rule):
        return lambda m: F.struct(
            m["line"].alias("line"),
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.severity or base_severity(rule.rule_id)).alias("base_severity"),
            m["g0"].alias("matched"),
        )

    for rule in rules:
        found = F.transform(T.matches(F.col("text"), FLAGS + rule.pattern), as_row(rule))
        parts.append(F.when(F.expr(_test(rule)), found).otherwise(none))
    hits = F.flatten(F.flatten(F.transform(F.array(F.lit(0)), lambda _: F.array(*parts))))
    return (
        sources.withColumn("_lower", F.lower("text"))
        .select("file", F.explode_outer(hits).alias("_m"))
        .filter(F.col("_m").isNotNull())
        .select("file", "_m.*")
    )


def custom_scan(lines: DataFrame, pattern: str, rule_id: str = "CUSTOM", severity: str = "MEDIUM") -> DataFrame:
    """One pattern of the caller's over all lines."""
    return scan_rules(lines, [Rule(rule_id, pattern, severity)], eligible_only=False)


def scan_structural_rules(lines: DataFrame) -> DataFrame:
    hits = scan_rules(lines, STRUCTURAL_RULES, eligible_only=False)
    return hits.select(
        "file",
        "line",
        F.col("rule_id").alias("type"),
        F.col("base_severity").alias("severity"),
        T.strip(F.col("text")).alias("evidence"),
        F.lit("MEDIUM").alias("confidence"),
    )


def classify_severity(
    base: Column, evidence: Column, user_input: Column, sanitized: Column, validated: Column
) -> Column:
    """Raise or lower a rule's severity by what surrounds the line."""

    def moved(level: Column, when: Column, steps: dict[str, str]) -> Column:
        out = F.when(~when, level)
        for before, after in steps.items():
            out = out.when(level == before, F.lit(after))
        return out.otherwise(level)

    up = {"MEDIUM": "HIGH", "LOW": "MEDIUM"}
    level = moved(base, user_input & ~sanitized, up)
    level = moved(level, T.contains_any(evidence, AUTH_WORDS, ignore_case=True), up)
    return moved(level, validated & sanitized, {"HIGH": "MEDIUM", "CRITICAL": "HIGH"})


def rule_findings(hits: DataFrame) -> DataFrame:
    """Rule hits with context flags to findings with severity and evidence."""
    bare = T.strip(F.col("text"))
    masked = F.when(F.col("family") == "SECRET", mask_match(F.col("matched"), bare)).otherwise(bare)
    rated = hits.withColumn(
        "severity",
        classify_severity(
            F.col("base_severity"), bare, F.col("has_user_input"), F.col("has_sanitization"),
            F.col("has_validation"),
        ),
    )
    return rated.select(
        "file",
        "line",
        F.col("rule_id").alias("type"),
        "severity",
        evidence_flags(
            F.col("severity"), F.col("has_user_input"), F.col("has_sanitization"), masked
        ).alias("evidence"),
    )


def finding_key(rule: Column, line: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", rule, line.cast("string"), T.strip(text)))


def dedup_line_findings(hits: DataFrame) -> DataFrame:
    """One row per file, rule, line and text of the line."""
    return hits.withColumn(
        "finding_key", finding_key(F.col("rule_id"), F.col("line"), F.col("text"))
    ).dropDuplicates(["file", "finding_key"])
