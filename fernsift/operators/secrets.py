"""Credentials by pattern and by character entropy, over whole source texts."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsift.functions import text as T
from fernsift.operators.rules import anchors

# Credential types with their patterns (searched without regard to case).
SECRET_PATTERNS = {
    "AWS_ACCESS_KEY": r"(?:AKIA|A3T|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}",
    "AWS_SECRET_KEY": r"(?:aws)?_?(?:secret)?_?(?:access)?_?key['\"\s:=]+([A-Za-z0-9/+=]{40})",
    "GITHUB_TOKEN": r"gh[pousr]_[A-Za-z0-9_]{36,}",
    "GITHUB_OAUTH": r"github[_\-]?(?:oauth)?[_\-]?(?:token)?['\"\s:=]+([a-f0-9]{40})",
    "GOOGLE_API_KEY": r"AIza[0-9A-Za-z_-]{35}",
    "GOOGLE_OAUTH": r"[0-9]+-[a-z0-9_]{32}\.apps\.googleusercontent\.com",
    "FIREBASE_KEY": r"AAAA[A-Za-z0-9_-]{7}:[A-Za-z0-9_-]{140}",
    "SLACK_TOKEN": r"xox[baprs]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*",
    "SLACK_WEBHOOK": r"https://hooks\.slack\.com/services/[A-Z0-9]{9}/[A-Z0-9]{9}/[a-zA-Z0-9]{24}",
    "STRIPE_KEY": r"sk_(?:live|test)_[0-9a-zA-Z]{24,}",
    "STRIPE_RESTRICTED": r"rk_(?:live|test)_[0-9a-zA-Z]{24,}",
    "TWILIO_SID": r"AC[a-f0-9]{32}",
    "TWILIO_TOKEN": r"SK[a-f0-9]{32}",
    "SENDGRID_KEY": r"SG\.[a-zA-Z0-9_-]{22}\.[a-zA-Z0-9_-]{43}",
    "MAILGUN_KEY": r"key-[0-9a-zA-Z]{32}",
    "JWT_SECRET": r"(?:jwt|JWT)[_\-]?(?:secret|SECRET|key|KEY)?['\"\s:=]+([A-Za-z0-9+/=]{20,})",
    "PRIVATE_KEY": r"-----BEGIN (?:RSA|EC|DSA|OPENSSH)? ?PRIVATE KEY-----",
    "BEARER_TOKEN": r"[Bb]earer\s+[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+",
    "BASIC_AUTH": r"[Bb]asic\s+[A-Za-z0-9+/=]{20,}",
    "DATABASE_URL": r"(?:postgres|mysql|mongodb)(?:ql)?://[^'\"\s]+:[^'\"\s]+@[^'\"\s]+",
    "REDIS_URL": r"redis://[^'\"\s]+:[^'\"\s]+@[^'\"\s]+",
    "API_KEY_GENERIC": r"(?:api[_\-]?key|apikey|API_KEY)['\"\s:=]+([A-Za-z0-9_\-]{20,})",
    "SECRET_GENERIC": r"(?:secret|SECRET)[_\-]?(?:key|KEY)?['\"\s:=]+([A-Za-z0-9_\-]{20,})",
    "PASSWORD_FIELD": r"(?:password|passwd|pwd)['\"\s:=]+([^'\"\\s]{8,})",
    "OAUTH_CLIENT_SECRET": r"client[_\-]?secret['\"\s:=]+([A-Za-z0-9_\-]{20,})",
    "NPM_TOKEN": r"//registry\.npmjs\.org/:_authToken=([A-Za-z0-9\-_]+)",
    "HEROKU_API_KEY": r"[Hh]eroku[_\-]?(?:api)?[_\-]?(?:key)?['\"\s:=]+"
    r"([a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12})",
}
CONFIG_PATTERNS = {
    "DATABASE_CONNECTION": r"(?:mongodb|mysql|postgres)://[^\s'\"]+",
    "INTERNAL_API_URL": r"(?:https?://)?(?:api|internal)[.\w]+\.(?:com|io|net)/[^\s'\"]*",
    "INTERNAL_ENDPOINT": r"(?:0\.0\.0\.0|127\.0\.0\.1|localhost):\d{4,5}",
}
ENV_PATTERNS = [
    r"process\.env\.([A-Z_][A-Z0-9_]*)",
    r"process\.env\[['\"]([A-Z_][A-Z0-9_]*)['\"]",
    r"import\.meta\.env\.([A-Z_][A-Z0-9_]*)",
    r"(?:REACT_APP|NEXT_PUBLIC|VITE)_[A-Z_]+",
]
QUOTED = r"['\"`]([A-Za-z0-9+/=_\-]{20,})['\"`]"
PLACEHOLDER_WORDS = [
    "xxx", "your_", "example", "placeholder", "changeme", "secret", "password", "key",
    "insert", "replace", "todo", "0000", "1111", "aaaa", "test",
]
CODE_WORDS = [
    "function", "return", "const", "let", "var", "import", "export", "class", "async", "await",
]

# Corrected forms, used with compat=False: words that real credentials also contain count only as
# the whole value, and the password pattern stops at white space instead of the letter s.
WHOLE_VALUE_WORDS = ["secret", "password", "key", "test"]
CORRECTED_PATTERNS = {"PASSWORD_FIELD": r"(?:password|passwd|pwd)['\"\s:=]+([^'\"\s]{8,})"}


def is_placeholder(value: Column, compat: bool = True) -> Column:
    if compat:
        return T.contains_any(value, PLACEHOLDER_WORDS, ignore_case=True)
    loose = [w for w in PLACEHOLDER_WORDS if w not in WHOLE_VALUE_WORDS and not w[0] == w[-1]]
    return T.contains_any(value, loose, ignore_case=True) | F.lower(value).isin(WHOLE_VALUE_WORDS)


def is_likely_code(value: Column) -> Column:
    few = F.size(F.array_distinct(F.split(value, ""))) < F.length(value) / 4
    return T.contains_any(value, CODE_WORDS, ignore_case=True) | few


def _found(sources: DataFrame, patterns: dict[str, str], flags: str) -> DataFrame:
    """All matches of all patterns: (file, line, nth, type, value, whole_line). Each text is split into lines once."""
    none = F.array().cast("array<struct<line:int,type:string,value:string,whole_line:string>>")

    def as_row(kind: str, group: int, lines: Column):
        return lambda m: F.struct(
            m["line"].alias("line"), F.lit(kind).alias("type"), m[f"g{group}"].alias("value"),
            F.get(lines, m["line"] - 1).alias("whole_line"),
        )

    # one pass over the text finds which patterns can match at all
    literals = sorted({w for p in patterns.values() for words in anchors(p)[:1] for w in words})
    seen = F.array().cast("array<string>")
    if literals:
        seen = F.array_distinct(
            F.regexp_extract_all(F.lower("text"), F.lit(f"(?=({T.one_of(literals)}))"), F.lit(1))
        )
    sources = sources.select("file", "text").withColumn("_found", seen)

    def of_pattern(kind: str, pattern: str, lines: Column) -> Column:
        group = min(re.compile(pattern).groups, 1)
        hits = F.transform(T.matches(F.col("text"), flags + pattern, (group,)), as_row(kind, group, lines))
        for words in anchors(pattern)[:1]:
            implied = [w for w in literals if any(a in w for a in words)]
            hits = F.when(F.arrays_overlap("_found", F.array(*map(F.lit, implied))), hits).otherwise(none)
        return hits

    # the patterns run in the body of a lambda, which keeps the generated code small
    def of_lines(lines: Column) -> Column:
        return F.flatten(F.array(*[of_pattern(kind, pattern, lines) for kind, pattern in patterns.items()]))

    found = T.let(F.split("text", "\n", -1), of_lines)
    if all(anchors(pattern) for pattern in patterns.values()):
        found = F.when(F.size("_found") > 0, found)  # texts without any of the words are not split into lines
    return (
        sources.select("file", F.posexplode_outer(found).alias("nth", "_m"))
        .filter(F.col("_m").isNotNull())
        .select("file", "nth", "_m.*")
    )


def _shaped(found: DataFrame, value: Column, confidence: Column) -> DataFrame:
    return found.select(
        "file",
        "line",
        "nth",
        "type",
        value.alias("value"),
        "entropy",
        confidence.alias("confidence"),
        T.strip(F.col("whole_line")).alias("context"),
    )


def scan_secrets(sources: DataFrame, patterns=None, compat: bool = True) -> DataFrame:
    """Credentials by pattern: (file, line, nth, type, value masked, entropy, confidence, context)."""
    patterns = patterns or {**SECRET_PATTERNS, **({} if compat else CORRECTED_PATTERNS)}
    found = (
        _found(sources, patterns, "(?id)")
        .filter(~is_placeholder(F.col("value"), compat))
        .withColumn("entropy", T.entropy(F.col("value")))
    )
    level = F.when(F.col("entropy") > 4.0, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))
    return _shaped(found, T.mask_secret(F.col("value")), level)


def scan_high_entropy(
    sources: DataFrame,
    known: DataFrame | None = None,
    threshold: float = 4.5,
    compat: bool = True,
) -> DataFrame:
    """Quoted strings that look random, the first of a line, on lines without a known credential."""
    value = F.col("value")
    found = (
        _found(sources, {"HIGH_ENTROPY_STRING": QUOTED}, "(?d)")
        .filter(~is_placeholder(value, compat) & ~is_likely_code(value))
        .withColumn("entropy", T.entropy(value))
        .filter(F.col("entropy") > threshold)
    )
    shaped = _shaped(found, T.mask_secret(value), F.lit("MEDIUM"))
    if known is not None:
        shaped = secret_lines_anti(shaped, known)
    rest = [c for c in shaped.columns if c not in ("file", "line")]
    return (
        shaped.groupBy("file", "line")
        .agg(F.min_by(F.struct(*rest), "nth").alias("_first"))
        .select("file", "line", "_first.*")
    )


def secret_lines_anti(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates on lines that have no known credential."""
    return candidates.join(known.select("file", "line").distinct(), ["file", "line"], "left_anti")


def scan_configs(sources: DataFrame) -> DataFrame:
    found = _found(sources, CONFIG_PATTERNS, "(?d)").withColumn("entropy", T.entropy(F.col("value")))
    return _shaped(found, F.col("value"), F.lit("LOW"))


def all_secrets(sources: DataFrame, threshold: float = 4.5, compat: bool = True) -> DataFrame:
    by_pattern = scan_secrets(sources, compat=compat)
    return by_pattern.unionByName(
        scan_high_entropy(sources, by_pattern, threshold, compat)
    ).unionByName(scan_configs(sources))


def extract_env_vars(sources: DataFrame, patterns: Iterable[str] = ENV_PATTERNS) -> DataFrame:
    """Distinct names of environment variables per file: (file, name)."""
    names = F.array_distinct(
        F.flatten(
            F.array(
                *[
                    F.regexp_extract_all("text", F.lit(p), F.lit(min(re.compile(p).groups, 1)))
                    for p in patterns
                ]
            )
        )
    )
    per_text = sources.select("file", F.explode_outer(names).alias("name"))
    return per_text.filter(F.col("name").isNotNull()).distinct()


def promote_secrets(secrets: DataFrame) -> DataFrame:
    """Credentials of high confidence as findings."""
    key_like = F.col("type").contains("KEY") | F.col("type").contains("TOKEN")
    return secrets.filter(F.col("confidence").isin("HIGH", "CRITICAL")).select(
        "file",
        "line",
        F.concat(F.lit("SECRET_"), "type").alias("type"),
        F.when(key_like, F.lit("CRITICAL")).otherwise(F.lit("HIGH")).alias("severity"),
        F.format_string("%s: %s (entropy: %.2f)", "type", "value", "entropy").alias("evidence"),
        "confidence",
    )
