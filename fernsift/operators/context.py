"""What surrounds a line: context flags, multi-line chains, security words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsift.functions import text as T
from fernsift.functions.frames import BLOCK, running_sum, sliding
from fernsift.operators.chains import FLAGS, advances, completes, echo_facts, echoes, ends_made, is_echo, steps_of
from fernsift.operators.lines import is_eligible
from fernsift.operators.rules import anchors

# Words for values that come from outside, words for cleaning them, security words.
USER_INPUT_WORDS = [
    "location.search", "location.hash", "location.href", "location.pathname",
    "document.location", "document.URL", "document.referrer", "window.name",
    "URLSearchParams", "params", "query", "innerHTML", "value", "getAttribute",
    "localStorage", "sessionStorage", "cookie", "fetch", "XMLHttpRequest",
    "postMessage", "event.data", "WebSocket", "FileReader", "req.body",
    "req.params", "req.query", "props", "state", "useParams", "match.params",
]
SANITIZER_WORDS = [
    "sanitize", "sanitizeHTML", "escape", "escapeHTML", "encode", "encodeURI",
    "encodeURIComponent", "DOMPurify", "xss", "validator", "textContent",
    "createTextNode", "Handlebars.escapeExpression", "_.escape",
]
SECURITY_WORDS = [
    "admin", "password", "credential", "auth", "token", "session", "jwt",
    "oauth", "bearer", "apikey", "api_key", "secret", "private", "key",
    "ssn", "credit", "card", "cvv", "bank", "account", "routing",
    "encrypt", "decrypt", "hash", "salt", "cipher", "certificate",
    "permission", "privilege", "role", "access", "authorize", "authenticated",
    "internal", "debug", "test", "dev", "staging", "prod", "master", "root",
]
DECLARES = r"(?:var|let|const)\s+(\w+)\s*="
VALIDATES = r"(?i)if\s*\(.*(?:typeof|instanceof|Array\.isArray|\.test\s*\(|\.match\s*\(|validator\.)"
TRIES = r"try\s*\{|catch\s*\("
AUTHENTICATES = r"(?i)function\s+\w*(?:auth|login|verify|check|validate)\w*"
AWAITS = r"async\s+function|await\s+"
FRAMEWORKS = {
    "React": r"React|useState|useEffect",
    "Vue": r"Vue|v-model|v-bind",
    "Angular": r"(?i)@Component|@Injectable|angular",
}
ASSIGNS = r"[:=]\s*['\"`]|function\s|const\s|let\s|var\s"
CHAINS = [
    (r"(?:location|params|cookie|query)[^\n]*=\s*(\w+)[^\n]*\1[^\n]*innerHTML",
     "XSS_CHAIN_DOM", "CRITICAL", "User input flows to innerHTML"),
    (r"(?:fetch|axios)[^\n]*\.then[^\n]*innerHTML",
     "XSS_CHAIN_FETCH", "CRITICAL", "Fetch response flows to innerHTML"),
    (r"(?:localStorage|sessionStorage)\.getItem[^\n]*innerHTML",
     "XSS_CHAIN_STORAGE", "HIGH", "Storage data flows to innerHTML"),
    (r"(?:postMessage|event\.data)[^\n]*innerHTML",
     "XSS_CHAIN_POSTMSG", "CRITICAL", "PostMessage data flows to innerHTML"),
    (r"JSON\.parse[^\n]*Object\.assign",
     "PROTO_CHAIN_JSON", "CRITICAL", "JSON.parse to Object.assign - prototype pollution"),
    (r"localStorage\.getItem[^\n]*role[^\n]*if[^\n]*admin",
     "AUTH_CHAIN_LOCALSTORAGE", "CRITICAL", "Client-side role check from localStorage"),
    (r"atob[^\n]*split[^\n]*JSON\.parse[^\n]*(?:role|admin)",
     "AUTH_CHAIN_JWT_CLIENT", "CRITICAL", "Client-side JWT parsing for auth"),
    (r"(?:params|query)[^\n]*fetch",
     "SSRF_CHAIN", "HIGH", "User input flows to fetch"),
    (r"(?:params|query)[^\n]*location",
     "REDIRECT_CHAIN", "HIGH", "User input flows to location"),
    (r"(?:params|query|body)[^\n]*(?:exec|spawn)",
     "CMDI_CHAIN", "CRITICAL", "User input flows to command execution"),
    (r"(?:params|query|body)[^\n]*(?:\.query|\.raw|\.execute)",
     "SQLI_CHAIN", "CRITICAL", "User input flows to SQL query"),
]


def line_context(
    lines: DataFrame,
    window: int = 25,
    user_input=USER_INPUT_WORDS,
    sanitizers=SANITIZER_WORDS,
    block: int = BLOCK,
) -> DataFrame:
    """Flags of the lines ``window`` before to ``window`` after each line: (file, line, flags).

    Only the flags are shuffled, not the text.
    """
    text = F.col("text")
    framework = F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for n, p in FRAMEWORKS.items()])
    user = T.contains_any(text, user_input, ignore_case=True)
    flags = {
        "has_user_input": user,
        "has_sanitization": T.contains_any(text, sanitizers, ignore_case=True),
        "has_validation": text.rlike(VALIDATES),
        "in_try_catch": text.rlike(TRIES),
        "in_auth_function": text.rlike(AUTHENTICATES),
        "async_context": text.rlike(AWAITS),
    }
    compact = lines.select(
        "file",
        "line",
        *[c.alias(f"_{n}") for n, c in flags.items()],
        framework.alias("_framework"),
        F.when(user, T.group_or_null(text, DECLARES, 1)).alias("_var"),
    )
    columns = {n: (lambda w, n=n: F.bool_or(f"_{n}").over(w)) for n in flags}
    columns["framework"] = lambda w: F.first("_framework", ignorenulls=True).over(w)
    columns["tainted_vars"] = lambda w: F.array_sort(F.collect_set("_var").over(w))
    return sliding(compact, ["file"], "line", window, window, columns, block).select(
        "file", "line", *flags, "framework", "tainted_vars"
    )


def context_tainted_vars(lines: DataFrame, window: int = 25) -> DataFrame:
    """Names declared near a line from a value that comes from outside."""
    return line_context(lines, window).select(
        "file", "line", F.explode("tainted_vars").alias("name")
    )


MARKS = 30  # chains in one number, two bits each


def may_chain(text: Column, chains=CHAINS) -> Column:
    """False only for whole texts in which no chain can hold: those that lack, for each chain, all literals that one of its steps requires."""

    def needed(pattern: str) -> list[tuple[str, ...]]:
        sets = {literals for step in steps_of(pattern) for literals in anchors(step)}
        return sorted(sets, key=lambda s: (-min(map(len, s)), s))  # the rarest first

    def has(low: Column, sets: list[tuple[str, ...]]) -> Column:
        return reduce(lambda a, b: a & b, [T.any_of(F.contains(low, F.lit(w)) for w in s) for s in sets], F.lit(True))

    return T.let(F.lower(text), lambda low: T.any_of([F.lit(False), *[has(low, needed(pattern)) for pattern, *_ in chains]]))


def detect_chains(
    lines: DataFrame, chains=CHAINS, look_back: int = 10, block: int = BLOCK
) -> DataFrame:
    """Chains of steps within the last ``look_back`` eligible lines and the line itself.

    Texts are not shuffled for this: windows see what a line does to each chain, in a few numbers. Only the lines on which a chain
    holds are joined with their texts, for the evidence.
    A window is gone through for a chain only if one of its lines has the first step and one has the last.
    """
    steps = [steps_of(pattern) for pattern, *_ in chains]
    plain = [k for k, s in enumerate(steps) if not is_echo(s)]
    echo = [k for k, s in enumerate(steps) if is_echo(s)]
    text = F.col("text")
    codes = [advances(text, steps[k]).cast("long") for k in plain]
    any_step = text.rlike(FLAGS + "(?:" + "|".join(x for k in plain for x in steps[k]) + ")") if plain else F.lit(False)
    compact = lines.filter(is_eligible(text)).select(
        "file",
        "line",
        F.when(any_step, F.array(*codes)).alias("_codes"),
        *[echo_facts(text, steps[k]).alias(f"_echo{k}") for k in echo],
    )
    counted = running_sum(compact, ["file"], "line", F.lit(1), "_nth", block)
    ends_of = [ends_made(F.get("_codes", F.lit(at)), steps[k]) for at, k in enumerate(plain)]
    marks = [ends_of[at : at + MARKS] for at in range(0, len(plain), MARKS)]
    counted = counted.withColumns(
        {f"_ends_of{i}": reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(e, 2 * j) for j, e in enumerate(part)]) for i, part in enumerate(marks)}
    )
    windows = {"_all": lambda w: F.collect_list("_codes").over(w)}
    for i in range(len(marks)):
        windows[f"_some{i}"] = lambda w, i=i: F.bit_or(f"_ends_of{i}").over(w)
    for k in echo:
        windows[f"_starts{k}"] = lambda w, k=k: F.bool_or(f"_echo{k}.starts").over(w)
        windows[f"_ends{k}"] = lambda w, k=k: F.bool_or(f"_echo{k}.ends").over(w)
        windows[f"_facts{k}"] = lambda w, k=k: F.collect_list(f"_echo{k}").over(w)
    near = sliding(counted, ["file"], "_nth", look_back, 0, windows, block)

    def of_chain(at: int) -> Column:
        return F.filter(F.transform("_all", lambda c: F.get(c, F.lit(at))), lambda c: c.isNotNull())

    def both_ends(at: int) -> Column:
        return F.shiftright(f"_some{at // MARKS}", 2 * (at % MARKS)).bitwiseAND(3) == 3

    held = {k: both_ends(at) & F.when(both_ends(at), completes(of_chain(at), steps[k])) for at, k in enumerate(plain)}
    held |= {k: F.col(f"_starts{k}") & F.col(f"_ends{k}") & F.when(F.col(f"_starts{k}") & F.col(f"_ends{k}"), echoes(F.col(f"_facts{k}"))) for k in echo}
    hits = F.array_compact(
        F.array(
            *[
                F.when(held[k], F.struct(F.lit(name).alias("type"), F.lit(severity).alias("severity"), F.lit(f"\U0001f517 {what}: ").alias("what")))
                for k, (_, name, severity, what) in enumerate(chains)
            ]
        )
    )
    chained = near.select("file", "line", F.explode_outer(hits).alias("_c")).filter(F.col("_c").isNotNull())
    return chained.join(lines.select("file", "line", "text"), ["file", "line"]).select(
        "file", "line", "_c.type", "_c.severity", F.concat("_c.what", "text").alias("evidence")
    )


def first_security_word(text: Column, words=SECURITY_WORDS) -> Column:
    return T.first_of(F.lower(text), sorted(words))


def intel_keywords(lines: DataFrame, findings: DataFrame, words=SECURITY_WORDS) -> DataFrame:
    """One INFO finding for a line that has no other finding, has a security word and assigns."""
    text = F.col("text")
    may_assign = T.any_of(F.contains(text, F.lit(w)) for w in (":", "=", "function", "const", "let", "var"))
    named = (
        lines.filter(may_assign & text.rlike(ASSIGNS) & is_eligible(text))
        .withColumn("_word", first_security_word(text, words))
        .filter(F.col("_word").isNotNull())
    )
    return named.join(findings.select("file", "line").distinct(), ["file", "line"], "left_anti").select(
        "file",
        "line",
        F.lit("INTEL_KEYWORD").alias("type"),
        F.lit("INFO").alias("severity"),
        F.concat(
            F.lit("\U0001f50e '"), F.col("_word"), F.lit("': "), T.strip(text)
        ).alias("evidence"),
    )
