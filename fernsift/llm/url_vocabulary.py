"""URL filter: host and path rules, then a weighted vocabulary found by one Aho-Corasick pass.

A term counts where it stands as a whole word, that is, between characters other than letters and digits. One strict
term is enough to block, soft terms only if several different ones occur.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from fernsift.llm.bpe import _schema
from fernsift.llm.shared import arrow_rows, column

STRICT = (
    "porn", "porno", "xxx", "xvideos", "hentai", "milf", "camgirl", "camgirls", "escorts", "casino", "casinos",
    "viagra", "cialis", "warez", "keygen", "torrents", "payday-loans", "spam-farm", "link-farm",
)
SOFT = (
    "sex", "sexy", "nude", "adult", "adults", "erotic", "dating", "hot", "girls", "bet", "bets", "betting", "poker",
    "slots", "jackpot", "bonus", "pills", "pharmacy", "cheap", "replica", "loan", "loans", "crack", "cracked", "serial",
    "torrent", "free", "download", "spam", "seo", "backlinks",
)
SOFT_HITS = 2


@dataclass(frozen=True)
class UrlRule:
    """Holds for a host and all its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)

_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path); both empty for null and for what has no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((at for c in "/?#" if (at := rest.find(c)) >= 0), default=len(rest))
    path = rest[end:]
    stop = min((at for c in "?#" if (at := path.find(c)) >= 0), default=len(path))
    return rest[:end].translate(_UPPER), path[:stop]


class RuleBook:
    """The longest rule that fits, found by host suffix; of equally long ones the longer host, then block."""

    def __init__(self, rules: Iterable[UrlRule]):
        self.by_host: dict[str, list[UrlRule]] = {}
        for rule in rules:
            self.by_host.setdefault(rule.host, []).append(rule)

    def find(self, host: str, path: str) -> UrlRule | None:
        labels = host.split(".")
        fits = [
            rule
            for i in range(len(labels))
            for rule in self.by_host.get(".".join(labels[i:]), ())
            if path.startswith(rule.path)
        ]
        return max(fits, key=lambda r: (len(r.name), len(r.host), r.verdict), default=None)


class Vocabulary:
    def __init__(self, strict: tuple[str, ...], soft: tuple[str, ...]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for terms, is_strict in ((soft, False), (strict, True)):
            for term in terms:
                if term:
                    self.machine.add_word(term.lower(), (term.lower(), is_strict))
        if len(self.machine):
            self.machine.make_automaton()

    def hits(self, url: str) -> tuple[list[str], list[str]]:
        """(strict terms, different soft terms) that stand as whole words, in alphabetical order."""
        text = url.translate(_UPPER)
        found: tuple[set[str], set[str]] = (set(), set())
        if len(self.machine):
            for end, (term, is_strict) in self.machine.iter(text):
                start = end - len(term) + 1
                if not (start and text[start - 1].isalnum()) and not (end + 1 < len(text) and text[end + 1].isalnum()):
                    found[0 if is_strict else 1].add(term)
        return sorted(found[0]), sorted(found[1])


@lru_cache(maxsize=4)
def _tools(strict, soft, rules) -> tuple[Vocabulary, RuleBook]:
    return Vocabulary(strict, soft), RuleBook(rules)


def judge(
    pages: DataFrame,
    url: str = "url",
    keys: tuple[str, ...] = ("page_id",),
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    rules: tuple[UrlRule, ...] = RULES,
    soft_hits: int = SOFT_HITS,
) -> DataFrame:
    """``keys``, ``host``, ``path``, ``rule`` that decided (else null), ``verdict``, ``strict_terms``, ``soft_terms``.

    Terms are looked for in the whole url, in either case. A null or empty url has empty parts and is allowed. Every row is
    judged by itself, so repeated rows get the same; other columns of ``pages`` are neither read nor returned.
    """

    def make(batch: pa.RecordBatch):
        vocabulary, book = _tools(strict, soft, rules)
        rows = []
        for u in column(batch, url).to_pylist():
            host, path = split_url(u)
            rule = book.find(host, path)
            hard, mild = vocabulary.hits(u or "")
            verdict = rule.verdict if rule else "block" if hard or len(mild) >= soft_hits else "allow"
            rows.append((host, path, rule and rule.name, verdict, hard, mild))
        yield {k: column(batch, k) for k in keys} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    schema = "host STRING, path STRING, rule STRING, verdict STRING, strict_terms ARRAY<STRING>, soft_terms ARRAY<STRING>"
    names = [x.split()[0] for x in schema.split(", ")]
    return arrow_rows(pages.select(*keys, url), make, f"{_schema(pages, keys)}, {schema}")
