"""Quality rules as a short-circuit cascade.

Each rule's cost and the share it rejects are estimated on a sample; rules then run in order of rejection per cost, and a
document that one rule rejects is not looked at by the next. Which documents stay doesn't depend on the order;
what a rejected one costs does. Every task takes its sample from its own rows, so nothing is read twice or sent for it, and
sources that differ may get orders of their own.

Words are runs of characters other than space and ``\\x09-\\x0D``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernsift.llm.bpe import _schema
from fernsift.llm.shared import arrow_rows, column, pieces_of
from fernsift.llm.words import raw, windows, words_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_BLANK = b" \t\n\x0b\x0c\r"


class Text:
    """One whole text; each measure is taken when a rule first asks for it."""

    def __init__(self, body: bytes, words: np.ndarray, chars: int):
        self.body, self.words, self.word_chars = body, words, chars

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def n_symbols(self) -> int:
        return len(self.body) - len(self.body.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> tuple[int, int]:
        """(lines with a word, those of them that equal an earlier line)."""
        seen: set[bytes] = set()
        n = 0
        for line in self.body.split(b"\n"):
            if line.strip(_BLANK):
                n += 1
                seen.add(line)
        return n, n - len(seen)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in runs of eight words that occur twice or more, the first time included."""
        if self.n_words <= WINDOW:
            return 0
        _, which, times = np.unique(windows(self.words, WINDOW), return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[which] > 1)
        if not len(again):
            return 0
        edge = np.zeros(self.n_words + 1, np.int64)
        edge[again] += 1
        edge[again + WINDOW] -= 1
        return int(np.count_nonzero(np.cumsum(edge)))

    @cached_property
    def top_word(self) -> int:
        """How often the most frequent word occurs."""
        return int(np.unique(self.words, return_counts=True)[1].max()) if self.n_words else 0

    @cached_property
    def n_letters(self) -> int:
        """Bytes that are ASCII letters or belong to other characters than ASCII."""
        codes = np.frombuffer(self.body, np.uint8)
        folded = codes | 0x20
        return int(np.count_nonzero(((folded >= 0x61) & (folded <= 0x7A)) | (codes >= 0x80)))

    @cached_property
    def n_visible(self) -> int:
        return len(self.body.translate(None, _BLANK))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def too_few_words(t: Text) -> bool:
    return t.n_words < 20


def repeats_itself(t: Text) -> bool:
    return 100 * t.n_repeat_words > 30 * t.n_words


def many_symbols(t: Text) -> bool:
    return 5 * t.n_symbols > t.n_words


def many_equal_lines(t: Text) -> bool:
    return 2 * t.lines[1] > t.lines[0]


def odd_word_length(t: Text) -> bool:
    return not 2 * t.n_words <= t.word_chars <= 16 * t.n_words


def one_word_over_and_over(t: Text) -> bool:
    return 3 * t.top_word > t.n_words


def few_letters(t: Text) -> bool:
    return 10 * t.n_letters < 6 * t.n_visible


BASE = (Rule("too few words", too_few_words), Rule("repeats itself", repeats_itself))
RULES = (
    *BASE,
    Rule("many symbols", many_symbols),
    Rule("many equal lines", many_equal_lines),
    Rule("odd word length", odd_word_length),
    Rule("one word over and over", one_word_over_and_over),
    Rule("few letters", few_letters),
)

#: Rows of a task's sample, spread over its first batch; they have no bearing on which documents stay.
SAMPLE_ROWS = 64


def texts_of(batch: pa.RecordBatch, text: str) -> Iterator[Text]:
    rows = column(batch, text)
    body, at = raw(rows)
    body, words = body.tobytes(), words_of(rows)
    for i in range(len(rows)):
        yield Text(body[at[i] : at[i + 1]], words.of(i), int(words.chars[i]))


def measure(batch: pa.RecordBatch, rules: tuple[Rule, ...], text: str) -> tuple[list[float], list[int]]:
    """Seconds and rejected rows of each rule over a batch; each rule alone."""
    cost, hits = [0.0] * len(rules), [0] * len(rules)
    for part in pieces_of(batch, text):
        for i, rule in enumerate(rules):
            texts = list(texts_of(part, text))
            began = time.perf_counter()
            hits[i] += sum(map(rule.rejects, texts))
            cost[i] += time.perf_counter() - began
    return cost, hits


def sample_of(batch: pa.RecordBatch, rows: int = SAMPLE_ROWS) -> pa.RecordBatch:
    """At most so many rows at even distances."""
    if batch.num_rows <= rows:
        return batch
    return batch.take(pa.array(np.linspace(0, batch.num_rows - 1, rows).astype(np.int64)))


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", one_in: int = 1) -> dict[str, tuple[float, float]]:
    """(seconds per document, share rejected) of each rule by name, on one row in ``one_in``, picked by a hash of the text.

    Rows are measured where they are; only sums leave a task. Without rows there is no estimate.
    """

    def make(batch: pa.RecordBatch):
        cost, hits = measure(batch, rules, text)
        yield {"name": [r.name for r in rules], "cost": cost, "hits": hits, "n": [batch.num_rows] * len(rules)}

    told = (
        arrow_rows(docs.select(text).filter(F.pmod(F.xxhash64(text), F.lit(one_in)) == 0), make, "name STRING, cost DOUBLE, hits LONG, n LONG")
        .groupBy("name")
        .agg(F.sum("cost").alias("cost"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))
        .collect()
    )
    return {r["name"]: (r["cost"] / max(r["n"], 1), r["hits"] / max(r["n"], 1)) for r in told}


def order(rules: tuple[Rule, ...], estimates: dict[str, tuple[float, float]]) -> list[Rule]:
    """By share rejected per second, most first; without an estimate as written."""

    def worth(rule: Rule) -> float:
        cost, share = estimates.get(rule.name, (1.0, 0.0))
        return share / max(cost, 1e-9)

    return sorted(rules, key=worth, reverse=True)


def cascade(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    measures: bool = False,
    estimates: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """``keys``, ``kept``, ``failed_rule`` (the first that rejected it in the order used) and ``n_tried`` rules.

    A null text is an empty one. Rows are judged one by one: repeated ones alike, null keys like others, other columns
    are not returned. Without ``estimates`` each task makes its own on a sample of its first batch. With ``measures`` the counts of the base rules come along for every document: ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``.
    """
    ordered = [] if estimates is None else order(rules, estimates)

    def make(batch: pa.RecordBatch):
        if not ordered and batch.num_rows:
            picked = sample_of(batch)
            cost, hits = measure(picked, rules, text)
            n = picked.num_rows
            ordered.extend(order(rules, {r.name: (c / n, h / n) for r, c, h in zip(rules, cost, hits, strict=True)}))
        for part in pieces_of(batch, text):
            out: dict = {k: column(part, k) for k in keys}
            rows = []
            for t in texts_of(part, text):
                tried, failed = 0, None
                for rule in ordered:
                    tried += 1
                    if rule.rejects(t):
                        failed = rule.name
                        break
                row = [failed is None, failed, tried]
                if measures:
                    row += [t.n_words, t.word_chars, t.n_symbols, t.lines[1], t.n_repeat_words, too_few_words(t) or repeats_itself(t)]
                rows.append(row)
            yield out | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    schema = "kept BOOLEAN, failed_rule STRING, n_tried INT"
    if measures:
        schema += ", n_words LONG, word_chars LONG, n_symbols LONG, n_dup_lines LONG, n_repeat_words LONG, base_failed BOOLEAN"
    names = [x.split()[0] for x in schema.split(", ")]
    return arrow_rows(docs.select(*keys, text), make, f"{_schema(docs, keys)}, {schema}")
