"""Secret scan with ownership over the corpus.

Three base kinds are found by pattern in every text. Further candidates, long mixed tokens, are common in harmless
text, so patterns alone can't tell; the corpus can: a value that several owners have is a copied example, one that
a single owner has, in any number of its repositories, looks live. Candidates that look live are added to the base spans. The same
counts say for base spans how many of a document's are live-looking or copied, and the owners and repositories of each span's value
stand beside it, so that a reader can tell a key of one repository from one that an owner has everywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsift.llm.shared import arrow_rows, column, pieces_of, store

# The base kinds, in the order that breaks ties, with the least length of what is tested.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "mixed")

#: A further candidate: a run that holds small and capital letters and digits.
MIXED = re.compile(r"(?<![A-Za-z0-9+_=-])[A-Za-z0-9+_-]{24,}={0,2}(?![A-Za-z0-9+_=-])")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, value): leftmost matches that do not overlap, of each kind by itself."""
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                yield m.start(), m.end(), "assign", m[2]
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST["access"]:
            yield m.start(), m.end(), "access", m[0]
    for m in HEX.finditer(text):
        yield m.start(), m.end(), "hex", m[0]


def mixed_spans(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in MIXED.finditer(text):
        run = m[0]
        if any(c.isdigit() for c in run) and any("a" <= c <= "z" for c in run) and any("A" <= c <= "Z" for c in run):
            yield m.start(), m.end(), "mixed", run


def spell(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def candidates(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per document with a row number of its own, its base results, and its candidates as hashed values."""

    def make(batch: pa.RecordBatch):
        for part in pieces_of(batch, "_text"):
            rows = []
            for t in column(part, "_text"):
                t = t.as_py() or ""
                base = list(base_spans(t))
                taken = [(s, e) for s, e, _, _ in base]
                more = [x for x in mixed_spans(t) if not any(s < x[1] and x[0] < e for s, e in taken)]
                spans = spell([x[:3] for x in base])
                rows.append(
                    (
                        *(sum(x[2] == k for x in base) for k in KINDS[:3]),
                        hashlib.sha256(spans.encode()).hexdigest(),
                        spans,
                        [{"value": hashlib.sha256(v.encode()).hexdigest(), "kind": k, "start": s, "end": e} for s, e, k, v in (*base, *more)],
                    )
                )
            yield {c: column(part, c) for c in others} | {n: [r[i] for r in rows] for i, n in enumerate(("n_assign", "n_access", "n_hex", "base_sha256", "base_spans", "found"))}

    narrow = docs.select(
        *[F.col(k) for k in keys],
        F.col(owner).cast("string").alias("_owner"),
        F.col(repository).cast("string").alias("_repository"),
        F.col(text).alias("_text"),
    )
    others = [c for c in narrow.columns if c != "_text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "_text")
    schema = f"{kinds}, n_assign LONG, n_access LONG, n_hex LONG, base_sha256 STRING, base_spans STRING, found ARRAY<STRUCT<value: STRING, kind: STRING, start: INT, end: INT>>"
    return store(arrow_rows(narrow, make, schema).withColumn("_row", F.monotonically_increasing_id()), "secret-candidates")


def ownership(found: DataFrame, most_repositories: int | None = None) -> DataFrame:
    """``value``, ``owners``, ``repositories``, ``live``: over all documents, each owner's repositories counted first.

    One owner makes a value live, in at most ``most_repositories`` if that is given.
    A value in a third of all documents costs one row per task, owner and repository; null is an owner and a repository of its own.
    """
    return (
        found.select(F.explode("found.value").alias("value"), F.col("_owner").alias("owner"), F.col("_repository").alias("repository"))
        .distinct()
        .groupBy("value", "owner")
        .agg(F.count("*").alias("repositories"))
        .groupBy("value")
        .agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
        .withColumn("live", (F.col("owners") == 1) & (F.lit(most_repositories is None) | (F.col("repositories") <= F.lit(most_repositories))))
    )


def scan(
    docs: DataFrame,
    text: str = "text",
    keys: tuple[str, ...] = ("doc_id",),
    owner: str = "source",
    repository: str = "doc_id",
    most_repositories: int | None = None,
) -> DataFrame:
    """``keys``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_live``, ``n_copied``, ``owners``, ``repositories``.

    ``spans`` holds the base spans and the further candidates that look live, as kind:start:end in code points; ``owners`` and
    ``repositories`` hold, in the order of the spans, how many over the corpus have the value of each. One
    row per input row, repeated ones and null keys too; a null text is an empty one and holds nothing.
    """
    found = candidates(docs, text, keys, owner, repository)
    judged = (
        found.filter(F.size("found") > 0)
        .select("_row", F.explode("found").alias("x"))
        .select("_row", "x.*")
        .join(ownership(found, most_repositories), "value")
        .groupBy("_row")
        .agg(
            F.sum(F.col("live").cast("long")).alias("n_live"),
            F.sum((~F.col("live")).cast("long")).alias("n_copied"),
            F.collect_list(F.when((F.col("kind") != "mixed") | F.col("live"), F.struct("start", "kind", "end", "owners", "repositories"))).alias("all"),
        )
    )
    rank = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(
        F.transform(
            "all",
            lambda x: F.struct(x["start"], F.array_position(rank, x["kind"]).alias("nth"), x["kind"], x["end"], x["owners"], x["repositories"]),
        )
    )

    def joined(item: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.array_join(F.transform("all", item), ","), F.lit(""))

    judged = judged.withColumn("all", ordered)
    return found.join(judged, "_row", "left").select(
        *keys,
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        joined(lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        joined(lambda x: x["owners"].cast("string")).alias("owners"),
        joined(lambda x: x["repositories"].cast("string")).alias("repositories"),
    )
