"""Toxicity by the nearest labelled examples, by exact TF-IDF cosine through a block-max inverted index.

``fit`` takes a bounded sample of labelled texts of either class as examples, picks the terms whose presence goes with
the label beyond chance, and counts in how many documents of the whole corpus each occurs. Examples become unit vectors of
(1 + log count) * log(1 + documents / document frequency) and are laid out in blocks; the index keeps the largest
weight of each term in each block. A text visits blocks by the bound that these give its cosine and stops
where the bound falls below its k-th best, so the neighbours are exact.

Neighbours vote, nearer ones with more weight; the vote becomes a probability by a logistic curve fitted to the votes that the
examples get when they are left out themselves, each class weighted as it is among all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernsift.llm.bpe import _schema
from fernsift.llm.shared import arrow_rows, column, pieces_of, store
from fernsift.llm.words import words_of

EXAMPLES_PER_CLASS = 2000  # bound of the sample
MOST_TERMS = 4096  # bound of the vocabulary
LEAST_CHI2 = 30.0  # association with the label that a term needs
LEAST_EXAMPLES = 5  # examples that hold a term at least
NEIGHBOURS = 15
BLOCK = 64
THRESHOLD = 0.3


def term_counts(part: pa.RecordBatch, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The different words of each text (A-Z folded, punctuation off) as hashes, and how often each occurs."""
    words = words_of(column(part, text), lower=True, letters=True)
    return [np.unique(words.of(i), return_counts=True) for i in range(part.num_rows)]


@dataclass
class Index:
    """Postings by term, ordered by example; ``cut[t, b]`` is where block b begins in them, ``top[t, b]`` its largest weight."""

    terms: np.ndarray  # sorted hashes
    idf: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    cut: np.ndarray
    top: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    norm_rate: float = 0.0  # probability for a text without any term
    slope: float = 1.0
    offset: float = 0.0

    def vector(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, unit weights) of a text; empty if it has no term of the index."""
        if not len(self.terms) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = self.terms[at] == hashes
        at = at[hit]
        w = (1 + np.log(counts[hit])) * self.idf[at]
        length = np.sqrt(np.sum(w * w))
        return (at, w / length) if length > 0 else (at[:0], w[:0])

    def neighbours(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines), best first: all with a positive cosine at least as large as the k-th largest."""
        bounds = weights @ self.top[terms] if len(terms) else np.zeros(0)
        order = np.argsort(-bounds, kind="stable")
        found, scores, kth = [], [], 0.0
        for b in order:
            if bounds[b] <= 0 or bounds[b] < kth - 1e-12:
                break
            sums = np.zeros(BLOCK)
            for t, w in zip(terms, weights, strict=True):
                s = slice(self.cut[t, b], self.cut[t, b + 1])
                sums[self.example[s] - b * BLOCK] += w * self.weight[s]
            if but // BLOCK == b:
                sums[but % BLOCK] = 0
            here = np.flatnonzero((sums > 0) & (sums >= kth - 1e-12))
            if len(here):
                found.append(here + b * BLOCK)
                scores.append(sums[here])
                every = np.concatenate(scores)
                if len(every) >= k:
                    kth = float(np.partition(every, len(every) - k)[len(every) - k])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        which, score = np.concatenate(found), np.concatenate(scores)
        enough = score >= kth - 1e-12
        which, score = which[enough], score[enough]
        best = np.lexsort((which, -score))
        return which[best], score[best]

    def vote(self, which: np.ndarray, cosines: np.ndarray) -> float:
        weight = 1 / (1.05 - np.minimum(cosines, 1.0))
        return float(np.sum(weight * self.toxic[which]) / np.sum(weight))

    def probability(self, vote: float | None) -> float:
        return self.norm_rate if vote is None else float(1 / (1 + np.exp(-(self.slope * vote + self.offset))))


def _lay_out(terms: np.ndarray, idf: np.ndarray, vectors: list[tuple[int, int, dict[int, float]]]) -> Index:
    """``vectors``: (id, label, {term: count}) of each example; neighbours in the layout share their weightiest term."""
    made = []
    for key, label, counts in vectors:
        at = np.array(sorted(counts), np.int64)
        w = (1 + np.log(np.array([counts[t] for t in at.tolist()], float))) * idf[at] if len(at) else np.zeros(0)
        length = np.sqrt(np.sum(w * w))
        w = w / length if length > 0 else w
        made.append((int(at[np.argmax(w)]) if len(at) else -1, key, label, at, w))
    made.sort(key=lambda m: (m[0], m[1]))
    blocks = max(1, -(-len(made) // BLOCK))
    example = np.concatenate([np.full(len(m[3]), i) for i, m in enumerate(made)] or [np.zeros(0)]).astype(np.int64)
    term = np.concatenate([m[3] for m in made] or [np.zeros(0)]).astype(np.int64)
    weight = np.concatenate([m[4] for m in made] or [np.zeros(0)])
    order = np.lexsort((example, term))
    example, term, weight = example[order], term[order], weight[order]
    cell = term * blocks + example // BLOCK
    edges = np.searchsorted(cell, np.arange(len(terms) * blocks + 1))
    cut = np.stack([edges[:-1].reshape(len(terms), blocks)[:, b] for b in range(blocks)] + [edges[blocks::blocks]], axis=1) if len(terms) else np.zeros((0, blocks + 1), np.int64)
    top = np.zeros(len(terms) * blocks)
    np.maximum.at(top, cell, weight)
    ids, toxic = np.array([m[1] for m in made], np.int64), np.array([m[2] for m in made], float)
    return Index(terms, idf, example, weight, cut, top.reshape(len(terms), blocks), ids, toxic)


def _calibrate(index: Index, share_toxic: float, k: int) -> None:
    """A logistic curve over left-out votes, and the rate among examples without any term, at the true class shares."""
    n1 = max(index.toxic.sum(), 1)
    n0 = max(len(index.toxic) - index.toxic.sum(), 1)
    weight_of = {1.0: share_toxic / n1, 0.0: (1 - share_toxic) / n0}
    by_example: list[list[tuple[int, float]]] = [[] for _ in index.toxic]
    term_of = np.repeat(np.arange(len(index.terms)), index.cut[:, -1] - index.cut[:, 0]) if len(index.terms) else []
    for t, e, w in zip(term_of, index.example, index.weight, strict=True):
        by_example[e].append((t, w))
    votes, labels, weights, none = [], [], [], [1e-4 * share_toxic, 1e-4]
    for e, vector in enumerate(by_example):
        w = weight_of[index.toxic[e]]
        which, cosines = (np.zeros(0), np.zeros(0)) if not vector else index.neighbours(np.array([t for t, _ in vector]), np.array([w for _, w in vector]), k, but=e)
        if len(which):
            votes.append(index.vote(which, cosines))
            labels.append(index.toxic[e])
            weights.append(w)
        else:
            none[0] += w * index.toxic[e]
            none[1] += w
    index.norm_rate = none[0] / none[1]
    x, y, w = np.array(votes), np.array(labels), np.array(weights)
    w = w * len(w) / max(w.sum(), 1e-12)
    rows = np.stack([x, np.ones(len(x))], axis=1) if len(x) else np.zeros((0, 2))
    b, ridge = np.array([4.0, -2.0]), np.array([0.5, 0.05])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(rows @ b)))
        step = np.linalg.solve((rows * (w * p * (1 - p))[:, None]).T @ rows + np.diag(ridge), rows.T @ (w * (p - y)) + ridge * (b - [4.0, -2.0]))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        b = b - step
        if np.abs(step).max() < 1e-9:
            break
    index.slope, index.offset = max(float(b[0]), 1e-6), float(b[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_class: int = EXAMPLES_PER_CLASS,
    k: int = NEIGHBOURS,
) -> Index:
    """Learn from ``labels(key, label)``, of which at most ``per_class`` rows of each class are taken, by a hash of the key.

    The examples, their terms and what is counted of these are bounded by ``per_class`` and ``MOST_TERMS`` and come to the
    driver; document frequencies are counted over all documents by the tasks. Null keys or labels are left out; a
    key with several labels has the largest; equal texts are one example.
    """
    named = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).dropna().groupBy("key").agg(F.max("label").alias("label"))
    named = store(named, "labels")
    share = named.agg(F.avg("label")).first()[0] or 0.0
    chosen = [named.filter(F.col("label") == c).orderBy(F.xxhash64("key"), "key").limit(per_class) for c in (0, 1)]
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def counted(batch: pa.RecordBatch):
        for part in pieces_of(batch, "text"):
            found = term_counts(part, "text")
            yield {"key": column(part, "key"), "label": column(part, "label"), "terms": [h.view(np.int64) for h, _ in found], "counts": [c for _, c in found]}

    texts = narrow.join(F.broadcast(chosen[0].unionByName(chosen[1])), "key").dropDuplicates(["key"])
    texts = texts.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("same"), "label").agg(F.min("key").alias("key"), F.first("text").alias("text"))
    examples = store(arrow_rows(texts.select("key", "label", "text"), counted, "key LONG, label INT, terms ARRAY<LONG>, counts ARRAY<INT>"), "examples")
    total = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    of_term = examples.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    off = a * (n0 - b) - b * (n1 - a)
    chi2 = (n0 + n1) * off * off / ((a + b) * (n0 + n1 - a - b) * F.lit(float(max(n1, 1))) * F.lit(float(max(n0, 1))))
    telling = of_term.filter((a + b >= LEAST_EXAMPLES) & (a + b < n0 + n1)).withColumn("chi2", chi2).filter(F.col("chi2") >= LEAST_CHI2)
    picked = telling.orderBy(F.desc("chi2"), "term").limit(MOST_TERMS).select("term").collect()
    terms = np.sort(np.array([r["term"] for r in picked], np.int64).view(np.uint64))

    n_docs, df = _document_frequencies(narrow, terms)
    idf = np.log(1 + n_docs / np.maximum(df, 1))
    number = {int(t): i for i, t in enumerate(terms.view(np.int64).tolist())}
    wanted = F.array(*[F.lit(t) for t in number]) if number else F.array().cast("array<bigint>")
    kept = F.filter(F.arrays_zip("terms", "counts"), lambda x: F.array_contains(F.col("wanted"), x["terms"]))
    vectors = [
        (r["key"], r["label"], {number[x["terms"]]: x["counts"] for x in r["kept"]})
        for r in examples.withColumn("wanted", wanted).select("key", "label", kept.alias("kept")).collect()
    ]
    index = _lay_out(terms, idf, vectors)
    _calibrate(index, share, k)
    return index


def _document_frequencies(narrow: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of documents, documents with each term) over the whole corpus; each batch sends a row per term it holds."""

    def make(batch: pa.RecordBatch):
        df = np.zeros(len(terms), np.int64)
        for part in pieces_of(batch, "text"):
            words = words_of(column(part, "text"), lower=True, letters=True)
            if len(terms) and len(words.hashes):
                at = np.minimum(np.searchsorted(terms, words.hashes), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == words.hashes)
                doc = np.searchsorted(words.first, hit, "right") - 1
                df += np.bincount(np.unique(doc * len(terms) + at[hit]) % len(terms), minlength=len(terms))
        held = np.flatnonzero(df)
        yield {"term": np.append(held, -1), "n": np.append(df[held], batch.num_rows)}

    out = np.zeros(len(terms), float)
    n_docs = 0
    for r in arrow_rows(narrow.select("text"), make, "term LONG, n LONG").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            n_docs = r["n"]
        else:
            out[r["term"]] = r["n"]
    return n_docs, out


def _scores(own: Index, part: pa.RecordBatch, text: str, k: int) -> tuple[list[float], list[list[dict]]]:
    words = words_of(column(part, text), lower=True, letters=True)
    at = np.minimum(np.searchsorted(own.terms, words.hashes), max(len(own.terms) - 1, 0))
    hit = np.flatnonzero(own.terms[at] == words.hashes) if len(own.terms) else np.zeros(0, np.int64)
    bounds = np.searchsorted(hit, words.first)
    scores, evidence = [], []
    for i in range(part.num_rows):
        mine = words.hashes[hit[bounds[i] : bounds[i + 1]]]
        which, cosines = own.neighbours(*own.vector(*np.unique(mine, return_counts=True)), k) if len(mine) else (mine, mine)
        scores.append(own.probability(own.vote(which, cosines) if len(which) else None))
        evidence.append([{"id": int(own.ids[e]), "toxic": int(own.toxic[e]), "cosine": float(c)} for e, c in zip(which[:5], cosines[:5], strict=True)])
    return scores, evidence


def score(
    docs: DataFrame, index: Index, keys: tuple[str, ...] = ("doc_id",), text: str = "text", k: int = NEIGHBOURS, threshold: float = THRESHOLD
) -> DataFrame:
    """``keys``, ``score``, ``predicted`` and ``evidence``: ids, labels and cosines of the five nearest examples.

    Nothing but the text decides. A null, empty or blank text, or one without any of the index's terms, has no neighbours
    and gets the rate that such texts have among the examples. Rows are scored one by one, repeated ones alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample and the vocabulary

    def make(batch: pa.RecordBatch):
        for part in pieces_of(batch, text):
            scores, evidence = _scores(sent.value, part, text, k)
            yield {n: column(part, n) for n in keys} | {"score": scores, "predicted": [int(s >= threshold) for s in scores], "evidence": evidence}

    schema = "score DOUBLE, predicted INT, evidence ARRAY<STRUCT<id: LONG, toxic: INT, cosine: DOUBLE>>"
    return arrow_rows(docs.select(*keys, text), make, f"{_schema(docs, keys)}, {schema}")


def keep_clean(docs: DataFrame, index: Index, text: str = "text", k: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, with all of their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, text):
                yield part.filter(pa.array([s < threshold for s in _scores(sent.value, part, text, k)[0]]))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
