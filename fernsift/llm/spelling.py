"""Spelling variants by Bloom-guided neighbourhoods.

All words of the corpus are counted, first in the tasks that read the texts. The vocabulary, the frequent ones of some length,
is put into blocked Bloom filters, one per word length: a word sets eight bits of one block of 256. Every word's edits are generated
from its code points as hashes, without building strings, and looked up in the filter of their length. Only those found go through a
shuffle, to an exact join with the vocabulary that takes the false positives away.

Of the words one edit apart the longer one deletes and, of equal length, the smaller code point is replaced by the larger, so each pair is
probed once and stands for both directions.

Filters are broadcast. They take ``BITS`` a word and ``MOST_BYTES`` together at most: a larger vocabulary is cut by hash into parts
that fit, which are broadcast one after the other, and every word probes each.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernsift.llm.shared import column, store
from fernsift.llm.words import U, mix

RUN = "[A-Za-zÀ-ÿ]+"
DAMAGED = 199  # one occurrence key in so many loses a code point; none do if null
LEAST_CHARS = 6
LEAST_COUNT = 5
RATIO = 5  # a form is at least so many times as frequent
BITS = 24  # of a filter, per word
MOST_BYTES = 1 << 26  # of all filters broadcast at once
CHUNK = 1024  # blocks that one task fills at once
HELD = 400_000  # words that a task counts before it sends them on
PROBED = 1 << 20  # edits looked up at once
_FOLD = {c: c + 32 for c in range(0x41, 0x5B)}
_BASE = U(0x9E3779B97F4A7C15)


def damaged(key: object, run: str, every: int | None) -> str:
    """A run of letters without one of its code points, if its key and itself hash to a multiple of ``every``."""
    if every is None or key is None:
        return run
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counts(docs: DataFrame, key: str, text: str, least_chars: int, least_count: int, every: int | None) -> DataFrame:
    """``word``, ``n`` of the words that are long and frequent enough."""
    find = re.compile(RUN).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for k, t in zip(column(batch, "key").to_pylist(), column(batch, "text"), strict=True):
                own: defaultdict[str, int] = defaultdict(int)
                for w in find((t.as_py() or "").translate(_FOLD)):
                    own[w] += 1
                for w, n in own.items():
                    w = damaged(k, w, every)
                    if len(w) >= least_chars:
                        held[w] += n
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    parts = narrow.mapInArrow(run, "word STRING, n LONG")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def powers(n: int) -> np.ndarray:
    """What the places of a word of n code points count, the last one 1."""
    ascending = np.full(n, _BASE, np.uint64)
    ascending[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(ascending, dtype=np.uint64)[::-1]


def sums(p: np.ndarray) -> np.ndarray:
    """The hash of each row before mixing: a polynomial of its code points."""
    return (p * powers(p.shape[1])).sum(axis=1, dtype=np.uint64)


def lanes(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and eight numbers of 5 bits: the bit it has in each lane of 32."""
    h = mix(h)
    block = ((h >> U(32)) * U(blocks)) >> U(32)
    bit = mix(h ^ _BASE)
    return block.astype(np.int64), bit


def _bit(bit: np.ndarray, lane: int) -> np.ndarray:
    return ((bit >> U(5 * lane)) & U(31)).astype(np.uint32)


def fill(filter_: np.ndarray, block: np.ndarray, bit: np.ndarray) -> None:
    for lane in range(8):
        np.bitwise_or.at(filter_[:, lane], block, np.uint32(1) << _bit(bit, lane))


def held(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter may hold; each lane is asked only for what the lanes before let through."""
    block, bit = lanes(h, len(filter_))
    left = np.arange(len(h))
    for lane in range(8):
        left = left[(filter_[block[left], lane] >> _bit(bit[left], lane)) & np.uint32(1) == 1]
    return left


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (mix(h ^ U(0xA5A5A5A5)) % U(parts)).astype(np.int64)


def _by_length(words: list[str]) -> Iterator[list[str]]:
    groups: defaultdict[int, list[str]] = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    yield from groups.values()


def filters(vocabulary: DataFrame, blocks: dict[int, int], part: int, parts: int) -> dict[int, np.ndarray]:
    """The filter of each length over one part of the vocabulary: blocks are filled chunk by chunk in tasks; bounded by ``MOST_BYTES``."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _by_length(batch.column(0).to_pylist()):
                h = sums(points(words))
                h = h[part_of(h, parts) == part]
                n = len(words[0])
                block, bit = lanes(h, blocks[n])
                yield pa.RecordBatch.from_pydict({"length": pa.array([n] * len(h), pa.int32()), "chunk": block // CHUNK, "block": block % CHUNK, "bit": bit.view(np.int64)})

    def chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros((CHUNK, 8), np.uint32)
        fill(own, rows["block"].to_numpy(), rows["bit"].to_numpy().view(np.uint64))
        return pd.DataFrame({"length": [key[0]], "chunk": [key[1]], "bits": [own.tobytes()]})

    placed = vocabulary.select("word").mapInArrow(places, "length INT, chunk LONG, block LONG, bit LONG")
    made = placed.groupBy("length", "chunk").applyInPandas(chunk, "length INT, chunk LONG, bits BINARY").collect()
    out = {n: np.zeros((-(-k // CHUNK) * CHUNK, 8), np.uint32) for n, k in blocks.items()}
    for r in made:
        out[r["length"]][r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["bits"], np.uint32).reshape(CHUNK, 8)
    return {n: f[: blocks[n]] for n, f in out.items()}


def neighbours_of(words: list[str], alphabet: np.ndarray, ask) -> Iterator[tuple[list[str], list[str]]]:
    """(words, edits) that the filters let through, for words of one length. ``ask(length, hashes)`` gives the places of those held."""
    p = points(words)
    n, power = p.shape[1], powers(p.shape[1])
    whole = sums(p)
    step = max(1, PROBED // max(1, n * len(alphabet)))
    for at in range(0, len(words), step):
        q, h = p[at : at + step], whole[at : at + step]
        # a larger code point in each place
        larger = alphabet[None, None, :] > q[:, :, None]
        i, j, k = np.nonzero(larger)
        hit = ask(n, h[i] + (alphabet[k] - q[i, j]) * power[j])
        i, j, k = i[hit], j[hit], k[hit]
        yield [words[at + x] for x in i], [words[at + x][:y] + chr(c) + words[at + x][y + 1 :] for x, y, c in zip(i, j, alphabet[k].tolist(), strict=True)]
        if n < 2:
            continue
        # each place deleted; of equal neighbours the first
        own = q * power
        behind = np.cumsum(own[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1] - own
        shifted = q * np.concatenate([power[1:], np.zeros(1, np.uint64)])
        before = np.cumsum(shifted, axis=1, dtype=np.uint64) - shifted
        first = np.ones(q.shape, bool)
        first[:, 1:] = q[:, 1:] != q[:, :-1]
        i, j = np.nonzero(first)
        hit = ask(n - 1, before[i, j] + behind[i, j])
        i, j = i[hit], j[hit]
        yield [words[at + x] for x in i], [words[at + x][:y] + words[at + x][y + 1 :] for x, y in zip(i, j, strict=True)]


def probe(vocabulary: DataFrame, held_in: dict[int, np.ndarray], alphabet: list[int], part: int, parts: int) -> DataFrame:
    """``word``, ``n``, ``edit``: edits that may be in this part of the vocabulary."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(held_in)
    letters = np.array(alphabet, np.uint64)

    def ask(length: int, h: np.ndarray) -> np.ndarray:
        mine = np.flatnonzero(part_of(h, parts) == part) if parts > 1 else np.arange(len(h))
        own = sent.value.get(length)
        return mine[held(own, h[mine])] if own is not None and len(own) else mine[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                times = dict(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                for words in _by_length(list(times)):
                    for word, edit in neighbours_of(words, letters, ask):
                        if word:
                            yield pa.RecordBatch.from_pydict({"word": word, "n": [times[w] for w in word], "edit": edit})

    return vocabulary.select("word", "n").mapInArrow(run, "word STRING, n LONG, edit STRING")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n``: every word with each word one edit away, both ways."""
    about = vocabulary.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("words")).collect()
    alphabet = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().select(F.ascii("c").alias("c"))
    letters = sorted(r["c"] for r in alphabet.collect())  # at most as many as the run's class has
    total = sum(r["words"] for r in about)
    parts = max(1, -(-total * BITS // (8 * MOST_BYTES)))
    blocks = {r["length"]: -(-r["words"] * BITS // (256 * parts)) for r in about}
    edits = None
    for part in range(parts):
        found = store(probe(vocabulary, filters(vocabulary, blocks, part, parts), letters, part, parts), "edits")
        edits = found if edits is None else edits.unionByName(found)
    known = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    pairs = store(edits.distinct().join(known, "edit"), "near-words")
    return pairs.select("word", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")).unionByName(
        pairs.select(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the last word that the forms lead to. Ways double in each round; counts grow along them, so they end."""
    ways = store(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        longer = store(longer, "ways")
        if longer.filter("moved").isEmpty():
            return longer.select("word", "root")
        ways = longer.select("word", "root")


def group(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    damage_every: int | None = None,
) -> DataFrame:
    """One row per word of the vocabulary: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are runs of letters (A-Z and the Latin-1 ones), A-Z folded, with at least ``least_chars`` code points and ``least_count``
    occurrences in all texts. ``n_near`` counts the words that differ by one inserted, deleted or replaced code point; ``form`` is the
    most frequent of them (ties: the first in code-point order) if it is at least ``ratio`` times as frequent, else null. ``root`` is
    the last word that forms lead to, the word itself if it has none.

    ``damage_every`` plants misspellings for tests: a run loses one code point where CRC-32 of key and run is a
    multiple; rows without a key are left alone. Null and empty texts have no words; repeated rows count as often as they are there; an empty
    table gives no rows.
    """
    vocabulary = store(counts(docs, key, text, least_chars, least_count, damage_every), "vocabulary")
    of_word = near_pairs(vocabulary).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    about = vocabulary.join(of_word, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    more = F.col("near_n") >= ratio * F.col("n")
    about = store(about.select("word", "n", "n_near", F.when(more, F.col("near")).alias("form"), F.when(more, F.col("near_n")).alias("form_n")), "variants")
    ended = roots(about.filter("form is not null").select("word", "form"))
    return about.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
