"""Near-duplicates by an inverted join on MinHash signature coordinates.

Every text has a set of word shingles and a signature of ``COORDINATES`` numbers, of which two texts share each with the
probability of their similarity. Texts with equal sets become one class first. Classes are posted under their
(coordinate, value) pairs; values that occur once can't collide and are skipped, so classes with fewer than ``MATCHES``
values left are out. Two classes that share ``MATCHES`` coordinates must meet in a list of one of a class's rarest
values: all but ``MATCHES - 1`` of its live ones (prefix). Only these lists are merged.

A list isn't expanded into its pairs. Its classes are first compared to its most central one; lists whose classes all
are known to be in one component then are skipped. In the others, a class can only have further links if enough of its
shingles occur in another class that is left, which drops strongly edited copies for good. What remains is compared pair
by pair inside the join, each pair in the first list that it shares, and only links come out of it: those of different
components that share enough coordinates and enough of their full sets.

With 40 coordinates and 20 matches a pair of similarity 0.8 is overlooked with a probability of about 5e-6, one of 0.85 with
4e-8.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernsift.llm.graph import components
from fernsift.llm.shared import arrow_rows, column, pieces_of, store
from fernsift.llm.words import U, mix, windows, words_of

COORDINATES = 40
MATCHES = 20
SHINGLE = 5
PERCENT = 80
CENTRE_ROUNDS = 2


@lru_cache(maxsize=4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * U(0xD1342543DE82EF95))
    return seeds[::2, None], seeds[1::2, None] | U(1)


def signature(hashes: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    shift, factor = _functions(n)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[None, k : k + 4096] ^ shift) * factor).min(axis=1))
    return mix(least)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; A-Z folded."""
    words = words_of(texts, lower=True)
    return [np.unique(windows(words.of(i), size)) for i in range(len(texts))]


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    one, two = mix(hashes), mix(hashes ^ U(0xA5A5A5A5DEADBEEF))
    total = np.sum(one, dtype=np.uint64), np.sum(two, dtype=np.uint64)
    return int(total[0].astype(np.int64)), int(total[1].astype(np.int64))


def features(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Per row: the key, the size of its set, two halves of the set's digest and the signature (null without words)."""

    def make(batch: pa.RecordBatch):
        for part in pieces_of(batch, "text"):
            sets = shingle_sets(column(part, "text"), size)
            digests = [_digest(s) for s in sets]
            yield {
                "key": column(part, "key"),
                "n_shingles": [len(s) for s in sets],
                "d1": [d[0] if len(s) else None for d, s in zip(digests, sets, strict=True)],
                "d2": [d[1] if len(s) else None for d, s in zip(digests, sets, strict=True)],
                "signature": [signature(s).view(np.int64) if len(s) else None for s in sets],
            }

    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    schema = "key LONG, n_shingles LONG, d1 LONG, d2 LONG, signature ARRAY<LONG>"
    return store(arrow_rows(narrow, make, schema).withColumn("row", F.monotonically_increasing_id()), "signatures")


def _prefix_lists(classes: DataFrame) -> DataFrame:
    """``node``, ``centre`` (how many others its values meet) and ``list`` for the rarest values of each class."""
    posted = classes.select("node", F.posexplode("signature").alias("i", "v")).select("node", F.xxhash64("i", "v").alias("list"))
    shared = posted.groupBy("list").agg(F.count("*").alias("n")).filter("n > 1")
    return (
        posted.join(shared, "list")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("n", "list"))).alias("live"), F.sum("n").alias("centre"))
        .filter(F.size("live") >= MATCHES)
        .select("node", "centre", F.explode(F.slice("live", 1, F.size("live") - (MATCHES - 1))).alias("x"))
        .select("node", "centre", "x.list")
    )


def _same(left: str, right: str) -> str:
    return f"size(filter(zip_with({left}, {right}, (x, y) -> x = y), z -> z))"


def _likely(x: str, y: str, percent: int) -> str:
    """Whether the sizes of two classes and the coordinates that they share allow a link; the cheap tests stand first."""
    sizes = f"100 * least({x}n_shingles, {y}n_shingles) >= {percent} * greatest({x}n_shingles, {y}n_shingles)"
    return f"{sizes} and {_same(f'{x}signature', f'{y}signature')} >= {MATCHES}"


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs ``(a, b)`` whose full sets are similar enough."""
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(x), F.col("hashes").alias(f"set_{x}")), x)
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("total"))
        .filter(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent)
        .select("a", "b")
    )


def _with_centre(lists: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs of each list's centre with the classes of its other components, as far as a link is likely."""
    best = lists.filter("not done").groupBy("list").agg(F.max(F.struct("centre", "node", "component")).alias("c"))
    pairs = lists.join(best, "list").filter("component <> c.component").select("node", F.col("c.node").alias("c_node")).distinct()
    pairs = pairs.join(about.select("node", F.struct("n_shingles", "signature").alias("x")), "node")
    pairs = pairs.join(about.select(F.col("node").alias("c_node"), F.struct("n_shingles", "signature").alias("y")), "c_node")
    pairs = pairs.filter(_likely("x.", "y.", percent))
    return store(pairs.select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")).distinct(), "likely")


def _able(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Lists without the classes that can have no link to another class in them, by their shingles that none of these has.

    ``live`` is the number of a class's shingles that occur in two or more classes of the lists: no similarity of
    it is above ``live`` / size.
    """
    held = sets.join(lists.select("node").distinct(), "node", "left_semi").select("node", F.explode("hashes").alias("h"))
    again = held.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    live = held.join(again, "h").groupBy("node").agg(F.count("*").alias("live"))
    return lists.join(live, "node").filter(F.col("live") * 100 >= F.col("n_shingles") * percent)


def _labels(links: DataFrame) -> DataFrame:
    """``node``, ``component``: the smallest class within two links. Classes of one label are in one component, and all
    classes around a centre have one label; whole components are only found at the end."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    further = both.join(near.select(F.col("a").alias("b"), "least"), "b").groupBy("a").agg(F.min("least").alias("component"))
    return further.select(F.col("a").alias("node"), "component")


def _relabel(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Lists with their classes' labels, and which of these a centre has had; lists with one label go."""
    labelled = lists.drop("component").join(_labels(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = store(labelled, "labelled")
    best = F.max(F.when(~F.col("done"), F.struct("centre", "node", "component"))).alias("c")
    of_list = labelled.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), best).filter("lo < hi")
    seen = labelled.join(of_list.select("list", "c"), "list")
    done = F.col("done") | F.coalesce(F.col("component") == F.col("c.component"), F.lit(False))
    return seen.withColumn("done", done).drop("c")


def _several(lists: DataFrame) -> DataFrame:
    """Lists that have more than one component."""
    mixed = lists.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return lists.join(mixed.select("list"), "list", "left_semi")


def _rest(lists: DataFrame, about: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` of different components that share a list; the costly tests stand last."""
    own = lists.groupBy("node").agg(F.collect_list("list").alias("own"))
    left = lists.select("list", "node", "component", "n_shingles", "live").join(own, "node")
    left = left.join(about.select("node", "signature"), "node").join(sets, "node")
    tests = [
        "x.list = y.list and x.node < y.node and x.component <> y.component",
        f"100 * least(x.live, y.live) >= {percent} * (x.n_shingles + y.n_shingles - least(x.live, y.live))",
        "x.list = array_min(array_intersect(x.own, y.own))",
        _likely("x.", "y.", percent),
        f"{100 + percent} * size(array_intersect(x.hashes, y.hashes)) >= {percent} * (x.n_shingles + y.n_shingles)",
    ]
    return left.alias("x").join(left.alias("y"), F.expr(" and ".join(tests))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: the key, ``n_shingles``, ``component_id`` and ``kept``.

    Two texts are linked if their sets of ``size``-word shingles (A-Z folded; a shorter text is one shingle) share at least
    ``percent`` per cent of their union. ``component_id`` is the smallest key reachable by links, and the row with that key is
    kept. A null, empty or blank text is linked with nothing. Rows with a null key are compared like others, but name no component; one
    whose component has no key at all is kept. Rows that repeat a key are rows of their own; equal ones get the same result.
    """
    rows = features(docs, key, text, size)
    filled = rows.filter("n_shingles > 0")
    classes = store(
        filled.groupBy("d1", "d2")
        .agg(F.min("key").alias("least_key"), F.min("row").alias("node"))
        .join(filled.select(F.col("row").alias("node"), F.col("key").alias("a_key"), "n_shingles", "signature"), "node"),
        "classes",
    )
    lists = store(_prefix_lists(classes), "prefixes")
    about = classes.join(lists.select("node").distinct(), "node", "left_semi")
    about = store(about.select("node", "d1", "d2", "a_key", "n_shingles", "signature"), "listed")
    sets = _sets(docs, about, key, text, size)
    lists = lists.join(about.select("node", "n_shingles"), "node").withColumn("component", F.col("node")).withColumn("done", F.lit(False))
    links = None
    for k in range(CENTRE_ROUNDS):
        if lists.isEmpty():
            break
        found = store(_confirm(_with_centre(lists, about, percent), sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        lists = store(_relabel(lists, links), "lists")
        if k == 0:
            lists = store(_several(store(_able(lists, sets, percent), "able")), "lists")
    if links is None:
        links = lists.select(F.col("node").alias("a"), F.col("node").alias("b"))
    elif not lists.isEmpty():
        links = store(links.unionByName(_rest(lists, about, sets, percent)), "links")
    named = classes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = store(named.select("node", "d1", "d2", "component", "least_key"), "named")
    least = named.groupBy("component").agg(F.min("least_key").alias("component_id"))
    of_class = named.join(least, "component").select("d1", "d2", "component_id")
    out = filled.join(of_class, ["d1", "d2"]).select("key", "n_shingles", "component_id")
    empty = rows.filter("n_shingles = 0").select("key", "n_shingles", F.col("key").alias("component_id"))
    return out.unionByName(empty).select(
        F.col("key").alias(key),
        "n_shingles",
        "component_id",
        F.col("key").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which ``dedup`` keeps the key; rows without a key stay.

    Rows that repeat a key are one document here, which goes if any of them has a smaller key in its component.
    """
    gone = store(dedup(docs, key, text, size, percent).filter(~F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias("_gone")), "gone")
    return docs.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def _sets(docs: DataFrame, about: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``node`` and the full set of shingles of the classes that are in a list, from their texts."""

    def make(batch: pa.RecordBatch):
        for part in pieces_of(batch, "text"):
            sets = shingle_sets(column(part, "text"), size)
            digests = [_digest(s) for s in sets]
            yield {"d1": [d[0] for d in digests], "d2": [d[1] for d in digests], "hashes": [s.view(np.int64) for s in sets]}

    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("text is not null")
    wanted = about.select("a_key").distinct().hint("shuffle_hash")
    picked = narrow.join(wanted, F.col("key").eqNullSafe(F.col("a_key")), "left_semi").select("text")
    made = arrow_rows(picked, make, "d1 LONG, d2 LONG, hashes ARRAY<LONG>")
    of_node = about.select("node", "d1", "d2").join(made, ["d1", "d2"])
    return store(of_node.select("node", "hashes").dropDuplicates(["node"]), "sets")
