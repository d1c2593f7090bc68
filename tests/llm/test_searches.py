"""Hard negatives, spelling variants and the permutation index against brute force, and their edges."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fernsift.llm import hard_negatives, permutation_index, spelling
from fernsift.llm.tiles import meet, pack, packed, unpack

VECTORS = "vec_id LONG, embedding ARRAY<DOUBLE>, label INT, score DOUBLE, rank STRING, row INT, n INT, tile INT, kind INT, place INT"


def table(spark, rows):
    """Rows (key, vector, label) with other columns whose names clash with those of results and steps."""
    return spark.createDataFrame([(k, v, label, 0.5, "x", 1, 2, 3, 4, 5) for k, v, label in rows], VECTORS)


def awkward(rng, n=300, width=12):
    """Random and repeated vectors, one hot group, short, zero, null and non-finite ones, repeated and null keys."""
    make = lambda: [rng.gauss(0, 0.3) for _ in range(width)]
    hot = make()
    rows = [(i, make(), rng.randrange(4)) for i in range(n)]
    rows += [(n + i, [x + rng.gauss(0, 0.01) for x in hot], i % 2) for i in range(n // 3)]
    rows += [(1000 + i, list(hot), 3) for i in range(20)]
    rows += [(1100, [0.5, -0.25], 1), (1110, [0.0] * width, 1), (1120, [], 2), (1130, None, 1), (1140, make(), None)]
    rows += [(1150, [math.nan] + make()[1:], 1), (1160, [math.inf] + make()[1:], 2), (1170, [None] + make()[1:], 1)]
    return rows + [rows[7], rows[7], (None, make(), 1), (None, make(), 2), (-40, make(), 9)]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def mined(rows, every, scale=256):
    """anchor, positive, rank, negative and both scores, by the definition."""
    fit = [(k, label, [math.floor(scale * x) for x in v]) for k, v, label in rows if k is not None and label is not None and usable(v)]
    out = []
    for at, (a, label, v) in enumerate(fit):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), k, i, other) for i, (k, other, w) in enumerate(fit) if i != at)
        for less, p, _, _ in [x for x in scored if x[3] == label][:5]:
            fits = [(k, -s) for s, k, _, other in scored if other != label and -80 * less <= -100 * s <= -100 * less]
            out += [(a, p, r + 1, k, -less, s) for r, (k, s) in enumerate(fits[:5])]
    return Counter(out)


def columns(r, *names):
    return tuple(r[n] for n in names)


MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed):
    rows = awkward(random.Random(seed))
    found = hard_negatives.mine(table(spark, rows).repartition(5), F.col("vec_id") % 10 == 0).collect()
    assert Counter(columns(r, *MINED) for r in found) == mined(rows, 10)


def test_hard_negatives_large_numbers(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(0.5, 1) * 1e6 for _ in range(6)], i % 2) for i in range(40)]
    found = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert Counter(columns(r, *MINED) for r in found) == mined(rows, 10)  # beyond what doubles hold exactly
    huge = [(i, [1e200, float(i)], i % 2) for i in range(12)]
    assert hard_negatives.mine(table(spark, huge), F.col("vec_id") % 10 == 0).count() > 0


def test_hard_negatives_small(spark):
    empty = hard_negatives.mine(table(spark, []), F.col("vec_id") % 10 == 0)
    assert empty.columns == list(MINED) and empty.count() == 0
    alone = table(spark, [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 1)])
    assert hard_negatives.mine(alone, F.col("vec_id") % 10 == 0).count() == 0  # no positive
    assert hard_negatives.mine(alone, F.lit(None).cast("boolean")).count() == 0  # no anchor
    below = table(spark, [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [-1.0, 0.0], 1)])
    assert hard_negatives.mine(below, F.col("vec_id") % 10 == 0).count() == 0  # no window below zero
    same = table(spark, [(i, [1.0, 1.0], i % 2) for i in range(14)])
    got = sorted(columns(r, *MINED)[:4] for r in hard_negatives.mine(same, F.col("vec_id") % 10 == 0).collect())
    assert got == [(a, p, r + 1, 2 * r + 1) for a, five in ((0, (2, 4, 6, 8, 10)), (10, (0, 2, 4, 6, 8))) for p in five for r in range(5)]


@pytest.mark.parametrize("least", [-50.0, 0.0, 5.0, 40.0])
def test_threshold_index(least):
    rng = np.random.default_rng(4)
    rows, anchors = rng.normal(size=(300, 20)) * 3, rng.normal(size=(40, 20)) * 2
    limits = least + rng.uniform(0, 10, 40)
    index = hard_negatives.Index(rows, float(limits.min()), float(np.sqrt((anchors**2).sum(axis=1)).max()))
    i, j = index.over(anchors, limits)
    whole = anchors @ rows.T
    assert set(zip(*np.nonzero(whole >= limits[:, None]))) <= set(zip(i, j))
    assert least < 40 or len(i) < whole.size / 4 and any(len(row) < len(rows) for row, _ in index.lists)


def nearest(rows, every, k=20):
    fit = [(key, v) for key, v, _ in rows if usable(v) and any(v)]
    width = max(len(v) for _, v in fit)
    at = np.array([v + [0.0] * (width - len(v)) for _, v in fit])
    score = at @ at.T
    np.fill_diagonal(score, -np.inf)
    return {(key, i): np.sort(score[i])[::-1][: min(k, len(fit) - 1)] for i, (key, _) in enumerate(fit) if key is not None and key % every == 0}


def recall(found, wanted, k=20):
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r.score)
    hit = total = 0
    for (key, _), scores in wanted.items():
        total += len(scores)
        hit += min(len(scores), sum(s >= scores[-1] - 1e-9 for s in by_query.get(key, [])))
    return hit / total


@pytest.mark.parametrize("seed", [1, 2])
def test_search_finds_nearest(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(32)], 0) for i in range(4000)]
    found = permutation_index.search(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert recall(found, nearest(rows, 50)) >= 0.9
    assert len(found) == 20 * 80
    by_query = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        by_query.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    v = {k: np.array(x) for k, x, _ in rows}
    for q, list_ in by_query.items():
        assert list_ == sorted(list_) and len({k for _, k in list_}) == 20 and q not in {k for _, k in list_}
        assert all(abs(-s - v[q] @ v[k]) < 1e-9 for s, k in list_)


def test_search_hot_group(spark):
    """A third of the rows is one group of close copies: the cut by share alone would miss many of their best."""
    rng = random.Random(5)
    centre = [rng.gauss(0, 1) for _ in range(32)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in centre] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(32)], 0) for i in range(3000)]
    found = permutation_index.search(table(spark, rows), F.col("vec_id") % 30 == 0).collect()
    assert recall(found, nearest(rows, 30)) >= 0.95


def test_search_edges(spark):
    rows = awkward(random.Random(6))
    found = permutation_index.search(table(spark, rows), F.col("vec_id") % 20 == 0).collect()
    wanted = nearest(rows, 20)
    assert recall(found, wanted) >= 0.95
    assert {r.query_id for r in found} == {k for k, _ in wanted}  # vectors that are null, zero or not finite don't ask
    assert not {r.vec_id for r in found} & {1110, 1120, 1130, 1150, 1160, 1170}
    few = permutation_index.search(table(spark, [(0, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (None, [3.0], 0)]), F.col("vec_id") % 20 == 0)
    assert [columns(r, "rank", "vec_id", "score") for r in few.orderBy("rank").collect()] == [(1, 1, 5.0), (2, 2, 5.0), (3, None, 3.0)]
    none = permutation_index.search(table(spark, []), F.col("vec_id") % 20 == 0)
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.count() == 0
    unasked = permutation_index.search(table(spark, [(1, [1.0], 0), (2, [2.0], 0)]), F.col("vec_id") % 20 == 0)
    assert unasked.count() == 0
    large = permutation_index.search(table(spark, [(20 * i, [1e200 * (i + 1), 1.0], 0) for i in range(3)]), F.col("vec_id") % 20 == 0)
    assert large.count() == 6


def test_footrule():
    rng = np.random.default_rng(7)
    order = np.array([rng.permutation(12)[:5] for _ in range(30)])
    files = permutation_index.inverted(order, 12)
    place = np.full((30, 12), 5)
    np.put_along_axis(place, order, np.arange(5)[None].repeat(30, 0), axis=1)
    for i in range(30):
        assert (permutation_index.footrule(order[i], files, 30) == np.abs(place - place[i]).sum(axis=1)).all()


def variants(docs, every=199):
    """word -> (form, root, n, n_near, form_n) by comparing all words."""
    counted = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode()) if key is not None else 1
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counted[run] += 1
    words = {w: n for w, n in counted.items() if len(w) >= 6 and n >= 5}

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        a, b = sorted((a, b), key=len)
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[i + (len(a) == len(b)) :] == b[i + 1 :]

    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 5 * n else None
        out[w] = [form, None, n, len(near), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def misspelt(rng):
    base = ["banana", "bandana", "orchestra", "naïveté", "façades", "façade", "aaaaaaa", "aaaaaa", "garçons", "Über×÷ung", "straße", "élèves"]
    texts = []
    for _ in range(120):
        words = []
        for _ in range(60):
            w = list(rng.choice(base))
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice("abcéÿÀz")], [w[at], rng.choice("abcéÿÀz")]])
            words.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        texts.append(rng.choice([" ", ", ", "1", "—"]).join(words))
    return texts


def grouped(found):
    rows = found.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants(spark, seed):
    docs = list(enumerate(misspelt(random.Random(seed))))
    docs += [(None, docs[0][1]), (5, docs[5][1]), (507, None), (508, ""), (509, "12 34 !"), (510, "x" * 300_000), (511, "abcdefg " * 30_000)]
    df = spark.createDataFrame([(k, t, "w", 1) for k, t in docs], "doc_id LONG, text STRING, word STRING, n INT").repartition(6)
    wanted = variants(docs, 7)
    assert grouped(spelling.group(df, damage_every=7)) == wanted
    assert sum(w[0] is not None for w in wanted.values()) > 20


def test_spelling_roots(spark):
    """Forms lead on to the last, over more than one doubling of the way."""
    words = [f"lantern{'s' * k}" for k in range(6)]
    docs = [(0, " ".join(w for k, w in enumerate(words) for _ in range(5 ** (k + 1))))]
    got = grouped(spelling.group(spark.createDataFrame(docs, "doc_id LONG, text STRING")))
    assert got == variants(docs, 1 << 40)
    assert {w[1] for w in got.values()} == {words[-1]} and got[words[0]][0] == words[1]


def test_spelling_in_parts(spark, monkeypatch):
    """A vocabulary larger than what may be broadcast is probed part by part, with the same result."""
    docs = list(enumerate(misspelt(random.Random(3))))
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING")
    whole = grouped(spelling.group(df))
    monkeypatch.setattr(spelling, "MOST_BYTES", 512)
    assert grouped(spelling.group(df)) == whole


def test_spelling_empty(spark, no_docs, edge_docs):
    assert spelling.group(no_docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.group(no_docs).count() == 0
    spelling.group(edge_docs, damage_every=3).collect()


def test_bloom_filter_holds_all():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)
    own = np.zeros((500, 8), np.uint32)
    spelling.fill(own, *spelling.lanes(h, 500))
    assert len(spelling.held(own, h)) == 5000
    assert len(spelling.held(own, rng.integers(0, 2**63, 100_000).astype(np.uint64))) < 500


def test_tiles(spark):
    """Every asking record meets every block once, however they are dealt."""
    df = spark.range(100).repartition(7)
    blocks, asks = packed(df, 4, lambda b: b, "blocks"), packed(df.filter("id % 9 = 0"), 2, lambda b: b, "asks")
    ids = lambda b: np.asarray(b.column(0))

    class Pairs:
        def __init__(self, asked):
            self.asked, self.out = np.concatenate([ids(b) for b in asked]), []

        def block(self, b):
            self.out += [(int(x), int(y)) for x in self.asked for y in ids(b)]

        def end(self):
            return {"a": [x for x, _ in self.out], "b": [y for _, y in self.out]}

    got = Counter(tuple(r) for r in meet(blocks, asks, Pairs, "a LONG, b LONG").collect())
    assert got == Counter((a, b) for a in range(0, 100, 9) for b in range(100))
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    assert unpack(pack(batch)) == batch
