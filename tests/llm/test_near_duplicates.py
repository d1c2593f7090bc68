"""Components, MinHash near-duplicates and vectors against plain pairwise versions."""

import random
import re

import numpy as np
import pytest

from fernsift.llm import graph, minhash_dedup, vector_dedup


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    links = {
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(500, i) for i in range(300)] + [(900, 901)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)],
        "none": [],
    }[shape]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a LONG, b LONG")).collect()}
    wanted = least_reachable({n for x in links for n in x}, links)
    assert all(got.get(n, n) == c for n, c in wanted.items())
    assert set(got) <= set(wanted)


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_copies(rng):
    """Groups around a base text, a drifting chain, exact copies, and texts that only share a passage."""
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for size, copies, edits in ((60, 40, 2), (120, 25, 6), (30, 12, 1), (400, 6, 20)):
        base = make(size)
        texts.append(" ".join(base))
        for _ in range(copies):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    drift = make(200)
    for k in range(15):
        drift[k * 13 % 200] = f"d{k}"
        texts.append(" ".join(drift))
    passage = make(25)
    texts += [" ".join(passage + make(20)) for _ in range(60)]
    texts += [texts[0]] * 5 + [texts[0].upper().replace("W", "w")] + [" ".join(make(50)) for _ in range(40)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, size):
    texts = near_copies(random.Random(size))
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    sets = {i: shingles(t, size) for i, t in rows}
    links = [
        (i, j) for i, _ in rows for j, _ in rows
        if i < j and sets[i] and sets[j] and 100 * (c := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - c)
    ]
    assert len(links) > 100
    wanted = least_reachable(sets, links)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {r.doc_id: r for r in minhash_dedup.dedup(docs, size=size).collect()}
    assert {i: r.component_id for i, r in got.items()} == wanted
    assert all(r.n_shingles == len(sets[i]) and r.kept == (wanted[i] == i) for i, r in got.items())
    stay = {r.doc_id for r in minhash_dedup.keep_one(docs, size=size).collect()}
    assert stay == {i for i, c in wanted.items() if i == c}


def test_without_centre_rounds_the_same(spark, monkeypatch):
    """The pairs left after the centres alone find every link too."""
    monkeypatch.setattr(minhash_dedup, "CENTRE_ROUNDS", 1)
    texts = near_copies(random.Random(8))[:120]
    rows = list(enumerate(texts))
    sets = {i: shingles(t, 5) for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * (c := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - c)]
    got = minhash_dedup.dedup(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()
    assert {r.doc_id: r.component_id for r in got} == least_reachable(sets, links)


def test_near_duplicate_edges(spark, edge_docs, no_docs):
    got = minhash_dedup.dedup(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (0, 1, 2))
    assert by[3].n_shingles == by[4].n_shingles == 1
    assert sum(r.doc_id is None and r.kept for r in got) == 2
    assert minhash_dedup.dedup(no_docs).count() == 0
    kept = minhash_dedup.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 1


def plain_vectors(rows, cosine=0.95):
    good = {}
    width = max([len(v) for _, v in rows if v] or [1])
    for n, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(list(v) + [0.0] * (width - len(v)))
            good[n] = x / np.abs(x).max()
    links = [
        (a, b) for a in good for b in good
        if a != b and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= cosine
    ]
    component = least_reachable(range(len(rows)), links)
    members: dict = {}
    for n, c in component.items():
        members.setdefault(c, []).append(rows[n][0])
    least = {c: min((k for k in keys if k is not None), default=None) for c, keys in members.items()}
    return sorted((str(rows[n][0]), sum(a == n for a, _ in links), str(least[component[n]])) for n in component)


@pytest.mark.parametrize("block", [4, 512])
def test_vectors_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = []
    for g in range(12):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 20))):
            rows.append((len(rows), (base * rng.uniform(0.1, 9) + rng.normal(size=16) * rng.uniform(0, 0.4)).tolist()))
    rows += [(len(rows) + k, rows[0][1]) for k in range(10)]  # equal vectors
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [float("inf")] + [1.0] * 15)]
    rows += [(905, [None] + [1.0] * 15), (906, rows[3][1][:9]), (907, [1e200] * 16), (908, [1e-200] * 16), (None, rows[0][1]), (None, [5.0] + [0.0] * 15), (3, rows[40][1])]
    vectors = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id LONG, embedding ARRAY<DOUBLE>, kept STRING")
    got = vector_dedup.dedup(vectors).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == plain_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vector_edges(spark):
    none = spark.createDataFrame([], "vec_id LONG, embedding ARRAY<FLOAT>")
    assert vector_dedup.dedup(none).count() == 0
    useless = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id LONG, embedding ARRAY<FLOAT>")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.dedup(useless).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_vectors_do_not_move_with_pairs(spark, monkeypatch):
    """What compares pairs of runs is given their numbers; vectors near the bound are told apart as in double precision."""
    made = {}

    def noted(df, name, keep=vector_dedup.store):
        made[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(vector_dedup, "store", noted)
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base, rows = rng.normal(size=24), []
    for n in range(300):
        side = rng.normal(size=24)
        side -= side @ base / (base @ base) * base
        angle = np.arccos(0.95 + (n % 7 - 3) * 1e-7)
        rows.append((n, (np.cos(angle) * base / np.linalg.norm(base) + np.sin(angle) * side / np.linalg.norm(side)).astype(np.float32).tolist()))
    rows.append((300, base.astype(np.float32).tolist()))
    vectors = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>")
    got = vector_dedup.dedup(vectors).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == plain_vectors(rows)
    assert "rows#" not in made["vector-links"] and "Join" not in made["vector-links"]
