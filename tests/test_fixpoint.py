"""Least labels against a plain search, on chains, circles and random graphs, for every kind of way."""

import random

import pytest

from fernsift.functions import fixpoint as X

ROUND = X.ROUND
KINDS = {
    "unchanged": (lambda: X.unchanged(), lambda label, at: label, 0),
    "counted": (lambda: X.counted(), lambda label, at: label + 1, 0),
    "counted, at most 9": (lambda: X.counted(9), lambda label, at: label + 1 if label < 9 else None, 0),
    "increasing": (lambda: X.increasing("at"), lambda label, at: at if at > label else None, -1),
    "in rounds": (lambda: X.in_rounds("at"), lambda label, at: (label // ROUND + (at <= label % ROUND)) * ROUND + at, ROUND),
    "in rounds, at most 3": (
        lambda: X.in_rounds("at", 3),
        lambda label, at: r * ROUND + at if (r := label // ROUND + (at <= label % ROUND)) <= 3 else None,
        ROUND,
    ),
}


def searched(seeds, edges, step):
    labels = dict(seeds)
    changed = True
    while changed:
        changed = False
        for f, a, b, at in edges:
            if (f, a) in labels:
                new = step(labels[f, a], at)
                if new is not None and new < labels.get((f, b), new + 1):
                    labels[f, b], changed = new, True
    return labels


def graphs():
    rng = random.Random(1)
    edges = [("chain", f"c{i}", f"c{i + 1}", i + 1) for i in range(70)]
    edges += [("back", f"c{i}", f"c{i + 1}", 100 - i) for i in range(40)]
    edges += [("forks", f"c{i}", f"c{i + 1 + k}", 3 * i + k) for i in range(30) for k in (0, 1, 5)]
    edges += [("circle", f"c{i}", f"c{(i + 1) % 20}", 50 + i) for i in range(20)] + [("circle", f"d{i}", f"d{(i + 1) % 9}", i) for i in range(9)]
    edges += [("circle", "d3", "tail", 8), ("self", "c0", "c0", 1), ("self", "x", "x", 2), ("self", "x", "y", 3)]
    edges += [("noise", f"c{i}", f"c{i + 1}", i) for i in range(25)] + [("noise", f"n{i}", f"c{i + 1}", i) for i in range(25)]
    for k in range(12):
        names = rng.randrange(5, 40)
        edges += [(f"r{k}", f"c{rng.randrange(names)}", f"c{rng.randrange(names)}", rng.randrange(60)) for _ in range(int(names * rng.choice([1, 1.3, 2])))]
    files = sorted({e[0] for e in edges})
    return edges, [(f, "c0") for f in files] + [("forks", "c9"), ("r3", "c4")]


@pytest.mark.parametrize("kind", sorted(KINDS))
@pytest.mark.parametrize("after", [0, 2])
def test_least_labels(spark, kind, after):
    way, step, start = KINDS[kind]
    edges, nodes = graphs()
    wanted = searched({n: start for n in nodes}, edges, step)
    e = spark.createDataFrame([(f, a, f, b, at) for f, a, b, at in edges], "from_file STRING, from_name STRING, to_file STRING, to_name STRING, at LONG")
    s = spark.createDataFrame([(*n, start) for n in nodes], "file STRING, name STRING, label LONG")
    found = X.smallest_labels(s, e, ["file", "name"], "label", way(), contract_after=after).collect()
    assert len(found) == len({(r.file, r.name) for r in found})
    assert {(r.file, r.name): r.label for r in found} == wanted


def test_rounds_of_a_long_chain(spark):
    """Ten thousand steps in fewer than twenty rounds: what is asked of the way is counted, once for each round's plan."""
    n, rounds = 10_000, []
    edges = spark.range(n).selectExpr("'f' from_file", "concat('c', id) from_name", "'f' to_file", "concat('c', id + 1) to_name", "id + 1 as at")
    seeds = spark.createDataFrame([("f", "c0", 0)], "file STRING, name STRING, label LONG")
    way = X.increasing("at")
    counting = X.Way(way.columns, lambda get, x: rounds.append("spread") or way.apply(get, x), lambda a, b: rounds.append("double") or way.then(a, b))
    found = X.smallest_labels(seeds, edges, ["file", "name"], "label", counting)
    assert found.count() == n + 1 and found.agg({"label": "max"}).first()[0] == n
    assert len(rounds) < 22  # two of them are no rounds: the ways behind the contracted edges, and the edges at their ends
