"""Block-wise windows against plain ones, with blocks far smaller than the files."""

import random

import pytest
from pyspark.sql import functions as F

from fernsift.functions.frames import last_before, running_sum, sliding

SIZES = {"a": 57, "b": 1, "c": 200}


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    data = [(f, i + 1, rnd.randint(0, 9)) for f, n in SIZES.items() for i in range(n)]
    rnd.shuffle(data)
    return data, spark.createDataFrame(data, "file STRING, line INT, x INT").repartition(5)


@pytest.mark.parametrize("block", [1, 3, 16, 10_000])
@pytest.mark.parametrize("before,after", [(0, 0), (4, 0), (10, 0), (25, 25), (0, 7)])
def test_sliding(rows, block, before, after):
    data, df = rows
    out = sliding(df, ["file"], "line", before, after, {"s": lambda w: F.sum("x").over(w)}, block)
    got = {(r.file, r.line): r.s for r in out.collect()}
    by_file = {(f, n): x for f, n, x in data}
    want = {
        (f, n): sum(by_file.get((f, k), 0) for k in range(n - before, n + after + 1)) for f, n in by_file
    }
    assert got == want


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_running_sum(rows, block):
    data, df = rows
    got = {(r.file, r.line): r.s for r in running_sum(df, ["file"], "line", F.col("x"), "s", block).collect()}
    want = {(f, n): sum(x for g, k, x in data if g == f and k <= n) for f, n, _ in data}
    assert got == want


@pytest.mark.parametrize("block", [1, 7, 10_000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_last_before(rows, block, inclusive):
    data, df = rows
    value = F.when(F.col("x") > 6, F.col("line"))
    out = last_before(df, ["file"], "line", value, "at", inclusive, block=block)
    got = {(r.file, r.line): r["at"] for r in out.collect()}
    want = {}
    for f, n, _ in data:
        hits = [k for g, k, x in data if g == f and x > 6 and (k <= n if inclusive else k < n)]
        want[f, n] = max(hits, default=None)
    assert got == want
