"""Hard negatives for contrastive training, by threshold joins over an inverted index with prefix bounds (after L2AP).

For every anchor its best rows of the same label are the positives. A positive's window are the rows of other labels whose scores
are at most the positive's and at least a share of it; its first rows are the hard negatives.

Both are found by joins "all rows with a score of at least t", t per anchor. A block of rows is indexed for the lowest threshold of
the anchors that it meets: a row's leading dimensions, as long as their norm times that of the longest anchor is below the threshold,
are left out of the inverted lists. Lists hold groups of ``GROUP`` dimensions and are merged from the last to the first. A row is given
up once its partial scores plus the product of what is left of both norms are below every anchor's threshold; what remains is
checked by its exact score. Thresholds rise while an anchor's positives are found in a task, and are lowered from join to join for
those anchors only whose positives or windows are not full.

The first thresholds come from a bounded sample. They decide how much is looked at, never what is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernsift.llm.shared import arrow_rows, column, store
from fernsift.llm.tiles import finite, meet, packed, vectors

POSITIVES = 5
NEGATIVES = 5
PERCENT = 80  # a negative has at least this share of the positive's score
SCALE = 256
SAMPLE = 2000  # rows that thresholds are estimated from
STEP = 8  # each lower threshold is expected to be passed by so many times the rows
GROUP = 8  # dimensions of an inverted list
BLOCK = 2048
AT_ONCE = 512  # anchors that a block is joined with at once
LOWEST = -(1 << 62)


def suffix_norms(rows: np.ndarray) -> np.ndarray:
    """Norms of the leading 0, GROUP, 2 * GROUP, ... dimensions of each row."""
    edges = np.arange(0, rows.shape[1] + GROUP, GROUP).clip(max=rows.shape[1])
    squares = np.column_stack([np.zeros(len(rows)), np.cumsum(rows * rows, axis=1)])
    return np.sqrt(squares[:, np.unique(edges)])


class Index:
    """Inverted lists of a block for all thresholds from ``least`` on and anchors of norm up to ``longest``."""

    def __init__(self, rows: np.ndarray, least: float, longest: float):
        self.rows, self.norms = rows, suffix_norms(rows)
        groups = self.norms.shape[1] - 1
        covered = (self.norms[:, 1:] * longest < least - _margin(longest, self.norms[:, -1:])).sum(axis=1)  # leading groups left out
        self.covered = np.minimum(covered, groups)
        self.lists = []
        for g in range(groups):
            row = np.flatnonzero(self.covered <= g)
            self.lists.append((row, rows[row, g * GROUP : (g + 1) * GROUP]))

    def over(self, anchors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (anchor, row) that may reach the anchor's threshold: all that do, and few others."""
        norms = suffix_norms(anchors)
        limit = thresholds - _margin(norms[:, -1:].max(initial=0), self.norms[:, -1].max(initial=0))
        partial = np.zeros((len(anchors), len(self.rows)))
        alive = self.covered < len(self.lists)
        for g in reversed(range(len(self.lists))):
            row, values = self.lists[g]
            kept = alive[row]
            row, values = row[kept], values[kept]
            if len(row) == 0:
                continue
            now = partial[:, row] + anchors[:, g * GROUP : (g + 1) * GROUP] @ values.T
            partial[:, row] = now
            alive[row] = (now + norms[:, g, None] * self.norms[row, g] >= limit[:, None]).any(axis=0)
        row = np.flatnonzero(alive)
        at = self.covered[row]
        pair = partial[:, row] + norms[:, at] * self.norms[row, at] >= limit[:, None]
        i, j = np.nonzero(pair)
        return i, row[j]


def _margin(longest, norms):
    """What rounding can make of a partial score."""
    return 1e-9 * longest * norms + 1e-9


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of paired rows, exact; those beyond 64 bits are the largest or least number of these."""
    most = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, anchors.shape[1])
    if most < 2**53:
        return np.einsum("ij,ij->i", anchors, rows).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(anchors, rows, strict=True)]
    return np.array([min(max(x, LOWEST), -LOWEST) for x in whole], np.int64).reshape(-1)


class _Join:
    """Anchors of a tile and what they have found; ``limit`` may rise as more is found."""

    def __init__(self, asked: list[pa.RecordBatch], width: int):
        whole = lambda name: np.concatenate([np.asarray(column(b, name)) for b in asked])
        self.row, self.label, self.limit = whole("row"), whole("label"), whole("limit").astype(np.float64)
        self.v = np.concatenate([vectors(b, "v", width) for b in asked])
        self.width, self.longest = width, float(np.sqrt((self.v * self.v).sum(axis=1)).max(initial=0))

    def block(self, b: pa.RecordBatch) -> None:
        row, key, label, v = (*(np.asarray(column(b, n)) for n in ("row", "key", "label")), vectors(b, "v", self.width))
        index = Index(v, float(self.limit.min()), self.longest)
        for at in range(0, len(self.row), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            i, j = index.over(self.v[part], self.limit[part])
            i = i + at
            fits = self.wanted(i, row[j], label[j])
            i, j = i[fits], j[fits]
            for lo in range(0, len(i), 1 << 16):
                x, y = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                score = scores(self.v[x], v[y])
                high = score >= self.limit[x]
                self.take(x[high], score[high], key[y[high]], row[y[high]])


def _first(group: np.ndarray, score: np.ndarray, key: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group, by score from the highest, then by key."""
    order = np.lexsort((row, key, -score, group))
    sorted_group = group[order]
    begins = np.searchsorted(sorted_group, sorted_group, "left")
    return order[np.arange(len(order)) - begins < most]


class _Positives(_Join):
    def __init__(self, asked, width, most):
        super().__init__(asked, width)
        self.most, self.held = most, [np.zeros(0, np.int64)] * 4

    def wanted(self, i, row, label):
        return (self.label[i] == label) & (self.row[i] != row)

    def take(self, i, score, key, row):
        held = [np.concatenate(x) for x in zip(self.held, (i, score, key, row), strict=True)]
        at = _first(*held, self.most)
        self.held = [x[at] for x in held]
        full = np.bincount(self.held[0], minlength=len(self.row)) >= self.most
        least = np.full(len(self.row), np.iinfo(np.int64).max)
        np.minimum.at(least, self.held[0], self.held[1])
        self.limit = np.where(full, np.maximum(self.limit, least), self.limit)

    def end(self):
        i, score, key, row = self.held
        return {"anchor": self.row[i], "score": score, "key": key, "found": row}


class _Negatives(_Join):
    def __init__(self, asked, width, most, percent):
        super().__init__(asked, width)
        self.most, self.percent = most, percent
        lists = pa.chunked_array([column(b, "positives") for b in asked]).combine_chunks()
        self.first = np.asarray(lists.offsets)
        self.positive = np.asarray(lists.flatten())
        self.held = [np.zeros(0, np.int64)] * 4

    def wanted(self, i, row, label):
        return self.label[i] != label

    def take(self, i, score, key, row):
        times = np.diff(self.first)[i]
        pair = np.repeat(np.arange(len(i)), times)
        of = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times) + self.first[i][pair]
        fits = in_window(score[pair], self.positive[of], self.percent)
        pair, of = pair[fits], of[fits]
        held = [np.concatenate(x) for x in zip(self.held, (of, score[pair], key[pair], row[pair]), strict=True)]
        at = _first(*held, self.most)
        self.held = [x[at] for x in held]

    def end(self):
        of, score, key, row = self.held
        anchor = np.searchsorted(self.first, of, "right") - 1
        return {"anchor": self.row[anchor], "positive_score": self.positive[of], "score": score, "key": key, "found": row}


def in_window(score, positive, percent: int = PERCENT):
    """percent * positive <= 100 * score <= 100 * positive, without overflow."""
    with np.errstate(over="ignore"):
        exact = (percent * positive <= 100 * score) & (score <= positive)
    wide = (np.abs(score) > 1 << 55) | (np.abs(positive) > 1 << 55)
    return np.where(wide, (percent * positive.astype(float) <= 100.0 * score) & (score <= positive), exact) if wide.any() else exact


def _floor(positive: Column, percent: int) -> Column:
    """The least score inside the window of a positive; none is inside if the positive's is below zero."""
    return F.ceil(positive.cast("decimal(38,0)") * percent / 100).cast("long")


def mine(
    table: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: int = PERCENT,
    scale: int = SCALE,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Each component becomes ``floor(scale * x)``; a score is the integer inner product. Higher scores come first, ties by the smaller
    key, then by the row's place in the table. Anchors are the rows for which ``anchors`` holds. An anchor's positives are its first ``positives`` other rows
    of the same label; for each of them the first ``negatives`` rows of other labels with a score of at most the positive's
    and at least ``percent`` per cent of it are returned. Rows without a key or a label, and rows whose vector is null or holds
    null or non-finite numbers, take no part; a shorter vector counts as filled up with zeros. Rows that repeat a key are rows of
    their own. An anchor alone in its label, or without rows in its windows, gives no rows; nor does an empty table.
    Numbers whose scores leave 64 bits are compared at 2**62.
    """
    spark = table.sparkSession
    named = F.col(label) if isinstance(label, str) else label
    rows = table.select(
        F.col(key).cast("long").alias("key"), named.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks")
    )
    rows = rows.filter(F.col("key").isNotNull() & F.col("label").isNotNull() & finite("v"))
    whole = rows.withColumn("v", F.transform("v", lambda x: _floored(x * scale)))
    rows = store(whole.withColumn("row", F.monotonically_increasing_id()), "scored-rows")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("label", "v").collect()
    if not sample:
        return spark.createDataFrame([], "anchor_id LONG, positive_id LONG, rank INT, negative_id LONG, positive_score LONG, negative_score LONG")
    sample_v = np.array([list(r["v"]) + [0.0] * (width - len(r["v"])) for r in sample])
    sample_label = np.array([r["label"] for r in sample])
    blocks = packed(rows.select("row", "key", "label", "v"), BLOCK, lambda b: b, "scored-blocks")

    def positive_limits(b: pa.RecordBatch):
        score = vectors(b, "v", width) @ sample_v.T
        mine = np.asarray(column(b, "label"))[:, None] == sample_label
        down = -np.sort(-np.where(mine, score, -np.inf), axis=1)
        yield _columns(b, "row", "label", "v") | {"limits": _limits(down)}

    def negative_limits(b: pa.RecordBatch):
        score = vectors(b, "v", width) @ sample_v.T
        mine = np.asarray(column(b, "label"))[:, None] == sample_label
        below = np.array([min(p) for p in column(b, "positives").to_pylist()], float)[:, None]
        down = -np.sort(-np.where(~mine & (score < below), score, -np.inf), axis=1)
        yield _columns(b, "row", "label", "v", "positives", "bottom") | {"limits": _limits(down)}

    def at(k: int) -> Column:
        return F.coalesce(F.get("limits", F.lit(k)), F.lit(LOWEST))

    def joined(asking: DataFrame, columns: list[str], begin, schema: str, name: str) -> DataFrame:
        asks = packed(asking.select("row", "label", "v", *columns, "limit"), 1024, lambda b: b, f"{name}-anchors")
        return store(meet(blocks, asks, begin, schema), name)

    # the positives: lower the threshold of anchors with fewer than they may have
    asking = store(arrow_rows(rows.filter("asks").select("row", "label", "v"), positive_limits, "row LONG, label LONG, v ARRAY<DOUBLE>, limits ARRAY<LONG>"), "anchors")
    ranked = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "key", "found"))
    left, parts, k = asking, [], 0
    while not left.isEmpty():
        found = joined(left.withColumn("limit", at(k)), [], lambda a: _Positives(a, width, positives), "anchor LONG, score LONG, key LONG, found LONG", "positives")
        first = store(found.withColumn("place", ranked).filter(F.col("place") <= positives), "first-positives")
        counts = first.groupBy(F.col("anchor").alias("row")).agg(F.count("*").alias("n"))
        left = store(left.join(counts, "row", "left").withColumn("full", (F.coalesce("n", F.lit(0)) >= positives) | (at(k) == LOWEST)).drop("n"), "anchors-left")
        parts.append(first.join(left.filter("full").select(F.col("row").alias("anchor")), "anchor", "left_semi"))
        left = left.filter("not full").drop("full")
        k += 1
    if not parts:
        return spark.createDataFrame([], "anchor_id LONG, positive_id LONG, rank INT, negative_id LONG, positive_score LONG, negative_score LONG")
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    chosen = store(chosen.select("anchor", "place", F.col("score").alias("positive_score"), F.col("key").alias("positive_id")), "chosen-positives")

    # their windows: lower the threshold until each is full or its bottom is reached
    windows = chosen.filter("positive_score >= 0").groupBy(F.col("anchor").alias("row")).agg(
        F.array_sort(F.collect_set("positive_score")).alias("positives"), F.min(_floor(F.col("positive_score"), percent)).alias("bottom")
    )
    schema = "row LONG, label LONG, v ARRAY<DOUBLE>, positives ARRAY<LONG>, bottom LONG, limits ARRAY<LONG>"
    left = store(arrow_rows(rows.filter("asks").join(windows, "row").select("row", "label", "v", "positives", "bottom"), negative_limits, schema), "windows")
    ranked = F.row_number().over(Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "key", "found"))
    parts, k = [], 0
    limit = lambda: F.greatest(at(k), F.col("bottom"))
    while not left.isEmpty():
        found = joined(
            left.withColumn("limit", limit()), ["positives"], lambda a: _Negatives(a, width, negatives, percent),
            "anchor LONG, positive_score LONG, score LONG, key LONG, found LONG", "negatives",
        )
        first = store(found.withColumn("rank", ranked).filter(F.col("rank") <= negatives), "first-negatives")
        full = first.filter(F.col("rank") == negatives).groupBy(F.col("anchor").alias("row")).agg(F.count("*").alias("n"))
        done = (F.coalesce("n", F.lit(0)) == F.size("positives")) | (limit() == F.col("bottom"))
        left = store(left.join(full, "row", "left").withColumn("full", done).drop("n"), "windows-left")
        parts.append(first.join(left.filter("full").select(F.col("row").alias("anchor")), "anchor", "left_semi"))
        left = left.filter("not full").drop("full")
        k += 1
    if not parts:
        return spark.createDataFrame([], "anchor_id LONG, positive_id LONG, rank INT, negative_id LONG, positive_score LONG, negative_score LONG")
    hard = parts[0]
    for p in parts[1:]:
        hard = hard.unionByName(p)
    names = rows.filter("asks").select(F.col("row").alias("anchor"), F.col("key").alias("anchor_id"))
    return chosen.join(hard, ["anchor", "positive_score"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _floored(x: Column) -> Column:
    """floor as a double, also beyond 64 bits, where a double has no fraction."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _columns(b: pa.RecordBatch, *names: str) -> dict:
    return {n: column(b, n) for n in names}


def _limits(down: np.ndarray) -> list[list[int]]:
    """For each anchor its 1st, STEP-th, STEP**2-th ... highest score in the sample, as whole numbers."""
    places = [STEP**k - 1 for k in range(12) if STEP**k <= down.shape[1]]
    return [[int(np.floor(s)) if abs(s) < 1 << 61 else LOWEST for s in row if np.isfinite(s)] for row in down[:, places]]
