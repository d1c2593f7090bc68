"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of the table that lie far apart. Every vector is represented by its ``PREFIX`` nearest pivots in order of
nearness, and posted in the inverted file of each of them with its place in that order. The index is cut into blocks of rows, each
with its own inverted files, so a list of a frequent pivot is spread like the rows are.

A query is represented in the same way. In every block the lists of its pivots are merged into the footrule distance of each
row's order to the query's, where a pivot outside the prefix counts as next after the last. The rows with the least distances, a
share of the block, and all rows at a small distance, however many, are ranked again by their inner products.

Nearness is the inner product. For pivots to be near in that sense whatever the lengths of vectors, a dimension is added that
brings all rows to one length; it is zero in queries, so inner products stay.

The pivots are from a bounded sample; every row is in the index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernsift.llm.shared import column, store
from fernsift.llm.tiles import finite, meet, packed, vectors

NEIGHBOURS = 20
PIVOTS = 256
SAMPLE = 2048  # vectors that pivots are chosen from
PREFIX = 64
SHARE = 0.125  # of a block's rows are ranked again,
LEAST = 256  # but of a small table a share that makes so many in all
NEAR = 0.35  # rows at a footrule distance of up to this share of the largest are always ranked again
BLOCK = 4096


def pivots(rows: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Rows far apart: the first, then again and again the one farthest from all before; equal rows are taken once."""
    chosen = [0]
    away = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < count and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def orders(rows: np.ndarray, of: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """For each row the numbers of its nearest pivots, nearest first."""
    near = rows @ of.T
    prefix = min(prefix, near.shape[1])
    part = np.sort(np.argpartition(-near, prefix - 1, axis=1)[:, :prefix], axis=1)  # ties to the smaller number
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)


def inverted(order: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted files of the pivots: where each begins, and its rows with the pivot's place in their order."""
    flat = order.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[by_pivot], np.arange(count + 1))
    return starts, by_pivot // order.shape[1], by_pivot % order.shape[1]


def _lists(flat: np.ndarray, size: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) // size + 1) * size, pa.int32()), pa.array(flat))


def footrule(order: np.ndarray, files: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int) -> np.ndarray:
    """Distance of every row's order to ``order``. Each pivot that both have lessens the largest distance by twice what is left
    of the prefix behind its later place."""
    starts, row, place = files
    size = len(order)
    lists = [slice(starts[p], starts[p + 1]) for p in order]
    left = np.concatenate([size - np.maximum(place[s], k) for k, s in enumerate(lists)])
    common = np.bincount(np.concatenate([row[s] for s in lists]), weights=left, minlength=rows)
    return size * (size + 1) - 2 * common


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each by the same order of additions, so that equal rows have equal ones."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (rows * query).sum(axis=1)


class _Search:
    def __init__(self, asked: list[pa.RecordBatch], width: int, neighbours: int, share: float, near: float):
        self.row = np.concatenate([np.asarray(column(b, "row")) for b in asked])
        self.order = np.concatenate([np.asarray(column(b, "order").flatten()).reshape(b.num_rows, -1) for b in asked])
        self.v = np.concatenate([vectors(b, "v", width) for b in asked])
        self.width, self.k, self.share, self.near = width, neighbours, share, near
        self.best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.row]

    def block(self, b: pa.RecordBatch) -> None:
        row, v = np.asarray(column(b, "row")), vectors(b, "v", self.width)
        key = column(b, "key").fill_null(np.iinfo(np.int64).max).to_numpy()
        posted = (np.asarray(column(b, name).flatten()) for name in ("posted", "place"))
        files, size, n = (np.frombuffer(b.schema.metadata[b"starts"], np.int64), *posted), self.order.shape[1], len(row)
        many = min(n, max(self.k + 1, int(np.ceil(self.share * n))))
        for i, (own, query) in enumerate(zip(self.row, self.v, strict=True)):
            away = footrule(self.order[i], files, n)
            cut = max(np.partition(away, many - 1)[many - 1], self.near * size * (size + 1))
            found = np.flatnonzero(away <= cut)
            found = found[row[found] != own]
            self.best[i] = self._first(*(np.concatenate(x) for x in zip(self.best[i], (products(v[found], query), key[found], row[found]), strict=True)))

    def _first(self, score: np.ndarray, key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(score) > 4 * self.k:
            kept = score >= np.partition(score, -self.k)[-self.k]
            score, key, row = score[kept], key[kept], row[kept]
        at = np.lexsort((row, key, -score))[: self.k]
        return score[at], key[at], row[at]

    def end(self) -> dict:
        sizes = [len(x[0]) for x in self.best]
        score, key, row = (np.concatenate(x) for x in zip(*self.best, strict=True))
        return {"asking": np.repeat(self.row, sizes), "found": row, "key": pa.array(key, mask=key == np.iinfo(np.int64).max), "score": score}


def search(
    table: DataFrame,
    asking,
    key: str = "vec_id",
    vector: str = "embedding",
    neighbours: int = NEIGHBOURS,
    count: int = PIVOTS,
    prefix: int = PREFIX,
    share: float = SHARE,
    near: float = NEAR,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the neighbour's ``key`` and ``score`` for every row for which ``asking`` holds.

    Neighbours are the rows with the largest inner products (double precision) that the index finds, the asking row
    itself left out; ties go to the smaller key, null keys last. Rows whose vector is null, empty, zero or holds null or non-finite numbers
    neither ask nor are found; a shorter vector counts as filled up with zeros. Rows that repeat a key are rows of their own,
    as queries and as neighbours. With ``neighbours`` rows or fewer all are found; an empty table gives no rows.
    """
    rows = table.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"), asking.alias("asks"))
    fit = finite("v") & F.exists("v", lambda e: e != 0)
    rows = store(rows.filter(fit).withColumn("row", F.monotonically_increasing_id()), "index-rows")
    largest = F.array_max(F.transform("v", F.abs))
    about = rows.agg(F.max(F.size("v")), F.max(largest), F.count("*")).first()
    width, unit, share = about[0] or 1, about[1] or 1.0, max(share, LEAST / max(1, about[2]))
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + (e / unit) * (e / unit)))).first()[0] or 1.0

    def lifted(v: np.ndarray) -> np.ndarray:
        v = v / unit
        return np.column_stack([v, np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))])

    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").collect()
    if not sample:
        return table.sparkSession.createDataFrame([], f"query_id LONG, rank INT, `{key}` LONG, score DOUBLE")
    of = pivots(lifted(np.array([list(r["v"]) + [0.0] * (width - len(r["v"])) for r in sample])), count)

    def posted(b: pa.RecordBatch) -> pa.RecordBatch:
        order = orders(lifted(vectors(b, "v", width)), of, prefix)
        starts, row, place = inverted(order, len(of))
        with_files = b.append_column("posted", _lists(row.astype(np.uint16), order.shape[1])).append_column("place", _lists(place.astype(np.int16), order.shape[1]))
        return with_files.replace_schema_metadata({"starts": starts.astype(np.int64).tobytes()})

    def ordered(b: pa.RecordBatch) -> pa.RecordBatch:
        v = vectors(b, "v", width) / unit
        order = orders(np.column_stack([v, np.zeros(len(v))]), of, prefix)
        return b.append_column("order", _lists(order.ravel(), order.shape[1]))

    blocks = packed(rows.select("row", "key", "v"), BLOCK, posted, "index-blocks")
    asks = packed(rows.filter("asks").select("row", "v"), 1024, ordered, "index-queries")
    found = meet(blocks, asks, lambda asked: _Search(asked, width, neighbours, share, near), "asking LONG, found LONG, key LONG, score DOUBLE")
    rank = F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), F.asc_nulls_last("key"), "found"))
    names = rows.filter("asks").select(F.col("row").alias("asking"), F.col("key").alias("query_id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= neighbours).join(names, "asking")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
