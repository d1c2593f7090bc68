"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of at least c lie at most eps = sqrt(2 - 2c) apart, in all dimensions and so in any projection.
Vectors are projected on leading principal directions, put in the lexicographic order of their cells of side eps, and cut into
blocks of that sequence. The join of the sequence with itself is split recursively, 16 parts by 16 at a time, and pairs of
intervals whose bounding boxes are more than eps apart are skipped. What is left are pairs of runs of blocks. Only their numbers
are dealt to tasks, which read the blocks from the shared folder and compare them in full dimension: in single precision
first, and whatever that leaves within its error of c or above in double precision. So vectors are written three times, as rows,
on their way into the order and as blocks, however many pairs there are.

The directions come from a bounded sample; they decide how much is skipped, never what is found.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernsift.llm.graph import components
from fernsift.llm.shared import column, file_system, shared_folder, store

COSINE = 0.95
DIRECTIONS = 8
SAMPLE = 2000  # vectors that the directions are taken from
BLOCK = 512
TILE_BITS = 3  # a tile is 8 blocks by 8
TILES = 64  # tiles of a task
FAN_BITS = 4


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; large and small values do not overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A column of number lists as a matrix; shorter ones are filled up with zeros."""
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes] or [[]]).astype(int)] = flat
    return out


def directions(vectors: DataFrame, width: int) -> np.ndarray:
    """Leading principal directions of a bounded sample of unit vectors, taken by hash."""
    rows = vectors.orderBy(F.xxhash64("key", "v")).limit(SAMPLE).select("v").collect()
    if not rows:
        return np.eye(width)[:, :DIRECTIONS]
    sample = unit(np.array([list(r["v"]) + [0.0] * (width - len(r["v"])) for r in rows]))
    centred = sample - sample.mean(axis=0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    return vectors[:, ::-1][:, : min(DIRECTIONS, width)].copy()


DIGEST = 16  # bytes that a vector is known by


def _raw(batch: pa.RecordBatch, width: int, kind: str) -> np.ndarray:
    return matrix(column(batch, "v"), width).astype(kind) + 0.0  # no negative zeros


def _digests(raw: np.ndarray) -> list[bytes]:
    return [blake2b(row.tobytes(), digest_size=DIGEST).digest() for row in raw]


def _merged(rows: pa.Table) -> pa.Table:
    """Neighbours of one vector as one row: how many there are, and their least key."""
    at = rows.column("at").to_pylist()
    starts = np.flatnonzero([True, *(a != b for a, b in zip(at, at[1:], strict=False))][: len(at)])
    if len(starts) == len(at):
        return rows
    keys, most = rows.column("least").combine_chunks(), np.iinfo(np.int64).max
    least = np.minimum.reduceat(np.asarray(pc.fill_null(keys, most)), starts)
    nameless = np.logical_and.reduceat(np.asarray(pc.is_null(keys)), starts)
    out = rows.take(pa.array(starts))
    out = out.set_column(out.schema.get_field_index("n"), "n", pa.array(np.add.reduceat(np.asarray(rows.column("n")), starts)))
    return out.set_column(out.schema.get_field_index("least"), "least", pa.array(least, pa.int64(), mask=nameless))


_ORDERED = "at BINARY, n LONG, least LONG, body BINARY"
_BLOCKS = "place LONG, digests BINARY, times ARRAY<LONG>, least ARRAY<LONG>, rows BINARY, lo ARRAY<DOUBLE>, hi ARRAY<DOUBLE>"


def _blocks(vectors: DataFrame, width: int, leading: np.ndarray, eps: float, kind: str) -> tuple[DataFrame, str]:
    """One row per block: its place in the sequence, digests, multiplicities and least keys of its members, vectors, and box of projections.

    Also the folder they lie in. A member is a class of equal vectors. Its number is the block's place times BLOCK, plus its own in the block.
    """

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = _raw(b, width, kind)
            cell = np.floor(unit(raw.astype(np.float64)) @ leading / eps).astype(np.int32)
            cells = (cell.view(np.uint32) ^ np.uint32(1 << 31)).astype(">u4")  # as bytes in the order of the numbers
            at = [c.tobytes() + d for c, d in zip(cells, _digests(raw), strict=True)]
            bodies = pa.array([r.tobytes() for r in raw], pa.binary())
            made = pa.Table.from_arrays([pa.array(at, pa.binary()), pa.array(np.ones(len(raw), np.int64)), column(b, "key"), bodies], names=["at", "n", "least", "body"])
            yield from _merged(made.sort_by("at")).combine_chunks().to_batches()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, held = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            table = pa.Table.from_batches([b])
            held = _merged(pa.concat_tables([held, table]) if held is not None else table)
            while held.num_rows > BLOCK:  # the last class may go on in the next batch
                yield packed(first + n, held.slice(0, BLOCK))
                held, n = held.slice(BLOCK), n + 1
        if held is not None and held.num_rows:
            yield packed(first + n, held)

    def packed(place: int, table: pa.Table) -> pa.RecordBatch:
        rows = b"".join(table.column("body").to_pylist())
        at = unit(np.frombuffer(rows, kind).reshape(-1, width).astype(np.float64)) @ leading
        digests = b"".join(x[-DIGEST:] for x in table.column("at").to_pylist())
        values = [place, digests, table.column("n").to_pylist(), table.column("least").to_pylist(), rows, at.min(axis=0).tolist(), at.max(axis=0).tolist()]
        longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
        types = [pa.int64(), pa.binary(), longs, longs, pa.binary(), doubles, doubles]
        names = ["place", "digests", "times", "least", "rows", "lo", "hi"]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    ordered = vectors.select("key", "v").mapInArrow(project, _ORDERED).repartitionByRange("at").sortWithinPartitions("at")
    folder = shared_folder(vectors.sparkSession, "blocks")
    written = ordered.mapInArrow(pack, _BLOCKS).write.option("parquet.enable.dictionary", "false")
    written.option("parquet.block.row.count.limit", str(1 << TILE_BITS)).parquet(folder)  # about a run each, so one can be read
    return vectors.sparkSession.read.schema(_BLOCKS).parquet(folder), folder


def _closer(made: DataFrame) -> tuple[DataFrame, int]:
    """Places without gaps inside a partition; partitions are pushed together as far as their sizes allow. Also the bits of a place in its partition."""
    most = made.agg(F.max(F.col("place").bitwiseAND(0xFFFFFFFF)).alias("n")).first()
    bits = (most["n"] or 0).bit_length()
    closer = F.shiftleft(F.shiftright("place", 32), bits) + F.col("place").bitwiseAND(0xFFFFFFFF)
    return made.withColumn("place", closer), bits


def _near(eps: float) -> str:
    """Whether two boxes are at most eps apart (with a margin for rounding)."""
    gap = "zip_with(zip_with(x.lo, y.hi, (a, b) -> a - b), zip_with(y.lo, x.hi, (a, b) -> a - b), (a, b) -> greatest(a, b, 0D))"
    return f"aggregate({gap}, 0D, (s, g) -> s + g * g) <= {eps * eps + 1e-9!r}"


def _tiles(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs of runs of blocks (``x <= y``) that may hold a link, from the whole sequence downwards."""
    last = blocks.agg(F.max("place")).first()[0] or 0
    boxes = store(blocks.select("place", "lo", "hi"), "boxes")
    levels = [TILE_BITS]
    while last >> levels[-1]:
        levels.append(levels[-1] + FAN_BITS)

    def boxes_at(bits: int) -> DataFrame:
        dims = boxes.select(F.shiftright("place", bits).alias("i"), F.posexplode(F.arrays_zip("lo", "hi")).alias("d", "z"))
        each = dims.groupBy("i", "d").agg(F.min("z.lo").alias("lo"), F.max("z.hi").alias("hi"))
        ordered = F.sort_array(F.collect_list(F.struct("d", "lo", "hi")))
        return each.groupBy("i").agg(ordered.alias("z")).select("i", F.col("z.lo").alias("lo"), F.col("z.hi").alias("hi"))

    top = boxes_at(levels[-1])  # one interval
    pairs = top.select(F.col("i").alias("x"), F.col("i").alias("y"))
    for bits in reversed(levels[:-1]):
        part = boxes_at(bits).withColumn("parent", F.shiftright("i", FAN_BITS))
        pairs = (
            pairs.join(part.select(F.col("parent").alias("x"), F.struct("i", "lo", "hi").alias("p")), "x")
            .join(part.select(F.col("parent").alias("y"), F.struct("i", "lo", "hi").alias("q")), "y")
            .filter("p.i <= q.i")
            .filter(_near(eps).replace("x.", "p.").replace("y.", "q."))
            .select(F.col("p.i").alias("x"), F.col("q.i").alias("y"))
        )
    return store(pairs, "tiles")


class _Block:
    """Members of a block, with unit vectors in single precision; those in double precision are made where they are asked for."""

    def __init__(self, row: dict, kind: str, width: int):
        self.place, self.lo, self.hi = row["place"], np.asarray(row["lo"]), np.asarray(row["hi"])
        self.raw = np.frombuffer(row["rows"], kind).reshape(-1, width)
        self.times, self.least = np.asarray(row["times"]), row["least"]
        self.digests = [row["digests"][k : k + DIGEST] for k in range(0, len(row["digests"]), DIGEST)]
        self.nodes = self.place * BLOCK + np.arange(len(self.raw))
        self.near = unit(self.raw.astype(np.float64)).astype(np.float32)

    def exact(self, members: np.ndarray) -> np.ndarray:
        return unit(self.raw[members].astype(np.float64))

    def within(self, other: _Block, eps: float) -> bool:
        gap = np.maximum(np.maximum(self.lo - other.hi, other.lo - self.hi), 0)
        return gap @ gap <= eps * eps + 1e-9


def _reader(folder: str, names: dict[int, str], bits: int, kind: str, width: int):
    """A function that reads the blocks of a run. It keeps the last few runs and the ends of the files it has read from."""
    files, root = file_system(folder)
    runs: OrderedDict[int, list[_Block]] = OrderedDict()
    ends: dict[int, np.ndarray] = {}

    def of_partition(partition: int, first: int, stop: int) -> Iterator[_Block]:
        with files.open_input_file(f"{root}/{names[partition]}") as source:
            whole = pq.ParquetFile(source)
            if partition not in ends:
                ends[partition] = np.cumsum([whole.metadata.row_group(g).num_rows for g in range(whole.num_row_groups)])
            groups = [g for g, end in enumerate(ends[partition]) if end > first and (g == 0 or ends[partition][g - 1] < stop)]
            if not groups:
                return
            start = int(ends[partition][groups[0] - 1]) if groups[0] else 0
            held = whole.read_row_groups(groups, use_threads=False).slice(max(first - start, 0), stop - max(first, start))
            for row in held.to_pylist():
                yield _Block(row, kind, width)

    def run(x: int) -> list[_Block]:
        if x not in runs:
            first, stop = x << TILE_BITS, (x + 1) << TILE_BITS
            made: list[_Block] = []
            for partition in range(first >> bits, ((stop - 1) >> bits) + 1):
                if partition in names:
                    base = partition << bits
                    made += of_partition(partition, max(first - base, 0), min(stop - base, 1 << bits))
            runs[x] = made
            while len(runs) > 3:
                runs.popitem(last=False)
        runs.move_to_end(x)
        return runs[x]

    return run


_FOUND = "node LONG, links LONG, other LONG, digest BINARY, n LONG, least LONG"


def _compare(cosine: float, eps: float, width: int, kind: str, folder: str, names: dict[int, str], bits: int):
    """Links inside tiles: for each linked class of a pair of blocks a partial count, and the smallest class it is joined to there."""
    sure = np.float32(cosine - (width + 8) * 2.0**-23)  # a product in single precision is off by less than that

    def links(a: _Block, b: _Block) -> Iterator[tuple]:
        close = a.near @ b.near.T >= sure
        if a.place == b.place:
            np.fill_diagonal(close, False)
        if not close.any():
            return
        i, j = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
        linked = a.exact(i) @ b.exact(j).T >= cosine
        if a.place == b.place:
            linked &= i[:, None] != j[None, :]
        if not linked.any():
            return
        some, other = linked.any(axis=1), linked.any(axis=0)
        linked, i, j = linked[np.ix_(some, other)], i[some], j[other]
        left, right = a.nodes[i], b.nodes[j]
        one, two = left.copy(), right.copy()
        none = np.iinfo(np.int64).max
        while True:
            new_one = np.minimum(one, np.where(linked, two[None, :], none).min(axis=1))
            new_two = np.minimum(two, np.where(linked, new_one[:, None], none).min(axis=0))
            if (new_one == one).all() and (new_two == two).all():
                break
            one, two = new_one, new_two
        yield left, linked @ b.times[j], one, a, i
        yield right, a.times[i] @ linked if a.place != b.place else np.zeros(len(j), np.int64), two, b, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder, names, bits, kind, width)
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = read(x)
                for a in one:
                    for b in one if x == y else read(y):
                        if a.place > b.place or not a.within(b, eps):
                            continue
                        for nodes, counts, others, block, members in links(a, b):
                            values = [nodes, counts, others, [block.digests[k] for k in members], block.times[members], [block.least[k] for k in members]]
                            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                            names_ = ["node", "links", "other", "digest", "n", "least"]
                            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names_)

    return run


def _links(blocks: DataFrame, folder: str, eps: float, cosine: float, width: int, kind: str) -> DataFrame:
    """What ``_compare`` finds in all tiles. Tasks get the numbers of runs only; one row per partition of the blocks comes to the driver."""
    spark = blocks.sparkSession
    files = blocks.select(F.shiftright("place", 32).alias("p"), "_metadata.file_name").distinct().collect()
    names = {r["p"]: r["file_name"] for r in files}
    closer, bits = _closer(blocks.select("place", "lo", "hi"))
    tiles = _tiles(closer, eps)
    count = tiles.count()
    tasks = max(1, min(count, max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // TILES)))
    dealt = tiles.repartition(tasks, "x", F.shiftright("y", 3)).sortWithinPartitions("x", "y")
    return store(dealt.mapInArrow(_compare(cosine, eps, width, kind, folder, names, bits), _FOUND), "vector-links")


def dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per input row: the key, ``n_links``, ``component_id`` and ``kept``.

    Two rows are linked if the cosine of their vectors is at least ``cosine`` (above zero). Vectors that are null or empty, zero, or hold null or
    non-finite numbers are linked with nothing; a shorter vector counts as filled up with zeros. Equal vectors are compared once, as
    a class with its number of rows. ``component_id`` is the smallest key reachable by links, the own one included. Rows
    that repeat a key are rows of their own; null keys name no component, and a row without any key in its component is kept.
    """
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    given = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    kind, number = ("<f4", "float") if given.schema["v"].dataType.simpleString() == "array<float>" else ("<f8", "double")
    rows = given.withColumn("v", F.col("v").cast(f"array<{number}>"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    fit = F.coalesce(~bad & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = store(rows.withColumn("v", F.when(fit, F.col("v"))), "vectors")
    whole = rows.filter("v is not null")
    width = max(1, whole.agg(F.max(F.size("v"))).first()[0] or 1)
    blocks, folder = _blocks(whole, width, directions(whole, width), eps, kind)
    found = _links(blocks, folder, eps, cosine, width, kind)
    counted = found.groupBy("node").agg(F.sum("links").alias("links"), F.first("digest").alias("digest"), F.first("n").alias("n"), F.first("least").alias("least"))
    joined = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = counted.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = store(named.select("digest", "component", "least", (F.col("links") + F.col("n") - 1).alias("n_links")), "vector-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = named.join(least, "component").select("digest", "n_links", "component_id")
    # classes of several rows that no other class is linked to
    members = blocks.select("digests", F.posexplode(F.arrays_zip("times", "least")).alias("k", "m")).filter("m.times > 1")
    equal = members.select(
        F.substring("digests", F.col("k") * DIGEST + 1, F.lit(DIGEST)).alias("digest"), (F.col("m.times") - 1).alias("n_links"), F.col("m.least").alias("component_id")
    )
    of_class = linked.unionByName(equal.join(named.select("digest"), "digest", "left_anti"))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([column(b, "key"), pa.array(_digests(_raw(b, width, kind)), pa.binary())], names=["key", "digest"])

    # rows whose class is not among these are alone
    out = whole.select("key", "v").mapInArrow(known, "key LONG, digest BINARY").join(of_class, "digest", "left").select(
        "key", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id")
    )
    alone = rows.filter("v is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    both = out.unionByName(alone)
    return both.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
