"""A bounded set of asking rows against all rows of a table, block by block.

Both sides are packed into records of some thousand rows each. A tile is one group of asking records and one group of
blocks; a task holds the asking rows of its tile and streams the blocks past them, so its memory depends on neither table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from fernsift.llm.shared import store
from fernsift.llm.vector_dedup import matrix

ASKS = 8192  # asking rows that a task holds
ROWS = 1 << 22  # rows that a task streams at most
_PACKED = "id LONG, n LONG, body BINARY"


def finite(vector) -> F.Column:
    """Whether a vector is there and has no null, NaN or infinite component."""
    bad = F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def vectors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return matrix(batch.column(batch.schema.get_field_index(name)), width)


def pack(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpack(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as reader:
        return reader.read_next_batch()


def packed(df: DataFrame, size: int, make: Callable[[pa.RecordBatch], pa.RecordBatch], name: str) -> DataFrame:
    """Records of up to ``size`` rows of a partition, each turned by ``make``: ``id``, ``n`` (rows) and ``body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k, held = TaskContext.get().partitionId() << 33, 0, []

        def record(table: pa.Table) -> pa.RecordBatch:
            rows = table.combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pydict({"id": [first + k], "n": [rows.num_rows], "body": pa.array([pack(make(rows))], pa.binary())})

        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= size:
                table = pa.Table.from_batches(held)
                yield record(table.slice(0, size))
                held, k = table.slice(size).to_batches(), k + 1
        if sum(x.num_rows for x in held):
            yield record(pa.Table.from_batches(held))

    return store(df.mapInArrow(run, _PACKED), name)


def meet(blocks: DataFrame, asks: DataFrame, begin: Callable, schema: str) -> DataFrame:
    """Every asking record against every block.

    ``begin(records)`` gets the asking records of a tile and gives an object whose ``block(record)`` is called for each block and
    whose ``end()`` then gives the columns of the result, by name.
    """
    spark = blocks.sparkSession
    rows, count = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    asking = asks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not rows or not asking:
        return spark.createDataFrame([], schema)
    across = -(-asking // ASKS)
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = min(count, max(-(-wide // across), -(-rows // ROWS)))
    place = F.shiftright("id", 33) + F.col("id").bitwiseAND((1 << 33) - 1)  # neighbours in a file go to different tiles
    at, of = F.pmod(place, F.lit(across)) * down, F.pmod(place, F.lit(down))
    to_all_down = F.explode(F.sequence(at, at + (down - 1))).alias("tile")
    to_all_across = F.explode(F.sequence(of, of + (across - 1) * down, F.lit(down))).alias("tile")
    both = asks.select(to_all_down, F.lit(0).alias("kind"), "id", "body").unionByName(
        blocks.select(to_all_across, F.lit(1).alias("kind"), "id", "body")
    )
    dealt = both.repartitionById(across * down, F.col("tile").cast("int")).sortWithinPartitions("kind", "id").select("kind", "body")
    types = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, work = [], None
        for batch in batches:
            for kind, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if kind == 0:
                    asked.append(unpack(body.as_py()))
                    continue
                if work is None:
                    work = begin(asked)
                work.block(unpack(body.as_py()))
        if work is not None:
            columns = work.end()
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in types], schema=types)

    return dealt.mapInArrow(run, schema)
