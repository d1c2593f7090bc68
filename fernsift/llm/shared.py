"""The folder that driver and executors share, tables written there, and small batch helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the session's checkpoint folder, which every executor sees."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or "/tmp/checkpoints")
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors share: a local mount, or whatever pyarrow can reach."""
    if "://" not in folder:
        return fs.LocalFileSystem(), folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_rows(
    df: DataFrame, make: Callable[[pa.RecordBatch], Iterable[dict]], schema: str
) -> DataFrame:
    """``mapInArrow`` where ``make`` gives, for each batch, column lists by name (a dict), any number of times."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    with_types = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in make(batch):
                yield pa.RecordBatch.from_arrays(
                    [
                        c if isinstance(c := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                        for f in with_types
                    ],
                    schema=with_types,
                )

    return df.mapInArrow(run, schema)


def pieces_of(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most_bytes`` of text each, so that what is made of one stays small."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    cut = np.flatnonzero(np.diff(ends // most_bytes)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def is_same(left, right):
    return F.coalesce(left.eqNullSafe(right), F.lit(False))


def ranked(df: DataFrame, order: list, rank: str, name: str) -> DataFrame:
    """Add the place of each row in the order of the whole table, from 0, without one task sorting all of it."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = store(ordered, name)
    part, total, offsets = F.shiftright("_id", 33), 0, []
    for r in kept.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row per partition
        offsets += [F.lit(r["p"]), F.lit(total)]
        total += r["count"]
    before = F.create_map(*offsets)[part] if offsets else F.lit(0)
    return kept.withColumn(rank, before + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
