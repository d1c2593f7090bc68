"""Windows over line numbers that stay small however long one file is.

A plain ``Window.partitionBy(file)`` puts a whole file into one task. Here the key is
(file, block of line numbers): a row is copied into the neighbouring block only when it lies inside
the frame of that block's rows, and running values are carried from block to block by a small table
with one row per block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192


def sliding(
    df: DataFrame,
    keys: list[str],
    pos: str,
    before: int,
    after: int,
    columns: dict[str, Callable],
    block: int = BLOCK,
) -> DataFrame:
    """Add ``columns`` (name -> function of a window spec) over ``pos - before .. pos + after``.

    ``pos`` must be a dense integer position, so that a range frame equals a rows frame.
    """
    first = F.floor((F.col(pos) - after) / block)
    last = F.floor((F.col(pos) + before) / block)
    copied = df.withColumn("_block", F.explode(F.sequence(first, last)))
    spec = Window.partitionBy(*keys, "_block").orderBy(pos).rangeBetween(-before, after)
    out = copied.withColumns({name: make(spec) for name, make in columns.items()})
    return out.filter(F.floor(F.col(pos) / block) == F.col("_block")).drop("_block")


def running_sum(
    df: DataFrame, keys: list[str], pos: str, value: Column, name: str, block: int = BLOCK
) -> DataFrame:
    """Running sum of ``value`` up to and including each row, in ``pos`` order."""
    blocked = df.withColumns({"_block": F.floor(F.col(pos) / block), "_value": value.cast("long")})
    spec = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_carry", F.coalesce(F.sum("_total").over(spec), F.lit(0)))
        .drop("_total")
    )
    inner = (
        Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        blocked.withColumn("_sum", F.sum("_value").over(inner))
        .join(carried, [*keys, "_block"])
        .withColumn(name, (F.col("_carry") + F.col("_sum")).cast("int"))
        .drop("_block", "_value", "_sum", "_carry")
    )


def last_before(
    df: DataFrame,
    keys: list[str],
    pos: str,
    value: Column,
    name: str,
    inclusive: bool = False,
    order: list[str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """The latest non-null ``value`` among earlier rows (or up to the row itself) in ``pos`` order.

    ``order`` breaks ties among rows of the same ``pos``.
    """
    order = order or []
    blocked = df.withColumns({"_block": F.floor(F.col(pos) / block), "_value": value})
    at = F.struct(pos, *order)
    spec = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.filter(F.col("_value").isNotNull())
        .groupBy(*keys, "_block")
        .agg(F.max_by("_value", at).alias("_end"))
    )
    blocks = blocked.select(*keys, "_block").distinct()
    carried = (
        blocks.join(carried, [*keys, "_block"], "left")
        .withColumn("_carry", F.last("_end", ignorenulls=True).over(spec))
        .drop("_end")
    )
    inner = (
        Window.partitionBy(*keys, "_block")
        .orderBy(pos, *order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return (
        blocked.withColumn("_last", F.last("_value", ignorenulls=True).over(inner))
        .join(carried, [*keys, "_block"], "left")
        .withColumn(name, F.coalesce("_last", "_carry"))
        .drop("_block", "_value", "_last", "_carry")
    )
