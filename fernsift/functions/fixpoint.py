"""Iterative joins: smallest labels over an edge table, and roots of a parent table.

Both loops cut their lineage with ``checkpoint()``, whose files survive the loss of an executor. Where labels still spread after a few
rounds, ways through nodes with a single incoming edge are contracted by doubling, so a long chain takes a number of rounds that grows
with the logarithm of its length.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder the session names; a folder of our own only on a local master, where all tasks see it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir():
        return
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="fernsift-checkpoint-"))


def pin(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so that Spark knows how large it is before it plans what comes next."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


Getter = Callable[[str], Column]


@dataclass(frozen=True)
class Way:
    """What edges do to labels, as columns that can be joined to those of a longer way.

    ``columns``: of an edge; ``apply(get, label)``: the label at the end of a way with these columns, null where it cannot be taken;
    ``then(first, second)``: the columns of one way after the other. Later labels at a start must not lead to earlier ones at an end.
    """

    columns: dict[str, Column]
    apply: Callable[[Getter, Column], Column]
    then: Callable[[Getter, Getter], dict[str, Column]]


def unchanged() -> Way:
    return Way({}, lambda get, label: label, lambda first, second: {})


def counted(most: int | None = None) -> Way:
    """Each edge adds one; labels stay at ``most``."""
    return Way(
        {"steps": F.lit(1)},
        lambda get, label: label + get("steps") if most is None else F.when(label + get("steps") <= most, label + get("steps")),
        lambda first, second: {"steps": first("steps") + second("steps")},
    )


def increasing(at: str) -> Way:
    """Edges are taken in rising order of ``at``, which becomes the label."""
    return Way(
        {"first": F.col(at), "last": F.col(at), "open": F.lit(True)},
        lambda get, label: F.when(get("open") & (get("first") > label), get("last")),
        lambda first, second: {
            "first": first("first"), "last": second("last"), "open": first("open") & second("open") & (second("first") > first("last")),
        },
    )


ROUND = 1 << 32


def in_rounds(line: str, most: int | None = None) -> Way:
    """Edges are read by ``line``, round after round; a label is round and line in one number, rounds end with ``most``."""

    def apply(get: Getter, label: Column) -> Column:
        round_, at = F.shiftright(label, 32), label.bitwiseAND(ROUND - 1)
        later = round_ + F.when(get("first") > at, 0).otherwise(1) + get("more")
        moment = later * F.lit(ROUND) + get("last")
        return moment if most is None else F.when(later <= most, moment)

    def then(first: Getter, second: Getter) -> dict[str, Column]:
        turn = F.when(second("first") > first("last"), 0).otherwise(1)
        return {"first": first("first"), "last": second("last"), "more": first("more") + turn + second("more")}

    return Way({"first": F.col(line), "last": F.col(line), "more": F.lit(0)}, apply, then)


def smallest_labels(seeds: DataFrame, edges: DataFrame, node: list[str], label: str, way: Way, contract_after: int = 4) -> DataFrame:
    """Least label of every node that the seeds reach.

    ``seeds``: node columns + ``label``; ``edges``: ``from_<node>`` and ``to_<node>`` columns and those that ``way`` is made from.
    The first column of ``node`` is the file, which no edge leaves.

    Each round joins only the nodes whose label has just improved (the frontier). How it is joined is left to
    adaptive execution, which knows its bytes: by a shuffle that splits hot nodes, or, once it is small, by a
    broadcast. The files that are not finished after ``contract_after`` rounds are solved again on contracted edges.
    """
    ends = [f"{side}_{c}" for side in ("from", "to") for c in node]
    ready = pin(edges.select(*ends, *[c.alias(f"w_{n}") for n, c in way.columns.items()]))
    first = pin(seeds.groupBy(*node).agg(F.min(label).alias(label)))
    labels, live = _spread(first, ready, node, label, way, contract_after)
    if live is None:
        return labels
    files = live.select(node[0]).distinct()
    finished = labels.join(files, node[0], "left_anti")
    open_edges = pin(ready.join(files.withColumnRenamed(node[0], f"from_{node[0]}"), f"from_{node[0]}", "left_semi"))
    open_seeds = pin(first.join(files, node[0], "left_semi"))
    chains, left = _contracted(open_edges, open_seeds, node, way)
    labels, _ = _spread(open_seeds, left, node, label, way, None)
    labels = pin(labels)
    behind = chains.join(labels.select(*[F.col(c).alias(f"from_{c}") for c in node], label), [f"from_{c}" for c in node])
    behind = behind.select(*[F.col(f"to_{c}").alias(c) for c in node], way.apply(lambda n: F.col(f"w_{n}"), F.col(label)).alias(label))
    return finished.unionByName(labels).unionByName(behind.filter(F.col(label).isNotNull()))


def _spread(
    frontier: DataFrame, edges: DataFrame, node: list[str], label: str, way: Way, most: int | None, compact_every: int = 8
) -> tuple[DataFrame, DataFrame | None]:
    """Labels after at most so many rounds, and the last frontier if that was too few."""
    heads = [F.col(f"from_{c}") == F.col(f"f.{c}") for c in node]
    log, rounds = [frontier], 0
    while not frontier.isEmpty():
        if rounds == most:
            return pin(_least(log, node, label)), frontier
        reached = (
            edges.alias("e")
            .join(frontier.alias("f"), heads)
            .select(
                *[F.col(f"e.to_{c}").alias(c) for c in node],
                way.apply(lambda n: F.col(f"e.w_{n}"), F.col(f"f.{label}")).alias(label),
            )
            .filter(F.col(label).isNotNull())
            .groupBy(*node)
            .agg(F.min(label).alias(label))
        )
        known = reduce(DataFrame.unionByName, log).withColumnRenamed(label, "_old")
        as_good = [F.col(f"r.{c}") == F.col(f"k.{c}") for c in node] + [F.col("_old") <= F.col(f"r.{label}")]
        frontier = pin(reached.alias("r").join(known.alias("k"), as_good, "left_anti"))
        log.append(frontier)
        rounds += 1
        if rounds % compact_every == 0:
            log = [pin(_least(log, node, label))]
            live = frontier.select(F.col(node[0]).alias(f"from_{node[0]}")).distinct()
            edges = pin(edges.join(live, f"from_{node[0]}", "left_semi"))
    return _least(log, node, label), None


def _least(log: list[DataFrame], node: list[str], label: str) -> DataFrame:
    return reduce(DataFrame.unionByName, log).groupBy(*node).agg(F.min(label).alias(label))


def _contracted(edges: DataFrame, seeds: DataFrame, node: list[str], way: Way) -> tuple[DataFrame, DataFrame]:
    """(ways, edges): for each node with one incoming edge the whole way to it from the nearest node that has several or is a seed, and
    the edges between those nodes, which may be ways too.

    Edges from nodes that nothing leads to are left out first. Ways double in every round; those that have not ended after as many
    rounds as the count of nodes allows run in circles that no seed reaches.
    """
    start, end = [f"from_{c}" for c in node], [f"to_{c}" for c in node]
    ways = [f"w_{n}" for n in way.columns]
    of = lambda df, names: df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names, strict=True)])
    led_to = edges.select(*end).unionByName(of(seeds.select(*node), end)).distinct()
    edges = pin(edges.join(of(led_to, start), start, "left_semi"))
    single = edges.groupBy(*end).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n").join(of(seeds.select(*node), end), end, "left_anti")
    single = pin(single)
    chains = pin(edges.join(single, end, "left_semi"))
    stops = of(single, start).withColumn("_on", F.lit(True))
    open_ = pin(chains.join(stops, start, "left"))
    ended = [open_.filter("_on is null").drop("_on")]
    open_ = pin(open_.filter("_on"))
    for _ in range(max(1, single.count()).bit_length()):
        if open_.isEmpty():
            break
        # every way that has not ended goes on by what the way to its start has become
        known = reduce(DataFrame.unionByName, [*ended, open_.drop("_on")])
        before = known.select(*[F.col(c).alias(f"b{c}") for c in (*start, *end, *ways)])
        on = [F.col(s) == F.col(f"b{e}") for s, e in zip(start, end, strict=True)]
        joined = way.then(lambda n: F.col(f"bw_{n}"), lambda n: F.col(f"w_{n}"))
        longer = open_.drop("_on").join(before, on).select(
            *[F.col(f"b{c}").alias(c) for c in start], *end, *[joined[n].alias(f"w_{n}") for n in way.columns]
        )
        longer = pin(longer.join(stops, start, "left"))
        ended = [pin(reduce(DataFrame.unionByName, [*ended, longer.filter("_on is null").drop("_on")]))]
        open_ = pin(longer.filter("_on"))
    chains = ended[0]
    # edges to other nodes begin where the way to their start begins
    others = edges.join(single, end, "left_anti")
    before = chains.select(*[F.col(c).alias(f"b{c}") for c in (*start, *end, *ways)])
    on = [F.col(s) == F.col(f"b{e}") for s, e in zip(start, end, strict=True)]
    joined = way.then(lambda n: F.col(f"bw_{n}"), lambda n: F.col(f"w_{n}"))
    moved = others.join(before, on).select(*[F.col(f"b{c}").alias(c) for c in start], *end, *[joined[n].alias(f"w_{n}") for n in way.columns])
    direct = others.join(of(single, start), start, "left_anti").select(*start, *end, *ways)
    return chains, pin(direct.unionByName(moved))


def roots(links: DataFrame, node: list[str], payload: list[str], steps: str) -> DataFrame:
    """Follow ``parent_<node>`` to the root of each node by doubling: log2(depth) joins.

    A root has null parents. ``payload`` columns are taken from the root; the arrays in ``steps``
    are joined on the way, root first. ``node[0]`` is the file.
    """
    inner = node[1:]
    links = pin(links)
    while not links.filter(F.col(f"parent_{inner[0]}").isNotNull()).isEmpty():
        up = links.select(
            F.col(node[0]).alias("u_file"),
            *[F.col(c).alias(f"u_{c}") for c in inner],
            *[F.col(f"parent_{c}").alias(f"up_{c}") for c in inner],
            *[F.col(c).alias(f"up_{c}") for c in payload],
            F.col(steps).alias("up_way"),
        )
        on = [F.col(node[0]) == F.col("u_file")]
        on += [F.col(f"parent_{c}") == F.col(f"u_{c}") for c in inner]
        links = pin(
            links.join(up, on, "left").select(
                *node,
                *[F.col(f"up_{c}").alias(f"parent_{c}") for c in inner],
                *[
                    F.when(F.col(f"parent_{inner[0]}").isNull(), F.col(c))
                    .otherwise(F.col(f"up_{c}"))
                    .alias(c)
                    for c in payload
                ],
                F.when(F.col(f"parent_{inner[0]}").isNull(), F.col(steps))
                .otherwise(F.concat("up_way", steps))
                .alias(steps),
            )
        )
    return links.select(*node, *payload, steps)
