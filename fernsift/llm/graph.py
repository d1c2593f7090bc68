"""Connected components of a link table that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernsift.llm.shared import store


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``a > b`` in every row: link a node and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    to_least = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return to_least.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of ``links(a, b)``.

    Large-star and small-star rounds (Kiveris et al., 2014), which need a number of rounds that grows with the logarithm of
    the nodes. Each round is written to the shared folder; only whether it was the last comes to the driver. No round makes
    more rows than there are links and nodes, and minima are taken before rows of a hot node meet.
    """
    one_way = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = store(one_way, "links")
    while not _finished(edges):
        edges = store(_small_star(_large_star(edges)), "links")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _finished(edges: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    of_node = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return of_node.filter("up > 1 or (up = 1 and down = 1)").isEmpty()
