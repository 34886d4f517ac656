"""Connected components of rows that share keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.sources.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids in ``edges`` (a, b) but the components themselves, which are the smallest ids reachable.

    In each round all neighbours of a node move to the smallest of them, first those above the node, then those below, so
    that the number of rounds grows with the logarithm of the longest path. Edges are written in each round; the minima are
    summed up within tasks, so that a node with very many neighbours needs a row from each task.
    """

    def star(pairs: DataFrame, upward: bool) -> DataFrame:
        least = written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        moved = pairs.join(least, "u").filter("v > u" if upward else "v < u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = moved if upward else moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return written(moved.filter("a <> b").distinct(), "edges")

    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    while True:
        up = star(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")), True)
        edges = star(up.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False)
        # Over when each node hangs from one other and none that hangs has any below it.
        ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("hangs").alias("n"), F.max("holds").alias("holds")).filter("n > 1 or n = 1 and holds = 1").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def of_shared_keys(memberships: DataFrame) -> DataFrame:
    """(r, component) of each row of ``memberships`` (r, k): rows that share a key, or are tied through others that do.

    ``r`` is a long. Each row is tied to the first row of each of its keys, so that a key of very many rows gives a row each.
    """
    first = memberships.groupBy("k").agg(F.min("r").alias("m"))
    edges = memberships.join(first, "k").select(F.col("r").alias("a"), F.col("m").alias("b"))
    found = components(edges)
    return memberships.select("r").distinct().join(found, F.col("r") == F.col("id"), "left").select("r", F.coalesce("component", "r").alias("component"))


def bucket(rows: DataFrame, component: str, most: int) -> Column:
    """A number by which whole components are dealt to groups of about ``most`` rows, at least as many as there are task slots."""
    groups = max(-(-rows.count() // most), rows.sparkSession.sparkContext.defaultParallelism)
    return F.pmod(F.xxhash64(component), F.lit(groups)).alias("bucket")
