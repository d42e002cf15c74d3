"""Connected components of a link table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

#: A link table of at most so many rows is solved by one task (a few MB).
ONE_TASK = 100_000


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> node, component: the smallest node that can be reached.

    While there are more than ONE_TASK links, each node points at its smallest neighbour, pointers are
    followed four steps, and links are redrawn between the nodes pointed at; those within one node go, so
    the table shrinks with each round. The rest is solved by one task. The smallest node of a component
    always points at itself, so it is the one that is left. Rounds are written to the shared folder.
    """
    small_batches(links.sparkSession)
    smaller, larger = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now = staged(links.where("a != b").select(smaller, larger).distinct())
    rounds = []
    while now.count() > ONE_TASK:
        both = now.select(F.col("b").alias("node"), F.col("a").alias("near")).union(now.select("a", "a"))  # a link's smaller end never points at the larger one
        to = staged(both.groupBy("node").agg(F.min("near").alias("to")))
        for _ in range(2):
            far = to.select(F.col("node").alias("to"), F.col("to").alias("far"))
            to = staged(to.join(far, "to").select("node", F.col("far").alias("to")))
        rounds.append(to)
        ends = now.join(to.toDF("a", "x"), "a").join(to.toDF("b", "y"), "b").where("x != y")
        now = staged(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    done = now.coalesce(1).mapInArrow(_solve, "node long, component long")
    for to in reversed(rounds):
        last = done.toDF("to", "component")
        done = to.join(last, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return staged(done)


def _solve(batches: Iterator) -> Iterator:
    """Union-find over all links of one task."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for b in batches:
        for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist()):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])
