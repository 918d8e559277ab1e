"""Connected components of long ids, in rounds that grow with the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.checkpoints import written


def connected(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of all ends of ``edges`` (a, b); the component is its smallest node.

    Every node points to a smaller one. A round hangs each neighbour of a node on the smallest one around it, first the
    larger neighbours, then the smaller; a hub's neighbours are combined before they are shuffled, and its rows can be
    split. It ends when a round changes nothing. Null ends are left out.
    """
    both = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    nodes = written(both.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    stars, mark = written(both.where("a <> b").distinct()), None
    while True:
        row = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("x"), F.bit_xor(F.xxhash64("a", "b")).alias("y")).first()
        if tuple(row) == mark or not row["n"]:
            break
        mark = tuple(row)
        around = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        larger = _hung(around, around.where("b > a"))
        stars = written(_hung(larger, larger, keep=True))
    return nodes.join(stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def _hung(around: DataFrame, moved: DataFrame, keep: bool = False) -> DataFrame:
    """``moved`` with each ``b`` hung on the smallest of ``a`` and what is ``around`` it; with ``keep``, ``a`` as well."""
    h = F.xxhash64("a").alias("h")
    low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"), h)
    # the hash makes Spark shuffle for this join alone, so that it can split a hub
    out = moved.select("*", h).join(low, ["a", "h"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if keep:
        out = out.unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
