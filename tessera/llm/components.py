"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import checkpointed


def connected_components(edges: DataFrame, src: str, dst: str, rows: int | None = None) -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the smallest node reachable.

    Each step is an aggregation with a map-side combine and an equi-join, so a
    hub with any number of neighbours never gathers them in one row. The number
    of steps grows with the logarithm of the longest chain. No edges: no rows.
    Null ends and loops are ignored. ``rows`` is about how many edges there are;
    with it each step writes files in proportion to its edges, not to partitions.
    """
    stars = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    stars = checkpointed(stars, rows)
    seen = _digest(stars)
    while seen[0]:
        stars = checkpointed(_small_star(_large_star(stars)), None if rows is None else seen[0])
        now = _digest(stars)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _digest(stars: DataFrame) -> tuple[int, int]:
    row = stars.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node gets an edge to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _joined(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _joined(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Join on ``u``. The hash beside it makes Spark shuffle both sides for the join alone, so it can split a hub's rows;
    were the aggregation's partitioning reused, all of them would stay in one task."""
    h = F.xxhash64("u")
    return edges.withColumn("h", h).join(low.withColumn("h", h), ["u", "h"])


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get an edge to the smallest of them. ``edges`` point downwards."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _joined(edges, low).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
