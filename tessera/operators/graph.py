"""Weighted graphs: edges, one-hop neighbourhoods and projections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_edges(relations: DataFrame, mentions: DataFrame, default: float = 0.5) -> DataFrame:
    """Undirected ``(a, b, weight)``: the sum of relation weights, null or 0 counting as ``default``, plus one for each claim that mentions both.

    ``relations`` is ``(src, dst, type, weight)``, of which the largest of a directed pair and type counts;
    ``mentions`` is ``(claim, entity)``. Loops are dropped.
    """
    merged = relations.where("src <> dst").groupBy("src", "dst", "type").agg(F.max("weight").alias("w"))
    weight = F.when(F.coalesce("w", F.lit(0.0)) == 0, default).otherwise(F.col("w"))
    stated = merged.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), weight.alias("w"))
    ends = mentions.distinct()
    together = ends.alias("x").join(ends.alias("y"), "claim").where("x.entity < y.entity").select(F.col("x.entity").alias("a"), F.col("y.entity").alias("b"), F.lit(1.0).alias("w"))
    return stated.unionByName(together).groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("weight"))


def neighbourhood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(node, hops)``: the seeds, and what an edge joins to them."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(seeds.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node"), F.lit(1).alias("hops"))
    return seeds.select("node", F.lit(0).alias("hops")).unionByName(near).groupBy("node").agg(F.min("hops").alias("hops"))


def principal_axes(vectors: DataFrame, vector_col: str, n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes) from the covariance of all rows, summed on the executors; the largest part of each axis is positive. Fewer than two rows: an error."""

    def partial(batches):
        import pandas as pd

        for rows in batches:
            m = np.stack(rows["v"].to_numpy()).astype(np.float64)
            m = m[np.isfinite(m).all(axis=1)]
            yield pd.DataFrame({"n": [len(m)], "s": [m.sum(axis=0)], "c": [(m.T @ m).ravel()]})

    parts = vectors.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).alias("v")).mapInPandas(partial, "n long, s array<double>, c array<double>")
    # a partial sum for each batch: merged by position on the executors, so the driver gets one row
    total = parts.agg(F.sum("n")).first()[0] or 0
    if total < 2:
        raise ValueError("a projection needs two rows")
    merge = lambda c: np.array([r["x"] for r in parts.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])
    mean = merge("s") / total
    covariance = merge("c").reshape(len(mean), len(mean)) / total - np.outer(mean, mean)
    values, axes = np.linalg.eigh(covariance)
    axes = axes[:, np.argsort(-values)[: min(n, total - 1, len(mean))]].T
    return mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def project(vectors: DataFrame, id_col: str, vector_col: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``(id, x0, x1, ...)``: each vector less the mean, along the axes, rounded to six places."""
    centre = F.array(*[F.lit(float(m)) for m in mean])
    along = lambda axis: F.aggregate(F.zip_with(F.zip_with(F.col(vector_col), centre, lambda a, b: a - b), F.array(*[F.lit(float(x)) for x in axis]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return vectors.select(id_col, *[F.round(along(a), 6).alias(f"x{i}") for i, a in enumerate(axes)])


def candidate_pairs(near: DataFrame) -> DataFrame:
    """``(a, b, similarity)`` from ``(query_id, id, score)``: one row for each pair, whichever side named it."""
    return near.groupBy(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).agg(F.max("score").alias("similarity"))
