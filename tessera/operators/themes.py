"""Soft clusters of vectors: Gaussian mixtures whose number of components the BIC chooses, and layouts of points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import mixtures
from tessera.operators.checkpoints import written

MEMBERSHIP = 0.1
LEAST_ROWS = 4


@dataclass(frozen=True)
class Settings:
    """Axes and components of the first pass and of those inside its components, rows that a cluster aims for, least posterior and size."""

    axes: int = 10
    most: int = 30
    inner_axes: int = 8
    inner_most: int = 30
    target: int = 50
    membership: float = MEMBERSHIP
    least_rows: int = LEAST_ROWS
    seed: int = 0


def soft_clusters(vectors: DataFrame, id_col: str, vector_col: str, settings: Settings = Settings()) -> DataFrame:
    """``(id, cluster, weight)``: unit vectors in overlapping clusters, by two passes of mixtures whose number of components the BIC chooses.

    The first pass reduces all vectors to their main axes and fits full covariances. Inside each of its components of
    more than twice ``target`` rows a second pass does so again with the component's own axes and with variances only,
    one component for each ``target`` rows at most and not more than ``inner_most``; all components are fitted together.
    A row is in every cluster that has ``membership`` of it or more. Clusters of fewer than ``least_rows`` rows are left
    out. Fewer rows than that make one cluster of all. Null vectors are left out, a zero vector stays zero.
    """
    size = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: F.when(size > 0, x / size).otherwise(F.lit(0.0)).cast("double")).alias("x"))
    unit = written(unit.withColumn("g", F.lit(0)))
    rows = unit.count()
    named = lambda df: df.select(F.col("id").alias(id_col), "cluster", F.round("weight", 6).alias("weight"))
    whole = unit.withColumns({"cluster": F.lit(0), "weight": F.lit(1.0)})
    if rows < settings.least_rows:
        return named(whole)
    points = written(mixtures.projected(unit, mixtures.axes(unit, settings.axes)))
    top = mixtures.fitted(points, {0: settings.most}, True, settings.seed)
    if not top:
        return named(whole)
    outer = written(mixtures.members(points, top, settings.membership).select(F.col("component").alias("g"), "id", "weight"))
    sizes = {r["g"]: r["n"] for r in outer.groupBy("g").agg(F.count("*").alias("n")).collect()}
    large = {g: min(settings.inner_most, max(2, n // settings.target)) for g, n in sizes.items() if n > 2 * settings.target}
    found = outer.where(~F.col("g").isin([*large, -1])).select("g", F.lit(0).alias("component"), "id", "weight")
    if large:
        inside = written(outer.where(F.col("g").isin(list(large))).select("g", "id").join(unit.select("id", "x"), "id"))
        near = written(mixtures.projected(inside, mixtures.axes(inside, settings.inner_axes)))
        found = found.unionByName(mixtures.members(near, mixtures.fitted(near, large, False, settings.seed), settings.membership))
    found = written(found)
    # as many as there are components
    kept = sorted((r["g"], r["component"]) for r in found.groupBy("g", "component").agg(F.count("*").alias("n")).where(F.col("n") >= settings.least_rows).collect())
    numbers = vectors.sparkSession.createDataFrame([(g, c, i) for i, (g, c) in enumerate(kept)], "g int, component int, cluster int")
    return named(found.join(F.broadcast(numbers), ["g", "component"]))


def normalised_layout(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` moved to their middle and divided by one shared span, the larger one, rounded to six places; zeros where they are all one."""
    box = points.agg(*(f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))))
    span = F.greatest(F.col(f"hi_{x}") - F.col(f"lo_{x}"), F.col(f"hi_{y}") - F.col(f"lo_{y}"))
    moved = lambda c: F.round(F.when(span > 0, (F.col(c) - (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2) / span).otherwise(F.lit(0.0)), 6) + F.lit(0.0)
    return points.crossJoin(box).withColumns({x: moved(x), y: moved(y)}).select(*points.columns)


def mark(*columns: Column) -> Column:
    """60 bits of the MD5 of what is given."""
    return F.conv(F.substring(F.md5(F.encode(F.concat_ws("|", *columns), "UTF-8")), 1, 15), 16, 10).cast("long")


def _total(marks: Column) -> Column:
    """The sum modulo 2^60: unlike an exclusive or, it tells a mark that is there twice from none."""
    return F.pmod(F.sum(marks.cast("decimal(38,0)")), F.lit(1 << 60)).cast("long")


def layout_fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row that changes with any node or undirected edge, whatever their order."""
    n = nodes.agg(F.count("*").alias("nodes"), _total(mark(F.col("id").cast("string"))).alias("node_mark"))
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().agg(F.count("*").alias("edges"), _total(mark(F.col("a").cast("string"), F.col("b").cast("string"))).alias("edge_mark"))
    return n.crossJoin(e)
