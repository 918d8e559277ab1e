"""Record linkage: interval, as-of, ownership and one-to-one joins, and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.checkpoints import placed
from tessera.operators.gates import exclusive


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, slack: float, width: float = 60.0) -> DataFrame:
    """Pairs of a point and each span of the same key that holds it, give or take ``slack``.

    Both sides meet in time buckets of ``width``, so the join is on equal keys: a span goes to all buckets that it
    touches, a point to its own.
    """
    bucket = lambda c: F.floor(c / width).cast("long")
    left = points.withColumn("__b", bucket(F.col(at)))
    right = spans.withColumn("__b", F.explode(F.sequence(bucket(F.col(start) - slack), bucket(F.col(end) + slack))))
    return left.join(right, [key, "__b"]).where(F.col(at).between(F.col(start) - slack, F.col(end) + slack)).drop("__b")


def nearest_in_time(points: DataFrame, rows: DataFrame, key: str, point_id: str, at: str, start: str, row_id: str, within: float) -> DataFrame:
    """``(point, row, gap)``: for each point the row of its key with the nearest start, if within reach; ties to the earlier start, then the id."""
    bucket = lambda c: F.floor(c / (2 * within)).cast("long")
    left = points.withColumn("__b", F.explode(F.array(bucket(F.col(at)) - 1, bucket(F.col(at)), bucket(F.col(at)) + 1)))
    gap = F.abs(F.col(at) - F.col(start))
    near = left.join(rows.withColumn("__b", bucket(F.col(start))), [key, "__b"]).where(gap <= within)
    best = near.groupBy(point_id).agg(F.min(F.struct(gap.alias("gap"), F.col(start).alias("start"), F.col(row_id).alias("row"))).alias("b"))
    return best.select(point_id, F.col("b.row").alias(row_id), F.round("b.gap", 6).alias("gap"))


def owned_by_one(claims: DataFrame, owner: str, item: str) -> DataFrame:
    """``(owner, item)`` of items that exactly one owner claims."""
    single = claims.groupBy(item).agg(F.count_distinct(owner).alias("n"), F.min(owner).alias(owner)).where("n = 1")
    return single.select(owner, item)


def one_to_one(pairs: DataFrame, left: str, right: str, score: Column) -> DataFrame:
    """Each right side keeps its best left side, ties to the first; the others get null."""
    best = F.row_number().over(Window.partitionBy(right).orderBy(score.desc(), left)) == 1
    return pairs.withColumn(right, F.when(best, F.col(right)))


def greedy_matching(pairs: DataFrame, group: str, left: str, right: str, score: str, least: float) -> DataFrame:
    """``(group, left, right, score)``: within each group the best pair whose ends are both free is taken, again and again, down to ``least``; ties by ids.

    Rows of ``pairs`` are distinct in their ends. Groups need not fit a task: what is first at both of its ends settles, in rounds.
    """
    rows = pairs.where(F.col(score) >= least).select(group, left, right, F.col(score).cast("double").alias(score))
    end = lambda side, c: F.concat_ws("\x01", F.lit(side), F.col(group).cast("string"), F.col(c).cast("string"))
    order = F.struct((-F.col(score)).alias("s"), F.col(left).alias("a"), F.col(right).alias("b"), F.col(group).alias("g"))
    keyed = rows.withColumns({"__at": order, "__l": end("l", left), "__r": end("r", right)})
    return exclusive(keyed, "__l", "__r", "__at").where("won").select(group, left, right, score)


def contains_all(wanted: DataFrame, have: DataFrame, group: str, item: str, owner: str) -> DataFrame:
    """``(owner, group)`` where the owner has every item of the group: relational division."""
    size = wanted.groupBy(group).agg(F.count_distinct(item).alias("n"))
    both = wanted.select(group, item).distinct().join(have.select(owner, item).distinct(), item)
    return both.groupBy(owner, group).agg(F.count("*").alias("m")).join(size, group).where("m = n").select(owner, group)


def set_change(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``(key, change)`` with ``kept``, ``added`` or ``removed``."""
    old, new = before.select(key).distinct().withColumn("__o", F.lit(1)), after.select(key).distinct().withColumn("__n", F.lit(1))
    both = old.join(new, key, "full_outer")
    return both.select(key, F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").otherwise("kept").alias("change"))


def overrides(routed: DataFrame, pinned: DataFrame, key: str) -> DataFrame:
    """Routed ``(key, score)`` with pinned ``(key, included)`` put over them; included ones first, then by score, then key."""
    both = routed.join(pinned, key, "full_outer").select(key, "score", F.coalesce("included", F.lit(True)).alias("included"))
    order = F.struct((~F.col("included")).alias("out"), F.col("score").isNull().alias("none"), (-F.col("score")).alias("score"), F.col(key).alias("key"))
    return placed(both.withColumn("__order", order), "__order").drop("__order").withColumnRenamed("place", "position")
