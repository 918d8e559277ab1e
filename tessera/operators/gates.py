"""Ordered decisions over ranked rows: gate cascades, near misses, numbering and interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import states_a_position
from tessera.operators.checkpoints import checkpointed
from tessera.operators.walks import within_capacity

GATES = ("not_a_conflict", "minority_verdict", "unstated_axis", "quote_not_in_transcript", "quote_is_not_a_position", "duplicate_evidence")


def exclusive(pairs: DataFrame, left: str, right: str, position: str) -> DataFrame:
    """``pairs`` with ``won``: what a walk in the order of ``position`` takes if each end can be used once.

    Each end is a key that takes one pair, see :func:`tessera.operators.walks.within_capacity`. ``position`` must be unique.
    """
    ends = pairs.select(position, F.explode(F.array(left, right)).alias("key"), F.lit(1).alias("cap"))
    won = within_capacity(ends, position).withColumn("won", F.lit(True))
    return pairs.join(won, position, "left").withColumn("won", F.coalesce("won", F.lit(False)))


def conflict_gates(judged: DataFrame) -> DataFrame:
    """``judged`` with ``gate``: the first gate that a pair fails, null for a conflict.

    Columns read: ``position`` (unique, best first), ``chunk_a``, ``chunk_b``, ``votes``, ``repeats``, ``axis``,
    ``why``, ``span_a`` and ``span_b`` (what of each quote was found in its source, else null). A majority is more
    than half of all repeats. Chunks of an earlier conflict cannot back another one. Empty counts as missing.
    """
    lacks = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    early = (
        F.when(F.coalesce("votes", F.lit(0)) == 0, GATES[0])
        .when(~F.coalesce(2 * F.col("votes") > F.col("repeats"), F.lit(False)), GATES[1])
        .when(lacks("axis") | lacks("why"), GATES[2])
        .when(F.col("span_a").isNull() | F.col("span_b").isNull(), GATES[3])
        .when(~states_a_position(F.col("span_a")) | ~states_a_position(F.col("span_b")), GATES[4])
    )
    rows = checkpointed(judged.withColumn("gate", early))
    last = exclusive(rows.where("gate is null").select("position", "chunk_a", "chunk_b"), "chunk_a", "chunk_b", "position").where("not won").select("position", F.lit(GATES[5]).alias("__late"))
    return rows.join(last, "position", "left").withColumn("gate", F.coalesce("gate", "__late")).drop("__late")


def gate_tally(gated: DataFrame) -> DataFrame:
    """``(gate, n)`` for every gate, also those that stopped nothing."""
    names = gated.sparkSession.createDataFrame([(i, g) for i, g in enumerate(GATES)], "place int, gate string")
    counts = gated.where("gate is not null").groupBy("gate").agg(F.count("*").alias("n"))
    return names.join(counts, "gate", "left").select("place", "gate", F.coalesce("n", F.lit(0)).alias("n"))


def near_misses(judged: DataFrame, limit: int = 25) -> DataFrame:
    """The pairs with votes but no majority: most votes first, then similarity, then chunks."""
    some = judged.where("votes > 0 and 2 * votes <= repeats")
    return some.orderBy(F.desc("votes"), F.desc("similarity"), "chunk_a", "chunk_b").limit(limit)


def numbered(rows: DataFrame, group: str, key: str, position: str) -> DataFrame:
    """``(group, key, number)``: keys numbered from 1 within each group by where they occur first."""
    first = rows.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.min(position).alias("__at"))
    return first.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy("__at", key)).alias("number"))


def interleave(first: DataFrame, second: DataFrame, key: str, rank: str, limit: int) -> DataFrame:
    """``(key, position)``: the two ranked lists in turn, each key once, up to ``limit``; when one list runs out the other goes on.

    A key in both lists can go to either turn, so the walk depends on what came before. It only ever sees the first
    ``2 * limit`` distinct keys of each list, of which no more than ``limit`` can be taken already.
    """
    top = lambda df: df.groupBy(key).agg(F.min(rank).alias("r")).orderBy("r", key).limit(2 * limit).agg(F.array_sort(F.collect_list(F.struct("r", F.col(key).alias("k")))).alias("l"))
    both = top(first).withColumnRenamed("l", "x").crossJoin(top(second).withColumnRenamed("l", "y"))
    keys = lambda c: F.transform(F.col(c), lambda s: s["k"])
    fresh = lambda pool, taken: F.get(F.filter(pool, lambda k: ~F.array_contains(taken, k)), F.lit(0))
    step = lambda taken, i: F.when(F.coalesce(fresh(F.col("a"), taken), fresh(F.col("b"), taken)).isNull(), taken).otherwise(
        F.array_append(taken, F.when(i % 2 == 0, F.coalesce(fresh(F.col("a"), taken), fresh(F.col("b"), taken))).otherwise(F.coalesce(fresh(F.col("b"), taken), fresh(F.col("a"), taken))))
    )
    ready = both.select(keys("x").alias("a"), keys("y").alias("b"))
    empty = F.slice(F.col("a"), 1, 0)
    return ready.select(F.posexplode(F.aggregate(F.sequence(F.lit(0), F.lit(limit - 1)), empty, step)).alias("position", key))
