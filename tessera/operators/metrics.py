"""Retrieval metrics, comparisons of configurations, leaderboards and vote statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10)


def first_seen(retrieved: DataFrame) -> DataFrame:
    """``(query_id, doc, rank)`` with repeated documents dropped and ranks moved up."""
    once = retrieved.groupBy("query_id", "doc").agg(F.min("rank").alias("__r"))
    return once.select("query_id", "doc", F.row_number().over(Window.partitionBy("query_id").orderBy("__r")).alias("rank"))


def ir_metrics(retrieved: DataFrame, expected: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Recall at 1, 3, 5 and 10, reciprocal rank, NDCG at ``k`` and average precision of every query, rounded to four places.

    A query that expects nothing has nulls. ``retrieved`` is ``(query_id, doc, rank)``, ``expected`` ``(query_id, doc)``.
    """
    wanted = expected.select("query_id", "doc").distinct()
    size = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = first_seen(retrieved).join(wanted, ["query_id", "doc"])
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    at = lambda c: F.sum(F.when(F.col("rank") <= c, 1).otherwise(0))
    gain = F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    sums = hits.groupBy("query_id").agg(*[at(c).alias(f"h{c}") for c in CUTOFFS], F.min("rank").alias("first"), gain.alias("gain"), F.sum(F.col("nth") / F.col("rank")).alias("ap"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.when(F.col("n").isNotNull(), F.round(F.coalesce(c, F.lit(0.0)), 4))
    joined = queries.select("query_id").join(size, "query_id", "left").join(sums, "query_id", "left")
    return joined.select(
        "query_id",
        *[zero(F.col(f"h{c}") / F.col("n")).alias(f"recall_{c}") for c in CUTOFFS],
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.when(F.col("n") > 0, F.col("gain") / ideal)).alias("ndcg"),
        zero(F.col("ap") / F.col("n")).alias("average_precision"),
    )


def summarise(cells: DataFrame, config: str, group: str, values: list[str]) -> DataFrame:
    """Means of the values that are not null, rounded to four places, for each configuration over all rows (group null) and for each group."""
    means = [F.round(F.avg(v), 4).alias(v) for v in values]
    return cells.groupingSets([[config], [config, group]], config, group).agg(*means, F.count("*").alias("n"), F.grouping(group).alias("__all")).withColumn(group, F.when(F.col("__all") == 0, F.col(group))).withColumn("overall", F.col("__all") == 1).drop("__all")


def against_baseline(summary: DataFrame, config: str, baseline: str, values: list[str]) -> DataFrame:
    """Each configuration's values less the baseline's, rounded to four places."""
    base = summary.where(F.col(config) == baseline).select(*[F.col(v).alias(f"__{v}") for v in values])
    return summary.crossJoin(base.limit(1)).select(config, *[F.round(F.col(v) - F.col(f"__{v}"), 4).alias(f"{v}_delta") for v in values])


def leaderboard(cells: DataFrame) -> DataFrame:
    """Of ``(setup, entry, score, seconds, tokens)``: means, contests, wins and win rate of every setup, best mean first, null last.

    An entry that two or more setups have a score for is a contest; its winner is the highest score, ties the first
    setup by name. Rows without a score count as failed.
    """
    scored = cells.where(F.col("score").isNotNull())
    fields = Window.partitionBy("entry")
    raced = scored.withColumn("n", F.count("*").over(fields)).withColumn("place", F.row_number().over(fields.orderBy(F.col("score").desc(), "setup")))
    wins = raced.where("n >= 2").groupBy("setup").agg(F.count("*").alias("contests"), F.sum(F.when(F.col("place") == 1, 1).otherwise(0)).alias("wins"))
    means = cells.groupBy("setup").agg(
        F.round(F.avg("score"), 4).alias("score"),
        F.count("score").alias("answered"),
        F.sum(F.when(F.col("score").isNull(), 1).otherwise(0)).alias("failed"),
        F.round(F.avg("seconds"), 4).alias("seconds"),
        F.round(F.avg("tokens"), 4).alias("tokens"),
    )
    out = means.join(wins, "setup", "left").fillna(0, ["contests", "wins"])
    out = out.withColumn("win_rate", F.round(F.try_divide("wins", "contests"), 4))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), "setup")))


def tally(votes: DataFrame) -> DataFrame:
    """Of ``(pair, attempt, verdict)``, null for an error: votes, majority (more than half of all attempts), unanimity, decision band and the chance of a majority."""
    from tessera.functions.text import majority_chance, undecided

    said = votes.groupBy("pair").agg(
        F.count("*").cast("int").alias("n"),
        F.sum(F.when(F.col("verdict") == "conflict", 1).otherwise(0)).cast("int").alias("conflict"),
        F.count_distinct("verdict").alias("kinds"),
        F.sum(F.when(F.col("verdict").isNull(), 1).otherwise(0)).alias("errors"),
        F.min_by("attempt", F.when(F.col("verdict") == "conflict", F.col("attempt"))).alias("first_conflict"),
    )
    return said.select(
        "pair",
        "n",
        "conflict",
        "errors",
        (2 * F.col("conflict") > F.col("n")).alias("carried"),
        ((F.col("kinds") == 1) & (F.col("errors") == 0)).alias("unanimous"),
        undecided(F.col("conflict"), F.col("n")).alias("undecided"),
        F.round(majority_chance(F.col("conflict"), F.col("n")), 6).alias("chance"),
        "first_conflict",
    )


def consensus(ballots: DataFrame) -> DataFrame:
    """The commonest choice of each criterion, null included; ties to the larger choice."""
    counts = ballots.groupBy("criterion", "choice").agg(F.count("*").alias("n"))
    best = counts.groupBy("criterion").agg(F.max(F.struct("n", F.coalesce("choice", F.lit("")).alias("key"))).alias("b"))
    return best.select("criterion", F.nullif(F.col("b.key"), F.lit("")).alias("choice"), F.col("b.n").alias("votes"))


def spread(values: DataFrame, group: str, value: str) -> DataFrame:
    """Smallest, upper median and largest value of each group.

    The median is exact: an estimate says between which two values it lies, and only those between are put in order, a
    few in a thousand of a large group's rows.
    """
    known = values.where(F.col(value).isNotNull()).select(group, F.col(value).alias("__v"))
    bounds = known.groupBy(group).agg(F.count("*").alias("__n"), F.min("__v").alias("low"), F.max("__v").alias("high"), F.percentile_approx("__v", [0.4999, 0.5001], 100_000).alias("__b"))
    both = known.join(F.broadcast(bounds) if bounds.limit(10_001).count() <= 10_000 else bounds, group)
    below = both.groupBy(group).agg(F.count_if(F.col("__v") < F.col("__b")[0]).alias("__below"))
    inside = both.where(F.col("__v").between(F.col("__b")[0], F.col("__b")[1])).groupBy(group, "__v", "__n").agg(F.count("*").alias("__m"))
    upto = F.sum("__m").over(Window.partitionBy(group).orderBy("__v"))
    found = inside.withColumn("__upto", upto).join(below, group).where(F.col("__below") + F.col("__upto") > F.floor(F.col("__n") / 2))
    median = found.groupBy(group).agg(F.min("__v").alias("median"))
    return bounds.join(median, group).select(group, "low", "median", "high")


def diff(before: DataFrame, after: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """Change of each key that both runs have, and whether it is better, worse or neither beyond the threshold."""
    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key)
    change = F.round(F.col("after") - F.col("before"), 6)
    return both.withColumn("change", change).withColumn("verdict", F.when(F.col("change") > threshold, "better").when(F.col("change") < -threshold, "worse").otherwise("same"))
