"""Statistics of rule packs, comparison of the arms that built them, and audits of a later round against an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import cosine, dense

#: A quote counts as found in its source from this ratio on.
RESOLVED = 0.9


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 4)).otherwise(F.lit(0.0))


def pack_statistics(rules: DataFrame, evidence: DataFrame, pack: str) -> DataFrame:
    """One row for each pack of ``rules`` (``pack``, ``rule``, ``contested``), over ``evidence`` (``rule``, ``video``, ``creator``, ``ratio``).

    A rule is of several creators if its evidence names at least two; a missing creator counts as the video's own.
    Rules without evidence count as rules only.
    """
    cited = evidence.withColumn("creator", F.coalesce("creator", F.col("video").cast("string")))
    creators = cited.groupBy("rule").agg(F.count_distinct("creator").alias("n"))
    per_rule = rules.join(creators, "rule", "left").groupBy(pack).agg(
        F.count("*").alias("rubrics"),
        F.count_if(F.col("n") >= 2).alias("multi_creator_rubrics"),
        F.count_if("contested").alias("contested_rubrics"),
    )
    per_quote = rules.select(pack, "rule").join(cited, "rule").groupBy(pack).agg(
        F.count("*").alias("citations"),
        F.count_if(F.col("ratio") >= RESOLVED).alias("resolved"),
        F.count_distinct("creator").alias("creators"),
        F.count_distinct("video").alias("videos"),
    )
    both = per_rule.join(per_quote, pack, "left").fillna(0, ["citations", "resolved", "creators", "videos"])
    return both.withColumn("multi_creator_share", _share("multi_creator_rubrics", "rubrics")).withColumn("quote_resolution", _share("resolved", "citations"))


def shared_budget(pools: DataFrame, pool: str, eligible: str, budget: int) -> DataFrame:
    """``budget``, or the size of the smallest pool that has eligible units, if that is less."""
    sizes = pools.where(F.col(eligible)).groupBy(pool).agg(F.count("*").alias("n"))
    return sizes.agg(F.least(F.lit(budget).cast("long"), F.min("n")).alias("budget"))


def staleness(built: DataFrame, live: DataFrame, video: str) -> DataFrame:
    """How many videos and chunks ``live`` has beyond ``built`` (signed), and whether videos and number of chunks are the same.

    Both have one row for each chunk. Equal sets of videos are told by their number and the exclusive or of their hashes.
    """

    def counted(chunks: DataFrame, name: str) -> DataFrame:
        per = chunks.where(F.col(video).isNotNull()).groupBy(video).agg(F.count("*").alias("n"))
        return per.agg(F.count("*").alias(f"{name}_videos"), F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_chunks"), F.bit_xor(F.xxhash64(video)).alias(f"{name}_mark"))

    row = counted(built, "built").crossJoin(counted(live, "live"))  # one row each
    same = (F.col("built_videos") == F.col("live_videos")) & (F.col("built_chunks") == F.col("live_chunks")) & F.col("built_mark").eqNullSafe(F.col("live_mark"))
    return row.select(
        "built_videos", "built_chunks", "live_videos", "live_chunks",
        (F.col("live_videos") - F.col("built_videos")).alias("behind_videos"),
        (F.col("live_chunks") - F.col("built_chunks")).alias("behind_chunks"),
        same.alias("current"),
    )


def rediscovered(added: DataFrame, shipped: DataFrame) -> DataFrame:
    """Each rule of ``added`` evidence (``rule``, ``chunk``) with the number of shipped rules that cite one of its chunks."""
    theirs = shipped.select("chunk", F.col("rule").alias("other")).distinct()
    met = added.select("rule", "chunk").distinct().join(theirs, "chunk").groupBy("rule").agg(F.count_distinct("other").alias("already_in_shipped"))
    return added.select("rule").distinct().join(met, "rule", "left").fillna(0, ["already_in_shipped"])


def rediscovery_rate(found: DataFrame) -> DataFrame:
    """Share of rules that cite a chunk which a shipped rule cites; null without rules."""
    hit = F.count_if(F.col("already_in_shipped") > 0)
    return found.agg(F.count("*").alias("added"), hit.alias("rediscovered")).withColumn("rate", F.when(F.col("added") > 0, F.round(F.col("rediscovered") / F.col("added"), 4)))


def nearest_prior(added: DataFrame, prior: DataFrame, threshold: float) -> DataFrame:
    """For each added rule (``id``, ``vector``) the nearest prior one, ties to the smaller id. Nothing is dropped at ``threshold``; it is reported."""
    best = dense(prior, added.select(F.col("id").alias("query_id"), "vector"), "id", "vector", k=1)
    named = best.select(F.col("query_id").alias("id"), F.col("id").alias("nearest_prior"), F.round("score", 4).alias("likeness"))
    return added.select("id").join(named, "id", "left").withColumn("near", F.col("likeness") >= threshold)


def gap_closure(gaps: DataFrame, prior: DataFrame, added: DataFrame) -> DataFrame:
    """Whether a rule that came from a gap's own probe lies nearer to the gap than every prior rule.

    ``gaps`` and ``prior`` have ``id`` and ``vector``; ``added`` has the ``gap`` of its probe as well. Without prior
    rules the baseline is 0; a gap whose probe gave no rule is open. Likeness counts to six places.
    """
    baseline = dense(prior, gaps.select(F.col("id").alias("query_id"), "vector"), "id", "vector", k=1).select(F.col("query_id").alias("gap"), F.col("score").alias("before"))
    mine = added.join(gaps.select(F.col("id").alias("gap"), F.col("vector").alias("wanted")), "gap")
    scored = mine.select("gap", "id", F.round(cosine(F.col("wanted"), F.col("vector")), 6).alias("s"))
    best = scored.groupBy("gap").agg(F.count("*").alias("rules"), F.max(F.struct("s", (-F.col("id")).alias("tie"))).alias("b"))
    out = gaps.select(F.col("id").alias("gap")).join(baseline, "gap", "left").join(best, "gap", "left")
    before = F.coalesce("before", F.lit(0.0))
    return out.select("gap", F.coalesce("rules", F.lit(0)).alias("rules"), (-F.col("b.tie")).alias("best_new"), F.coalesce(F.col("b.s") > before, F.lit(False)).alias("closed"))


def arm_winner(cells: DataFrame, run: str) -> DataFrame:
    """The leading arm of each run, and on what its lead rests. ``cells`` has ``arm``, ``value`` and ``high``, the most that repeats gave.

    A lead is decisive only if it clears the highest repeat of all other arms. Arms without a value don't take part;
    a run without any has no row. Ties go to the smaller name and are never decisive.
    """
    order = Window.partitionBy(run).orderBy(F.desc("value"), "arm")
    placed = cells.where(F.col("value").isNotNull()).withColumn("place", F.row_number().over(order)).withColumn("best", F.max("value").over(Window.partitionBy(run)))
    first = F.col("place") == 1
    per = placed.groupBy(run).agg(
        F.max(F.when(first, F.col("arm"))).alias("leader"),
        F.max("value").alias("value"),
        F.count_if(F.col("value") == F.col("best")).alias("tied"),
        F.count("*").alias("arms"),
        F.max(F.when(~first, F.col("high"))).alias("runner_up_max"),
    )
    basis = (
        F.when(F.col("arms") == 1, "single-arm")
        .when(F.col("tied") > 1, "tied")
        .when(F.col("runner_up_max").isNull(), "unrepeated")
        .when(F.col("value") > F.col("runner_up_max"), "cleared-spread")
        .otherwise("inside-spread")
    )
    return per.withColumn("basis", basis).withColumn("decisive", F.col("basis") == "cleared-spread")


def arms_against(cells: DataFrame, run: str, baseline: str, repeated: bool = True) -> DataFrame:
    """Every other arm beside the ``baseline`` arm of its run; runs without that arm have no rows.

    An arm beats it if its lowest repeat (``low``) is above the baseline's highest (``high``); where a metric has no
    model in its path (``repeated`` false), if its value is greater.
    """
    base = cells.where(F.col("arm") == baseline).select(run, F.col("value").alias("baseline_value"), F.col("high").alias("baseline_max"))
    both = cells.where(F.col("arm") != baseline).select(run, "arm", "value", F.col("low").alias("arm_min")).join(base, run)
    delta = F.round(F.col("value") - F.col("baseline_value"), 4)
    if repeated:
        beats = F.col("arm_min") > F.col("baseline_max")
        basis = F.when(beats, "ranges-disjoint").when(~beats, "ranges-overlap").otherwise("unrepeated")
    else:
        beats, basis = delta > 0, F.lit("deterministic")
    graded = delta.isNotNull()
    return both.withColumn("delta", delta).withColumn("beats_baseline", F.when(graded, beats)).withColumn("basis", F.when(graded, basis).otherwise("ungraded"))
