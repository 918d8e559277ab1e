"""Units of a pack: what themes and communities offer, which of it is eligible, and how members, themes and units are listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.checkpoints import placed

LEAST_CHUNKS, LEAST_VIDEOS, LEAST_CREATORS, MOST_SHARE = 5, 2, 2, 0.8
LEAST_ENTITIES, TOP_ENTITIES = 5, 6
IMPURE = 0.2


def theme_units(members: DataFrame, pack: DataFrame) -> DataFrame:
    """``(theme, chunks, videos, creators, share, reason, eligible)`` of themes restricted to a pack's videos, largest first.

    ``members`` has ``theme, chunk, video, creator``. Themes with fewer than five chunks in the pack are no units; of the
    others the first reason that holds against one is given: too few videos, too few creators, one creator with too much.
    """
    inside = members.join(pack.select("video").distinct(), "video", "left_semi")
    per = inside.groupBy("theme", "creator").agg(F.count("*").alias("n"))
    top = per.groupBy("theme").agg(F.max("n").alias("most"), F.count("*").alias("creators"), F.sum("n").alias("chunks"))
    videos = inside.groupBy("theme").agg(F.count_distinct("video").alias("videos"))
    out = top.where(F.col("chunks") >= LEAST_CHUNKS).join(videos, "theme").withColumn("share", F.round(F.col("most") / F.col("chunks"), 4))
    reason = F.when(F.col("videos") < LEAST_VIDEOS, "few_videos").when(F.col("creators") < LEAST_CREATORS, "few_creators").when(F.col("share") > MOST_SHARE, "one_creator")
    return out.select("theme", "chunks", "videos", "creators", "share", reason.alias("reason"), reason.isNull().alias("eligible"))


def community_units(members: DataFrame, mentions: DataFrame, anchors: DataFrame, claims: DataFrame, pack: DataFrame) -> DataFrame:
    """``(community, entities, claims, videos, title)`` of communities of five entities or more: claims of the pack about them, named by their most mentioned entities.

    ``members`` has ``entity, community``, ``mentions`` ``entity, name, mentions``, ``anchors`` ``claim, entity``, ``claims`` ``claim, video``.
    """
    large = members.groupBy("community").agg(F.count("*").alias("entities")).where(F.col("entities") >= LEAST_ENTITIES)
    inside = claims.join(pack.select("video").distinct(), "video", "left_semi")
    about = anchors.join(members, "entity").join(inside, "claim").groupBy("community").agg(F.count_distinct("claim").alias("claims"), F.count_distinct("video").alias("videos"))
    order = Window.partitionBy("community").orderBy(F.desc("mentions"), "entity")
    named = members.join(mentions, "entity").withColumn("n", F.row_number().over(order)).where(F.col("n") <= TOP_ENTITIES)
    title = named.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ", ").alias("title"))
    return large.join(about, "community").join(title, "community")


def eligible(units: DataFrame) -> DataFrame:
    return units.where("eligible")


def selected(arms: dict[str, DataFrame], arm: str) -> DataFrame:
    """The units of an arm; an unknown arm is an error."""
    if arm not in arms:
        raise ValueError(f"unknown arm: {arm}")
    return arms[arm]


def clusters_ordered(clusters: DataFrame) -> DataFrame:
    """``clusters`` (``cluster, size, videos, first``) with ``place``: those of several videos first, then by size, then by their first chunk.

    The places are given range by range, so no task sees all clusters.
    """
    key = F.struct((F.col("videos") < 2).alias("single"), (-F.col("size")).alias("size"), F.col("first"), F.col("cluster"))
    return placed(clusters.withColumn("__key", key), "__key").drop("__key")


def theme_videos(members: DataFrame) -> DataFrame:
    """``(theme, video, members, position)``: each theme's videos by how many members they have."""
    per = members.groupBy("theme", "video").agg(F.count("*").alias("members"))
    order = Window.partitionBy("theme").orderBy(F.desc("members"), "video")
    return per.withColumn("position", F.row_number().over(order).cast("long"))


def theme_purity(members: DataFrame) -> DataFrame:
    """``(theme, top_creator, top_share, off_share, impure)``: the creator with most members, ties to the larger name, and the share of other domains than the theme's commonest."""
    per = members.groupBy("theme", "creator").agg(F.count("*").alias("n")).groupBy("theme").agg(F.max(F.struct("n", "creator")).alias("t"), F.sum("n").alias("total"))
    domain = members.groupBy("theme", "domain").agg(F.count("*").alias("n")).groupBy("theme").agg(F.max("n").alias("d"))
    out = per.join(domain, "theme").withColumn("off_share", F.round(1 - F.col("d") / F.col("total"), 4))
    return out.select("theme", F.col("t.creator").alias("top_creator"), F.round(F.col("t.n") / F.col("total"), 4).alias("top_share"), "off_share", (F.col("off_share") > IMPURE).alias("impure"))


def theme_detail(members: DataFrame, chunks: DataFrame, theme) -> DataFrame:
    """A theme's members with their chunks' fields, in order of the chunk; members whose chunk is gone are left out."""
    return members.where(F.col("theme") == theme).select("chunk").join(chunks, "chunk").orderBy("chunk")


def membership_columns(soft: DataFrame) -> DataFrame:
    """``(chunk, clusters, best, weights)`` of soft memberships ``(chunk, cluster, weight)``: how many clusters, the heaviest (ties to the smaller), and the weights as a map."""
    return soft.groupBy("chunk").agg(
        F.count("*").alias("clusters"),
        F.max(F.struct("weight", (-F.col("cluster")).alias("c")))["c"].alias("__c"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("cluster", "weight")))).alias("weights"),
    ).select("chunk", "clusters", (-F.col("__c")).alias("best"), "weights")


def intruders(members: DataFrame, own: int = 4) -> DataFrame:
    """``(theme, chunk, intruder, position)``: for each theme some of its members and one of the next theme, in an order that depends on a hash, not on chance."""
    draw = Window.partitionBy("theme").orderBy(F.md5(F.concat_ws("|", "theme", "chunk")), "chunk")
    ranked = members.select("theme", "chunk").distinct().withColumn("n", F.row_number().over(draw))
    names = members.select("theme").distinct()
    following = names.alias("a").join(names.alias("b"), F.col("b.theme") > F.col("a.theme"), "left").groupBy(F.col("a.theme").alias("theme")).agg(F.min("b.theme").alias("other"))
    least = names.agg(F.min("theme").alias("least"))
    following = following.crossJoin(least).select("theme", F.coalesce("other", "least").alias("other"))
    outside = ranked.where("n = 1").select(F.col("theme").alias("other"), "chunk")
    guests = following.where("theme <> other").join(outside, "other").select("theme", "chunk", F.lit(True).alias("intruder"))
    both = ranked.where(F.col("n") <= own).select("theme", "chunk", F.lit(False).alias("intruder")).unionByName(guests)
    order = Window.partitionBy("theme").orderBy(F.md5(F.concat_ws("|", "chunk", "theme")), "chunk")
    return both.withColumn("position", F.row_number().over(order).cast("long"))


def conflicts_listed(conflicts: DataFrame, chunks: DataFrame) -> DataFrame:
    """``conflicts`` (``conflict, chunk_a, chunk_b, similarity``) with the videos of both chunks; a conflict with a chunk that is gone is left out."""
    side = lambda x: chunks.select(F.col("chunk").alias(f"chunk_{x}"), F.col("video").alias(f"video_{x}"))
    return conflicts.join(side("a"), "chunk_a").join(side("b"), "chunk_b")


def packs_listed(packs: DataFrame, members: DataFrame, rules: DataFrame) -> DataFrame:
    """``(pack, members, rules, built)`` of every pack in the catalogue, also those that are not built yet."""
    m, r = members.where("included").groupBy("pack").agg(F.count("*").alias("members")), rules.groupBy("pack").agg(F.count("*").alias("rules"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return packs.select("pack").join(m, "pack", "left").join(r, "pack", "left").select("pack", none("members"), none("rules"), F.col("rules").isNotNull().alias("built"))


def with_override(overrides: DataFrame, written: DataFrame) -> DataFrame:
    """``overrides`` after new ones were written: one for each pack and video, the new one if there are both; a null takes it away. Both have ``pack, video, included``."""
    kept = overrides.join(written.select("pack", "video"), ["pack", "video"], "left_anti")
    return kept.unionByName(written).where("included is not null")


def pack_checks(evidence: DataFrame, least: float = 0.9) -> DataFrame:
    """``(pack, quotes, resolved, resolution, ok)`` of ``(pack, ratio)``: the share of quotes found in their source, and whether it is all of them."""
    per = evidence.groupBy("pack").agg(F.count("*").alias("quotes"), F.count_if(F.col("ratio") >= least).alias("resolved"))
    return per.withColumn("resolution", F.round(F.col("resolved") / F.col("quotes"), 4)).withColumn("ok", F.col("quotes") == F.col("resolved"))


def member_routes(summaries: DataFrame, blocked: DataFrame, pins: DataFrame, k: int) -> DataFrame:
    """``(pack, video, score, included, position)``: each pack's ``k`` best routed videos that are not blocked, with pins over them; included ones first, then by score.

    ``summaries`` has ``pack, video, score``, ``pins`` ``pack, video, included``.
    """
    free = summaries.join(blocked.select("video").distinct(), "video", "left_anti")
    order = Window.partitionBy("pack").orderBy(F.desc("score"), "video")
    routed = free.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("pack", "video", "score")
    both = routed.join(pins.withColumnRenamed("included", "pin"), ["pack", "video"], "full").withColumn("included", F.coalesce("pin", F.lit(True)))
    order = Window.partitionBy("pack").orderBy(F.desc("included"), F.col("score").desc_nulls_last(), "video")
    return both.select("pack", "video", "score", "included", F.row_number().over(order).cast("long").alias("position"))


def added(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(key, change)`` of documents that are new or whose digest changed. Both have ``key, digest``."""
    joined = after.join(before.withColumnRenamed("digest", "old"), "key", "left")
    return joined.where(~F.col("digest").eqNullSafe(F.col("old"))).select("key", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("change"))


def pack_detail(packs: DataFrame, members: DataFrame, rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(pack, rule, citations, videos, outside)`` of each pack's rules: how much evidence each has, from how many videos, and how much of it from videos that are no included members."""
    inside = members.where("included").select("pack", "video", F.lit(True).alias("in")).distinct()
    cited = rules.join(packs.select("pack"), "pack", "left_semi").join(evidence, "rule", "left").join(inside, ["pack", "video"], "left")
    out = F.count_if(F.col("video").isNotNull() & F.col("in").isNull())
    return cited.groupBy("pack", "rule").agg(F.count("video").alias("citations"), F.count_distinct("video").alias("videos"), out.alias("outside"))
