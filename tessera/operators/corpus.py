"""Reads of a chunk corpus: scopes, listings, lookups, and what an index run leaves behind.

Chunks have ``video, index, channel, text`` and whatever else; all functions keep further columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import store


def scoped(rows: DataFrame, video: str | None = None, channel: str | None = None, held_out: DataFrame | None = None) -> DataFrame:
    """Rows of one video or channel, without held-out videos. Write it before any ranking: it reaches the scan."""
    if video is not None:
        rows = rows.where(F.col("video") == video)
    if channel is not None:
        rows = rows.where(F.col("channel") == channel)
    return rows if held_out is None else rows.join(held_out.select("video").distinct(), "video", "left_anti")


def of_videos(chunks: DataFrame, videos: DataFrame) -> DataFrame:
    """The chunks of a set of videos."""
    return chunks.join(videos.select("video").distinct(), "video", "left_semi")


def listed(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``position`` in their video by index, and the video's ``total``."""
    total = chunks.groupBy("video").agg(F.count("*").alias("total"))
    order = Window.partitionBy("video").orderBy("index")
    return chunks.withColumn("position", F.row_number().over(order).cast("long")).join(total, "video")


def counted(chunks: DataFrame, videos: DataFrame) -> DataFrame:
    """``(video, chunks, has_any)`` of each video asked for, also of those without chunks."""
    n = chunks.groupBy("video").agg(F.count("*").alias("n"))
    return videos.select("video").distinct().join(n, "video", "left").select("video", F.coalesce("n", F.lit(0)).alias("chunks"), F.col("n").isNotNull().alias("has_any"))


def videos_of_channels(chunks: DataFrame, order: str, held_out: DataFrame | None = None) -> DataFrame:
    """``(channel, video, position)``: each channel's videos in the order in which their chunks are first seen."""
    first = scoped(chunks, held_out=held_out).groupBy("channel", "video").agg(F.min(order).alias("first"))
    return first.select("channel", "video", F.row_number().over(Window.partitionBy("channel").orderBy("first", "video")).cast("long").alias("position"))


def raw_key(video: Column) -> Column:
    return F.concat(F.lit("raw_transcript:"), video.cast("string"))


def with_body(docs: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """``(key, body)``: a stored document, its columns as one JSON body."""
    return docs.select(key.alias("key"), F.to_json(F.struct(*columns)).alias("body"))


def looked_up(stored: DataFrame, keys: DataFrame, schema: str) -> DataFrame:
    """The documents with the given ``key``, their bodies read back as columns of ``schema``. Unknown keys have no row."""
    found = stored.join(keys.select("key").distinct(), "key", "left_semi")
    return found.select("key", F.from_json("body", schema).alias("d")).select("key", "d.*")


def with_identity(chunks: DataFrame, videos: DataFrame) -> DataFrame:
    """``chunks`` with channel, title and date of their video; a missing channel id becomes ``name:<channel>``."""
    known = videos.select("video", F.coalesce(F.nullif("channel_id", F.lit("")), F.concat(F.lit("name:"), F.col("channel_name"))).alias("channel_key"), "title", "upload_date")
    return chunks.join(known, "video", "left")


def summary_status(raw: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """``(video, status)``: ``hit`` if a summary of this embedding model is stored, ``refresh`` if one of another model is,
    ``indexed`` if the document brings one, ``created`` if one has to be made."""
    old = stored.select("video", F.col("model").alias("__model"))
    given = F.coalesce(F.trim("summary"), F.lit("")) != ""
    status = F.when(F.col("__model") == model, "hit").when(F.col("__model").isNotNull(), "refresh").when(given, "indexed").otherwise("created")
    return raw.join(old, "video", "left").select("video", status.alias("status"))


def situated(chunks: DataFrame, contexts: DataFrame) -> DataFrame:
    """``chunks`` with each header followed by its context where one was made; a chunk without one keeps its header. ``contexts`` has ``chunk, context``."""
    made = contexts.where(F.coalesce(F.trim("context"), F.lit("")) != "").select("chunk", "context")
    return chunks.join(made, "chunk", "left").withColumn("situated", F.col("context").isNotNull()).withColumn("header", F.concat_ws("\n", "header", "context")).drop("context")


def index_report(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``(video, stored, removed)`` for each video with new chunks: how many it has now, and how many old ones went. Both have ``video, chunk``."""
    _, removed = store.replace_group(stored, new, "video", "chunk")
    gone = stored.join(removed, "chunk", "left_semi").groupBy("video").agg(F.count("*").alias("removed"))
    now = new.groupBy("video").agg(F.count("*").alias("stored"))
    return now.join(gone, "video", "left").select("video", "stored", F.coalesce("removed", F.lit(0)).alias("removed"))


def cached_cells(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted`` with ``hit`` and the cached ``value``: a cell that is missing, unreadable (null) or ended in an error is a miss."""
    good = cache.where("value is not null and error is null").select("fingerprint", "value")
    return wanted.join(good, "fingerprint", "left").withColumn("hit", F.col("value").isNotNull())


def cacheable(cells: DataFrame) -> DataFrame:
    """What may be written to the cache: cells without an error."""
    return cells.where("error is null")


def transcript_rows(docs: DataFrame, chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """``(video, segments, chunks, has_summary, stage)``: how far each document has come."""
    n = chunks.groupBy("video").agg(F.count("*").alias("chunks"))
    has = summaries.select("video", F.lit(True).alias("s")).distinct()
    both = docs.join(n, "video", "left").join(has, "video", "left")
    chunked, summed = F.coalesce("chunks", F.lit(0)), F.coalesce("s", F.lit(False))
    stage = F.when(chunked == 0, "raw").when(~summed, "chunked").otherwise("summarised")
    return both.select("video", "segments", chunked.alias("chunks"), summed.alias("has_summary"), stage.alias("stage"))
