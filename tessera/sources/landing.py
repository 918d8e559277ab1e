"""JSON that other systems leave in a folder, read into typed rows: transcripts, discoveries, extractions, question sets and runs."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = "struct<text:string,offset:double,duration:double,lang:string>"
#: Every field as text where its type varies between providers.
METADATA = (
    "struct<title:string,description:string,uploadDate:string,createdAt:string,duration:double,viewCount:long,likeCount:long,tags:array<string>,"
    "channel:struct<id:string,name:string>,author:struct<id:string,displayName:string,username:string>,media:struct<duration:double,thumbnailUrl:string>,"
    "thumbnail:string,thumbnailUrl:string,stats:struct<views:long,likes:long>,additionalData:struct<channelId:string,transcriptLanguages:array<string>>,transcriptLanguages:array<string>>"
)
GOLDEN = "id string, question string, reference_answer string, expected_video_ids array<string>, expected_chunk_ids array<string>, domain string, question_type string, notes string"
EXTRACTION = (
    "chunk_id string, video_id string, error string, entities array<struct<name:string,type:string,aliases:array<string>>>, "
    "relations array<struct<source:string,target:string,type:string,weight:double>>, claims array<struct<text:string,entities:array<string>>>"
)


def unescaped(text: Column) -> Column:
    """Character references decoded, twice at most."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda s: None if s is None else html.unescape(html.unescape(s)))

    return run(text)


def transcripts(raw: DataFrame) -> DataFrame:
    """Typed transcripts of ``(video_id, url, body, metadata)``, the last two JSON texts.

    ``content`` (or ``result``) is a text, which has no segments, or a list of segments, of which blank ones go;
    times in seconds come from milliseconds. A row without any text keeps its place with ``error`` set, so that
    callers can count it. Fields fall back in order: see the expressions.
    """
    blank = lambda c: F.nullif(c, F.lit(""))
    body = lambda p: F.get_json_object("body", p)
    said = F.coalesce(blank(body("$.content")), body("$.result"))
    # a JSON string comes out of get_json_object bare, so a list is told by what the parser makes of it
    parsed = F.from_json(said, f"array<{SEGMENT}>", {"mode": "PERMISSIVE"})
    listed = said.rlike(r"^\s*\[\s*(\{|\])") & parsed.isNotNull()
    read = raw.select("video_id", "url", "body", F.from_json("metadata", METADATA).alias("m"), said.alias("said"), F.when(listed, parsed).alias("parsed"), F.when(~listed, said).alias("plain"))
    # decoded as one text, since a segment cannot hold a NUL that its JSON does not escape; it is split again after
    joined = F.array_join(F.transform(F.col("parsed"), lambda s: F.regexp_replace(F.coalesce(s["text"], F.lit("")), "\u0000", " ")), "\u0000")
    decoded = read.withColumn("joined", unescaped(F.coalesce(joined, F.col("plain"))))
    texts = F.split("joined", "\u0000")
    times = lambda s, t: F.struct(
        F.trim(t).alias("text"),
        (s["offset"] / 1000).alias("start_seconds"),
        ((s["offset"] + s["duration"]) / 1000).alias("end_seconds"),
        s["lang"].alias("language"),
    )
    segments = F.filter(F.zip_with("parsed", texts, times), lambda s: s["text"] != "")
    rows = decoded.withColumn("segments", F.coalesce(segments, F.expr("cast(array() as array<struct<text:string,start_seconds:double,end_seconds:double,language:string>>)")))
    rows = rows.withColumn("raw_text", blank(F.when(F.col("parsed").isNotNull(), F.array_join(F.transform("segments", lambda s: s["text"]), " ")).otherwise(F.trim("joined"))))
    first = lambda *names: F.coalesce(*[blank(F.col(n)) for n in names])
    return rows.select(
        "video_id",
        "url",
        F.coalesce(blank(F.col("m.title")), blank(body("$.title"))).alias("title"),
        blank(F.col("m.description")).alias("description"),
        first("m.channel.id", "m.additionalData.channelId", "m.author.id").alias("channel_id"),
        first("m.channel.name", "m.author.displayName", "m.author.username").alias("channel_name"),
        F.coalesce("m.media.duration", "m.duration").alias("duration_seconds"),
        first("m.media.thumbnailUrl", "m.thumbnail", "m.thumbnailUrl").alias("thumbnail_url"),
        first("m.uploadDate", "m.createdAt").alias("upload_date"),
        F.coalesce("m.stats.views", "m.viewCount").alias("view_count"),
        F.coalesce("m.stats.likes", "m.likeCount").alias("like_count"),
        F.coalesce("m.tags", F.expr("cast(array() as array<string>)")).alias("tags"),
        F.coalesce("m.transcriptLanguages", "m.additionalData.transcriptLanguages", F.expr("cast(array() as array<string>)")).alias("transcript_languages"),
        F.coalesce(blank(body("$.lang")), blank(body("$.language")), F.get(F.col("parsed"), F.lit(0))["lang"]).alias("language"),
        "raw_text",
        "segments",
        F.when(F.col("said").isNull(), "no content").when(F.col("raw_text").isNull(), "empty transcript").alias("error"),
    )


def published_between(listed: DataFrame, channel: str, position: str, published: str, after: Column | None = None, before: Column | None = None, limit: int = 50) -> DataFrame:
    """The first ``limit`` rows of each channel's newest-first list within the dates.

    The list ends at its first row older than ``after``, also for newer rows that follow; newer ones than ``before``
    and undated ones are skipped. Without dates: the first ``limit`` rows.
    """
    rows, whole = listed, Window.partitionBy(channel)
    if after is not None or before is not None:
        if after is not None:
            rows = rows.withColumn("__end", F.min(F.when(F.col(published) < after, F.col(position))).over(whole)).where(F.col("__end").isNull() | (F.col(position) < F.col("__end"))).drop("__end")
        rows = rows.where(F.col(published).isNotNull())
        if before is not None:
            rows = rows.where(F.col(published) <= before)
    return rows.withColumn("__n", F.row_number().over(whole.orderBy(position))).where(F.col("__n") <= limit).drop("__n")


def extractions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file of extracted entities, relations and claims; unreadable, failed and nameless ones are left out."""
    read = spark.read.schema(EXTRACTION + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return read.where("_bad is null and error is null and coalesce(chunk_id, '') <> ''").drop("_bad")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a file that is a list of entries or has one under ``entries``.

    An unreadable file, an entry without id, question or answer, or an id that occurs twice is an error: half a set is worse than none.
    """
    text = spark.read.text(path, wholetext=True)
    struct = "array<struct<" + GOLDEN.replace(" array", ":array").replace(" string", ":string") + ">>"
    listed = F.coalesce(F.get_json_object("value", "$.entries"), F.when(F.col("value").rlike(r"^\s*\["), F.col("value")))
    sets = text.select(F.from_json(listed, struct).alias("entries"))
    if sets.where("entries is null").limit(1).count():
        raise ValueError(f"{path}: neither a list nor an object with entries")
    entries = sets.select(F.explode("entries").alias("e")).select("e.*")
    bad = entries.where("coalesce(id, '') = '' or coalesce(question, '') = '' or reference_answer is null").limit(1).collect()
    if bad:
        raise ValueError(f"{path}: incomplete entry {bad[0]['id']!r}")
    twice = entries.groupBy("id").count().where("count > 1").orderBy("id").limit(5).collect()
    if twice:
        raise ValueError(f"{path}: ids occur twice: {[r['id'] for r in twice]}")
    return entries


def run_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each run file, newest first by name, with its name; unreadable ones are left out."""
    read = spark.read.schema(schema + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return read.withColumn("run_file", F.element_at(F.split(F.input_file_name(), "/"), -1)).where("_bad is null").drop("_bad").orderBy(F.desc("run_file"))


def search_results(raw: DataFrame, body: str = "body") -> DataFrame:
    """``(video_id, title, next_page)`` of pages of search results: the first list that is not empty of ``items``, ``results``, ``videos`` and ``data``, only videos."""
    item = "array<struct<id:string,videoId:string,type:string,title:string>>"
    lists = [F.from_json(F.get_json_object(body, f"$.{k}"), item) for k in ("items", "results", "videos", "data")]
    found = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    token = F.coalesce(F.get_json_object(body, "$.nextPageToken"), F.get_json_object(body, "$.next"))
    rows = raw.select(token.alias("next_page"), F.posexplode(found).alias("position", "v"))
    return rows.where("coalesce(v.type, 'video') = 'video'").select(F.coalesce("v.id", "v.videoId").alias("video_id"), "v.title", "position", "next_page").where("video_id is not null")
