"""Held-out criteria and pack catalogues, read through Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRITERION = "struct<id:string,criterion:string,quote:string,start_seconds:double,applies_to:array<string>,note:string,group:string>"
TOPIC = "struct<id:string,title:string,query:string>"


def _one(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def critique_dataset(spark: SparkSession, path: str) -> DataFrame:
    """``(criterion, text, quote, start_seconds, group, applies_to)`` of a file that is a list of criteria or has one under ``criteria``, one row for each document that a criterion applies to.

    A criterion without an id or a text, and an id that occurs twice, is an error. One that applies to nothing has no row.
    """
    listed = F.coalesce(F.get_json_object("value", "$.criteria"), F.when(F.col("value").rlike(r"^\s*\["), F.col("value")))
    rows = _one(spark, path).select(F.explode(F.from_json(listed, f"array<{CRITERION}>")).alias("c")).select("c.*")
    if rows.where("coalesce(id, '') = '' or coalesce(criterion, '') = ''").limit(1).count():
        raise ValueError(f"{path}: a criterion without an id or a text")
    if twice := rows.groupBy("id").count().where("count > 1").limit(1).collect():
        raise ValueError(f"{path}: {twice[0]['id']} occurs twice")
    return rows.select(F.col("id").alias("criterion"), F.col("criterion").alias("text"), "quote", "start_seconds", F.coalesce("group", "id").alias("group"), F.explode("applies_to").alias("applies_to"))


def pack_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(topics ``(pack, title, query)``, videos kept out ``(video, why)`` with ``excluded`` or ``held_out``) of a catalogue. A video in both lists is held out."""
    whole = _one(spark, path)
    topics = whole.select(F.explode(F.from_json(F.get_json_object("value", "$.topics"), f"array<{TOPIC}>")).alias("t")).select(F.col("t.id").alias("pack"), "t.title", F.coalesce("t.query", "t.title").alias("query"))
    out = None
    for why in ("excluded", "held_out"):
        part = whole.select(F.explode(F.from_json(F.get_json_object("value", f"$.{why}"), "array<string>")).alias("video")).withColumn("why", F.lit(why))
        out = part if out is None else out.unionByName(part)
    return topics, out.groupBy("video").agg(F.max("why").alias("why"))
