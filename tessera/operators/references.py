"""References of answers: labels to chunks, fallbacks, order, global labels, repair, merging and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import estimated_tokens, label_number

CITED = r"\[(\d+)\]"


def by_position(labels: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``(answer, number, chunk)``: a label's number is the place of what was retrieved, from 1. Numbers out of range and repeated ones go.

    ``labels`` has ``answer, label``, ``retrieved`` has ``answer, place, chunk``.
    """
    numbers = labels.select("answer", label_number(F.col("label")).alias("number")).where("number is not null").distinct()
    return numbers.join(retrieved.select("answer", F.col("place").alias("number"), "chunk"), ["answer", "number"])


def or_fallback(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``(answer, place, chunk)``: the retrieved rows that an answer's text cites by number; all of them if it cites none that exists."""
    cited = answers.select("answer", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(CITED), F.lit(1)).cast("array<int>"))).alias("place"))
    found = retrieved.join(cited, ["answer", "place"], "left_semi")
    silent = answers.select("answer").join(found.select("answer").distinct(), "answer", "left_anti")
    return found.unionByName(retrieved.join(silent, "answer", "left_semi")).select("answer", "place", "chunk")


def ordered(references: DataFrame) -> DataFrame:
    """``references`` with ``position`` in their answer: plain numbers first, then those of subtopics, each by number; others last."""
    sub = F.nullif(F.regexp_extract("label", r"^\[s(\d+)\.\d+\]$", 1), F.lit("")).cast("int")
    number = label_number(F.col("label"))
    kind = F.when(number.isNull(), 2).when(sub.isNull(), 0).otherwise(1)
    order = Window.partitionBy("answer").orderBy(kind, sub, number, "label")
    return references.withColumn("position", F.row_number().over(order).cast("long"))


def global_labels(calls: DataFrame) -> DataFrame:
    """``(session, call, place, chunk, label)``: a chunk has the number of its first sighting in the session, in whatever call it comes again."""
    first = calls.groupBy("session", "chunk").agg(F.min(F.struct("call", "place")).alias("seen"))
    label = F.row_number().over(Window.partitionBy("session").orderBy("seen", "chunk")).cast("long")
    return calls.join(first.select("session", "chunk", label.alias("label")), ["session", "chunk"]).select("session", "call", "place", "chunk", "label")


def repaired(citations: DataFrame, chunks: DataFrame, within: float) -> DataFrame:
    """``citations`` with the ``index`` of their video's chunk that starts nearest, if within reach; ties to the earlier start. Others keep a null.

    Both sides meet in buckets of the reach, so that no video's chunks are compared with all its citations.
    """
    bucket = lambda c: F.floor(c / within).cast("long")
    near = citations.withColumn("__b", F.explode(F.array(bucket(F.col("at")) - 1, bucket(F.col("at")), bucket(F.col("at")) + 1)))
    gap = F.abs(F.col("at") - F.col("start"))
    best = near.join(chunks.select("video", "index", "start", bucket(F.col("start")).alias("__b")), ["video", "__b"]).where(gap <= within)
    best = best.groupBy("citation").agg(F.min(F.struct(gap, F.col("start"), F.col("index").alias("index")))["index"].alias("index"))
    return citations.join(best, "citation", "left")


def merged_contexts(contexts: DataFrame) -> DataFrame:
    """``(answer, chunk, position)``: the rows of several contexts one after the other, each chunk where it came first."""
    first = contexts.groupBy("answer", "chunk").agg(F.min(F.struct("context", "place")).alias("seen"))
    return first.select("answer", "chunk", F.row_number().over(Window.partitionBy("answer").orderBy("seen", "chunk")).cast("long").alias("position"))


def unique_pool(rankings: DataFrame) -> DataFrame:
    """``(query_id, doc, list, rank, position)``: each document of several rankings once, where it is first seen."""
    first = rankings.groupBy("query_id", "doc").agg(F.min(F.struct("list", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy("seen", "doc")
    return first.select("query_id", "doc", "seen.list", "seen.rank", F.row_number().over(order).cast("long").alias("position"))


def resolvable(hits: DataFrame, records: DataFrame, needed: list[str]) -> DataFrame:
    """Hits whose record exists and has all of the needed fields."""
    full = records
    for c in needed:
        full = full.where(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return hits.join(full.select("doc"), "doc", "left_semi")


def null_rerank(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits of each query in their order, with scores from their number down to 1."""
    kept = hits.where(F.col("rank") <= k)
    n = kept.groupBy("query_id").agg(F.max("rank").alias("n"))
    return kept.join(n, "query_id").withColumn("score", (F.col("n") - F.col("rank") + 1).cast("double")).drop("n")


def compared(full: Column, short: Column) -> Column:
    """Token estimates of two contexts, and how much of the first the second saves, in per cent."""
    a, b = estimated_tokens(full), estimated_tokens(short)
    return F.struct(a.alias("full_tokens"), b.alias("short_tokens"), F.coalesce(F.round(F.try_divide(100.0 * (a - b), a), 2), F.lit(0.0)).alias("saved"))


def prompt_context(chunks: DataFrame) -> DataFrame:
    """``(answer, context)``: an answer's chunks in order, each under its number and header."""
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.concat_ws("\n", "header", "text"))
    said = chunks.select("answer", F.struct("place", line.alias("line")).alias("x"))
    return said.groupBy("answer").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda s: s["line"]), "\n\n").alias("context"))
