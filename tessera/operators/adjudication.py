"""Verdicts that are kept: each look at a pair is stored once, so that a run that was killed goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ERROR = "error"
STORED = "digest string, verdict string"


def stored(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """``(digest, verdict)`` of a run: one row for each look; none if the run has not begun."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{run}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], STORED)
    # what two drivers stored at once is one verdict, the same for every reader
    return spark.read.schema(STORED).parquet(f"{folder}/{run}").groupBy("digest").agg(F.min("verdict").alias("verdict"))


def looks(pairs: DataFrame, repeats: int) -> DataFrame:
    """``pairs`` (chunk_a, chunk_b, text_a, text_b) once for each attempt, with the digest of ids, texts and attempt.

    The attempt is part of the key: looks at one pair are independent draws, not one verdict served again. So are the
    texts: a verdict about other words is none about these.
    """
    each = pairs.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    said = F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("chunk_a", "chunk_b", "text_a", "text_b", "attempt")))
    return each.withColumn("digest", F.substring(F.sha2(F.encode(said, "UTF-8"), 256), 1, 32))


def adjudicated(pairs: DataFrame, repeats: int, judge: Callable[[str, str, int], str], folder: str, run: str, commits: int = 16) -> DataFrame:
    """``(chunk_a, chunk_b, attempt, verdict)``: every pair looked at ``repeats`` times, from ``folder`` where ``run`` has a verdict already.

    ``judge`` gets both texts and the attempt. The looks that are missing are dealt by digest to ``commits`` parts, and
    each part is committed before the next begins: a run that is killed loses the part it was in. A lost executor may
    make a call again, but a look is stored once, as only one attempt of a task is committed. A call that fails, or
    says ``error``, gives that look the verdict ``error`` and is not stored, so the next run tries it again. ``run``
    keeps measurements apart and has no default. Null texts are empty; repeated pairs are looked at once.
    """
    if repeats < 1:
        raise ValueError("a pair is looked at once at least")
    spark = pairs.sparkSession
    wanted = looks(pairs.select("chunk_a", "chunk_b", "text_a", "text_b").distinct(), repeats)

    def call(batches):
        for batch in batches:
            kept = []
            for digest, a, b, attempt in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                try:
                    verdict = judge(a or "", b or "", attempt)
                except Exception:  # noqa: BLE001 - belongs to this look
                    verdict = ERROR
                if verdict and verdict != ERROR:
                    kept.append((digest, verdict))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.string()) for i in (0, 1)], ["digest", "verdict"])

    for part in range(commits):
        mine = wanted.where(F.pmod(F.xxhash64("digest"), F.lit(commits)) == part)
        missing = mine.join(stored(spark, folder, run), "digest", "left_anti").dropDuplicates(["digest"])
        missing.select("digest", "text_a", "text_b", "attempt").mapInArrow(call, STORED).write.mode("append").parquet(f"{folder}/{run}")
    known = stored(spark, folder, run)
    return wanted.join(known, "digest", "left").select("chunk_a", "chunk_b", "attempt", F.coalesce("verdict", F.lit(ERROR)).alias("verdict"))


def votes(verdicts: DataFrame, verdict: str = "conflict") -> DataFrame:
    """``(chunk_a, chunk_b, votes, repeats, errors)``: failed looks stay in the denominator."""
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1)).cast("int")
    return verdicts.groupBy("chunk_a", "chunk_b").agg(count(verdict).alias("votes"), F.count("*").cast("int").alias("repeats"), count(ERROR).alias("errors"))
