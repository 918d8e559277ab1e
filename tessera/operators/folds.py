"""Order-dependent folds within one document or group: chunks and round robins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "chunk_index int, text string, start_segment int, end_segment int"


def chunk_segments(segments: list[str], target: int = 1200, overlap: int = 150) -> list[tuple[int, str, int, int]]:
    """``(index, text, first segment, last segment)``: whole segments are packed while they fit, one at least; the next chunk goes back over whole segments that fit the overlap."""
    out, start = [], 0
    while start < len(segments):
        end, size = start + 1, len(segments[start])
        # nothing stands between an empty beginning and what follows
        while end < len(segments) and size + (size > 0) + len(segments[end]) <= target:
            size += (size > 0) + len(segments[end])
            end += 1
        out.append((len(out), " ".join(segments[start:end]).strip(), start, end - 1))
        if end == len(segments):
            break
        back, room = end, overlap
        while overlap > 0 and back > start + 1 and len(segments[back - 1]) <= room:
            room -= len(segments[back - 1]) + 1
            back -= 1
        start = back
    return out


def chunks(docs: DataFrame, id_col: str, segments_col: str, target: int = 1200, overlap: int = 150) -> DataFrame:
    """Rows of :func:`chunk_segments` for each document; ``segments_col`` is an array of texts. No segments: no rows."""
    kind = f"array<struct<{CHUNK.replace(' int', ':int').replace(' string', ':string')}>>"

    @F.pandas_udf(kind)
    def cut(column: pd.Series) -> pd.Series:
        names = ("chunk_index", "text", "start_segment", "end_segment")
        return column.map(lambda x: [dict(zip(names, c, strict=True)) for c in chunk_segments([] if x is None else list(x), target, overlap)])

    return docs.select(F.col(id_col), F.explode(cut(F.col(segments_col))).alias("c")).select(id_col, "c.*")


def round_robin(rows: DataFrame, group: str, member: str, order: str, limit: int) -> DataFrame:
    """Up to ``limit`` rows of each group: the first of each member, then the second of each, members with more rows first, then by name."""
    sizes = rows.groupBy(group, member).agg(F.count("*").alias("__n"))
    # a member's rows beyond the limit are never taken, so that each task drops them before the shuffle
    first = rows.withColumn("depth", F.row_number().over(Window.partitionBy(group, member).orderBy(order))).where(F.col("depth") <= limit)
    deep = first.withColumn("depth", F.col("depth").cast("long")).join(sizes, [group, member])
    place = F.row_number().over(Window.partitionBy(group).orderBy("depth", F.col("__n").desc(), member))
    return deep.withColumn("position", place).where(F.col("position") <= limit).withColumn("position", F.col("position").cast("long")).drop("__n")
