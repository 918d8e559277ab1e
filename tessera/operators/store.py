"""Keyed tables: upserts, replacements, read-through caches and latest states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with the same key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def replace_group(existing: DataFrame, new: DataFrame, group: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(the table, the removed keys) after each group in ``new`` is replaced as a whole; groups without new rows stay as they are."""
    touched = existing.join(new.select(group).distinct(), group, "left_semi")
    removed = touched.join(new.select(key), key, "left_anti").select(key)
    untouched = existing.join(new.select(group).distinct(), group, "left_anti")
    return untouched.unionByName(new), removed


def latest(states: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc())
    return states.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def read_through(wanted: DataFrame, stored: DataFrame, key: str, required: list[str]) -> DataFrame:
    """``wanted`` keys with a status: ``hit`` if stored with all required columns, ``metadata`` if one is missing, else ``miss``."""
    known = stored.withColumn("__known", F.lit(True))
    gaps = F.lit(False)
    for c in required:
        gaps = gaps | F.col(c).isNull()
    joined = wanted.select(key).join(known, key, "left")
    return joined.withColumn("status", F.when(F.col("__known").isNull(), "miss").when(gaps, "metadata").otherwise("hit")).drop("__known")
