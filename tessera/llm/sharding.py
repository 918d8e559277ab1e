"""Vector bin packing of rows into shards that balances bytes, tokens and rows together.

Groups of equal texts stay whole unless one alone outgrows a fixed share of a
shard; such a group, which may hold a third of all rows, is dealt out in
pieces. What is packed is a table of units of bounded size: each group above a
small share of the corpus (or its pieces), and all smaller groups in a fixed
number of bundles by the hash of their text. Each unit, largest first, goes to
the shard where the dot product of its vector with the shard's residual
capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.runtime import checkpointed

#: Bundles of small groups for each shard, about 1/512 of a shard each, so the last placed ones level what larger units left uneven.
BUNDLES_PER_SHARD = 512
#: A group of equal texts is split only if it is above this share of one shard's capacity in bytes, words or rows.
WHOLE_UP_TO = 0.5


def pack(units: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit, a row of weights. Deterministic: larger units first, ties by position, then the lowest shard."""
    total = np.maximum(units.sum(axis=0), 1.0)
    share = units / total * shards
    left = np.ones((shards, units.shape[1]))
    out = np.zeros(len(units), dtype=np.int64)
    for i in np.lexsort((np.arange(len(units)), -share.sum(axis=1))):
        score = left @ share[i]
        # among shards that still hold the unit; if none does, the one with most room for its largest weight
        fits = (left >= share[i] - 1e-12).all(axis=1)
        at = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(left[:, 0]))
        out[i] = at
        left[at] -= share[i]
    return out


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", bundles_per_shard: int = BUNDLES_PER_SHARD, whole_up_to: float = WHOLE_UP_TO) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` of every row. The law is ``bytes``: shards' sizes are near equal, and tokens and rows with them.

    ``size`` is the UTF-8 length of the text plus one, so null and empty texts weigh one byte and the rest of a row's
    vector is its words and itself. Rows of equal texts share a shard, but for groups above ``whole_up_to`` of a shard.
    ``slot`` numbers the rows of a shard from 0 without gaps. Null ids and repeated rows are placed like others; null
    and empty texts are one group. An empty table gives no rows. Same rows, same shards.
    """
    spark, cells = docs.sparkSession, shards * bundles_per_shard
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = checkpointed(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
            (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long").alias("tokens"),
            F.xxhash64(text).alias("group"),
        )
    )
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    total = rows.agg(*sums).first()
    share = F.greatest(*(F.col(x) / F.lit(max(total[x] or 0, 1)) for x in ("b", "t", "r")))
    # at most three times `cells` groups are above one cell in one of three weights, so this table has a bound
    large = [tuple(r) for r in rows.groupBy("group").agg(*sums).where(share * cells > 1).select("group", F.ceil(share * cells).cast("int"), share * shards > whole_up_to).orderBy("group").collect()]
    begins, unit_of, at = [], {}, cells
    for group, pieces, split in large:
        begins.append((group, at, pieces))
        # the pieces of a whole group are one unit; they only bound how many rows are numbered together
        unit_of.update((at + i, at + i if split else at) for i in range(pieces))
        at += pieces
    table = spark.createDataFrame(begins, "group long, begin int, pieces int")
    piece = F.coalesce(F.col("begin") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("pieces").cast("long")).cast("int"), F.pmod(F.xxhash64("group", F.lit(2)), F.lit(cells)).cast("int"))
    placed = rows.join(F.broadcast(table), "group", "left").select("id", "size", "text_crc32", "tokens", piece.alias("piece"))
    found = sorted(tuple(r) for r in placed.groupBy("piece").agg(*sums).collect())
    units: dict[int, list[int]] = {}
    for p, b, t, r in found:
        own = units.setdefault(unit_of.get(p, p), [0, 0, 0])
        own[:] = own[0] + b, own[1] + t, own[2] + r
    where = dict(zip(units, pack(np.array(list(units.values()), dtype=float).reshape(-1, 3), shards).tolist(), strict=True))
    next_slot, plan = [0] * shards, []
    for p, _, _, r in found:
        shard = where[unit_of.get(p, p)]
        plan.append((p, shard, next_slot[shard]))
        next_slot[shard] += r
    firsts = spark.createDataFrame(plan, "piece int, shard int, first long")
    numbered = placed.withColumn("n", F.row_number().over(Window.partitionBy("piece").orderBy("id", "text_crc32", "size")))
    return numbered.join(F.broadcast(firsts), "piece").select("id", "size", "text_crc32", "shard", (F.col("first") + F.col("n") - 1).alias("slot"))
