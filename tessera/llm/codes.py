"""Product codes: every part of a vector becomes the index of its nearest codebook entry, exactly.

Components are integers, so distances and centroids have one right value. The nearest of the entries is screened by
float32 matrix products: the rounding error of such a product has a proven bound, so each distance lies in an interval,
and only entries whose interval reaches the best one's are computed again in int64. Each pass over the vectors sends
sums of integers, at most one for each component of each entry from a task, so nothing grows with the rows but the
reading.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import checkpointed, slices
from tessera.llm.vectors import matrices

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows whose distances to one codebook are held at once.
ROWS_AT_ONCE = 4096
#: Labels up to which their totals go to every executor: at some 40 bytes each, 4 MB.
LABELS_TO_SEND = 100_000
#: Relative error of one rounding to float32.
UNIT = 2.0**-24


def largest(width: int) -> int:
    """Absolute value up to which integer components keep every distance of whole vectors of ``width`` inside int64."""
    return math.isqrt(2**62 // max(width, 1)) // 2


def integers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose components are small enough, these as floor(256 * x))."""
    scaled = np.floor(values * SCALE)
    fits = (np.abs(scaled) <= largest(values.shape[1])).all(axis=1)
    return np.flatnonzero(fits), scaled[fits].astype(np.int64)


def screened(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries can be nearest to which rows.

    For p and c of w components, |c|^2 - 2 p.c ranks entries as the distance does. Rounding p and c, w products and
    w - 1 sums in any order, |c|^2 and the difference each cost a factor of 1 + UNIT at most, so the float32 value is
    off by less than (w + 8) * UNIT * (2 |p| |c| + |c|^2), with a hundredth to spare for terms of second order and for
    the doubles that the bound itself is computed in.
    """
    squares = (book * book).sum(axis=1)
    score = (squares.astype(np.float32) - 2 * (part.astype(np.float32) @ book.astype(np.float32).T)).astype(np.float64)
    norms = np.sqrt((part * part).sum(axis=1).astype(np.float64))
    off = 1.01 * (part.shape[1] + 8) * UNIT * (2 * norms[:, None] * np.sqrt(squares.astype(np.float64)) + squares)
    return score - off <= (score + off).min(axis=1)[:, None]


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the smallest of several; its squared distance) for each row of integers."""
    if not len(part):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    row, entry = np.nonzero(screened(part, book))
    distance = ((part[row] - book[entry]) ** 2).sum(axis=1)
    starts = np.searchsorted(row, np.arange(len(part)))
    least = np.minimum.reduceat(distance, starts)
    at = np.flatnonzero(distance == least[row])
    _, first = np.unique(row[at], return_index=True)
    return entry[at[first]], least


def _cut(batch: pa.RecordBatch, width: int, parts: int):
    """(rows, integer vectors as rows x parts x components) of the vectors of ``width``, some rows at a time."""
    for rows, values in matrices(batch.column(2)):
        if values.shape[1] == width:
            fits, whole = integers(values)
            for at in range(0, len(fits), ROWS_AT_ONCE):
                yield rows[fits[at : at + ROWS_AT_ONCE]], whole[at : at + ROWS_AT_ONCE].reshape(-1, parts, width // parts)


def _smallest(parts: int, entries: int):
    """Rows ``(id, width, vector)``: of each batch and width the vectors with the smallest ids."""

    def run(batches):
        for batch in batches:
            for rows, values in matrices(batch.column(2)):
                width = values.shape[1]
                fits, whole = integers(values)
                if not len(fits) or not width or width % parts:
                    continue
                ids = batch.column(0).take(pa.array(rows[fits]))
                order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
                last = ids[int(order[min(entries, len(order)) - 1])]
                near = np.arange(len(ids)) if not last.is_valid else np.flatnonzero(pc.fill_null(pc.less_equal(ids, last), False).to_numpy(zero_copy_only=False))
                found = sorted(((x is None, x, whole[i].tolist()) for i, x in zip(near, ids.take(pa.array(near)).to_pylist(), strict=True)), key=lambda x: (x[0], x[1] if not x[0] else 0, x[2]))[:entries]
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in found], ids.type), pa.array([width] * len(found), pa.int32()), pa.array([x[2] for x in found], pa.list_(pa.int64()))], ["id", "width", "vector"])

    return run


def _sums(books: np.ndarray):
    """Rows ``(cell, total)`` of a task: of each entry how many parts are nearest to it and the sums of their components."""
    parts, entries, size = books.shape

    def run(batches):
        totals = np.zeros((parts, entries, size + 1), dtype=np.int64)
        for batch in batches:
            for _, whole in _cut(batch, parts * size, parts):
                for p in range(parts):
                    to, _ = nearest(whole[:, p], books[p])
                    totals[p, :, size] += np.bincount(to, minlength=entries)
                    for k in range(size):
                        # below 2^53, so the doubles of these sums are exact
                        totals[p, :, k] += np.bincount(to, weights=whole[:, p, k], minlength=entries).astype(np.int64)
        flat = totals.ravel()
        cells = np.flatnonzero(np.repeat(totals[:, :, size].ravel() > 0, size + 1))
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(flat[cells])], ["cell", "total"])

    return run


def _codes(books: np.ndarray | None):
    """Rows ``(id, label, code, error)`` of every vector without null or non-finite components."""
    parts, _, size = books.shape if books is not None else (1, 0, 0)

    def run(batches):
        for batch in slices(batches, ROWS_AT_ONCE):
            kept = np.zeros(batch.num_rows, dtype=bool)
            codes, errors = np.full(batch.num_rows, None, dtype=object), np.full(batch.num_rows, None, dtype=object)
            for rows, _ in matrices(batch.column(2)):
                kept[rows] = True
            if books is not None:
                for rows, whole in _cut(batch, parts * size, parts):
                    found = [nearest(whole[:, p], books[p]) for p in range(parts)]
                    said = np.stack([x[0] for x in found], axis=1).astype(np.uint8).tobytes().hex()
                    codes[rows] = [said[at : at + 2 * parts] for at in range(0, len(said), 2 * parts)]
                    errors[rows] = np.sum([x[1] for x in found], axis=0)
            at = pa.array(np.flatnonzero(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(codes[kept], pa.string()), pa.array(errors[kept], pa.int64())], ["id", "label", "code", "error"])

    return run


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, component) of rows ``(id, label, vector)``; None if no vector can be cut.

    The width is that of the smallest id whose vector can be cut. What comes to the driver is ``entries`` vectors and
    their sums, whatever the rows.
    """
    id_type = vectors.schema["id"].dataType.simpleString()
    small = checkpointed(vectors.mapInArrow(_smallest(parts, entries), f"id {id_type}, width int, vector array<long>"))
    order = [F.col("id").asc_nulls_last(), "vector"]
    first = small.orderBy(*order).first()
    if first is None:
        return None
    size = first["width"] // parts
    chosen = small.where(F.col("width") == first["width"]).orderBy(*order).limit(entries).collect()
    books = np.array([r["vector"] for r in chosen], dtype=np.int64).reshape(len(chosen), parts, size).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        found = vectors.mapInArrow(_sums(books), "cell long, total long").groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        totals = {r["cell"]: int(r["total"]) for r in found.collect()}
        for p, entry in np.ndindex(books.shape[:2]):
            at = (p * books.shape[1] + entry) * (size + 1)
            if n := totals.get(at + size):
                books[p, entry] = [totals[at + k] // n for k in range(size)]
    return books


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components in order of part, entry and position, as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``(id, label, code, error, label_error, codebooks_sha256)`` for each vector without null or non-finite components.

    ``code`` has two hex digits for each part. ``label_error`` sums ``error`` over equal labels, null ones together.
    Vectors that cannot be cut into ``parts``, whose width is not that of the smallest id, or with a component above
    ``largest`` are no part of the codebooks; their rows have null code and error. Of repeated ids the smaller vector
    comes first; null ids come last; repeated rows stay, and each counts. Fewer than ``entries`` vectors give as many
    entries. Other columns are ignored. An empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vector"))
    books = train(rows, parts, entries, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = checkpointed(rows.mapInArrow(_codes(books), f"id {kinds['id']}, label {kinds['label']}, code string, error long"))
    totals = checkpointed(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "of"))
    if totals.count() <= LABELS_TO_SEND:
        joined = coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("of")))
    else:
        # the hash makes Spark shuffle for this join alone, so that it can split a label that holds much of the input
        joined = coded.withColumn("h", F.xxhash64("label")).join(totals.withColumn("g", F.xxhash64("of")), F.col("label").eqNullSafe(F.col("of")) & (F.col("h") == F.col("g")))
    return joined.select("id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
