"""Ranked lexical search: postings are traversed window by window of documents.

One pass turns each document into its counts of the terms that items ask for. Totals and document frequencies come from
these. In the second pass each task walks its documents in order of their ids, a fixed number at a time: it inverts the
window's counts to postings, adds every posting's worth to an array with one cell for each document of the window, keeps
a bitset of the cells that were touched, and harvests these into a heap for each item. Documents never move; a task
sends its best for each item.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType, StructField, StructType

from tessera.llm.runtime import checkpointed, slices

#: Documents of a window: their scores take 32 KB.
WINDOW = 4096
#: Bytes of texts of a task, about, where they are fewer documents than a window.
TASK_BYTES = 1 << 23
#: Rows of what tasks send for each partition of the result, about, unless there are fewer partitions or more cores.
RANKED_ROWS = 1 << 16
BEST = 20
#: Different terms of items, summed over items, that one pass over the documents serves. More are dealt to several passes.
ITEM_TERMS = 1_000_000
#: Rows of the table of document frequencies that are no terms: documents and all their terms.
DOCUMENTS, TERMS = -1, -2

#: In UTF-8 every byte of a character outside ASCII is above 0x7F, so bytes can be told apart without decoding: what is
#: neither letter nor digit becomes a blank, A-Z small letters.
_TO_TERMS = bytes(b + 32 if 0x41 <= b < 0x5B else b if b >= 0x80 or 0x30 <= b < 0x3A or 0x61 <= b < 0x7B else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text with repeats: runs of digits, letters and what lies outside ASCII, A-Z in small letters."""
    return text.translate(_TO_TERMS).split()


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def items_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, terms)``: counts of the terms of all different texts of an item."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).distinct()

    def run(batches):
        for batch in slices(batches):
            counts = [Counter(terms(x)) for x in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"term": t, "n": n} for t, n in x.items()] for x in counts], pa.list_(pa.struct([("term", pa.binary()), ("n", pa.int64())])))], ["item", "terms"])

    kind = rows.schema["item"].dataType.simpleString()
    each = rows.mapInArrow(run, f"item {kind}, terms array<struct<term: binary, n: bigint>>")
    return each.groupBy("item").agg(F.flatten(F.collect_list("terms")).alias("terms"))


def _gathered(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with small partitions put together, to a window of documents or ``TASK_BYTES`` of texts, about, or one for each core; and how many they are at most.

    Each partition becomes a file of a checkpoint and sends its best for every item, however few documents it has.
    """
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // WINDOW), -(-(size or 0) // TASK_BYTES))
    return rows.coalesce(parts), parts


def _forward(numbers: dict[bytes, int]):
    """Rows ``(doc, n, terms, counts)``: of each document with any term its length and its counts of the numbered terms, packed."""

    def run(batches):
        for batch in slices(batches):
            rows, sizes, found, counts = [], [], [], []
            for i, text in enumerate(_texts(batch.column(1))):
                said = terms(text) if text else []
                if said:
                    known = [(k, n) for t, n in Counter(said).items() if (k := numbers.get(t)) is not None]
                    rows.append(i)
                    sizes.append(len(said))
                    found.append(np.array([k for k, _ in known], dtype=np.int32).tobytes())
                    n = np.array([n for _, n in known], dtype=np.int64)
                    counts.append(n.astype(np.uint8 if not len(n) or n.max() < 256 else np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(counts, pa.binary())], ["doc", "n", "terms", "counts"])

    return run


def _frequencies(size: int):
    """Rows ``(term, df)`` of a task, with those of ``DOCUMENTS`` and ``TERMS``."""

    def run(batches):
        df, documents, words = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int32), minlength=size)
            documents += batch.num_rows
            words += sum(batch.column(0).to_pylist())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*held.tolist(), DOCUMENTS, TERMS], pa.int64()), pa.array([*df[held].tolist(), documents, words], pa.int64())], ["term", "df"])

    return run


class _Postings:
    """The postings of one window, by term: cells of documents and what each adds to their score."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, documents: int, words: int):
        self.rows = batch.num_rows
        found, packed = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        # in Python's integers: the product may be beyond 64 bits
        m = np.array([75 + 25 * n * documents // words for n in batch.column(1).to_pylist()], dtype=np.int64)
        held = np.frombuffer(b"".join(found), dtype=np.int32)
        cells = np.repeat(np.arange(self.rows), [len(x) // 4 for x in found])
        tf = np.concatenate([np.frombuffer(n, dtype=np.uint8 if len(n) * 4 == len(k) else np.int64).astype(np.int64) for k, n in zip(found, packed, strict=True)])
        order = np.argsort(held, kind="stable")
        self.cells = cells[order]
        tf, held = tf[order], held[order]
        self.worth = weights[held] * (1_000_000_000 * tf // (1000 * tf + 12 * m[self.cells]))
        self.starts = np.searchsorted(held, np.arange(len(weights) + 1))
        self.bits: dict[int, np.ndarray] = {}

    def touched(self, term: int) -> np.ndarray:
        """Bitset of the cells that the term's postings reach."""
        if term not in self.bits:
            flags = np.zeros(WINDOW, dtype=bool)
            flags[self.cells[self.starts[term] : self.starts[term + 1]]] = True
            self.bits[term] = np.packbits(flags)
        return self.bits[term]

    def score(self, asked: list[tuple[int, int]], array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells that any term of the item reaches, their scores); ``array`` is all zeros before and after."""
        occupied = np.zeros(WINDOW // 8, dtype=np.uint8)
        for term, n in asked:
            at = slice(self.starts[term], self.starts[term + 1])
            if at.start < at.stop:
                array[self.cells[at]] += self.worth[at] if n == 1 else n * self.worth[at]
                occupied |= self.touched(term)
        cells = np.flatnonzero(np.unpackbits(occupied))
        scores = array[cells]
        array[cells] = 0
        return cells, scores


def _search(items: pa.Array, asked: list[list[tuple[int, int]]], weights: np.ndarray, documents: int, words: int, best: int):
    """Rows ``(item, doc, score)`` of a task: for each item its best documents. Rows come in order of their ids."""

    def run(batches):
        heaps: list[list] = [[] for _ in asked]
        array, seen, kind = np.zeros(WINDOW, dtype=np.int64), 0, None
        for batch in slices(batches, WINDOW):
            kind = batch.column(0).type
            postings = _Postings(batch, weights, documents, words)
            for heap, item in zip(heaps, asked, strict=True):
                cells, scores = postings.score(item, array)
                # of equal scores the smaller id comes first, and later rows have larger ones
                better = scores > (heap[0][0] if len(heap) == best else 0)
                cells, scores = cells[better], scores[better]
                if len(cells) > best:
                    high = scores >= np.partition(scores, -best)[-best]
                    cells, scores = cells[high], scores[high]
                for cell, score in zip(cells.tolist(), scores.tolist(), strict=True):
                    entry = (score, -seen - cell, batch.column(0)[cell])
                    if len(heap) < best:
                        heapq.heappush(heap, entry)
                    elif entry[:2] > heap[0][:2]:
                        heapq.heapreplace(heap, entry)
            seen += batch.num_rows
        if kind is not None:
            flat = [(i, doc.as_py(), score) for i, heap in enumerate(heaps) for score, _, doc in heap]
            yield pa.RecordBatch.from_arrays([items.take(pa.array([x[0] for x in flat], pa.int32())), pa.array([x[1] for x in flat], kind), pa.array([x[2] for x in flat], pa.int64())], ["item", "doc", "score"])

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _best_of_block(docs: DataFrame, block: list[Row], kind: DataType, best: int) -> DataFrame | None:
    """``(item, doc, score)`` with at most ``best`` rows for each of the items from each task; None without documents."""
    numbers = {t: i for i, t in enumerate(sorted({bytes(x["term"]) for row in block for x in row["terms"]}))}
    doc_kind = docs.schema["doc"].dataType.simpleString()
    forward = checkpointed(docs.mapInArrow(_forward(numbers), f"doc {doc_kind}, n long, terms binary, counts binary"))
    counted = forward.select("n", "terms").mapInArrow(_frequencies(len(numbers)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = {r["term"]: r["df"] for r in counted.collect()}
    documents, words = df.get(DOCUMENTS, 0), df.get(TERMS, 0)
    if not documents:
        return None
    weights = np.array([weight(documents, df.get(i, 0)) for i in range(len(numbers))], dtype=np.int64)
    asked = []
    for row in block:
        counts: Counter = Counter()
        for x in row["terms"]:
            counts[numbers[bytes(x["term"])]] += x["n"]
        asked.append(sorted(counts.items()))
    items = pa.array([row["item"] for row in block], to_arrow_type(kind))
    walked = forward.sortWithinPartitions(F.col("doc").asc_nulls_last())
    return walked.mapInArrow(_search(items, asked, weights, documents, words, best), f"item {kind.simpleString()}, doc {doc_kind}, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", best: int = BEST, block_terms: int = ITEM_TERMS) -> DataFrame:
    """``(item, rank, doc, score)``: the ``best`` documents of each item with a score above 0, equal ones by id.

    N documents have a term, L terms in all; n is a document's, df the number of documents with a term, tf its count in
    one. A term weighs floor(1000 ln((2N + 2) / (2df + 1))); with m = 75 + 25nN div L a document's score is the sum of
    weight * (10^9 tf div (1000 tf + 12m)) over the item's terms, repeats too.

    Null and empty texts have no terms. A repeated document is ranked as often as it stands there; null ids come last
    among equal scores. Different texts of one item id are searched as one item, equal ones count once. Other columns
    are ignored. Without documents or items there are no rows. Items are dealt by hash into blocks of ``block_terms``
    different terms on average, the bound of what the driver and every task hold of them; each block is one pass.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    wanted = checkpointed(items_terms(items, item_col, item_text), items.count())
    kind = wanted.schema["item"].dataType
    size = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-size // block_terms))
    rows, parts = _gathered(rows) if size else (rows, 0)
    found, sent = None, 0
    for b in range(blocks):
        block = wanted.where((F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) & (F.size("terms") > 0)).collect()
        part = _best_of_block(rows, block, kind, best) if block else None
        sent += parts * len(block) * best
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], StructType([StructField("item", kind), StructField("doc", rows.schema["doc"].dataType), StructField("score", LongType())]))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item", "rank", "doc", "score")
    return ranked.coalesce(max(ranked.sparkSession.sparkContext.defaultParallelism, -(-sent // RANKED_ROWS)))
