"""Retrieval for whole batches of queries: lexical and dense search, fusion, reranking, diversity, neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import postings
from tessera.operators.checkpoints import written

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: Components of questions that are sent to every task at most: 32 MB as doubles.
SENT_VALUES = 4_000_000
#: Rows of either side in one block of a vector search, on average.
BLOCK_ROWS = 8192
#: Scores that a task holds at once, and the rows of a block if none of its pairs is cut.
CELLS, UNCUT_ROWS = 1 << 20, 1024


def ranked(scored: DataFrame, score: str, tie: str, k: int, by: str = "query_id") -> DataFrame:
    """The ``k`` best rows of each query with ``rank`` from 1; ties by ``tie``. Spark prunes each task to ``k`` rows before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def lexical_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' posting lists, written once for all that reads them; documents without tokens are in none."""
    return written(postings.inverted(docs, id_col, text_col))


def _bm25_hits(index: DataFrame, queries: DataFrame, k: int, k1: float, b: float, epsilon: float, spread: DataFrame | None = None) -> DataFrame:
    n, words = postings.totals(index)
    wanted = postings.query_terms(queries)
    rarity = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    raw = postings.frequencies(index).select("term", rarity.alias("idf"))
    spread = postings.spread_of(index) if spread is None else spread
    mean = spread.agg((F.sum(F.col("terms") * rarity) / F.sum("terms") * epsilon).alias("floor"))
    weights = wanted.join(raw, "term").crossJoin(mean).select("query_id", "term", (F.col("qtf") * F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))).alias("weight"))
    average = words / n if n else 1.0
    return postings.best(index, weights, k, lambda tf, length, squares: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)), 4)


def _cosine_hits(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    wanted = postings.query_terms(queries)
    own = wanted.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))).alias("qnorm"))
    weights = wanted.join(own, "query_id").select("query_id", "term", (F.col("qtf") / F.col("qnorm")).alias("weight"))
    return postings.best(index, weights, k, lambda tf, length, squares: tf / np.sqrt(squares), 6)


def bm25(docs: DataFrame | None, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 30, k1: float = K1, b: float = B, epsilon: float = EPSILON, index: DataFrame | None = None, spread: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc, score, rank)`` by Okapi BM25; ``queries`` has ``query_id`` and ``text``.

    A negative inverse document frequency becomes ``epsilon`` times the mean one. A hit shares at least one word with
    the query, whatever its score; scores are rounded to four places, ties go by document id. ``index`` is the
    documents' :func:`lexical_index`, or a kept one, if there is one; if it holds some terms only, ``spread`` is that of
    all terms.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    index = lexical_index(docs, id_col, text_col) if index is None else index
    return ranked(_bm25_hits(index, queries, k, k1, b, epsilon, spread), "score", "doc", k)


def term_cosine(docs: DataFrame | None, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 30, index: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc, score, rank)`` by the cosine of term counts: a dense stand-in that needs no model."""
    index = lexical_index(docs, id_col, text_col) if index is None else index
    return ranked(_cosine_hits(index, queries, k), "score", "doc", k)


def both_lists(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, list, doc, score, rank)``: list 0 by BM25 and list 1 by the cosine, ranked together so that one shuffle serves both."""
    hits = _bm25_hits(index, queries, k, K1, B, EPSILON).withColumn("list", F.lit(0)).unionByName(_cosine_hits(index, queries, k).withColumn("list", F.lit(1)))
    order = Window.partitionBy("query_id", "list").orderBy(F.col("score").desc_nulls_last(), "doc")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "list", "doc", "score", "rank")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where their lengths differ, one is empty, or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def dense(
    vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, min_score: float = -2.0, max_score: float = 2.0, skip_self: bool = False, group_col: str | None = None, groups: str | None = None
) -> DataFrame:
    """``(query_id, id, score, rank)``: the exact ``k`` nearest by cosine of all rows, for ``queries`` of ``query_id`` and ``vector``.

    Up to ``BLOCK_ROWS`` questions of ``SENT_VALUES`` components in all are sent to the tasks that read the rows. Beyond
    that both sides are dealt into blocks of bounded size; each pair of blocks is one task, which keeps each query's best
    ``k`` of it, so nothing passes through the driver and a task holds two blocks at most. With ``groups="other"`` rows
    of the query's own group (column ``group_col`` of both sides) are left out before anything is cut, with ``"each"``
    the best ``k`` of each group are returned, with the ``group``. Null vectors are left out; vectors with values that
    are not finite score 0, those of another width than the query are none of its rows. Scores are rounded to six places
    before ranking and have to lie between the limits; ties go by id.
    """
    grouped = group_col is not None
    none = F.lit(None).cast("string")
    v = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), (F.col(group_col) if grouped else none).alias("group"))
    q = queries.where(F.col("vector").isNotNull()).select("query_id", "vector", (F.col(group_col) if groups == "other" else none).alias("group"))
    kinds = {x.name: x.dataType for x in v.schema}
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {kinds['id'].simpleString()}, score double, group {kinds['group'].simpleString()}"
    best = _best(k, min_score, max_score, skip_self, groups)
    asked_rows, widest = q.agg(F.count("*"), F.max(F.size("vector"))).first()
    if asked_rows <= BLOCK_ROWS and asked_rows * (widest or 0) <= SENT_VALUES:
        # few questions go to the rows, which then stay where they are; each batch gives its best
        sent = q.toArrow()
        near = v.mapInArrow(lambda batches: (b for batch in batches for found in best(sent, pa.Table.from_batches([batch])) for b in found.to_batches()), schema)
    else:
        size = BLOCK_ROWS if k < UNCUT_ROWS else UNCUT_ROWS
        blocks = [max(1, -(-v.count() // size)), -(-asked_rows // size)]
        deal = lambda x, name, own, other: x.select("*", F.pmod(F.xxhash64(name, "vector"), F.lit(own)).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))).alias("met"))
        rows = deal(v, "id", *blocks).withColumnsRenamed({"own": "vb", "met": "qb"})
        asked = deal(q, "query_id", *reversed(blocks)).withColumnsRenamed({"own": "qb", "met": "vb"})
        near = asked.groupBy("qb", "vb").cogroup(rows.groupBy("qb", "vb")).applyInArrow(lambda a, b: pa.concat_tables(best(a, b)), schema)
    if groups != "each":
        return ranked(near.drop("group"), "score", "id", k)
    order = Window.partitionBy("query_id", "group").orderBy(F.col("score").desc(), "id")
    return near.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by width: where they are, and their unit vectors, zeros for those without a finite length."""
    column = column.combine_chunks()
    width = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        m = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), int(w))
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        usable = np.isfinite(norm) & (norm > 0)
        out[int(w)] = at, np.divide(m, norm, out=np.zeros_like(m), where=usable)
    return out


def _best(k: int, min_score: float, max_score: float, skip_self: bool, groups: str | None):
    """A function from questions and rows to tables of what is best, each of a few questions: with a large ``k`` all pairs come."""

    def run(asked: pa.Table, rows: pa.Table) -> Iterator[pa.Table]:
        kinds = [asked.schema.field("query_id").type, rows.schema.field("id").type, pa.float64(), rows.schema.field("group").type]
        names = ["query_id", "id", "score", "group"]

        def table(q: list, v: list, s: list) -> pa.Table:
            q, v, s = (pa.array(np.concatenate([np.zeros(0, kind), *x])) for x, kind in ((q, np.int64), (v, np.int64), (s, np.float64)))
            columns = [asked.column("query_id").take(q), rows.column("id").take(v), s, rows.column("group").take(v)]
            return pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, kinds, strict=True)], names)

        yield table([], [], [])
        if not asked.num_rows or not rows.num_rows:
            return
        qid, vid = (t.column(c).to_numpy() for t, c in ((asked, "query_id"), (rows, "id")))
        qg, vg = (np.array(t.column("group").to_pylist(), dtype=object) for t in (asked, rows))
        wanted, held = _matrices(asked.column("vector")), _matrices(rows.column("vector"))
        for w in wanted.keys() & held.keys():
            (qat, qm), (vat, vm) = wanted[w], held[w]
            parts = [np.arange(len(vat))] if groups != "each" else [np.flatnonzero(vg[vat] == g) for g in dict.fromkeys(vg[vat].tolist())]
            step = max(1, min(256, CELLS // len(vat)))
            for at in range(0, len(qat), step):
                found_q, found_v, found_s = [], [], []
                own = qat[at : at + step]
                score = np.round(np.clip(qm[at : at + step] @ vm.T, -1, 1), 6) + 0.0
                ok = (score >= min_score) & (score <= max_score)
                if skip_self:
                    ok &= qid[own][:, None] != vid[vat][None, :]
                if groups == "other":
                    ok &= qg[own][:, None] != vg[vat][None, :]
                for part in parts:
                    for j in range(len(own)):
                        kept = part[ok[j, part]]
                        if len(kept) > k:
                            # all that tie with the k-th stay: ids decide later
                            kept = kept[score[j, kept] >= np.partition(score[j, kept], -k)[-k]]
                        found_q.append(np.full(len(kept), own[j]))
                        found_v.append(vat[kept])
                        found_s.append(score[j, kept])
                yield table(found_q, found_v, found_s)

    return run


def fuse(rankings: DataFrame, k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``(query_id, list, rank, doc)``, with an optional ``weight``.

    A document listed twice counts at its first rank; later ranks are not moved up. Ties go to the document that
    appears first, by list, then position.
    """
    if constant < 0:
        raise ValueError("the constant must not be negative")
    weight = F.col("weight") if "weight" in rankings.columns else F.lit(1.0)
    first = rankings.withColumn("__w", weight).groupBy("query_id", "list", "doc").agg(F.min("rank").alias("rank"), F.max("__w").alias("w"))
    scores = first.groupBy("query_id", "doc").agg(F.round(F.sum(F.col("w") / (constant + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seen.list", "seen.rank", "doc")
    out = scores.withColumn("rank", F.row_number().over(order).cast("long")).select("query_id", "doc", "score", "rank")
    return out if k is None else out.where(F.col("rank") <= k)


def rerank(hits: DataFrame, score: Column, k: int | None = None) -> DataFrame:
    """New ranks by a pair score, ties in the order before."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("__before"))
    out = hits.withColumnRenamed("rank", "__before").withColumn("score", score).withColumn("rank", F.row_number().over(order).cast("long")).drop("__before")
    return out if k is None else out.where(F.col("rank") <= k)


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has: a reranker without a model."""
    q = F.array_distinct(tokens(query))
    return F.round(F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1)), 6)


def diversify(hits: DataFrame, source: str, per_source: int, k: int) -> DataFrame:
    """``k`` hits in rank order with at most ``per_source`` of one source, filled up with the others in rank order. A blank source has no limit."""
    blank = F.coalesce(F.col(source).cast("string"), F.lit("")) == ""
    nth = F.row_number().over(Window.partitionBy("query_id", source).orderBy("rank"))
    parked = (nth > per_source) & ~blank
    flagged = hits.withColumn("__parked", parked)
    taken = flagged.withColumn("__at", F.row_number().over(Window.partitionBy("query_id").orderBy("__parked", "rank"))).where(F.col("__at") <= k)
    return taken.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")).drop("__parked", "__at")


def with_neighbours(hits: DataFrame, chunks: DataFrame, span: int = 1) -> DataFrame:
    """``(query_id, position, source, index, is_hit)``: each hit with the chunks up to ``span`` before and after it.

    New neighbours come ahead of their hit, also those that follow it in the text; a chunk appears once, a hit as a hit
    only. ``hits`` has ``query_id, rank, source, index``, ``chunks`` has ``source, index``.
    """
    offsets = F.transform(F.filter(F.sequence(F.lit(-span), F.lit(span)), lambda x: x != 0), lambda x: F.col("index") + x)
    around = hits.select("query_id", "rank", "source", F.explode(offsets).alias("index")).join(chunks, ["source", "index"])
    own = hits.select("query_id", "source", "index", "rank")
    new = around.join(own.select("query_id", "source", "index"), ["query_id", "source", "index"], "left_anti").groupBy("query_id", "source", "index").agg(F.min("rank").alias("rank"))
    both = new.withColumn("is_hit", F.lit(False)).unionByName(own.withColumn("is_hit", F.lit(True)))
    order = Window.partitionBy("query_id").orderBy("rank", "is_hit", "index")
    return both.withColumn("position", F.row_number().over(order).cast("long")).select("query_id", "position", "source", "index", "is_hit")


def compare_modes(rankings: DataFrame) -> DataFrame:
    """``(query_id, mode, doc, rank, best_elsewhere, in_all)`` of ``(query_id, mode, doc, rank)``.

    ``best_elsewhere`` is the best rank in another mode, ``in_all`` whether every mode that answered the query has it.
    """
    per_doc = Window.partitionBy("query_id", "doc")
    answering = rankings.groupBy("query_id").agg(F.count_distinct("mode").alias("modes"))
    lists = F.collect_list(F.struct("mode", "rank")).over(per_doc)
    others = F.array_min(F.transform(F.filter(lists, lambda x: x["mode"] != F.col("mode")), lambda x: x["rank"]))
    out = rankings.withColumn("best_elsewhere", others).withColumn("__n", F.size(F.array_distinct(F.transform(lists, lambda x: x["mode"]))))
    return out.join(answering, "query_id").select("query_id", "mode", "doc", "rank", "best_elsewhere", (F.col("__n") == F.col("modes")).alias("in_all"))


def route(summaries: DataFrame, queries: DataFrame, k: int, min_score: float, excluded: DataFrame | None = None) -> DataFrame:
    """Documents whose summary vectors are nearest, of ``(id, vector)``: excluded ones go first, then those below ``min_score``, then all but ``k``."""
    kept = summaries if excluded is None else summaries.join(excluded, "id", "left_anti")
    return dense(kept, queries, "id", "vector", k, min_score)
