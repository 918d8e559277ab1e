"""Posting lists of documents: built in one pass, kept in files by hash of the term, changed by segments, scored by chunks.

A chunk is a few thousand documents that one task saw together. Each chunk has a row of its documents and one for each
of its terms, with the documents' positions in the chunk and how often they have the term. Building inverts a chunk
where it is read, so no single posting is shuffled; a search moves the rows of its own terms only, to one place for
each chunk, adds up scores in arrays and keeps each query's best.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from tessera.operators.checkpoints import written

#: Documents of a chunk at most.
CHUNK = 2048
#: Different terms of queries, summed over queries, that one search pass holds on the driver and in each task.
QUERY_TERMS = 1_000_000
#: Folders that the terms of a kept index are dealt to by hash.
BUCKETS = 64
#: The folder of the chunks' own rows.
OWN = -1
#: Chunks whose marks of replaced documents are sent to all tasks, at most: 16 MB; more are joined.
MARKED = 1 << 16
#: Rows of an index that a task hands over at once.
SENT_ROWS = 1 << 14

# lower-cased text in UTF-8: all but ASCII letters and digits separate
_TO_TERMS = bytes(b if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B else 0x20 for b in range(256))


def inverted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = 0) -> DataFrame:
    """``(chunk, segment, term, at, tf, docs, length, squares)`` of all documents with any token.

    A row with a null term lists a chunk's documents, their numbers of tokens and the sums of their squared counts; the
    others have positions in that list and counts. Null texts have no tokens; of repeated rows each is a document.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.lower(F.col(text_col)).alias("text"))
    kind = rows.schema["doc"].dataType
    # a file that cannot be split is spread before it is read through; what has tasks enough is not moved
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows

    def run(batches):
        base, nth = (TaskContext.get().partitionId() << 32) + (segment << 56), 0
        for wide in batches:
            for start in range(0, wide.num_rows, CHUNK):
                batch = wide.slice(start, CHUNK)
                numbers: defaultdict = defaultdict()
                numbers.default_factory = numbers.__len__
                held, said = [], []
                for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                    if tokens := text.translate(_TO_TERMS).split() if text else None:
                        held.append(i)
                        said.append(np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
                if not held:
                    continue
                lengths = np.array([len(x) for x in said])
                pairs, tf = np.unique(np.concatenate(said, dtype=np.int64) * CHUNK + np.repeat(np.arange(len(held)), lengths), return_counts=True)
                del said
                at, n = pairs % CHUNK, len(numbers)
                starts = np.concatenate(([0, 0], np.searchsorted(pairs, np.arange(1, n + 1) * CHUNK)))
                lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.int32())) for x in (at, tf)]
                # the documents' row comes first
                once = pa.array([0] + [len(held)] * (n + 1), pa.int32())
                own = [batch.column(0).take(pa.array(held)), pa.array(lengths), pa.array(np.bincount(at, tf * tf).astype(np.int64))]
                # of the other rows these are null: an empty list takes room
                whole = [pa.ListArray.from_arrays(once, x, mask=pa.array(np.arange(n + 1) > 0)) for x in own]
                named = pa.array([None, *(t.decode() for t in numbers)], pa.string())
                found = pa.RecordBatch.from_arrays([pa.array([base + nth] * (n + 1)), pa.array([segment] * (n + 1), pa.int32()), named, *lists, *whole], ["chunk", "segment", "term", "at", "tf", "docs", "length", "squares"])
                # in parts, as the JVM holds what comes at once
                yield from (found.slice(at, SENT_ROWS) for at in range(0, n + 1, SENT_ROWS))
                nth += 1

    return rows.mapInArrow(run, f"chunk long, segment int, term string, at array<int>, tf array<int>, docs array<{kind.simpleString()}>, length array<long>, squares array<long>")


# --- A kept index


def save(index: DataFrame, folder: str, buckets: int = BUCKETS, spread: int = 1) -> None:
    """Appends the rows to ``folder``, dealt by hash of their term and sorted by it. The chunks' own rows have a folder of their own.

    ``spread`` is the number of tasks, and of files, that a folder is written by. How many terms have which document
    frequency is kept beside the postings, as no search reads all of them.
    """
    bucket = F.when(F.col("term").isNull(), OWN).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int")
    dealt = index.withColumn("bucket", bucket)
    dealt.repartition("bucket", F.pmod("chunk", F.lit(spread))).sortWithinPartitions("bucket", "term", "chunk").write.mode("append").partitionBy("bucket").parquet(f"{folder}/postings")
    _count(index.sparkSession, folder)


def _count(spark: SparkSession, folder: str) -> None:
    old = _table(spark, folder, "spread")
    version = 0 if old is None else old.agg(F.max("version")).first()[0] + 1
    spread_of(load(spark, folder, columns=("chunk", "term", "at"))).withColumn("version", F.lit(version)).coalesce(1).write.mode("append").partitionBy("version").parquet(f"{folder}/spread")


def kept_spread(spark: SparkSession, folder: str) -> DataFrame:
    """``(df, terms)`` of the whole index as it is now."""
    all_ = spark.read.parquet(f"{folder}/spread")
    return all_.where(F.col("version") == all_.agg(F.max("version")).first()[0]).select("df", "terms")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}") if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def load(spark: SparkSession, folder: str, queries: DataFrame | None = None, buckets: int = BUCKETS, columns: tuple[str, ...] = ()) -> DataFrame:
    """The kept index without documents that later segments replaced or deleted; with ``queries``, of the folders of their
    terms only, and of no other terms if anything was replaced; with ``columns``, of an index that has no others."""
    index = spark.read.parquet(f"{folder}/postings")
    dead = _table(spark, folder, "dead")
    if queries is not None:
        # as many values as there are folders, at most
        terms = query_terms(queries).select("term").distinct()
        numbers = terms.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b")).distinct()
        index = index.where(F.col("bucket").isin([OWN, *(r["b"] for r in numbers.collect())]))
        if dead is not None:
            index = index.where("term is null").unionByName(index.join(terms, "term", "left_semi"))
    index = index.drop("bucket")
    return index.select(*(columns or index.columns)) if dead is None else without(index, dead, columns)


def upsert(spark: SparkSession, folder: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> None:
    """Puts documents in the place of those with their ids, or adds them."""
    segment = (spark.read.parquet(f"{folder}/postings").agg(F.max("segment")).first()[0] or 0) + 1
    _bury(docs.select(F.col(id_col).alias("doc")), folder, segment)
    save(inverted(docs, id_col, text_col, segment), folder, buckets)


def delete(spark: SparkSession, folder: str, ids: DataFrame) -> None:
    """Takes documents (doc) out of all segments there are."""
    before = (spark.read.parquet(f"{folder}/postings").agg(F.max("segment")).first()[0] or 0) + 1
    _bury(ids, folder, before)
    _count(spark, folder)


def _bury(ids: DataFrame, folder: str, before: int) -> None:
    ids.select("doc").distinct().withColumn("before", F.lit(before)).write.mode("append").parquet(f"{folder}/dead")


def without(index: DataFrame, dead: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """``index``, or these ``columns`` of it, without the documents of ``dead`` (doc, before) in earlier segments. Their places stay, with a null id.

    A chunk's gone places are one bit each, which its rows get as a column; a posting looks up its own bit.
    """
    own = index.where("term is null")
    gone = own.select("chunk", "segment", F.posexplode("docs").alias("place", "doc")).join(dead.groupBy("doc").agg(F.max("before").alias("before")), "doc").where("segment < before")
    bit = F.col("place") + 1
    marks = written(gone.groupBy("chunk").agg(F.substring(F.bitmap_construct_agg(F.bitmap_bit_position(bit)), 1, CHUNK // 8).alias("gone")))
    rows = index.select(*(columns or index.columns))
    marked = rows.join(F.broadcast(marks) if marks.limit(MARKED + 1).count() <= MARKED else marks, "chunk", "left").select(*rows.columns, "gone")
    return marked.mapInArrow(_living, rows.schema)


def _living(batches):
    for batch in batches:
        marks = batch.column(batch.num_columns - 1)
        bits = np.frombuffer(b"".join(x or bytes(CHUNK // 8) for x in marks.to_pylist()), dtype=np.uint8).reshape(-1, CHUNK // 8)
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names[:-1])}
        sizes = columns["at"].value_lengths().fill_null(0).to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = columns["at"].flatten().to_numpy()
        stays = (bits[row, at >> 3] >> (at & 7)) & 1 == 0
        ends = np.concatenate(([0], np.cumsum(np.bincount(row[stays], minlength=len(sizes))))).astype(np.int32)
        for name, column in columns.items():
            if name in ("at", "tf"):
                columns[name] = pa.ListArray.from_arrays(pa.array(ends), column.flatten().filter(pa.array(stays)))
            elif name in ("docs", "length", "squares"):
                n = column.value_lengths().fill_null(0).to_numpy()
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                blank = (bits[np.repeat(np.arange(len(n)), n), place >> 3] >> (place & 7)) & 1 == 1
                starts = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                columns[name] = pa.ListArray.from_arrays(starts, pc.if_else(pa.array(blank), pa.scalar(None, column.type.value_type), column.flatten()))
        left = pc.or_(columns["term"].is_null(), pa.array(np.diff(ends) > 0))
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(left)


# --- Search


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, qtf)``: a word that a query repeats counts as often."""
    from tessera.functions.text import tokens

    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def totals(index: DataFrame) -> tuple[int, int]:
    """Numbers of documents and of their tokens."""
    own = index.where("term is null").select(F.explode("length").alias("n")).where("n is not null")
    row = own.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    return row["docs"], row["words"] or 0


def frequencies(index: DataFrame) -> DataFrame:
    """``(term, df)``."""
    return index.where("term is not null").groupBy("term").agg(F.sum(F.size("at")).alias("df"))


def spread_of(index: DataFrame) -> DataFrame:
    """``(df, terms)``: how many terms have which document frequency."""
    return frequencies(index).groupBy("df").agg(F.count("*").alias("terms"))


def best(index: DataFrame, weights: DataFrame, k: int, value, places: int) -> DataFrame:
    """``(query_id, doc, score)``: all that may be among the ``k`` best of each query; scores are rounded to ``places``.

    ``weights`` has ``(query_id, term, weight)``; a document scores the sum of ``weight * value(tf, length, squares)``
    over the query's terms that it has. Queries are dealt by hash into passes of ``QUERY_TERMS`` rows on average, the
    bound of what the driver and each task hold of them.
    """
    spark, out = index.sparkSession, None
    query_type, doc_type = weights.schema["query_id"].dataType, index.schema["docs"].dataType
    assert isinstance(doc_type, ArrayType)
    passes = max(1, -(-weights.count() // QUERY_TERMS))
    for p in range(passes):
        rows = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).collect()
        asked: dict = {}
        for r in rows:
            asked.setdefault(r["query_id"], []).append((r["term"], r["weight"]))
        terms = spark.createDataFrame([(t,) for t in sorted({r["term"] for r in rows})], "term string")
        wanted = index.join(F.broadcast(terms), "term", "left_semi").select("chunk", "term", "at", "tf", F.lit(None).cast(doc_type).alias("docs"), *(F.lit(None).cast("array<long>").alias(c) for c in ("length", "squares")))
        held = index.where("term is null").select("chunk", "term", "at", "tf", "docs", "length", "squares").unionByName(wanted)
        walk = held.repartition("chunk").sortWithinPartitions("chunk", F.col("term").asc_nulls_first())
        schema = f"query_id {query_type.simpleString()}, doc {doc_type.elementType.simpleString()}, score double"
        found = walk.mapInArrow(_scored(pa.array(list(asked), to_arrow_type(query_type)), list(asked.values()), k, value, places), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _chunks(batches):
    """(documents' row, terms, positions, counts) of each chunk; rows come sorted, the documents' first."""
    now, parts = None, []
    for batch in batches:
        chunk = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                if chunk[a] != now and parts:
                    yield pa.Table.from_batches(parts)
                    parts = []
                now = chunk[a]
                parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def _scored(ids: pa.Array, asked: list[list[tuple[str, float]]], k: int, value, places: int):
    def run(batches):
        for table in _chunks(batches):
            own = table.slice(0, 1).combine_chunks().to_batches()[0]
            docs = own.column(4)[0].values
            lengths, squares = (own.column(c)[0].values.to_numpy(zero_copy_only=False).astype(np.float64) for c in (5, 6))
            rest = table.slice(1).combine_chunks()
            if not rest.num_rows:
                continue
            at, tf = (rest.column(c).combine_chunks() for c in (2, 3))
            ends = np.concatenate(([0], np.cumsum(at.value_lengths().to_numpy())))
            at, tf = at.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.float64)
            worth = value(tf, lengths[at], squares[at])
            place = {t: i for i, t in enumerate(rest.column(1).to_pylist())}
            score, touched = np.zeros(len(docs)), np.zeros(len(docs), dtype=bool)
            queries, found, scores = [], [], []
            for q, terms in enumerate(asked):
                for term, weight in terms:
                    if (i := place.get(term)) is not None:
                        x = slice(ends[i], ends[i + 1])
                        score[at[x]] += weight * worth[x]
                        touched[at[x]] = True
                hits = np.flatnonzero(touched)
                if len(hits):
                    rated = np.round(score[hits], places) + 0.0
                    score[hits], touched[hits] = 0.0, False
                    if len(hits) > k:
                        # all that tie with the k-th stay: ids decide later
                        high = rated >= np.partition(rated, -k)[-k]
                        hits, rated = hits[high], rated[high]
                    queries.append(np.full(len(hits), q))
                    found.append(hits)
                    scores.append(rated)
            if queries:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(queries))), docs.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))], ["query_id", "doc", "score"])

    return run
