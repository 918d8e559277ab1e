"""Near copies among vectors by a pivot-permutation index.

A vector is described by its nearest reference points. Lists are kept not of single pivots but of triples of them: two
vectors share a triple exactly if they share three pivots or more, so retrieving by triples is retrieving by the count
of shared pivots, and lists stay short. Pairs of one list are verified by cosine in blocks. Of the triples a pair
shares, the one with the smallest pivots counts the pair, so links are summed up without a list of pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.runtime import checkpointed, slices
from tessera.llm.vectors import matrices

COSINE = 0.98
#: Reference points, those that describe a vector, those that linked vectors have to share.
PIVOTS, NEAREST, SHARED = 512, 6, 3
#: Distinct vectors, those with the smallest digests, among which pivots are chosen: each next one is the farthest from
#: all before, so that a crowd of near copies gives one pivot. None is closer to another than this cosine.
SAMPLE, SPREAD = 4096, 0.92
#: Rows of a list that are compared with each other at once; longer lists are split into pairs of such blocks.
BLOCK = 2048
#: Lists up to this length are compared many at a time.
SHORT = 24
NONE = np.uint16(65535)


def _described():
    """Rows ``(id, list, vector, node)``: ``node`` is a digest of label and vector, null for what links with nothing."""

    def run(batches):
        for batch in slices(batches, 4096):
            nodes = np.full(batch.num_rows, None, dtype=object)
            labels = batch.column(1).to_pylist()
            for rows, values in matrices(batch.column(2)):
                for i, vector, full in zip(rows, values + 0.0, values.any(axis=1), strict=True):
                    if full and labels[i] is not None:
                        nodes[i] = xxhash.xxh128_digest(vector.tobytes(), labels[i] & (2**64 - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], ["id", "list", "vector", "node"])

    return run


def _unit(values: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay in range
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def spread(values: np.ndarray, most: int = PIVOTS, limit: float = SPREAD) -> np.ndarray:
    """The first of the unit vectors, then always the one farthest from all chosen, while it is farther than ``limit``."""
    chosen, closest = [0], values @ values[0]
    while len(chosen) < most and closest.min() < limit:
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, values @ values[chosen[-1]])
    return values[chosen]


def nearest_pivots(values: np.ndarray, pivots: np.ndarray, n: int = NEAREST) -> np.ndarray:
    """Indexes of the ``n`` pivots nearest to each unit vector, ascending; places that no pivot fills have 65535."""
    out = np.full((len(values), n), NONE)
    k = min(n, len(pivots))
    if k:
        near = -(values @ pivots.T)
        out[:, :k] = np.sort(np.argpartition(near, k - 1, axis=1)[:, :k] if k < len(pivots) else np.argsort(near, axis=1), axis=1)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _triples(n: int, shared: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), shared)), dtype=np.int64)


def _keys(pivots: dict[int, np.ndarray], nearest: int, shared: int):
    """Rows ``(node, near, keys)``: the pivots of a vector and the lists it stands in, with the position of each triple."""
    triples = _triples(nearest, shared)

    def run(batches):
        for batch in slices(batches, 4096):
            near = np.full((batch.num_rows, nearest), NONE)
            for rows, values in matrices(batch.column(2)):
                near[rows] = nearest_pivots(_unit(values), pivots.get(values.shape[1], values[:0]), nearest)
            lists = batch.column(1).to_numpy().astype(np.uint64)
            keys = np.repeat(lists[:, None], len(triples), axis=1)
            for k in range(shared):
                keys = _mixed(keys + near[:, triples[:, k]].astype(np.uint64))
            # vectors with fewer pivots than have to be shared have one list for each label
            n = np.where((near != NONE).sum(axis=1) >= shared, len(triples), 1)
            keys[n == 1, 0] = lists[n == 1]
            # triples that reach into unfilled places are none
            stands = np.where((n == 1)[:, None], np.arange(len(triples)) == 0, (near != NONE)[:, triples[:, -1]])
            row, nth = np.nonzero(stands)
            offsets = np.concatenate(([0], np.cumsum(stands.sum(axis=1))))
            found = pa.StructArray.from_arrays([pa.array(nth.astype(np.int32)), pa.array(keys[row, nth].view(np.int64))], ["nth", "key"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in near], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)], ["node", "near", "keys"])

    return run


class _Rows:
    """Whole lists, as arrays: sorted so that the rows of one list stand together."""

    def __init__(self, table: pa.Table, rows: np.ndarray, values: np.ndarray, nearest: int, shared: int):
        column = lambda name: table.column(name).take(pa.array(rows)).combine_chunks()
        near = np.frombuffer(b"".join(column("near").to_pylist()), dtype=np.uint16).reshape(len(rows), nearest)
        triples = _triples(nearest, shared)
        at = column("nth").to_numpy()
        # vectors with fewer pivots have one list, of none
        named = (near != NONE).sum(axis=1) >= shared
        triple = np.where(named[:, None], np.take_along_axis(near, triples[at], axis=1), NONE)
        bucket, of = column("bucket").to_numpy(), column("list").to_numpy()
        # pivots before the triple's last that are none of it: a pair that shares one is counted in another list
        spare = (near < triple[:, -1:]) & ~(near[:, :, None] == triple[:, None, :]).any(axis=2) & named[:, None]
        extra = np.sort(np.where(spare, near, NONE), axis=1)
        order = np.lexsort((*extra.T[::-1], *triple.T[::-1], of, bucket))
        same = np.ones(max(0, len(rows) - 1), dtype=bool)
        for x in (bucket, of, *triple.T):
            same &= x[order][1:] == x[order][:-1]
        self.starts = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(rows)])) if len(rows) else np.zeros(1, dtype=np.int64)
        self.extra = extra[order][:, : nearest - shared]
        self.unit = _unit(values[order])
        self.probe, self.alone = (column(x).to_numpy(zero_copy_only=False)[order] for x in ("probe", "alone"))
        self.copies = column("n").to_numpy()[order]
        self.nodes = column("node").take(pa.array(order))
        self.links = np.zeros(len(rows), dtype=np.int64)
        self.root = np.arange(len(rows))

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Counts those of the linked pairs that belong to this list and connects them."""
        here = self.alone[a] | (self.probe[a] != self.probe[b])
        for i, j in np.ndindex(self.extra.shape[1], self.extra.shape[1]):
            here &= (self.extra[a, i] != self.extra[b, j]) | (self.extra[a, i] == NONE)
        a, b = a[here], b[here]
        np.add.at(self.links, a, self.copies[b])
        np.add.at(self.links, b, self.copies[a])
        while True:
            x, y = self.root[a], self.root[b]
            if (x == y).all():
                return
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def compare(self, cosine: float) -> None:
        sizes = np.diff(self.starts)
        # short lists: every row with those after it in its list
        short = np.repeat(sizes <= SHORT, sizes)
        ends = np.repeat(self.starts[1:], sizes)
        rows = np.flatnonzero(short)
        for at in range(0, len(rows), 16_384):
            first = rows[at : at + 16_384]
            n = ends[first] - first - 1
            a = np.repeat(first, n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            near = np.einsum("ij,ij->i", self.unit[a], self.unit[b]) >= cosine
            self.link(a[near], b[near])
        for start, end in zip(self.starts[:-1][sizes > SHORT], self.starts[1:][sizes > SHORT], strict=True):
            for i in range(start, end, 512):
                for j in range(i, end, 512):
                    x, y = slice(i, min(i + 512, end)), slice(j, min(j + 512, end))
                    # all rows of both have this pivot before the triple: none of their pairs belongs here
                    if self.extra.shape[1] and (first := self.extra[i, 0]) != NONE and (self.extra[x] == first).any(axis=1).all() and (self.extra[y] == first).any(axis=1).all():
                        continue
                    a, b = np.nonzero(self.unit[x] @ self.unit[y].T >= cosine)
                    keep = a + i < b + j
                    self.link(a[keep] + i, b[keep] + j)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by bucket, in tables that end where a bucket does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        cut = len(bucket) and int(np.searchsorted(bucket, bucket[-1]))
        if held and len(bucket) and held[0].column("bucket")[0].as_py() != bucket[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        if len(bucket):
            held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _compare(cosine: float, nearest: int, shared: int):
    """Rows ``(a, b, links)``: to how many vectors ``a`` links here, or that ``a`` and ``b`` are connected."""

    def run(batches):
        for table in _whole(batches):
            for rows, values in matrices(table.column("vector").combine_chunks()):
                lists = _Rows(table, rows, values, nearest, shared)
                lists.compare(cosine)
                linked, tied = np.flatnonzero(lists.links), np.flatnonzero(lists.root != np.arange(len(rows)))
                if len(linked):
                    a = pa.concat_arrays([lists.nodes.take(pa.array(linked)), lists.nodes.take(pa.array(tied))])
                    b = pa.concat_arrays([pa.nulls(len(linked), pa.binary()), lists.nodes.take(pa.array(lists.root[tied]))])
                    links = pa.concat_arrays([pa.array(lists.links[linked]), pa.nulls(len(tied), pa.int64())])
                    yield pa.RecordBatch.from_arrays([a, b, links], ["a", "b", "links"])

    return run


def links(reps: DataFrame, cosine: float = COSINE, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """``(a, b, links)`` as ``_compare`` gives them for distinct ``reps`` (node, list, n, vector)."""
    sample: dict[int, list] = {}
    for row in reps.select("node", "vector").orderBy("node").limit(SAMPLE).collect():
        sample.setdefault(len(row["vector"]), []).append(row["vector"])
    # each width has its share of the pivots; one that the sample lacks has one list for each label
    chosen = {width: spread(_unit(np.array(x, dtype=np.float64)), max(nearest, pivots * len(x) // sum(map(len, sample.values())))) for width, x in sample.items()}
    keyed = checkpointed(reps.select("node", "list", "vector").mapInArrow(_keys(chosen, nearest, shared), "node binary, near binary, keys array<struct<nth: int, key: long>>"))
    keys = keyed.select("node", "near", F.inline("keys"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # the hash makes Spark shuffle for this join alone, so that it can split a long list
    h = F.xxhash64("key").alias("h")
    common = keys.select("*", h).join(sizes.select("key", h, F.ceil(F.col("n") / block).alias("blocks")), ["key", "h"])
    placed = common.select("node", "near", "nth", "key", F.pmod(F.xxhash64("node"), "blocks").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("met"))
    bucket = F.xxhash64("key", F.least("own", "met"), F.greatest("own", "met")).alias("bucket")
    rows = placed.select(bucket, (F.col("met") < F.col("own")).alias("probe"), (F.col("met") == F.col("own")).alias("alone"), "nth", "near", "node").join(reps, "node")
    rows = rows.select("bucket", "probe", "alone", "nth", "near", "node", "list", "n", "vector")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compare(cosine, nearest, shared), "a binary, b binary, links long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """``(id, n_links, component_id)`` for every row; vectors of one label link at a cosine of ``COSINE`` or more.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id reachable by links. No link
    is below the threshold. The index retrieves nearly all that are above: pairs of which fewer than ``SHARED`` pivots
    agree are not seen. Equal vectors of one label are one until the end, whatever their number. Rows with a null label
    and vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors of
    different widths. Repeated rows link with each other. A null id never names a component unless all its ids are
    null. Other columns are ignored. An empty table gives no rows.
    """
    id_type, kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, vec_col))
    label = F.when(F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col), F.size(vec_col)))
    described = vectors.select(F.col(id_col).alias("id"), label.alias("list"), F.col(vec_col).alias("vector")).mapInArrow(_described(), f"id {id_type}, list long, vector {kind}, node binary")
    placed = checkpointed(described.select("id", "node"))
    reps = checkpointed(described.where("node is not null").groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("list").alias("list"), F.first("vector").alias("vector")))
    found = checkpointed(links(reps.select("node", "list", "n", "vector"), **options))
    counted = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("links is null"), "a", "b")
    classes = reps.select("node", "low", "n").join(counted, "node", "left").join(parts, "node", "left").withColumn("class", F.coalesce("component", "node"))
    least = classes.groupBy("class").agg(F.min("low").alias("component_id"))
    h = F.xxhash64("class").alias("h")
    named = classes.select("*", h).join(least.select("*", h), ["class", "h"]).select("node", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = placed.where("node is not null").join(named, "node").select("id", "n_links", "component_id")
    return linked.unionByName(placed.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
