"""SimHash near-duplicate detection by anchor-point covering.

Fingerprints are split into parts of at most 23 bits. The anchors of a part are
the 4,096 words of the binary Golay code: every 23-bit value lies within the
covering radius 3 of exactly one of them, its home. If two values differ by at
most ``t`` bits, the second lies within ``3 + t`` of the first one's home, so
replicating each value to all anchors within that distance makes every such
pair meet, at the home of either. With ``p`` parts and a limit of ``d`` bits
over all of them, some part differs by at most ``d // p`` bits.

Near copies at a similarity of 0.8 differ in about 15 of 100 bits, for which
anchors would need some 160 replicas of each fingerprint. There, minima of
hashed shingles, in bands, say which texts meet, and the distance of their
SimHash fingerprints alone decides.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.runtime import checkpointed, slices

SEED = 42
WIDTH, RADIUS = 23, 3
#: Generator polynomial of the [23, 12] Golay code.
GENERATOR = 0b110001110101
#: Homes compared in one task at once; a fuller anchor is split into blocks of this size, compared block by block.
BLOCK = 4096
SHINGLES_AT_ONCE = 1 << 12
CELLS = 1 << 21


@dataclass(frozen=True)
class Sketch:
    """``words`` 64-bit SimHash words over ``shingle``-word shingles, each counted once if ``distinct``."""

    shingle: int
    words: int = 1
    distinct: bool = False


@dataclass(frozen=True)
class Plan:
    """What is fingerprinted and when two fingerprints link.

    The first ``key_bits`` bits are cut into parts of up to 23 bits, which must
    differ by at most ``part_limit`` bits in one part to be compared. They link
    if the key differs by at most ``key_limit`` bits and the words after the
    key's by at most ``check_limit``. ``spare`` words after all these only tell
    values apart.
    """

    sketches: tuple[Sketch, ...]
    key_bits: int
    part_limit: int
    key_limit: int
    check_limit: int = 0
    spare: int = 0

    @property
    def key_words(self) -> int:
        return -(-self.key_bits // 64)

    @property
    def words(self) -> int:
        return sum(s.words for s in self.sketches) + self.spare


#: Four-word shingles, 64 bits, links at 4 or fewer: three parts, one of which differs by at most one bit.
EXACT = Plan((Sketch(4),), key_bits=64, part_limit=1, key_limit=4)

#: For removing near copies: texts are near copies if their sets of distinct five-word shingles have about this Jaccard similarity, or more.
ALIKE, SHINGLE = 0.8, 5
#: Minima in each of so many bands. Two texts meet if all minima of one band are equal: a pair at 0.8 misses all bands
#: in one of 4,600 cases, wherever its edits are.
BANDS, MINIMA = 16, 4
MULTIPLIERS = np.random.default_rng(SEED).integers(1 << 63, size=(BANDS * MINIMA, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: 1,024 SimHash bits over the distinct shingles. Sets at 0.8 differ in 155 bits on average, with a standard deviation of
#: 11.5; the limit leaves one such pair in 13 apart and links one at 0.7 (196 bits) in 40, and one at 0.6 practically never.
NEAR_COPIES = Plan((Sketch(SHINGLE, 16, True),), key_bits=1024, part_limit=0, key_limit=171, spare=2)


def _mixed(h: np.ndarray, j: np.ndarray | int) -> np.ndarray:
    """The j-th 64-bit value derived from each hash; the hash itself for j = 0."""
    j = np.atleast_1d(np.asarray(j, dtype=np.uint64))
    x = (h ^ j * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.where(j == 0, h, x ^ (x >> np.uint64(31)))


def _majority(parts: Iterator[np.ndarray], words: int) -> list[int]:
    """Bits set in over half of the hashes, which come in arrays, as ``words`` integers; zeros if there are none."""
    total, n = np.zeros(64 * words, dtype=np.int64), 0
    for part in parts:
        n += len(part)
        bits = np.unpackbits(_mixed(part[:, None], np.arange(words)).astype(">u8").view(np.uint8), axis=1)
        # up to 255 ones fit into a byte
        even = len(bits) // 255 * 255
        total += bits[:even].reshape(-1, 255, 64 * words).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[even:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > n).view(">u8").tolist()


def _in_arrays(hashes: Iterator[int], at_once: int = SHINGLES_AT_ONCE) -> Iterator[np.ndarray]:
    while len(part := np.fromiter(itertools.islice(hashes, at_once), dtype=np.uint64)):
        yield part


def fingerprint(text: str | None, plan: Plan = EXACT) -> bytes:
    """Big-endian words of the sketches of one text. Null and blank texts: all zero."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return bytes(8 * plan.words)
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    out, hashed = [], xxhash.xxh64_intdigest
    for sketch in plan.sketches:
        k = min(sketch.shingle, len(split))
        pieces = (joined[a:b] for a, b in zip(starts[: len(split) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
        if sketch.distinct:
            pieces = set(pieces)
        out += _majority(_in_arrays(hashed(x, SEED) for x in pieces), sketch.words)
    return b"".join(w.to_bytes(8, "big") for w in out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = EXACT) -> DataFrame:
    """``(id, fp)`` for every row, repeated rows included; null and blank texts have the zero fingerprint."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches):
            fps = [fingerprint(t, plan) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp binary")


@lru_cache(None)
def _coset_tables(limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of low and high halves; per syndrome, where its error patterns of weight ``limit`` or less start; the patterns, lightest first."""

    def syndrome(v: int) -> int:
        for bit in range(WIDTH - 1, WIDTH - 13, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    unit = [syndrome(1 << b) for b in range(WIDTH)]
    low, high = (np.zeros(1 << 12, dtype=np.int32) for _ in range(2))
    for table, base in ((low, 0), (high, 12)):
        for b in range(12):
            if base + b < WIDTH:
                table[np.arange(1 << 12) >> b & 1 == 1] ^= unit[base + b]
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(limit + 1):
        for bits in itertools.combinations(range(WIDTH), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            found[s].append(sum(1 << b for b in bits))
    begins = np.concatenate(([0], np.cumsum([len(x) for x in found])))
    return low, high, begins, np.array([p for x in found for p in x], dtype=np.int64)


def anchors(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All anchors within ``limit`` bits of each 23-bit value: (index of the value, anchor, whether it is the home)."""
    low, high, begins, patterns = _coset_tables(limit)
    s = low[values & 0xFFF] ^ high[values >> 12]
    n = begins[s + 1] - begins[s]
    of = np.repeat(np.arange(len(values)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return of, (values[of] ^ patterns[begins[s][of] + nth]) >> 11, nth == 0


def _parts(words: np.ndarray, key_bits: int) -> list[np.ndarray]:
    """The key's parts of up to 23 bits, each as one array over the rows of ``words``."""
    bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1)[:, :key_bits]
    weights = 1 << np.arange(WIDTH, dtype=np.int64)
    return [(x := bits[:, at : at + WIDTH].astype(np.int64)) @ weights[: x.shape[1]] for at in range(0, key_bits, WIDTH)]


def _words(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, n)


def _replicate(plan: Plan, blocks: dict[int, tuple[int, int]]):
    """Rows ``(bucket, probe, fp)``: at its home a fingerprint is one of those compared with, elsewhere it probes.

    ``blocks`` says of full anchors into how many blocks their homes and their probes are split. Each pair of blocks
    that can hold a link is a bucket of its own, so no bucket is larger than two blocks.
    """

    def run(batches):
        for batch in slices(batches, 8192):
            fps = batch.column(0)
            words = _words(fps, plan.words)
            salt = _mixed(words[:, 0] ^ words[:, -1], 7)
            index, bucket, probe = [], [], []
            for p, values in enumerate(_parts(words, plan.key_bits)):
                of, anchor, home = anchors(values, RADIUS + plan.part_limit)
                split = np.array([blocks.get(x, (0, 0)) for x in range(p * 4096, p * 4096 + 4096)], dtype=np.int64)[anchor]
                homes, probes = split[:, 0], split[:, 1]
                n = np.maximum(np.where(home, homes, probes), 1)
                own = (salt[of] % n.astype(np.uint64)).astype(np.int64) + np.where(home, 0, homes)
                copies = np.maximum(np.where(home, homes + probes, homes), 1)
                row = np.repeat(np.arange(len(of)), copies)
                met = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                low, high = np.minimum(met, own[row]), np.maximum(met, own[row])
                index.append(of[row])
                bucket.append(((p * 4096 + anchor[row]) << 40) + (low << 20) + high)
                probe.append(np.where(homes[row] > 0, met < own[row], ~home[row]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bucket)), pa.array(np.concatenate(probe)), fps.take(pa.array(np.concatenate(index)))], ["bucket", "probe", "fp"])

    return run


def _filling(plan: Plan):
    """Rows ``(at, homes, probes)``: how many fingerprints come to each anchor of each part."""

    def run(batches):
        for batch in slices(batches, 8192):
            for p, values in enumerate(_parts(_words(batch.column(0), plan.words), plan.key_bits)):
                of, anchor, home = anchors(values, RADIUS + plan.part_limit)
                homes, probes = (np.bincount(anchor[x], minlength=4096) for x in (home, ~home))
                at = np.flatnonzero(homes + probes)
                yield pa.RecordBatch.from_arrays([pa.array(p * 4096 + at), pa.array(homes[at]), pa.array(probes[at])], ["at", "homes", "probes"])

    return run


class _Anchor:
    """The homes of one bucket and which of them are already connected."""

    def __init__(self, plan: Plan):
        self.plan, self.fps = plan, []
        self.words = np.zeros((0, plan.words), dtype=np.uint64)
        self.root = np.zeros(0, dtype=np.int64)

    def near(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(row of ``words``, the homes it links to), for rows that link to any."""
        plan, k = self.plan, self.plan.key_words
        tail = np.uint64((1 << (64 * k - plan.key_bits)) - 1)
        step = max(1, CELLS // max(1, len(self.words)))
        for at in range(0, len(words), step):
            part = words[at : at + step]
            d = np.zeros((len(part), len(self.words)), dtype=np.uint8 if plan.key_bits < 256 else np.uint16)
            for j in range(k):
                x = part[:, j, None] ^ self.words[None, :, j]
                d += np.bitwise_count(x & ~tail if j == k - 1 else x)
            a, b = np.nonzero(d <= plan.key_limit)
            if len(a) and plan.words - plan.spare > k:
                ok = sum(np.bitwise_count(part[a, j] ^ self.words[b, j]).astype(np.int64) for j in range(k, plan.words - plan.spare)) <= plan.check_limit
                a, b = a[ok], b[ok]
            cut = np.flatnonzero(np.diff(a)) + 1
            for rows, homes in zip(np.split(a, cut), np.split(b, cut), strict=True):
                if len(rows):
                    yield at + int(rows[0]), homes

    def link(self, homes: np.ndarray) -> np.ndarray:
        """One home of each component among ``homes``, which are connected from now on."""
        roots = self.root[homes]
        if roots.min() == roots.max():
            return homes[:1]
        roots, first = np.unique(roots, return_index=True)
        self.root[np.isin(self.root, roots[1:])] = roots[0]
        return homes[first]


def _compare(plan: Plan):
    """Edges that connect what links within each bucket: a spanning forest, never all pairs.

    Rows come sorted by bucket, homes first, so memory holds one block of homes and one batch of probes.
    """

    def run(batches):
        now, at = None, None
        for batch in batches:
            bucket, probe = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            words = _words(batch.column(2), plan.words)
            cut = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(probe.astype(np.int8)) != 0)) + 1
            edges: list[tuple[bytes, bytes]] = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True):
                if bucket[a] != at:
                    now, at = _Anchor(plan), bucket[a]
                own = words[a:b]
                if not probe[a]:
                    n = len(now.words)
                    now.words = np.concatenate((now.words, own))
                    now.root = np.concatenate((now.root, np.arange(n, n + len(own))))
                    for row, homes in now.near(own):
                        homes = homes[homes < n + row]
                        if len(homes):
                            for x in now.link(homes):
                                edges.append((own[row], now.words[x]))
                            # the row has been compared with none before, so it was alone
                            now.root[n + row] = now.root[homes[0]]
                elif len(now.words):
                    for row, homes in now.near(own):
                        for x in now.link(homes):
                            edges.append((own[row], now.words[x]))
            if edges:
                flat = np.array(edges, dtype=np.uint64).astype(">u8")
                out = [pa.array([x.tobytes() for x in flat[:, i]], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(out, ["a", "b"])

    return run


def links(fps: DataFrame, plan: Plan = EXACT, block: int = BLOCK) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that connect exactly what ``plan`` links.

    ``fps`` has distinct values in column ``fp``. The table of full anchors has at most 4,096 rows a part, however
    large the input, and goes to the driver; it says into how many blocks their homes and probes are split.
    """
    counts = fps.select("fp").mapInArrow(_filling(plan), "at long, homes long, probes long").groupBy("at").agg(F.sum("homes").alias("homes"), F.sum("probes").alias("probes"))
    full = counts.where((F.col("homes") > block) | (F.col("probes") > 4 * block)).collect()
    blocks = {r["at"]: (max(1, -(-r["homes"] // block)), max(1, -(-r["probes"] // (4 * block)))) for r in full}
    rows = fps.select("fp").mapInArrow(_replicate(plan, blocks), "bucket long, probe boolean, fp binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "probe").mapInArrow(_compare(plan), "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = EXACT) -> DataFrame:
    """``(id, fp, component_id)`` for every row; ``component_id`` is the smallest id whose fingerprint is reachable.

    Equal texts share a fingerprint and are collapsed before anything is compared. Null texts count as blank, and
    blank texts have the zero fingerprint, linked like any other. A null id never names a component unless all its
    ids are null. Repeated rows stay; other columns are ignored. An empty table gives no rows.
    """
    docs_fp = checkpointed(fingerprints(docs, id_col, text_col, plan))
    reps = checkpointed(docs_fp.groupBy("fp").agg(F.min("id").alias("low")))
    return _named(docs_fp, reps, links(reps, plan))


def _named(docs_fp: DataFrame, reps: DataFrame, edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``docs_fp`` with ``component_id``, the smallest id of each component of fingerprints."""
    found = connected_components(edges, "a", "b", rows).withColumnRenamed("node", "fp")
    classes = reps.select("fp", "low").join(found, "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    least = classes.groupBy("class").agg(F.min("low").alias("component_id"))
    # the hash makes Spark shuffle for this join alone, so that it can split a class that holds much of the input
    h = F.xxhash64("class").alias("h")
    named = classes.select("*", h).join(least.select("*", h), ["class", "h"]).select("fp", "component_id")
    return docs_fp.join(named, "fp").select(*docs_fp.columns, "component_id")


# --- Near copies


def shingles(text: str | None) -> set[bytes]:
    """Distinct five-word shingles in small letters; the whole of a shorter text, nothing of a blank one."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = min(SHINGLE, len(split))
    return {b" ".join(split[i : i + k]) for i in range(len(split) - k + 1)} if split else set()


def sketch(text: str | None) -> tuple[bytes, list[int]]:
    """A text's fingerprint by ``NEAR_COPIES``, a digest of all this as its last 16 bytes, and its bands; none for blank texts."""
    found = shingles(text)
    if not found:
        return bytes(8 * NEAR_COPIES.words), []
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in found), dtype=np.uint64, count=len(found))
    minima = np.full(BANDS * MINIMA, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        minima = np.minimum(minima, (hashes[at : at + SHINGLES_AT_ONCE] * MULTIPLIERS).min(axis=1))
    bands = [xxhash.xxh64_intdigest(x.tobytes(), i) - 2**63 for i, x in enumerate(minima.reshape(BANDS, MINIMA))]
    words = _majority((hashes[at : at + SHINGLES_AT_ONCE] for at in range(0, len(hashes), SHINGLES_AT_ONCE)), NEAR_COPIES.words - NEAR_COPIES.spare)
    said = b"".join(w.to_bytes(8, "big") for w in words)
    return said + xxhash.xxh128_digest(said + np.array(bands, dtype=np.int64).tobytes(), SEED), bands


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_hash, fp, sketch, bands)``: ``fp`` is the digest in the sketch, so texts with equal ones have sketch and bands in common."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches):
            out = [sketch(t) for t in batch.column(2).to_pylist()]
            columns = [pa.array([x[0][-16:] for x in out], pa.binary()), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "text_hash", "fp", "sketch", "bands"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_hash long, fp binary, sketch binary, bands array<long>")


def copy_links(reps: DataFrame, plan: Plan = NEAR_COPIES, block: int = BLOCK) -> DataFrame:
    """Edges ``(a, b)`` that connect all of ``reps`` that share a band and that ``plan`` links.

    ``reps`` has distinct ``fp`` with ``sketch`` and ``bands``. Each bucket gives a spanning forest, not its pairs. Bands
    that one row alone has are left out before sketches are shuffled. Full buckets are split into blocks, and each pair
    of blocks is a bucket of its own.
    """
    keys = reps.select(F.explode("bands").alias("band"), "fp")
    sizes = keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    h = F.xxhash64("band").alias("h")
    shared = keys.select("*", h).join(sizes.select("*", h), ["band", "h"]).select("band", "fp", F.ceil(F.col("n") / block).alias("blocks"))
    placed = shared.select("band", "fp", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("own")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("met"))
    bucket = F.xxhash64("band", F.least("own", "met"), F.greatest("own", "met")).alias("bucket")
    rows = placed.select(bucket, (F.col("met") < F.col("own")).alias("probe"), "fp").join(reps.select("fp", "sketch"), "fp").select("bucket", "probe", "sketch")
    edges = rows.repartition("bucket").sortWithinPartitions("bucket", "probe", "sketch").mapInArrow(_compare(plan), "a binary, b binary")
    return edges.select(*(F.substring(x, -16, 16).alias(x) for x in ("a", "b")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_hash, fp, component_id)`` for every row: as ``near_duplicates``, for texts whose five-word shingles are alike.

    Texts link if they share a band of minima and their sketches differ by at most ``NEAR_COPIES.key_limit`` bits. All
    blank texts, null ones too, are one component.
    """
    return _near_copies(docs, id_col, text_col)[0]


def _near_copies(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``near_copies``, and how many rows it has."""
    sketched = checkpointed(_sketches(docs, id_col, text_col))
    n = sketched.count()
    reps = checkpointed(sketched.groupBy("fp").agg(F.min("id").alias("low"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), n)
    return _named(sketched.select("id", "text_hash", "fp"), reps, copy_links(reps), n), n


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are first of their group of near copies, one for each group.

    The smallest id is first; of several texts with that id, the one with the smallest hash; of repeated rows, any, as
    they have the same id and text. Two texts that share an id but are no copies both stay. Rows with a null id stay:
    nothing says which of them is first.
    """
    named, n = _near_copies(docs, id_col, text_col)
    found = checkpointed(named.where("id is not null").groupBy("component_id", "id", "text_hash").agg(F.count("*").alias("n")), n)
    first = found.groupBy("component_id").agg(F.min(F.struct("id", "text_hash")).alias("first"))
    h = F.xxhash64("component_id").alias("h")
    ranked = found.select("*", h).join(first.select("*", h), ["component_id", "h"])
    goes = (F.col("id") > F.col("first.id")) | (F.col("text_hash") != F.col("first.text_hash"))
    # what is first but repeated goes too, and comes back once
    gone = ranked.where(goes | (F.col("n") > 1)).select(F.col("id").alias("key"), "text_hash")
    twice = checkpointed(ranked.where(~goes & (F.col("n") > 1)).select(F.col("id").alias("key"), "text_hash"), n)
    # the rows go along as one column, so that their names clash with none here
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    kept = rows.join(gone, ["key", "text_hash"], "left_anti").select("row.*")
    if twice.isEmpty():
        return kept
    return kept.unionByName(rows.join(twice, ["key", "text_hash"], "left_semi").dropDuplicates(["key", "text_hash"]).select("row.*"))
