"""Product codes, near vectors and ranked search against plain walks, with nulls, ties, repeats, odd widths and clashing columns."""

import hashlib
import math
import pathlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import codes, lexical, pivots, runtime

VECTORS = "vec_id long, embedding array<float>, label int, node string, id string, `list` string, vector string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", "z", "w") for i, v, label in rows], VECTORS)


# --- Product codes


def plain_codes(rows, parts, entries, rounds):
    """By plain integers, one vector at a time."""
    usable = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v: [tuple(math.floor(256 * x) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]) for p in range(parts)]
    whole = [(i, cut(v), label) for i, v, label in sorted(usable, key=lambda r: r[0])]
    books = [[v[p] for _, v, _ in whole[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min((far(part, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in whole:
                members[near(v[p], books[p])[1]].append(v[p])
            books[p] = [tuple(sum(x) // len(members[e]) for x in zip(*members[e], strict=True)) if members[e] else c for e, c in enumerate(books[p])]
    found, by = [], defaultdict(int)
    for i, v, label in whole:
        best = [near(v[p], books[p]) for p in range(parts)]
        by[label] += sum(d for d, _ in best)
        found.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    said = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted((i, label, code, error, by[label], said) for i, label, code, error in found)


def some_vectors(seed, n, width=32):
    r = random.Random(seed)
    crowd = [r.gauss(0, 0.2) for _ in range(width)]
    out = []
    for i in range(n):
        v = [float(np.float32(r.gauss(0, 0.3))) for _ in range(width)] if i % 3 else [float(np.float32(x + r.gauss(0, 0.01))) for x in crowd]
        out.append((i * 7 % 1009, v, r.choice([1, 2, 2, 2, None])))
    return out


def test_codes_are_those_of_plain_integers(spark):
    rows = some_vectors(1, 300)
    rows += [(2000, None, 1), (2001, [math.nan] * 32, 1), (2002, [None] + [0.5] * 31, 1), (2003, [math.inf] + [0.5] * 31, 2), (2004, [0.0] * 32, None), (2005, rows[5][1], 1)]
    for parts, entries in ((16, 64), (4, 8)):
        found = codes.encode(table(spark, rows), parts=parts, entries=entries).collect()
        assert sorted((tuple(r) for r in found), key=str) == sorted(plain_codes(rows, parts, entries, 2), key=str)


def test_screening_keeps_every_nearest_entry():
    rng = np.random.default_rng(3)
    for size, high in ((1, 5), (4, 300), (4, 2**27), (64, 2**20)):
        part, book = rng.integers(-high, high, (500, size)), rng.integers(-high, high, (64, size))
        # entries that differ by less than float32 can tell, and equal ones
        book[1::2] = book[::2] + rng.integers(0, 2, (32, size))
        distance = ((part[:, None].astype(object) - book[None]) ** 2).sum(axis=2)
        want, least = distance.argmin(axis=1), distance.min(axis=1)
        entry, got = codes.nearest(part, book)
        assert entry.tolist() == want.tolist() and got.tolist() == least.tolist()
        kept = codes.screened(part, book)
        assert kept[np.arange(500), want].all()
    # in float32 these two are equally far; only whole numbers tell them apart
    part, book = np.array([[2**24 + 1, 0]]), np.array([[2**24 + 2, 1], [2**24 + 1, 1]])
    assert codes.screened(part, book).all() and codes.nearest(part, book)[0].tolist() == [1]


def test_codes_of_odd_tables(spark):
    assert codes.encode(table(spark, [])).collect() == []
    # fewer vectors than entries; repeated rows; a width and a size that cannot be cut; ties by the smaller vector
    rows = [(1, [0.5] * 16, 1), (1, [0.5] * 16, 1), (1, [0.25] * 16, 1), (None, [0.1] * 16, None), (3, [0.5] * 17, 1), (4, [3e38] * 16, 1), (5, [], 2)]
    found = sorted((tuple(r)[:5] for r in codes.encode(table(spark, rows)).collect()), key=str)
    assert found == sorted([(1, 1, "01" * 16, 0, 0), (1, 1, "01" * 16, 0, 0), (1, 1, "00" * 16, 0, 0), (None, None, "03" * 16, 0, 0), (3, 1, None, None, 0), (4, 1, None, None, 0), (5, 2, None, None, None)], key=str)
    only = codes.encode(table(spark, [(3, [0.5] * 17, 1)])).collect()
    assert [tuple(r)[:5] for r in only] == [(3, 1, None, None, None)] and only[0]["codebooks_sha256"] == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        codes.encode(table(spark, rows), entries=257)


def test_labels_that_are_too_many_to_send_are_joined(spark, monkeypatch):
    rows = some_vectors(2, 120)
    want = sorted(map(str, codes.encode(table(spark, rows)).collect()))
    monkeypatch.setattr(codes, "LABELS_TO_SEND", 0)
    assert sorted(map(str, codes.encode(table(spark, rows)).collect())) == want


# --- Near vectors


def plain_links(rows):
    """Each row's number of links and smallest id reachable, by all pairs."""
    usable = [v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if usable[a] and usable[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= pivots.COSINE:
                    n[a] += 1
                    n[b] += 1
                    root[find(a)] = find(b)
    low = {}
    for i, (id_, _, _) in enumerate(rows):
        if id_ is not None:
            low[find(i)] = min(low.get(find(i), id_), id_)
    return sorted(((id_, n[i], low.get(find(i))) for i, (id_, _, _) in enumerate(rows)), key=str)


def crowds(seed, sizes, noise, width=48):
    """Vectors about some centres each, so that some pairs are just above and some just below the threshold."""
    r, rows = np.random.default_rng(seed), []
    for size in sizes:
        centre = r.normal(size=width)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            v = centre + r.normal(size=width) * noise / math.sqrt(width)
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(r.integers(0, 2))))
    return rows


def near(spark, rows, **options):
    return sorted((tuple(r) for r in pivots.near_vectors(table(spark, rows), **options).select("id", "n_links", "component_id").collect()), key=str)


def test_links_are_those_of_all_pairs(spark):
    rows = crowds(1, [90, 40, 1, 1, 1, 2, 3, 5, 30] + [1] * 150, 0.12)
    copies = [(1000 + i, rows[3][1], rows[3][2]) for i in range(40)] + [(1100, [2 * x for x in rows[3][1]], rows[3][2])]
    odd = [(2000, None, 1), (2001, [0.0] * 48, 1), (2002, [math.nan] * 48, 1), (2003, [None] * 48, 1), (2004, rows[3][1], None), (2005, [1.0, 0.0], 1), (2006, [1.0, 0.1], 1), (2007, [], 1), (2008, [1e30] * 48, 0), (2009, [1e-30] * 48, 0)]
    everything = rows + copies + odd + rows[:2] + [(None, rows[100][1], rows[100][2]), (None, None, 0)]
    want = plain_links(everything)
    assert sum(x[1] for x in want) > 4000 and near(spark, everything) == want
    # long lists are split into pairs of blocks, in which every pair is still met once
    assert near(spark, everything, block=16) == want


def test_recall_of_the_index(spark):
    rows = crowds(2, [2] * 300 + [60] * 4, 0.14)
    want, found = plain_links(rows), near(spark, rows)
    by = {x[0]: x[1] for x in want}
    assert all(n <= by[i] for i, n, _ in found)
    assert sum(x[1] for x in found) >= 0.99 * sum(by.values()) > 1000


def test_near_vectors_of_odd_tables(spark):
    assert near(spark, []) == []
    assert near(spark, [(1, None, 1), (2, [1.0], None)]) == [(1, 0, 1), (2, 0, 2)]
    # fewer pivots than have to be shared
    assert near(spark, [(4, [1.0, 0.0], 1), (5, [1.0, 0.01], 1), (6, [0.0, 1.0], 1)]) == [(4, 1, 4), (5, 1, 4), (6, 0, 6)]


def test_a_crowd_gives_one_pivot():
    r = np.random.default_rng(5)
    crowd, others = r.normal(size=48) + r.normal(size=(900, 48)) * 0.02, r.normal(size=(100, 48))
    values = np.concatenate([crowd, others])
    values /= np.linalg.norm(values, axis=1, keepdims=True)
    chosen = pivots.spread(values, 200)
    assert len(chosen) <= 101 and (np.triu(chosen @ chosen.T, 1) < pivots.SPREAD).all()


# --- Ranked search


def plain_ranking(docs, items, best):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    said = [(i, cut(t)) for i, t in docs]
    said = [(i, t) for i, t in said if t]
    n_docs, words = len(said), sum(len(t) for _, t in said)
    df = Counter(x for _, t in said for x in set(t))
    out = []
    for item in sorted({i for i, _ in items}):
        asked = [x for text in sorted({t for i, t in items if i == item and t is not None}) for x in cut(text)]
        scored = []
        for i, t in said:
            tf, m = Counter(t), 75 + 25 * len(t) * n_docs // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m)) for x in asked if tf[x])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:best])]
    return sorted(out)


DOCS, ITEMS = "doc_id long, text string, doc string, n long, terms string, score string", "item_id long, text string, item string, terms string"


def ranked(spark, docs, items, **options):
    left = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in docs], DOCS)
    right = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS)
    return sorted(tuple(r) for r in lexical.search(left, right, **options).collect())


def test_ranking_is_that_of_a_plain_walk(spark):
    r = random.Random(7)
    words = ["Äpfel", "the", "THE", "naïve", "x1", "2024", "漢字", "İ", "end", "rare", *(f"w{i}" for i in range(60))]
    docs = [(i * 31 % 997, " ".join(r.choice(words[: r.choice([5, 70])]) for _ in range(r.choice([1, 5, 30])))) for i in range(400)]
    docs += [(2000 + i, "the same-copy_of x1!") for i in range(60)] + [(3000, "the " * 300 + "w1 " * 70_000), (3001, None), (3002, ""), (3003, "?! \x00\x7f"), (None, "rare rare"), (5, docs[5][1]), (5, "rare again")]
    items = [(1, "The x1 x1 copy"), (2, "rare"), (3, None), (4, "nowhere to-be-found"), (5, "äpfel İ 漢字 w1"), (6, "the w2\x00w3"), (7, ""), (8, "w4 the"), (8, "w4 the"), (8, "w5 w4")]
    want = plain_ranking(docs, items, 20)
    assert {x[0] for x in want} == {1, 2, 5, 6, 8} and ranked(spark, docs, items) == want
    # several blocks of items, and of the ids beyond the best
    assert ranked(spark, docs, items, block_terms=3, best=3) == plain_ranking(docs, items, 3)


def test_windows_end_anywhere(spark, monkeypatch):
    docs = [(i, f"w{i % 7} w{i % 11} common") for i in range(300)]
    items = [(1, "common w3"), (2, "w1 w2 w3")]
    want = plain_ranking(docs, items, 20)
    assert ranked(spark, docs, items) == want
    asked = [sorted({0: 1, 1: 1}.items())]
    import pyarrow as pa

    row = lambda i: (i, 3, np.array([0, 1], np.int32).tobytes(), np.array([1 + i % 3, 2], np.uint8).tobytes())
    batch = lambda at: pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*map(row, at), strict=True)], ["doc", "n", "terms", "counts"])
    run = lambda batches: [b.to_pylist() for b in lexical._search(pa.array([9]), asked, np.array([5, 7]), 300, 900, 4)(iter(batches))]
    whole = run([batch(range(300))])
    assert sorted(x["doc"] for x in whole[0]) == [2, 5, 8, 11]
    monkeypatch.setattr(lexical, "WINDOW", 8)
    assert [sorted(map(str, b)) for b in run([batch(range(100)), batch(range(100, 300))])] == [sorted(map(str, b)) for b in whole]


def test_ranking_of_odd_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a")], []) == [] and ranked(spark, [(1, None)], [(1, "a")]) == []


def test_ranking_writes_files_by_documents_and_not_by_partitions(spark, monkeypatch):
    many = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in many}
    runtime.ensure_checkpoint_dir(spark)
    folder = pathlib.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    docs = [(i * 31 % 997, f"w{i % 7} w{i % 11} common") for i in range(300)]
    items = [(i, f"common w{i}") for i in range(12)]
    want, cores = plain_ranking(docs, items, 20), spark.sparkContext.defaultParallelism
    left, right = spark.createDataFrame(docs, "doc_id long, text string").repartition(64), spark.createDataFrame(items, "item_id long, text string")
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        # files of documents and items, partitions of the result; with less for each, more of them
        for bounds, files, parts in (({}, cores + 1, cores), ({"TASK_BYTES": 100, "RANKED_ROWS": 500}, 42, 20), ({"TASK_BYTES": 1, "RANKED_ROWS": 1}, 65, 40)):
            for k, v in bounds.items():
                monkeypatch.setattr(lexical, k, v)
            old = set(folder.rglob("part-*"))
            found = lexical.search(left, right)
            assert sorted(tuple(r) for r in found.collect()) == want
            assert len(set(folder.rglob("part-*")) - old) <= files and found.rdd.getNumPartitions() <= parts
        assert len(set(folder.rglob("part-*")) - old) == 65
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
