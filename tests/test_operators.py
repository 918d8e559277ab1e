import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import communities, folds, graph, joins, metrics, retrieval, store

CORPUS = ["capital gains tax discount for property investors", "negative gearing rules and rental deductions", "the capital gains tax discount is being grandfathered", "interest rates and the housing market outlook"]


def corpus(spark, texts=CORPUS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_bm25_literals(spark):
    hits = retrieval.bm25(corpus(spark), asked(spark, "capital gains tax", "gearing", "  ", "zzz"), k=5).collect()
    assert {(r.query_id, r.doc) for r in hits} == {(0, 0), (0, 2), (1, 1)}
    assert sorted(r["rank"] for r in hits if r.query_id == 0) == [1, 2]


def test_bm25_zero_idf_still_hits_and_blank_documents_do_not(spark):
    hits = retrieval.bm25(corpus(spark, ["tax one", "rate two", " ", None]), asked(spark, "tax"), k=3).collect()
    assert [r.doc for r in hits] == [0]
    with pytest.raises(ValueError):
        retrieval.bm25(corpus(spark), asked(spark, "tax"), k=0)


def test_tokens(spark):
    row = spark.range(1).select(tx.tokens(F.lit("Capital-Gains, TAX! été")).alias("t"), tx.tokens(F.lit(None).cast("string")).alias("n")).first()
    assert row.t == ["capital", "gains", "tax", "t"] and row.n == []


def test_fusion_literals(spark):
    lists = spark.createDataFrame([(0, 0, 1, "a"), (0, 0, 2, "b"), (0, 0, 3, "c"), (0, 1, 1, "c"), (0, 1, 2, "a")], "query_id long, list int, rank int, doc string")
    out = {r.doc: (r.score, r["rank"]) for r in retrieval.fuse(lists, constant=1).collect()}
    assert out["a"] == (round(1 / 2 + 1 / 3, 9), 1) and out["c"] == (0.75, 2) and out["b"] == (round(1 / 3, 9), 3)
    with pytest.raises(ValueError):
        retrieval.fuse(lists, constant=-1)


def test_fusion_counts_a_repeat_once_and_keeps_later_ranks(spark):
    lists = spark.createDataFrame([(0, 0, 1, "a"), (0, 0, 2, "a"), (0, 0, 3, "b")], "query_id long, list int, rank int, doc string")
    assert {r.doc: r.score for r in retrieval.fuse(lists, constant=0).collect()} == {"a": 1.0, "b": round(1 / 3, 9)}


def test_metrics_literals(spark):
    got = spark.createDataFrame([(0, d, i + 1) for i, d in enumerate("ABCDE")] + [(1, d, i + 1) for i, d in enumerate("AACB")], "query_id long, doc string, rank int")
    want = spark.createDataFrame([(0, "A"), (0, "C"), (1, "A"), (1, "B")], "query_id long, doc string")
    rows = {r.query_id: r for r in metrics.ir_metrics(got, want, spark.range(3).select(F.col("id").alias("query_id"))).collect()}
    assert (rows[0].recall_1, rows[0].recall_3, rows[0].recall_10, rows[0].mrr) == (0.5, 1.0, 1.0, 1.0)
    assert rows[1].recall_3 == 1.0 and rows[2].mrr is None
    assert rows[0].average_precision == round((1 + 2 / 3) / 2, 4)


def test_diversity_and_neighbours(spark):
    hits = spark.createDataFrame([(0, 1, "x", 5), (0, 2, "x", 6), (0, 3, "y", 1), (0, 4, "", 9), (0, 5, "", 3)], "query_id long, rank int, source string, index long")
    out = retrieval.diversify(hits, "source", 1, 4).orderBy("position").collect()
    assert [r["rank"] for r in out] == [1, 3, 4, 5]
    chunks = spark.createDataFrame([("x", i) for i in range(10)] + [("y", i) for i in range(3)], "source string, index long")
    wide = retrieval.with_neighbours(hits.where("rank <= 3"), chunks).orderBy("position").collect()
    assert [(r.source, r["index"], r.is_hit) for r in wide] == [("x", 4, False), ("x", 5, True), ("x", 7, False), ("x", 6, True), ("y", 0, False), ("y", 2, False), ("y", 1, True)]


def test_dense_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 8), (62, [1.0, float("nan")] + [0.0] * 6), (63, [1.0])]
    df = spark.createDataFrame(vectors, "id long, v array<double>")
    out = retrieval.dense(df, df.where("id < 5").select(F.col("id").alias("query_id"), F.col("v").alias("vector")), "id", "v", 4).collect()
    m = np.array([v for _, v in vectors[:60]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(5):
        s = np.round(m @ m[q], 6)
        assert [r.id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(60), -s))[:4].tolist()


def test_votes(spark):
    said = [(1, 1, "conflict"), (1, 2, None), (2, 1, "conflict"), (2, 2, "conflict"), (2, 3, "unrelated"), (3, 1, "conflict"), (3, 2, "other"), (3, 3, None)]
    rows = {r.pair: r for r in metrics.tally(spark.createDataFrame(said, "pair long, attempt long, verdict string")).collect()}
    assert [rows[p].carried for p in (1, 2, 3)] == [False, True, False]
    assert rows[3].undecided and not rows[2].undecided
    p = 2 / 3
    assert rows[2].chance == pytest.approx(3 * p * p * (1 - p) + p**3, abs=1e-6)


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (4.0, 1.0, 3.0, 2.0)], "g string, v double")
    assert tuple(metrics.spread(df, "g", "v").first()) == ("a", 1.0, 3.0, 4.0)


def test_interval_and_nearest_joins_match_brute_force(spark):
    r = random.Random(3)
    points = [(r.choice("ab"), i, r.uniform(-50, 500)) for i in range(60)]
    spans = [(r.choice("ab"), i, s := r.uniform(0, 450), s + r.uniform(0, 200)) for i in range(60)]
    p, s = spark.createDataFrame(points, "k string, p long, at double"), spark.createDataFrame(spans, "k string, c long, start double, end double")
    got = {(x.p, x.c) for x in joins.interval_join(p, s, "k", "at", "start", "end", 20.0, 30.0).collect()}
    assert got == {(b, d) for a, b, t in points for c, d, lo, hi in spans if a == c and lo - 20 <= t <= hi + 20}
    near = {x.p: x.c for x in joins.nearest_in_time(p, s, "k", "p", "at", "start", "c", 10.0).collect()}
    for a, b, t in points:
        own = sorted((abs(t - lo), lo, d) for c, d, lo, _ in spans if a == c and abs(t - lo) <= 10)
        assert near.get(b) == (own[0][2] if own else None)


def test_greedy_matching_is_one_to_one(spark):
    pairs = spark.createDataFrame([("g", "a", "x", 0.9), ("g", "a", "y", 0.95), ("g", "b", "y", 0.94), ("g", "b", "x", 0.61), ("g", "c", "z", 0.5)], "g string, l string, r string, s double")
    assert {(x.l, x.r) for x in joins.greedy_matching(pairs, "g", "l", "r", "s", 0.6).collect()} == {("a", "y"), ("b", "x")}


def test_replacement_leaves_groups_without_new_rows(spark):
    old = spark.createDataFrame([("v", "v:0"), ("v", "v:1"), ("w", "w:0")], "g string, k string")
    table, removed = store.replace_group(old, spark.createDataFrame([("v", "v:0")], "g string, k string"), "g", "k")
    assert sorted(x.k for x in table.collect()) == ["v:0", "w:0"] and [x.k for x in removed.collect()] == ["v:1"]
    assert store.replace_group(old, old.limit(0), "g", "k")[0].count() == 3


def test_chunker():
    assert folds.chunk_segments([]) == []
    assert folds.chunk_segments(["x" * 50], 10) == [(0, "x" * 50, 0, 0)]
    out = folds.chunk_segments(["aaaa", "bbbb", "cccc", "dddd"], 9, 4)
    assert [(c[2], c[3]) for c in out] == [(0, 1), (1, 2), (2, 3)]
    assert [(c[2], c[3]) for c in folds.chunk_segments(["aaaa", "bbbb", "cccc"], 9, 0)] == [(0, 1), (2, 2)]


@pytest.mark.parametrize("walked", [1_000_000, 0])
def test_communities_separate_cliques(spark, monkeypatch, walked):
    monkeypatch.setattr(communities, "WALKED_LINKS", walked)
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 0.1), (2, 2, 1.0), (3, None, 9.0), (0, 14, 0.0), (7, 7, 2.0)]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    labels = communities.communities(df, spark.createDataFrame([(n,) for n in (0, 50, 51, None)], "node long"))
    found = {r.node: r.community for r in labels.collect()}
    assert set(found) == {*range(5), *range(10, 15), 7, 50, 51} and all(c == (n if n in (7, 50, 51) else 0 if n < 10 else 10) for n, c in found.items())
    assert communities.modularity(df, labels) > 0.4
    assert communities.communities(df.limit(0)).collect() == []


@pytest.mark.parametrize(("planted", "walked"), [(1, 1_000_000), (2, 1_000_000), (3, 1_000_000), (1, 0)])
def test_communities_are_as_modular_as_moves_one_by_one(spark, monkeypatch, planted, walked):
    monkeypatch.setattr(communities, "WALKED_LINKS", walked)
    r = random.Random(planted)
    edges = [(a, b, float(r.choice([1, 2]))) for a in range(48) for b in range(a) if r.random() < (0.6 if a // 12 == b // 12 else 0.04)]
    found = {x.node: x.community for x in communities.communities(spark.createDataFrame(edges, "a long, b long, weight double"), seed=3).collect()}

    def quality(label):
        total, inside, degree = sum(w for *_, w in edges), sum(w for a, b, w in edges if label[a] == label[b]), Counter()
        for a, b, w in edges:
            degree[label[a]] += w
            degree[label[b]] += w
        return inside / total - sum((d / 2 / total) ** 2 for d in degree.values())

    # one node after the other, from the planted groups on: no move may be better
    best = {n: n // 12 for n in found}
    moved = True
    while moved:
        moved = False
        for n in sorted(best):
            other = max(range(4), key=lambda c: quality(best | {n: c}))
            if quality(best | {n: other}) > quality(best) + 1e-9:
                best, moved = best | {n: other}, True
    assert quality(found) >= quality(best) - 1e-9
    # every community holds together
    for c in set(found.values()):
        reached, open_ = set(), [c]
        while open_:
            n = open_.pop()
            if n not in reached:
                reached.add(n)
                open_ += [b if a == n else a for a, b, _ in edges if n in (a, b) and found[a] == found[b]]
        assert reached == {n for n, x in found.items() if x == c}


def test_projection_matches_numpy(spark):
    m = np.random.default_rng(2).normal(size=(50, 4)) * [5, 2, 1, 0.5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    mean, axes = graph.principal_axes(df, "v", 2)
    _, _, vt = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(axes @ vt[:2].T), np.eye(2), atol=1e-6) and np.allclose(mean, m.mean(axis=0))
    with pytest.raises(ValueError):
        graph.principal_axes(df.limit(1), "v")


def test_text_scalars(spark):
    row = spark.range(1).select(
        tx.slug(F.lit(" The A.T.O.! ")).alias("slug"), tx.slug(F.lit("!!")).alias("none"), tx.chunk_index(F.lit("chunk:v:12")).alias("i"), tx.chunk_index(F.lit("v:12")).alias("z"),
        tx.timestamp(F.lit(3725.0)).alias("t"), tx.timestamp(F.lit(-3.0)).alias("neg"), tx.timestamp(F.lit(None).cast("double")).alias("nul"),
        tx.video_id(F.lit("https://youtu.be/abcdefghijk?t=1")).alias("v"), tx.label_number(F.lit("[s1.3]")).alias("l"), tx.corpus_wide_signal(F.lit("What themes recur across these videos?")).alias("w"), tx.corpus_wide_signal(F.lit("every step of the workflow")).alias("x"), tx.corpus_wide_signal(F.lit("How did it change over the years?")).alias("y"),
        tx.states_a_position(F.lit("Is it?")).alias("q"), tx.document_url(F.lit("https://youtu.be/x https://a.example/y.")).alias("d"), tx.normal_query(F.lit("  What  IS it?! ")).alias("n"),
    ).first()
    assert (row.slug, row.none, row.i, row.z, row.t, row.neg, row.nul) == ("the-a-t-o", "unknown", 12, 0, "01:02:05", "00:00", "unknown")
    assert (row.v, row.l, row.w, row.x, row.y, row.q, row.d, row.n) == ("abcdefghijk", 3, "all-sources", None, "over-time", False, "https://a.example/y", "what is it")


def test_modes(spark):
    df = spark.createDataFrame([(0, "a", "x", 1), (0, "a", "y", 2), (0, "b", "x", 5)], "query_id long, mode string, doc string, rank int")
    assert Counter((r.mode, r.doc, r.best_elsewhere, r.in_all) for r in retrieval.compare_modes(df).collect()) == Counter([("a", "x", 5, True), ("a", "y", None, False), ("b", "x", 1, True)])
