import random
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import composites, context, critique, documents, postings, retrieval, walks


def test_character_references_end_with_a_semicolon(spark):
    assert documents.sections_of("<title>a &amp; b&amp</title><p>&copy; &amp &am &nosuch; &#38;&#x26; &#38 AT&T &amp") == ("a & b&amp", [("", "© &amp &am &nosuch; && &#38 AT&T &amp")])
    # the first mark is in the page already, and raw text has no references
    assert documents.sections_of("<p> &amp;&<xmp>a & b</xmp>")[1] == [("", " &&a & b")]

def test_sets_of_chunks_tell_repeats_apart(spark):
    retrieved = spark.createDataFrame([(1, 5), (1, 7), (2, 5), (2, 5), (2, 5), (2, 7), (3, 7), (3, 5), (4, None), (4, 5), (5, 5)], "finding long, chunk long")
    findings = spark.createDataFrame([(f // 4, f) for f in range(1, 6)], "cell long, finding long")
    assert sorted(tuple(r) for r in critique.provenance_sets(retrieved, findings).collect()) == [(0, 3, 2), (1, 2, 2)]

@pytest.mark.parametrize("n", [1, 2, 7, 20, 21, 64, 1001, 3000])
def test_chance_of_a_majority_for_any_number_of_votes(spark, n):
    votes = sorted({0, 1, n // 3, n // 2, n // 2 + 1, n * 51 // 100, n - 1, n})
    got = spark.createDataFrame([(v, n) for v in votes], "v int, n int").select("v", tx.majority_chance(F.col("v"), F.col("n")).alias("c")).collect()
    for v, c in got:
        want = Fraction(sum(comb(n, k) * v**k * (n - v) ** (n - k) for k in range(n // 2 + 1, n + 1)), n**n)
        assert abs(c - float(want)) < 1e-9, (v, n, c)


def test_requests_are_walked_and_not_gathered(spark):
    r = random.Random(5)
    rows = [(r.choice([None, 1, 2]), i, float(r.randrange(300)), float(r.randrange(9))) for i in range(400)]
    rows += [(7, 1, 1.0, None), (7, 2, 2.0, 1.0), (8, 1, None, 1.0), (8, 2, 2.0, 1.0)]
    made = composites.single_flight(spark.createDataFrame(rows, "runner long, request long, at double, takes double").repartition(5))
    want, until = {}, {}
    for runner, request, at, takes in sorted(rows[:400], key=lambda x: (x[2], x[1])):
        want[runner, request] = at >= until.get(runner, -1)
        if want[runner, request]:
            until[runner] = at + takes
    want |= {(7, 1): True, (7, 2): None, (8, 1): None, (8, 2): True}
    assert {(x.runner, x.request): x.started for x in made.collect()} == want
    assert "collect_list" not in made._jdf.queryExecution().toString()


def test_sweeps_are_walked_and_not_gathered(spark):
    r = random.Random(6)
    rows = [(q, p, [r.randrange(40) for _ in range(r.randrange(6))]) for q in (None, 1, 2) for p in range(60)] + [(3, 0, None), (3, 1, [1, 2, 2]), (3, 2, [None, 3])]
    made = walks.swept(spark.createDataFrame(rows, "query_id long, position long, chunks array<long>").repartition(5), 2)
    want, seen = {}, {}
    for q, p, chunks in rows:
        new = set(chunks or []) - seen.setdefault(q, set())
        want[q, p] = "merged" if len(new) >= 2 else "no_new_evidence"
        if len(new) >= 2:
            seen[q] |= new
    assert {(x.query_id, x.position): x.outcome for x in made.collect()} == want
    assert "collect_list" not in made._jdf.queryExecution().toString()

def test_a_search_that_cuts_nothing_comes_in_pieces(spark, monkeypatch):
    r = np.random.default_rng(8)
    m = r.normal(size=(90, 6))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    asked = table.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(q, i): round(float(unit[q] @ unit[i]), 6) for q in range(0, 90, 3) for i in range(90)}
    monkeypatch.setattr(retrieval, "CELLS", 200)
    pieces = list(retrieval._best(1 << 31, -2.0, 2.0, False, None)(asked.withColumn("group", F.lit(None).cast("string")).toArrow(), table.withColumn("group", F.lit(None).cast("string")).toArrow()))
    assert sum(x.num_rows for x in pieces) == len(want) and max(x.num_rows for x in pieces) <= 200
    for sent in (1000, 10):
        monkeypatch.setattr(retrieval, "SENT_VALUES", sent)
        monkeypatch.setattr(retrieval, "UNCUT_ROWS", 20)
        found = context.filter_report(table, asked, 3, 0.1).collect()
        assert {(x.query_id, x.id): x.score for x in found} == pytest.approx(want, abs=2e-6) and len(found) == len(want)
        assert all(x.selected == (x.score >= 0.1 and x["rank"] <= 3) for x in found)


@pytest.mark.parametrize("block", [1, 7, 8192])
def test_rows_apart_are_those_of_a_walk(spark, monkeypatch, block):
    r = np.random.default_rng(9)
    rows = [(int(i), v.tolist()) for i, v in zip(r.permutation(60) % 50, r.normal(size=(60, 3)), strict=True)]
    rows += [(3, None), (70, None), (None, [1.0, 0.0, 0.0]), (71, [1.0, 0.0]), (72, [2.0, 0.1]), (73, [0.0, 0.0, 0.0]), (74, [float("nan"), 1.0, 1.0]), (75, [])]
    of = {}
    for p, v in rows:
        of.setdefault(p, []).append(v)

    def near(a, b):
        return a and b and len(a) == len(b) and np.linalg.norm(a) > 0 and np.linalg.norm(b) > 0 and round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6) >= 0.5

    kept = []
    for p in sorted(x for x in of if x is not None):
        if not any(near(a, b) for q in kept for a in of[p] for b in of[q]):
            kept.append(p)
    monkeypatch.setattr(walks, "BLOCK", block)
    found = walks.first_apart(spark.createDataFrame(rows, "position long, v array<double>").repartition(3), "position", "v", 0.5)
    assert 5 < len(kept) < 40
    assert sorted((x.position for x in found.collect()), key=str) == sorted([None, *kept], key=str)

def test_replaced_documents_are_looked_up_and_not_searched_for(spark, tmp_path):
    r = random.Random(11)
    text = lambda: " ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(9)))
    docs = {i: text() for i in range(3000)}
    folder = str(tmp_path / "index")
    table = lambda x: spark.createDataFrame(list(x.items()), "doc_id long, text string").coalesce(1)
    postings.save(postings.inverted(table(docs)), folder, buckets=2)
    new = {i: text() for i in range(3100) if i % 3}
    postings.upsert(spark, folder, table(new), buckets=2)
    docs |= new
    whole = postings.load(spark, folder)
    df = Counter(w for t in docs.values() for w in set(t.split()))
    assert {x.term: x.df for x in postings.frequencies(postings.load(spark, folder, columns=("term", "chunk", "at"))).collect()} == df
    assert postings.totals(whole) == (sum(bool(t.split()) for t in docs.values()), sum(len(t.split()) for t in docs.values()))
    asked = spark.createDataFrame([(1, "w1 w2")], "query_id long, text string")
    some = postings.load(spark, folder, asked, buckets=2)
    assert {x.term: x.df for x in postings.frequencies(some).collect()} == {w: df[w] for w in ("w1", "w2")}
    assert "array_contains" not in whole._jdf.queryExecution().toString()
