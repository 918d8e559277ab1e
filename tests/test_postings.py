"""A kept index against one built anew, and the pruning of its files."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import postings, retrieval


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc", "score", "rank").collect())


def plain_bm25(docs, queries, k):
    said = {i: t.lower().split() for i, t in docs if t and t.split()}
    n, average, df = len(said), sum(map(len, said.values())) / len(said), Counter(w for t in said.values() for w in set(t))
    raw = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    out = []
    for q, text in enumerate(queries):
        want = Counter(text.lower().split())
        hits = [(round(sum(m * idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / average)) for w, m in want.items() if w in t), 4), i) for i, t in said.items() if any(w in t for w in want)]
        out += [(q, i, s, r + 1) for r, (s, i) in enumerate(sorted(hits, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def test_a_changed_index_is_that_of_the_changed_documents(spark, tmp_path):
    r = random.Random(4)
    words = [f"w{i}" for i in range(80)]
    text = lambda: " ".join(r.choice(words[: r.choice([6, 80])]) for _ in range(r.randint(1, 25)))
    docs = {i: text() for i in range(300)} | {900: None, 901: " ", 902: "w1 " * 3000}
    folder, queries = str(tmp_path / "index"), ["w1 w2 w2", "w70 w71", "nowhere", "w3"]
    postings.save(postings.inverted(table(spark, list(docs.items()))), folder, buckets=8)
    questions = asked(spark, *queries)
    found = lambda: rows(retrieval.bm25(None, questions, k=8, index=postings.load(spark, folder, questions, buckets=8), spread=postings.kept_spread(spark, folder)))
    assert found() == plain_bm25(docs.items(), queries, 8)
    for _ in range(2):
        new = {r.randrange(400): text() for _ in range(60)}
        docs |= new
        postings.upsert(spark, folder, table(spark, list(new.items())), buckets=8)
    for i in (gone := [5, 17, 902, 12345]):
        docs.pop(i, None)
    postings.delete(spark, folder, spark.createDataFrame([(i,) for i in gone], "doc long"))
    docs[17] = "w1 again"
    postings.upsert(spark, folder, table(spark, [(17, "w1 again")]), buckets=8)
    whole = postings.load(spark, folder)
    assert postings.totals(whole) == (sum(bool(t and t.split()) for t in docs.values()), sum(len(t.split()) for t in docs.values() if t))
    assert {x.term: x.df for x in postings.frequencies(whole).collect()} == Counter(w for t in docs.values() if t for w in set(t.split()))
    want = plain_bm25(docs.items(), queries, 8)
    assert found() == want and rows(retrieval.bm25(None, questions, k=8, index=whole)) == want


def test_a_search_reads_the_folders_of_its_terms_only(spark, tmp_path):
    folder = str(tmp_path / "index")
    postings.save(postings.inverted(table(spark, [(i, f"w{i} both") for i in range(200)])), folder, buckets=32)
    one = postings.load(spark, folder, asked(spark, "w3"), buckets=32)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(one) == 2 and files(postings.load(spark, folder)) > 20
    assert [x.doc for x in retrieval.bm25(None, asked(spark, "w3"), index=one).collect()] == [3]


def test_queries_in_several_passes(spark, monkeypatch):
    docs = table(spark, [(i, f"w{i % 5} w{i % 3}") for i in range(40)])
    questions = asked(spark, "w1", "w2 w4", "w0 w3", "w4")
    want = rows(retrieval.bm25(docs, questions, k=5))
    monkeypatch.setattr(postings, "QUERY_TERMS", 2)
    assert rows(retrieval.bm25(docs, questions, k=5)) == want
    assert rows(retrieval.bm25(docs.limit(0), questions, k=5)) == []
