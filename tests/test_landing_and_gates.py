"""Sources, document kinds, gates, supplied functions and the job queue, with literal results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import documents as dc
from tessera.operators import callables, gates
from tessera.sources import landing
from tessera.streaming import queue


def test_transcripts(spark):
    listed = {"content": [{"text": "it&amp;#39;s", "offset": 1500, "duration": 500, "lang": "en"}, {"text": "  ", "offset": 1}, {"text": "so"}]}
    raw = [
        ("a", "u", json.dumps(listed), json.dumps({"title": "T", "author": {"displayName": "D", "id": "i"}, "media": {"duration": 3.5}})),
        ("b", "u", json.dumps({"result": " plain &lt;b&gt; ", "lang": "fr", "title": "own"}), None),
        ("c", "u", json.dumps({"content": []}), "{}"),
        ("d", "u", json.dumps({"other": 1}), None),
        ("e", "u", None, None),
    ]
    rows = {r.video_id: r for r in landing.transcripts(spark.createDataFrame(raw, "video_id string, url string, body string, metadata string")).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.raw_text, a.title, a.channel_id, a.channel_name, a.duration_seconds, a.language, a.error) == ("it's so", "T", "i", "D", 3.5, "en", None)
    assert [(s.text, s.start_seconds, s.end_seconds) for s in a.segments] == [("it's", 1.5, 2.0), ("so", None, None)]
    assert (b.raw_text, b.title, b.language, b.segments, b.error) == ("plain <b>", "own", "fr", [], None)
    assert (rows["c"].error, rows["d"].error, rows["e"].error) == ("empty transcript", "no content", "no content")


def test_published_between(spark):
    rows = [("c", 0, "2024-05-01"), ("c", 1, None), ("c", 2, "2024-04-01"), ("c", 3, "2024-01-01"), ("c", 4, "2024-04-15"), ("d", 0, "2024-06-01")]
    df = spark.createDataFrame(rows, "channel string, i int, day string").withColumn("day", F.to_date("day"))
    got = lambda **k: sorted((r.channel, r.i) for r in landing.published_between(df, "channel", "i", "day", **k).collect())
    assert got(after=F.lit("2024-03-01").cast("date")) == [("c", 0), ("c", 2), ("d", 0)]
    assert got(before=F.lit("2024-04-20").cast("date"), limit=2) == [("c", 2), ("c", 3)]
    assert got(limit=1) == [("c", 0), ("d", 0)]


def test_json_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.json").write_text(json.dumps({"chunk_id": "c1", "claims": [{"text": "t"}]}))
    (tmp_path / "x/b.json").write_text("{broken")
    (tmp_path / "x/c.json").write_text(json.dumps({"chunk_id": "c2", "error": "failed"}))
    assert [r.chunk_id for r in landing.extractions(spark, str(tmp_path / "x")).collect()] == ["c1"]
    entry = {"id": "1", "question": "q", "reference_answer": "a", "expected_chunk_ids": ["k"]}
    for name, content in (("list", [entry]), ("object", {"entries": [entry]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
        assert [(r.id, r.expected_chunk_ids) for r in landing.golden_set(spark, str(tmp_path / f"{name}.json")).collect()] == [("1", ["k"])]
    for bad in ([entry, entry], {"other": 1}, [{"id": "1"}]):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            landing.golden_set(spark, str(tmp_path / "bad.json"))
    found = landing.run_files(spark, str(tmp_path / "*.json"), "id string")
    assert [r.run_file for r in found.collect()][0] > "b"


def test_document_kinds(spark):
    rows = [
        ("https://evilnotgithub.io/", "T", [None], ["text"], "document"),
        ("https://me.github.io/", "T", ["x"], ["text"], "portfolio"),
        ("https://a.example/", "How I hire", ["Intro"], ["work experience and education in a résumé"], "document"),
        ("https://a.example/", "My Resumé", ["Intro"], ["text"], "resume"),
        ("https://a.example/", "T", ["Education", "Work history"], ["a", "b"], "resume"),
        ("https://a.example/", "T", [None], ["Dear Sir, ..."], "cover_letter"),
        ("https://www.linkedin.com/in/x", "T", [None], ["text"], "profile"),
        (None, None, None, None, "document"),
    ]
    df = spark.createDataFrame(rows, "url string, title string, h array<string>, t array<string>, expected string")
    got = df.select("expected", dc.document_kind(F.col("url"), F.col("title"), F.col("h"), F.col("t")).alias("kind")).collect()
    assert [r.kind for r in got] == [r.expected for r in got]


def test_scalars(spark):
    r = spark.range(1).select(
        dc.timestamp_url(F.lit("https://x.example/w?v=1&t=2s&b=3#f"), F.lit(61.9)).alias("u"), dc.timestamp_url(F.lit("https://x.example/w"), F.lit(-1.0)).alias("u2"),
        dc.timestamp_url(F.lit("u"), F.lit(None).cast("double")).alias("u3"), dc.unfenced(F.lit('```json\n{"a":1}\n```')).alias("j"),
        dc.section_indices(F.array(F.lit("§3"), F.lit("#1"), F.lit("x"), F.lit("3")), F.array(F.lit(0), F.lit(2))).alias("s"),
        dc.composite(F.create_map(F.lit("faithfulness"), F.lit(0.9), F.lit("coverage"), F.lit(0.6))).alias("c"),
        dc.composite(F.create_map(F.lit("coverage"), F.lit(1.0), F.lit("specificity"), F.lit(float("nan")))).alias("d"),
        dc.composite(F.create_map(F.lit("other"), F.lit(1.0))).alias("e"),
        dc.review_query(F.lit("see https://x.example now"), F.lit("resume"), F.lit("t"), {"resume": "R", "document": "D"}).alias("q"),
        dc.review_query(F.lit(""), F.lit("document"), F.lit("topic"), {"resume": "R", "document": "D"}).alias("q2"),
    ).first()
    assert (r.u, r.u2, r.u3, r.j) == ("https://x.example/w?v=1&t=61s&b=3#f", "https://x.example/w?t=0s", "u", '{"a":1}')
    assert (r.s, r.q, r.q2) == ([0, 2], "R", "D topic")
    assert (r.c.composite, r.c.breached, r.d.composite, r.d.uncapped, r.d.breached, r.d.capped, r.e.composite, r.e.breached) == (0.8, False, 0.5, 1.0, True, True, None, False)


def test_corpus_digest(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 1)], "id string, n int")
    one = lambda df: tuple(dc.corpus_digest(df, "id", "n").first())
    assert one(a) == one(a.orderBy("id", ascending=False).distinct()) != one(a.where("id = 'x'"))
    assert one(a.limit(0))[1] == 0


def test_gates(spark):
    said = "we hold this view"
    rows = [
        (0, "a", "b", 3, 3, "axis", "why", said, said), (1, "b", "c", 2, 3, "axis", "why", said, said), (2, "c", "d", 2, 3, "axis", "why", said, said),
        (3, "e", "f", 0, 3, None, None, None, None), (4, "e", "f", 1, 3, "x", "y", said, said), (5, "e", "f", 3, 3, "", "y", said, said),
        (6, "e", "f", 3, 3, "x", "y", None, said), (7, "e", "f", 3, 3, "x", "y", "so is it true", said),
    ]
    df = spark.createDataFrame(rows, "position int, chunk_a string, chunk_b string, votes int, repeats int, axis string, why string, span_a string, span_b string")
    gated = gates.conflict_gates(df)
    assert [r.gate for r in gated.orderBy("position").collect()] == [None, gates.GATES[5], None, *gates.GATES[:5]]
    assert {r.gate: r.n for r in gates.gate_tally(gated).collect()} == dict.fromkeys(gates.GATES, 1)
    assert [r.position for r in gates.near_misses(df.withColumn("similarity", F.lit(1.0))).collect()] == [4]
    assert gates.exclusive(df.limit(0), "chunk_a", "chunk_b", "position").count() == 0


def test_exclusive_is_the_walk(spark):
    rng = random.Random(5)
    rows = [(i, f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for i in range(300)]
    used, expected = set(), []
    for i, a, b in rows:
        if a not in used and b not in used:
            used |= {a, b}
            expected.append(i)
    got = gates.exclusive(spark.createDataFrame(rows, "i int, a string, b string"), "a", "b", "i").where("won")
    assert sorted(r.i for r in got.collect()) == expected


def test_numbering_and_interleaving(spark):
    df = spark.createDataFrame([("g", "b", 0), ("g", "a", 1), ("g", "b", 2), ("h", "a", 0)], "g string, k string, p int")
    assert sorted(tuple(r) for r in gates.numbered(df, "g", "k", "p").collect()) == [("g", "a", 2), ("g", "b", 1), ("h", "a", 1)]
    lists = lambda keys: spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, r int")
    got = lambda a, b, n: [r.k for r in gates.interleave(lists(a), lists(b), "k", "r", n).orderBy("position").collect()]
    assert got("abc", "axy", 4) == ["a", "x", "b", "y"]
    assert got("a", "xyz", 9) == ["a", "x", "y", "z"]
    assert got("", "", 3) == []


def test_supplied_functions(spark):
    df = spark.createDataFrame([(0, "one"), (1, "bad"), (2, None), (3, "")], "query_id long, question string")

    def make(text):
        if text == "bad":
            raise RuntimeError("no")
        return f" {text}  said" if text else ""

    rows = {r.query_id: (r.out, r.out_error) for r in callables.generated(df, "question", make, "out").collect()}
    assert rows == {0: ("one said", None), 1: (None, "RuntimeError: no"), 2: (None, "no text"), 3: (None, "empty result")}
    cache = spark.createDataFrame([], "key string, variants array<string>")
    plan, fresh = callables.expanded(df.where("query_id < 2"), cache, lambda q: [q.upper(), "two", "Two"] if q == "one" else 1 / 0, "multi", "m")
    assert sorted(tuple(r) for r in plan.collect()) == [(0, 0, "one", False), (0, 1, "two", False), (1, 0, "bad", True)]
    assert fresh.count() == 1
    plan, fresh = callables.expanded(df.where("query_id = 0"), fresh, lambda q: 1 / 0, "multi", "m")
    assert plan.count() == 2 and fresh.count() == 0
    v = df.select(callables.hashed_embedding(F.col("question"), 16).alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-6 and not any(v[2].v)
    pairs = spark.createDataFrame([("p",), ("q",)], "pair string")
    votes = callables.judged(pairs, 3, lambda row: ["conflict"] if row["pair"].iloc[0] == "p" else [][0])
    assert sorted((r.pair, r.verdict) for r in votes.collect()) == [("p", "conflict")] * 3 + [("q", None)] * 3


def test_queue(spark, tmp_path):
    land, states = tmp_path / "jobs", str(tmp_path / "states")
    land.mkdir()
    for i, job in enumerate(["a", "bad"]):
        (land / f"{i}.json").write_text(json.dumps({"job_id": job, "mode": "url", "target": job, "enqueued_at": "2024-01-01T00:00:00"}))
    seen = []

    def work(jobs):
        ids = [r.job_id for r in jobs.collect()]
        seen.extend(ids)
        if "bad" in ids:
            raise RuntimeError("no")

    def enrich(jobs):
        raise RuntimeError("graph")

    start = lambda: queue.run_queue(spark, str(land), states, str(tmp_path / "cp"), work, enrich).awaitTermination(90)
    assert start()
    latest = lambda: {r.job_id: (r.status, r.detail) for r in queue.job_states(queue.job_log(spark, states)).collect()}
    expected = {"a": ("done", "enrichment failed: RuntimeError: graph"), "bad": ("error", "RuntimeError: no")}
    assert latest() == expected and sorted(seen) == ["a", "bad"]
    assert start() and latest() == expected and sorted(seen) == ["a", "bad"]
