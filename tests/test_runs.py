"""Walks against plain loops, sections, quotes, clusters, writers and the parts that SQL cannot express."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import checkpoints, composites, context, contracts, corpus, documents, folds, retrieval, themes, walks
from tessera.sources import catalogues


def test_questions_in_any_script(spark):
    said = ["what do the café videos say", "the naïve-thinking channels", "café the", "résumé", "Why though", "é why", "what", "they hold"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i long, s string").select("i", tx.corpus_wide_signal(F.col("s")).alias("signal"), tx.states_a_position(F.col("s")).alias("states")).orderBy("i").collect()
    assert [r.signal for r in rows[:3]] == ["all-sources", "all-sources", None]
    assert [r.states for r in rows] == [False, True, True, True, False, True, False, True]


def test_nothing_stands_after_an_empty_beginning():
    assert folds.chunk_segments(["", "abc", "de"], target=6, overlap=0) == [(0, "abc de", 0, 2)]
    assert folds.chunk_segments(["ab", "abc"], target=5, overlap=0) == [(0, "ab", 0, 0), (1, "abc", 1, 1)]


def test_capacities_are_those_of_a_walk(spark):
    r = random.Random(1)
    rows = [(p, f"k{r.randrange(12)}", r.choice([1, 2, 3])) for p in range(120) for _ in range(2)]
    cap = {k: c for _, k, c in rows}
    rows = [(p, k, cap[k]) for p, k, _ in rows]
    left, want = dict(cap), []
    for p in range(120):
        keys = {k for q, k, _ in rows if q == p}
        if all(left[k] > 0 for k in keys):
            want.append(p)
            for k in keys:
                left[k] -= 1
    got = walks.within_capacity(spark.createDataFrame(rows, "position long, key string, cap int"))
    assert sorted(x.position for x in got.collect()) == want
    assert walks.within_capacity(spark.createDataFrame([], "position long, key string, cap int")).count() == 0


def test_admission_and_distance_are_those_of_a_walk(spark):
    r = random.Random(2)
    rows = [(p % 3, p, r.randrange(25)) for p in range(90) for _ in range(3)]
    want = set()
    for g in range(3):
        seen = set()
        for p in range(90):
            items = {i for h, q, i in rows if (h, q) == (g, p)}
            if items - seen:
                want.add((g, p))
                seen |= items
    assert {tuple(x) for x in walks.admitted(spark.createDataFrame(rows, "group long, position long, item long")).collect()} == want
    near = [(r.randrange(60), r.randrange(60)) for _ in range(90)]
    kept: list[int] = []
    for p in range(60):
        if not any((p, q) in near or (q, p) in near for q in kept):
            kept.append(p)
    got = walks.first_of_near(spark.range(60).withColumnRenamed("id", "position"), spark.createDataFrame(near, "a long, b long"))
    assert sorted(x.position for x in got.collect()) == kept


def centred_window(texts: list[str], at: int, budget: int) -> tuple[int, int]:
    """First and last neighbour around ``at``: sides grow in turn, before first, while a whole one fits; a side stops for good at its first misfit."""
    low = high = at
    left, right, room = True, True, budget - len(texts[at])
    while left or right:
        if left:
            left = low > 0 and len(texts[low - 1]) <= room
            if left:
                low -= 1
                room -= len(texts[low])
        if right:
            right = high + 1 < len(texts) and len(texts[high + 1]) <= room
            if right:
                high += 1
                room -= len(texts[high])
    return low, high


def test_windows_and_sections_of_a_budget(spark):
    chunks = spark.createDataFrame([("v", i, s) for i, s in enumerate([5, 3, 4, 2, 9])], "video string, index long, size long")
    rows = {r["index"]: (r.low, r.high) for r in walks.windows(chunks, 10).collect()}
    assert rows == {i: centred_window(["x" * s for s in [5, 3, 4, 2, 9]], i, 10) for i in range(5)}
    sections = spark.createDataFrame([(1, 0, 2, 8), (1, 1, 0, 9), (1, 2, 1, 1), (2, 0, 0, 3)], "document long, index long, rank long, size long")
    assert sorted(tuple(r) for r in walks.selected_sections(sections, 10).collect()) == [(1, 1), (1, 2), (2, 0)]


def test_sections_of_pages(spark):
    page = "<title> A  page </title><script>no</script><h1>One</h1><p>" + "x " * 30 + "</p><h2>Two<p>short</p><div>" + "y " * 30 + "<h3>open"
    title, found = documents.sections_of(page)
    assert title == "A page" and [h for h, _ in found][0] == "One" and "no" not in found[0][1].split()
    assert documents.sections_of("<p>a</p></div></p>")[1] == [("", "a")]
    long = "word " * 12
    # headings that are never closed, elements without text, breaks and runs of blanks
    assert documents.sections_of(f"<h1>A<h2>B</h2>{long}")[1] == [("A", ""), ("B", long.strip())]
    assert documents.sections_of(f"<h2>Title<p>{long}") == ("Title", [("Title", long.strip())])
    assert documents.sections_of(f"<p>{long}<iframe>no</iframe><canvas>no</canvas><svg><title>no</title></svg></script>yes")[1] == [("", long + "yes")]
    assert documents.sections_of("<p>a\u00a0 b\n\n c<br>d<label>e</label>f <b>g</b> <i>h</i>")[1] == [("", "a b\nc\nd\ne\nf gh")]
    assert documents.sections_of("one\n\n" + "two " * 20 + "\n \n x", html=False)[1] == [("", "one"), ("", ("two " * 20).strip() + "\nx")]
    assert documents.sections_of("one\n two  three\n\n", html=False) == ("", [("", "one\ntwo three")])
    assert documents.merged_short([("a", "x"), ("b", "y")]) == [("a", "x\nb\ny")]
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, body string")
    rows = documents.sections(pages, "id", "body").collect()
    assert {r.id for r in rows} == {1} and rows[0].title == "A page"


def test_well_separated_groups_are_clusters(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(6)[:3]
    rows = [(i, (centres[i % 3] + rng.normal(scale=0.03, size=6)).tolist()) for i in range(90)]
    out = themes.soft_clusters(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", themes.Settings(axes=2, most=4)).collect()
    groups = [{x.cluster for x in out if x.id % 3 == g and x.weight > 0.5} for g in range(3)]
    assert {x.id for x in out} == set(range(90)) and not groups[0] & groups[1] and not groups[1] & groups[2]
    few = themes.soft_clusters(spark.createDataFrame(rows[:2], "id long, v array<double>"), "id", "v").collect()
    assert [x.cluster for x in few] == [0, 0]


def test_masks_come_before_cuts(spark):
    rows = [(i, [1.0, i / 100.0], i % 2) for i in range(40)] + [(40, [1.0, 0.9], 7)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g long")
    asked = df.where("id = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"), "g")
    other = retrieval.dense(df, asked, "id", "v", 3, skip_self=True, group_col="g", groups="other").orderBy("rank").collect()
    assert [x.id for x in other] == [1, 3, 5]
    each = retrieval.dense(df, asked.drop("g"), "id", "v", 1, group_col="g", groups="each").orderBy("group").collect()
    assert [(x.group, x.id) for x in each] == [(0, 0), (1, 1), (7, 40)]
    with pytest.raises(ValueError):
        context.nearest(spark.createDataFrame([(1, [1.0])], "id long, vector array<double>"), asked, 2)
    with pytest.raises(ValueError):
        context.guarded(df, 5)


def test_writers_and_errors(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    composites.save_table(rows, str(tmp_path), "t")
    composites.save_table(rows.limit(0), str(tmp_path), "t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 0
    path = composites.save_run(rows, str(tmp_path), "eval", "20240101")
    assert spark.read.json(path).count() == 1
    with pytest.raises(Exception):  # noqa: B017 - the writer's own error
        composites.save_run(rows, str(tmp_path), "eval", "20240101")
    runs = spark.createDataFrame([("a",), ("b",)], "run string")
    assert contracts.run_selected(runs).first().run == "b" and contracts.run_selected(runs, "a").first().run == "a"
    with pytest.raises(ValueError):
        contracts.run_selected(runs, "c")
    assert corpus.scoped(spark.createDataFrame([("v", "c", 1)], "video string, channel string, n long"), video="w").count() == 0


def test_places_are_those_of_one_order(spark):
    r = random.Random(4)
    values = [r.randrange(1000) for _ in range(500)]
    rows = checkpoints.placed(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").withColumn("key", F.struct("v", "i")), "key").collect()
    want = {i: n + 1 for n, i in enumerate(sorted(range(500), key=lambda i: (values[i], i)))}
    assert {x.i: x.place for x in rows} == want


def test_criteria_and_catalogues(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"criteria": [{"id": "a", "criterion": "x", "applies_to": ["d1", "d2"], "group": "g"}, {"id": "b", "criterion": "y", "applies_to": ["d1"]}]}')
    rows = catalogues.critique_dataset(spark, str(tmp_path / "c.json")).collect()
    assert sorted((r.criterion, r.applies_to, r.group) for r in rows) == [("a", "d1", "g"), ("a", "d2", "g"), ("b", "d1", "b")]
    (tmp_path / "twice.json").write_text('[{"id": "a", "criterion": "x"}, {"id": "a", "criterion": "y"}]')
    (tmp_path / "bad.json").write_text('[{"id": "a"}]')
    for name in ("twice", "bad"):
        with pytest.raises(ValueError):
            catalogues.critique_dataset(spark, str(tmp_path / f"{name}.json"))
    (tmp_path / "p.json").write_text('{"topics": [{"id": "p", "title": "T"}], "excluded": ["v1", "v2"], "held_out": ["v2"]}')
    topics, out = catalogues.pack_catalogue(spark, str(tmp_path / "p.json"))
    assert [tuple(r) for r in topics.collect()] == [("p", "T", "T")] and sorted(tuple(r) for r in out.collect()) == [("v1", "excluded"), ("v2", "held_out")]
