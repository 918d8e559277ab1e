"""Kept verdicts over several runs and crashes; names that hold terms against all pairs."""

import os
import random

import pytest

from tessera.operators import adjudication, claims

PAIRS = "chunk_a long, chunk_b long, text_a string, text_b string, digest string, attempt string"


def test_verdicts_are_stored_once_and_errors_never(spark, tmp_path):
    pairs = spark.createDataFrame([(i, i + 1, f"a{i}", None if i == 3 else "b", "x", "y") for i in range(20)] + [(0, 1, "a0", "b", "x", "y")], PAIRS)
    log = str(tmp_path / "calls")
    os.makedirs(log)

    def judge(down):
        def run(a, b, attempt):
            with open(f"{log}/{os.getpid()}", "a") as f:
                f.write(f"{a} {attempt}\n")
            if a in down:
                raise RuntimeError("away")
            return "conflict" if (len(a) + attempt) % 2 else "error" if attempt == 2 and a == "a7" else "unrelated"

        return run

    calls = lambda: sum(len(open(f"{log}/{x}").readlines()) for x in os.listdir(log))
    folder = str(tmp_path / "store")
    look = lambda down=(), run="one", repeats=3: sorted(tuple(r) for r in adjudication.adjudicated(pairs.select(*PAIRS.replace(" long", "").replace(" string", "").split(", ")), repeats, judge(down), folder, run, commits=4).collect())
    first = look(down=("a5",))
    assert len(first) == 60 and calls() == 60 and {x[3] for x in first if x[0] == 5} == {"error"}
    # only what failed is asked again, and each attempt is a draw of its own
    second = look()
    assert calls() == 64 and {(x[2], x[3]) for x in second if x[0] == 5} == {(0, "unrelated"), (1, "conflict"), (2, "unrelated")}
    assert [x for x in second if x[0] not in (5,)] == [x for x in first if x[0] not in (5,)]
    assert [x[3] for x in second if x[0] == 7] == ["unrelated", "conflict", "error"]
    # another run is another measurement; more attempts ask for the new ones only
    look(run="two")
    assert calls() == 124
    look(run="two", repeats=4)
    assert calls() == 124 + 1 + 20
    tally = {r.chunk_a: (r.votes, r.repeats, r.errors) for r in adjudication.votes(adjudication.adjudicated(pairs, 3, judge(()), folder, "one", 4)).collect()}
    assert tally[0] == (1, 3, 0) and tally[7] == (1, 3, 1) and len(tally) == 20
    # changed words are asked about anew
    changed = spark.createDataFrame([(0, 1, "a0!", "b", "x", "y")], PAIRS)
    before = calls()
    adjudication.adjudicated(changed, 3, judge(()), folder, "one", 4)
    assert calls() == before + 3
    with pytest.raises(ValueError):
        adjudication.adjudicated(pairs, 0, judge(()), folder, "one")


def test_a_killed_run_keeps_what_it_committed(spark, tmp_path, monkeypatch):
    pairs = spark.createDataFrame([(i, 0, f"a{i}", "b", "x", "y") for i in range(40)], PAIRS)
    folder, keep, n = str(tmp_path / "store"), adjudication.stored, []

    def dies(*args):
        n.append(1)
        if len(n) == 3:
            raise KeyboardInterrupt
        return keep(*args)

    monkeypatch.setattr(adjudication, "stored", dies)
    with pytest.raises(KeyboardInterrupt):
        adjudication.adjudicated(pairs, 1, lambda a, b, t: "conflict", folder, "r", commits=4)
    monkeypatch.setattr(adjudication, "stored", keep)
    kept = keep(spark, folder, "r").count()
    assert 0 < kept < 40
    found = adjudication.adjudicated(pairs, 1, lambda a, b, t: "unrelated", folder, "r", commits=4).collect()
    assert sorted(x.verdict for x in found) == ["conflict"] * kept + ["unrelated"] * (40 - kept)


def test_names_that_hold_terms_are_those_of_all_pairs(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abAB é") for _ in range(n))
    names = [(i, word(r.randint(0, 9)), 0) for i in range(200)] + [(900, None, 0), (901, "Straße Nord", 0)]
    terms = [(i, word(r.randint(1, 5))) for i in range(60)] + [(100, ""), (101, None), (102, "STRASSE"), (103, "nord"), (103, "e n"), (103, "e n")]
    found = claims.holding(spark.createDataFrame(names, "entity long, said string, mentions int"), spark.createDataFrame(terms, "query_id long, term string"))
    want = {(q, e) for q, t in terms for e, s, _ in names if t and s is not None and t.lower() in s.lower()}
    assert {(x.query_id, x.entity) for x in found.collect()} == want and found.columns == ["entity", "said", "mentions", "query_id"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert claims.holding(spark.createDataFrame(names, "entity long, said string, mentions int"), spark.createDataFrame([(1, "")], "query_id long, term string")).collect() == []
