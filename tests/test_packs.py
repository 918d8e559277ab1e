"""Packs, arms and audits with small literal cases."""

import duckdb

from tessera.operators import packs
from tessera.plans import packs as plans


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_statistics_count_rules_without_evidence_and_missing_creators(spark):
    rules = spark.createDataFrame([("p", 1, True), ("p", 2, False), ("q", 3, None)], "pack string, rule int, contested boolean")
    evidence = spark.createDataFrame([(1, "v1", "a", 0.9), (1, "v2", None, 0.89), (2, "v1", "a", 1.0)], "rule int, video string, creator string, ratio double")
    got = {r["pack"]: r for r in rows(packs.pack_statistics(rules, evidence, "pack"))}
    assert (got["p"]["rubrics"], got["p"]["multi_creator_rubrics"], got["p"]["citations"], got["p"]["resolved"], got["p"]["creators"]) == (2, 1, 3, 2, 2)
    assert (got["p"]["multi_creator_share"], got["p"]["quote_resolution"]) == (0.5, 0.6667)
    assert (got["q"]["rubrics"], got["q"]["citations"], got["q"]["quote_resolution"]) == (1, 0, 0.0)


def test_budget_ignores_pools_without_eligible_units(spark):
    units = spark.createDataFrame([("a", True), ("a", True), ("a", True), ("b", False), ("c", True), ("c", True)], "pool string, ok boolean")
    assert rows(packs.shared_budget(units, "pool", "ok", 8)) == [{"budget": 2}]
    assert rows(packs.shared_budget(units.where("pool = 'b'"), "pool", "ok", 8)) == [{"budget": 8}]


def test_staleness_is_signed_and_sees_other_videos(spark):
    chunks = lambda *v: spark.createDataFrame([(x,) for x in v], "video string")
    one = lambda a, b: rows(packs.staleness(a, b, "video"))[0]
    assert one(chunks("a", "b"), chunks("b", "a"))["current"]
    assert not one(chunks("a", "b"), chunks("a", "c"))["current"]
    got = one(chunks("a", "b", "b"), chunks("a", None))
    assert (got["behind_videos"], got["behind_chunks"], got["current"]) == (-1, -2, False)


def test_rediscovery_needs_a_shared_chunk(spark):
    added = spark.createDataFrame([(1, "c1"), (1, "c2"), (2, "c3"), (2, None)], "rule int, chunk string")
    shipped = spark.createDataFrame([(7, "c1"), (8, "c2"), (8, "c1"), (9, None)], "rule int, chunk string")
    found = packs.rediscovered(added, shipped)
    assert {r["rule"]: r["already_in_shipped"] for r in rows(found)} == {1: 2, 2: 0}
    assert rows(packs.rediscovery_rate(found)) == [{"added": 2, "rediscovered": 1, "rate": 0.5}]
    assert rows(packs.rediscovery_rate(found.where("rule > 9")))[0]["rate"] is None


def test_gap_is_closed_only_by_a_nearer_rule_of_its_own_probe(spark):
    schema = "id long, vector array<double>"
    gaps = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], schema)
    prior = spark.createDataFrame([(10, [1.0, 1.0])], schema)
    added = spark.createDataFrame([(20, [1.0, 0.1], 1), (21, [1.0, 0.1], 1), (22, [0.0, 1.0], 3)], schema + ", gap long")
    got = {r["gap"]: (r["rules"], r["best_new"], r["closed"]) for r in rows(packs.gap_closure(gaps, prior, added))}
    assert got == {1: (2, 20, True), 2: (0, None, False), 3: (1, 22, False)}
    near = {r["id"]: r["nearest_prior"] for r in rows(packs.nearest_prior(added, prior, 0.8))}
    assert near == {20: 10, 21: 10, 22: 10}


def test_a_lead_is_decisive_only_beyond_the_others_spread(spark):
    cells = [
        ("clear", "a", 0.5, 0.5, 0.5), ("clear", "b", 0.2, 0.1, 0.4),
        ("inside", "a", 0.5, 0.3, 0.5), ("inside", "b", 0.2, 0.1, 0.6),
        ("tied", "b", 0.5, 0.5, 0.5), ("tied", "a", 0.5, 0.5, 0.5),
        ("once", "a", 0.5, None, None), ("once", "b", 0.4, None, None),
        ("alone", "b", 0.4, None, None), ("alone", "a", None, None, None),
    ]
    df = spark.createDataFrame(cells, "run string, arm string, value double, low double, high double")
    got = {r["run"]: (r["leader"], r["basis"], r["decisive"]) for r in rows(packs.arm_winner(df, "run"))}
    assert got == {"clear": ("a", "cleared-spread", True), "inside": ("a", "inside-spread", False), "tied": ("a", "tied", False), "once": ("a", "unrepeated", False), "alone": ("b", "single-arm", False)}
    against = {r["run"]: (r["arm"], r["basis"], r["beats_baseline"]) for r in rows(packs.arms_against(df, "run", "b"))}
    assert against == {"clear": ("a", "ranges-disjoint", True), "inside": ("a", "ranges-overlap", False), "tied": ("a", "ranges-overlap", False), "once": ("a", "unrepeated", None), "alone": ("a", "ungraded", None)}
    assert {r["basis"] for r in rows(packs.arms_against(df.where("run = 'once'"), "run", "b", repeated=False))} == {"deterministic"}


def test_queries_agree_with_their_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, query in plans.QUERIES.items():
        df = query(spark, sf)
        cols = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({plans.ORACLE[name]})").fetchall()
        key = lambda r: tuple((x is not None, str(x)) for x in r)
        assert sorted(map(tuple, df.select(*cols).collect()), key=key) == sorted(want, key=key), name
