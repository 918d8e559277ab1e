"""Walks in order against plain ones: chains, hubs, components on both sides of the size that one task walks."""

import random

from pyspark.sql import functions as F

from tessera.operators import checkpoints, components, gates, walks


def plain_capacity(rows):
    used, kept = {}, []
    for p in sorted({p for p, _, _ in rows}):
        keys = {(k, c) for q, k, c in rows if q == p}
        if all(used.get(k, 0) < c for k, c in keys):
            kept.append(p)
            for k, _ in keys:
                used[k] = used.get(k, 0) + 1
    return kept


def test_capacities_are_those_of_a_walk(spark, monkeypatch):
    r = random.Random(3)
    rows = [(p, f"{side}{r.randrange(n)}", cap) for p in range(300) for side, n, cap in (("a", 40, 2), ("b", 60, 1), ("c", 3, 70))] + [(1000 + i, f"d{j}", 1) for i in range(60) for j in (i, i + 1)]
    table = spark.createDataFrame(rows, "position long, key string, cap int")
    want = plain_capacity(rows)
    found = lambda: sorted(x.position for x in walks.within_capacity(table).collect())
    assert found() == want
    for rounds, walked in ((1, 1_000_000), (1, 150), (0, 1_000_000)):
        monkeypatch.setattr(walks, "ROUNDS", rounds)
        monkeypatch.setattr(walks, "WALKED", walked)
        if rounds or walked > 900:
            assert found() == want
    assert walks.within_capacity(table.limit(0)).collect() == []


def test_a_long_chain_settles_in_few_rounds(spark, monkeypatch):
    n, tables = 30_000, []
    keep = checkpoints.written
    for module in (walks, components):
        monkeypatch.setattr(module, "written", lambda df: tables.append(1) or keep(df))
    pairs = spark.range(n).select(F.col("id").alias("position"), F.concat(F.lit("x"), F.col("id")).alias("l"), F.concat(F.lit("x"), F.col("id") + 1).alias("r"))
    won = gates.exclusive(pairs, "l", "r", "position").where("won")
    assert won.agg(F.count("*"), F.sum(F.col("position") % 2)).first() == (n // 2, 0)
    # three tables a round at most
    assert len(tables) < 90


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 7), (9, 8), (None, 4), *((20 + i, 21 + i) for i in range(200)), *((500, 600 + i) for i in range(300))]
    found = {x.node: x.component for x in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 7: 7, 8: 8, 9: 8} | {i: 20 for i in range(20, 221)} | {i: 500 for i in (500, *range(600, 900))}
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_novel_rows_are_those_of_a_walk(spark, monkeypatch):
    r = random.Random(9)
    rows = [(r.choice("ab"), p, r.randrange(25)) for p in range(60) for _ in range(r.randint(1, 4))] + [("c", i, j) for i in range(40) for j in (i, i + 1)] + [("d", 1, None), ("d", 2, None)]
    table = spark.createDataFrame(rows + rows[:9], "group string, position int, item int")
    want, used = [], {}
    for g, p in sorted({(g, p) for g, p, _ in rows}):
        items = {i for a, b, i in rows if (a, b) == (g, p)}
        if items - used.setdefault(g, set()):
            used[g] |= items
            want.append((g, p))
    found = lambda rows: sorted(tuple(x) for x in walks.admitted(rows).collect())
    assert found(table) == want and found(table.limit(0)) == []
    monkeypatch.setattr(walks, "WALKED", 70)
    whole = table.where("item is not null")
    assert found(whole) == [x for x in want if x[0] != "d"]
