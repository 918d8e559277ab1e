"""Queries over rule packs: parts stand for rules, line items for their evidence, suppliers for runs and return flags for arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import packs
from tessera.sources.tables import table

BUDGET = 1000
THRESHOLD = 0.85


def pack_statistics(spark, sf_dir):
    rules = table(spark, sf_dir, "part").select(F.col("p_brand").alias("pack"), F.col("p_partkey").alias("rule"), (F.col("p_size") > 40).alias("contested"))
    evidence = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("rule"), F.col("l_suppkey").alias("video"), F.when(F.col("l_linenumber") != 7, (F.col("l_suppkey") % 10).cast("string")).alias("creator"), (F.col("l_quantity") / 50).cast("double").alias("ratio")
    )
    return packs.pack_statistics(rules, evidence, "pack")


def shared_budget(spark, sf_dir):
    return packs.shared_budget(table(spark, sf_dir, "part").withColumn("ok", F.col("p_size") >= 25), "p_brand", "ok", BUDGET)


def corpus_staleness(spark, sf_dir):
    """How far the orders' finished part is behind all orders, by customer."""
    orders = table(spark, sf_dir, "orders")
    return packs.staleness(orders.where("o_orderstatus = 'F'"), orders, "o_custkey")


def _found(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_partkey").alias("rule"), F.col("l_orderkey").alias("chunk"))
    return packs.rediscovered(items.where("l_returnflag <> 'R'"), items.where("l_returnflag = 'R'"))


def rediscovered_rules(spark, sf_dir):
    return _found(spark, sf_dir)


def rediscovery_rate(spark, sf_dir):
    return packs.rediscovery_rate(_found(spark, sf_dir))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("gap"))


def restatement_audit(spark, sf_dir):
    """Vectors with an id divisible by 50 as added rules, all others as prior ones."""
    v = _vectors(spark, sf_dir)
    return packs.nearest_prior(v.where("id % 50 = 0"), v.where("id % 50 <> 0"), THRESHOLD)


def gap_closure(spark, sf_dir):
    """The first vector of each label as a gap; the others are prior rules (even ids) or came from its label's probe (odd ids)."""
    v = _vectors(spark, sf_dir)
    gaps = v.groupBy("gap").agg(F.min(F.struct("id", "vector")).alias("g")).select(F.col("gap").alias("id"), F.col("g.vector").alias("vector"), F.col("g.id").alias("row"))
    rest = v.join(gaps.select(F.col("row").alias("id")), "id", "left_anti")
    return packs.gap_closure(gaps, rest.where("id % 2 = 0"), rest.where("id % 2 = 1"))


def _cells(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_returnflag").alias("arm")).agg(F.sum(q).alias("value"), F.max(q).alias("m"), F.count("*").alias("n"))
    repeated = lambda c: F.when(F.col("n") % 5 != 0, c)
    return per.select("run", "arm", F.when(F.col("n") % 7 != 0, F.col("value")).alias("value"), repeated(F.col("value") - F.col("m")).alias("low"), repeated(F.col("value") + F.col("m")).alias("high"))


def arm_winner(spark, sf_dir):
    return packs.arm_winner(_cells(spark, sf_dir), "run")


def arms_against_baseline(spark, sf_dir):
    return packs.arms_against(_cells(spark, sf_dir), "run", "A")


QUERIES = {f.__name__: f for f in (pack_statistics, shared_budget, corpus_staleness, rediscovered_rules, rediscovery_rate, restatement_audit, gap_closure, arm_winner, arms_against_baseline)}

_FOUND = """items AS (SELECT l_returnflag = 'R' AS old, l_partkey AS rule, l_orderkey AS chunk FROM lineitem),
  met AS (SELECT a.rule, count(DISTINCT b.rule) AS n FROM items a JOIN items b USING (chunk) WHERE NOT a.old AND b.old GROUP BY a.rule),
  found AS (SELECT rule, coalesce(n, 0) AS already_in_shipped FROM (SELECT DISTINCT rule FROM items WHERE NOT old) LEFT JOIN met USING (rule))"""
_CELLS = """raw AS (SELECT l_suppkey AS run, l_returnflag AS arm, sum(l_quantity::DOUBLE) AS v, max(l_quantity::DOUBLE) AS m, count(*) AS n FROM lineitem GROUP BY ALL),
  cells AS (SELECT run, arm, CASE WHEN n % 7 <> 0 THEN v END AS value, CASE WHEN n % 5 <> 0 THEN v - m END AS low, CASE WHEN n % 5 <> 0 THEN v + m END AS high FROM raw)"""
_LIKE = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"

ORACLE = {
    "pack_statistics": """WITH e AS (SELECT l_partkey AS rule, l_suppkey AS video, CASE WHEN l_linenumber <> 7 THEN (l_suppkey % 10)::VARCHAR ELSE l_suppkey::VARCHAR END AS creator, l_quantity / 50 AS ratio FROM lineitem),
      c AS (SELECT rule, count(DISTINCT creator) AS n FROM e GROUP BY rule),
      r AS (SELECT p_brand AS pack, count(*) AS rubrics, count(*) FILTER (n >= 2) AS multi_creator_rubrics, count(*) FILTER (p_size > 40) AS contested_rubrics FROM part LEFT JOIN c ON rule = p_partkey GROUP BY p_brand),
      q AS (SELECT p_brand AS pack, count(*) AS citations, count(*) FILTER (ratio >= 0.9) AS resolved, count(DISTINCT creator) AS creators, count(DISTINCT video) AS videos FROM part JOIN e ON rule = p_partkey GROUP BY p_brand)
      SELECT pack, rubrics, multi_creator_rubrics, contested_rubrics, coalesce(citations, 0) AS citations, coalesce(resolved, 0) AS resolved, coalesce(creators, 0) AS creators, coalesce(videos, 0) AS videos,
        round(multi_creator_rubrics / rubrics, 4) AS multi_creator_share, coalesce(round(resolved / citations, 4), 0.0) AS quote_resolution FROM r LEFT JOIN q USING (pack)""",
    "shared_budget": f"SELECT least({BUDGET}, min(n)) AS budget FROM (SELECT count(*) AS n FROM part WHERE p_size >= 25 GROUP BY p_brand)",
    "corpus_staleness": """WITH b AS (SELECT count(DISTINCT o_custkey) AS built_videos, count(*) AS built_chunks FROM orders WHERE o_orderstatus = 'F'), l AS (SELECT count(DISTINCT o_custkey) AS live_videos, count(*) AS live_chunks FROM orders)
      SELECT *, live_videos - built_videos AS behind_videos, live_chunks - built_chunks AS behind_chunks, live_chunks = built_chunks AS current FROM b, l""",
    "rediscovered_rules": f"WITH {_FOUND} SELECT * FROM found",
    "rediscovery_rate": f"WITH {_FOUND} SELECT count(*) AS added, count(*) FILTER (already_in_shipped > 0) AS rediscovered, round(count(*) FILTER (already_in_shipped > 0) / count(*), 4) AS rate FROM found",
    "restatement_audit": f"""SELECT id, nearest_prior, round(s, 4) AS likeness, round(s, 4) >= {THRESHOLD} AS near FROM (
      SELECT a.vec_id AS id, b.vec_id AS nearest_prior, {_LIKE} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_LIKE} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0) WHERE r = 1""",
    "gap_closure": f"""WITH g AS (SELECT label::BIGINT AS gap, min(vec_id) AS vec_id FROM embeddings GROUP BY label), a AS (SELECT g.gap, g.vec_id, embedding FROM g JOIN embeddings USING (vec_id)),
      rest AS (SELECT * FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM g)),
      p AS (SELECT gap, max({_LIKE}) AS before FROM a, rest b WHERE b.vec_id % 2 = 0 GROUP BY gap),
      n AS (SELECT gap, b.vec_id, {_LIKE} AS s FROM a JOIN rest b ON b.label = a.gap AND b.vec_id % 2 = 1),
      m AS (SELECT gap, count(*) AS rules, max(s) AS s FROM n GROUP BY gap), w AS (SELECT gap, min(vec_id) AS best_new FROM n JOIN m USING (gap, s) GROUP BY gap)
      SELECT g.gap, coalesce(rules, 0) AS rules, best_new, coalesce(s > coalesce(before, 0), false) AS closed FROM g LEFT JOIN p USING (gap) LEFT JOIN m USING (gap) LEFT JOIN w USING (gap)""",
    "arm_winner": f"""WITH {_CELLS}, placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, arm) AS place, max(value) OVER (PARTITION BY run) AS best FROM cells WHERE value IS NOT NULL),
      per AS (SELECT run, max(arm) FILTER (place = 1) AS leader, max(value) AS value, count(*) FILTER (value = best) AS tied, count(*) AS arms, max(high) FILTER (place > 1) AS runner_up_max FROM placed GROUP BY run)
      SELECT *, basis = 'cleared-spread' AS decisive FROM (SELECT *, CASE WHEN arms = 1 THEN 'single-arm' WHEN tied > 1 THEN 'tied' WHEN runner_up_max IS NULL THEN 'unrepeated' WHEN value > runner_up_max THEN 'cleared-spread' ELSE 'inside-spread' END AS basis FROM per)""",
    "arms_against_baseline": f"""WITH {_CELLS}, b AS (SELECT run, c.arm, c.value, c.low AS arm_min, o.value AS baseline_value, o.high AS baseline_max FROM cells c JOIN cells o USING (run) WHERE c.arm <> 'A' AND o.arm = 'A')
      SELECT *, round(value - baseline_value, 4) AS delta, CASE WHEN value - baseline_value IS NOT NULL THEN arm_min > baseline_max END AS beats_baseline,
        CASE WHEN value - baseline_value IS NULL THEN 'ungraded' WHEN arm_min > baseline_max THEN 'ranges-disjoint' WHEN arm_min <= baseline_max THEN 'ranges-overlap' ELSE 'unrepeated' END AS basis FROM b""",
}
