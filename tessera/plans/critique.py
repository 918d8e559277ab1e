"""Queries over critiques: orders are findings of a customer group's cell, their line items citations and retrievals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import critique as cr
from tessera.sources.tables import table

SETUPS = ["line1", "line2", "line3"]
ORDER, SEVERITIES = ["F", "O"], ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def _findings(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 400).alias("cell"), F.col("o_orderkey").alias("finding"))


def _citations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding"), (F.col("l_partkey") % 500).alias("chunk"))


def _retrieved(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity > 3 and l_orderkey % 40 <> 7").select(F.col("l_orderkey").alias("finding"), (F.col("l_partkey") % 500).alias("chunk"))


def _conflicts(spark, sf_dir):
    return spark.range(250).select(F.col("id").alias("conflict"), (F.col("id") * 2).alias("chunk_a"), (F.col("id") * 2 + 1).alias("chunk_b"))


def _matches(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("finding"), (F.col("o_orderkey") % 17).alias("criterion"))


def _criteria(spark, sf_dir):
    return spark.range(20).select(F.col("id").alias("criterion"), (F.col("id") % 6).alias("group"))


def gate_verdicts(spark, sf_dir):
    return cr.gate(_findings(spark, sf_dir), _retrieved(spark, sf_dir))


def grounded_findings(spark, sf_dir):
    return cr.grounded(_findings(spark, sf_dir), _citations(spark, sf_dir), _retrieved(spark, sf_dir))


def held_out_leaks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    outputs = d.select("lang", (F.col("doc_id") % 20).alias("cell"), F.concat(F.when(F.col("doc_id") % 9 > 0, "chunk:").otherwise("part:"), "source", F.lit(":"), "doc_id").alias("chunk"))
    return cr.leaks(outputs.drop("lang"), d.where("source in ('src1', 'src12')").select(F.col("source").alias("video")))


def conflict_coverage(spark, sf_dir):
    return cr.contested_coverage(_conflicts(spark, sf_dir), _findings(spark, sf_dir), _citations(spark, sf_dir), _retrieved(spark, sf_dir))


def group_recall(spark, sf_dir):
    return cr.grouped_recall(_criteria(spark, sf_dir), _matches(spark, sf_dir).join(_findings(spark, sf_dir), "finding").select("cell", "criterion"))


def critique_scores(spark, sf_dir):
    return cr.scored(_findings(spark, sf_dir), _citations(spark, sf_dir), _retrieved(spark, sf_dir), _matches(spark, sf_dir), _criteria(spark, sf_dir))


def retrieval_sets(spark, sf_dir):
    return cr.provenance_sets(_retrieved(spark, sf_dir), _findings(spark, sf_dir))


def finding_provenance(spark, sf_dir):
    return cr.with_provenance(_findings(spark, sf_dir), _retrieved(spark, sf_dir))


def fabricated_citations(spark, sf_dir):
    return cr.fabricated(_citations(spark, sf_dir), table(spark, sf_dir, "part").where("p_partkey % 500 < 450").select((F.col("p_partkey") % 500).alias("chunk"))).select("finding", "chunk")


def citation_checks(spark, sf_dir):
    cites = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citation"), F.when(F.col("l_orderkey") % 6 > 0, F.col("l_partkey")).alias("chunk"), (F.col("l_quantity").cast("double") / 50).alias("ratio"))
    return cr.checked(cites)


def match_ballots(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    repeats = e.select(F.lit(1).alias("run"), (F.col("user_id") % 300).alias("criterion"), F.when((F.col("event_type") != "error") & (F.col("user_id") % 300 > 9), F.col("event_type")).alias("choice"))
    chosen = e.where("event_type <> 'view'").groupBy((F.col("user_id") % 300).alias("criterion")).agg(F.max("event_type").alias("choice"))
    return cr.ballots(repeats, chosen)


def _cells(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).alias("judge"), (F.col("l_orderkey") % 500).alias("question"), F.concat(F.lit("line"), "l_linenumber").alias("setup"), F.col("l_linenumber").alias("position"), F.col("l_discount").cast("double").alias("d"), "l_returnflag")
    return rows.groupBy("judge", "question", "setup", "position").agg(F.when(F.max("l_returnflag") != "R", F.max("d")).alias("composite"))


def judge_winners(spark, sf_dir):
    return cr.winners_by_judge(_cells(spark, sf_dir))


def matrix_questions(spark, sf_dir):
    cells = _cells(spark, sf_dir).where("judge = 0").select("question", "setup", F.concat(F.lit("a"), "question").alias("answer"), F.col("composite").alias("score"))
    return cr.question_rows(cells, SETUPS)


def extraction_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    labels = d.select(F.col("doc_id").alias("chunk"), F.array("lang", "source", F.lit("nothing")).alias("entities"), F.array(F.array(F.lit("the"), F.lit("and")), F.array(F.lit("de"), F.lit("le"))).alias("keywords"))
    found = d.where("doc_id % 8 > 0").select(F.col("doc_id").alias("chunk"), F.array(F.substring("lang", 1, 1), F.concat("source", F.lit("-x"))).alias("found"), F.split("text", "\n").alias("claims"))
    return cr.extraction_recall(labels, found)


def _pairs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    gate = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return li.select((F.col("l_suppkey") % 5).alias("channel_a"), (F.col("l_partkey") % 5).alias("channel_b"), F.col("l_linenumber").alias("votes"), F.lit(4).alias("repeats"), F.when(F.col("l_linestatus") == "O", "factual").alias("axis"), gate.alias("gate"), F.col("l_discount").cast("double").alias("ratio"))


def conflict_totals(spark, sf_dir):
    return cr.conflict_statistics(_pairs(spark, sf_dir))


def vote_samples(spark, sf_dir):
    votes = table(spark, sf_dir, "events").select((F.col("user_id") % 500).alias("pair"), F.col("event_id").alias("attempt"), (F.col("event_type") == "click").alias("conflict"))
    return cr.subsample_verdicts(votes)


def pair_ledger(spark, sf_dir):
    candidates = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), (F.col("c_custkey") * 7).alias("pair"))
    votes = table(spark, sf_dir, "events").select(F.col("user_id").alias("pair"), F.when(F.col("event_type") == "click", "conflict").when(F.col("event_type") == "view", "other").alias("verdict"))
    return cr.vote_ledger(candidates, votes)


def verdict_order(spark, sf_dir):
    verdicts = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("document"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderpriority").alias("severity"), (F.col("o_orderkey") % 13).alias("position"), F.col("o_orderkey").alias("rule"))
    return cr.verdicts_sorted(verdicts, ORDER, SEVERITIES, "document").select("document", "rule", "place")


QUERIES = {f.__name__: f for f in (gate_verdicts, grounded_findings, held_out_leaks, conflict_coverage, group_recall, critique_scores, retrieval_sets, finding_provenance, fabricated_citations, citation_checks, match_ballots, judge_winners, matrix_questions, extraction_scores, conflict_totals, vote_samples, pair_ledger, verdict_order)}

_BASE = """fin AS (SELECT o_custkey % 400 AS cell, o_orderkey AS finding FROM orders),
cit AS (SELECT DISTINCT l_orderkey AS finding, l_partkey % 500 AS chunk FROM lineitem),
ret AS (SELECT l_orderkey AS finding, l_partkey % 500 AS chunk FROM lineitem WHERE l_quantity > 3 AND l_orderkey % 40 <> 7),
gat AS (SELECT cell, count(*) AS findings, count(*) FILTER (finding NOT IN (SELECT finding FROM ret)) AS without FROM fin GROUP BY cell),
own AS (SELECT cell, min(finding) AS finding FROM (SELECT DISTINCT cell, finding, chunk FROM cit JOIN fin USING (finding) WHERE (finding, chunk) IN (SELECT (finding, chunk) FROM ret)) GROUP BY cell, chunk HAVING count(*) = 1),
gro AS (SELECT cell, finding, count(o) AS owned, count(o) > 0 AS grounded FROM fin LEFT JOIN (SELECT cell, finding, 1 AS o FROM own) USING (cell, finding) GROUP BY cell, finding),
mat AS (SELECT o_orderkey AS finding, o_orderkey % 17 AS criterion FROM orders WHERE o_orderkey % 3 = 0)"""
_CELLS = """cells AS (SELECT l_suppkey % 3 AS judge, l_orderkey % 500 AS question, 'line' || l_linenumber AS setup, l_linenumber AS position, CASE WHEN max(l_returnflag) <> 'R' THEN max(l_discount::DOUBLE) END AS composite FROM lineitem GROUP BY ALL)"""
ORACLE = {
    "gate_verdicts": f"WITH {_BASE} SELECT *, without = 0 AS gradable FROM gat",
    "grounded_findings": f"WITH {_BASE} SELECT * FROM gro",
    "held_out_leaks": "SELECT doc_id % 20 AS cell, source AS video, count(DISTINCT doc_id) AS chunks FROM documents WHERE doc_id % 9 > 0 AND source IN ('src1', 'src12') GROUP BY ALL",
    "conflict_coverage": f"""WITH {_BASE}, con AS (SELECT range AS conflict FROM range(250)), had AS (SELECT DISTINCT cell, chunk FROM ret JOIN fin USING (finding)), cf AS (SELECT cell, finding, chunk FROM cit JOIN fin USING (finding)),
      av AS (SELECT cell, conflict FROM con JOIN had ON chunk = conflict * 2 WHERE (cell, conflict * 2 + 1) IN (SELECT (cell, chunk) FROM had)),
      na AS (SELECT DISTINCT cell, conflict FROM con JOIN cf ON chunk = conflict * 2 WHERE (finding, conflict * 2 + 1) IN (SELECT (finding, chunk) FROM cf) AND (cell, conflict) IN (SELECT (cell, conflict) FROM av))
      SELECT cell, coalesce(a, 0) AS available, coalesce(n, 0) AS named, round(coalesce(n, 0) / a, 4) AS coverage FROM (SELECT DISTINCT cell FROM fin) LEFT JOIN (SELECT cell, count(*) AS a FROM av GROUP BY cell) USING (cell) LEFT JOIN (SELECT cell, count(*) AS n FROM na GROUP BY cell) USING (cell)""",
    "group_recall": f"WITH {_BASE} SELECT cell, count(DISTINCT criterion % 6) AS reached, 6::BIGINT AS total, round(count(DISTINCT criterion % 6) / 6, 4) AS recall FROM mat JOIN fin USING (finding) GROUP BY cell",
    "critique_scores": f"""WITH {_BASE}, h AS (SELECT cell, count(DISTINCT criterion) AS hit FROM mat JOIN gro USING (finding) WHERE grounded GROUP BY cell), l AS (SELECT cell, count(DISTINCT criterion) AS loose FROM mat JOIN fin USING (finding) GROUP BY cell),
      p AS (SELECT cell, round(count(*) FILTER (grounded) / count(*), 4) AS p FROM gro GROUP BY cell), v AS (SELECT cell, round(count(*) FILTER ((finding, chunk) IN (SELECT (finding, chunk) FROM ret)) / count(*), 4) AS v FROM cit JOIN fin USING (finding) GROUP BY cell)
      SELECT cell, without = 0 AS gradable, CASE WHEN without = 0 THEN round(coalesce(hit, 0) / 20, 4) END AS criteria_recall, CASE WHEN without = 0 THEN p END AS evidence_precision, CASE WHEN without = 0 THEN v END AS provenance, round(coalesce(loose, 0) / 20, 4) AS ungated_recall, p AS ungated_precision
      FROM gat LEFT JOIN h USING (cell) LEFT JOIN l USING (cell) JOIN p USING (cell) LEFT JOIN v USING (cell)""",
    "retrieval_sets": f"WITH {_BASE}, s AS (SELECT finding, list_sort(list(chunk)) AS c FROM ret GROUP BY finding) SELECT cell, count(*) AS findings, count(DISTINCT c) AS sets FROM s JOIN fin USING (finding) GROUP BY cell",
    "finding_provenance": f"WITH {_BASE} SELECT cell, finding, n AS chunks, f AS first FROM fin LEFT JOIN (SELECT finding, count(*) AS n, min(chunk) AS f FROM ret GROUP BY finding) USING (finding)",
    "fabricated_citations": "SELECT l_orderkey AS finding, l_partkey % 500 AS chunk FROM lineitem WHERE l_partkey % 500 NOT IN (SELECT p_partkey % 500 FROM part WHERE p_partkey % 500 < 450)",
    "citation_checks": "SELECT citation, chunk, ratio, CASE WHEN chunk IS NULL THEN 'no_chunk' WHEN ratio >= 0.8 THEN 'resolved' ELSE 'below' END AS outcome FROM (SELECT l_orderkey AS citation, CASE WHEN l_orderkey % 6 > 0 THEN l_partkey END AS chunk, CASE WHEN l_orderkey % 6 > 0 THEN l_quantity::DOUBLE / 50 END AS ratio, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey DESC) AS n FROM lineitem) WHERE n = 1",
    "match_ballots": """WITH r AS (SELECT user_id % 300 AS criterion, CASE WHEN event_type <> 'error' AND user_id % 300 > 9 THEN event_type END AS choice FROM events), c AS (SELECT user_id % 300 AS criterion, max(event_type) AS chosen FROM events WHERE event_type <> 'view' GROUP BY 1)
      SELECT criterion, choice, count(*) AS votes, any_value(chosen) AS chosen, choice IS NOT DISTINCT FROM any_value(chosen) AS agrees FROM r LEFT JOIN c USING (criterion) WHERE criterion IN (SELECT criterion FROM r WHERE choice IS NOT NULL) GROUP BY criterion, choice""",
    "judge_winners": f"WITH {_CELLS} SELECT judge, question, setup, composite FROM (SELECT *, count(*) OVER (PARTITION BY judge, question) AS n, row_number() OVER (PARTITION BY judge, question ORDER BY composite DESC, position) AS p FROM cells WHERE composite IS NOT NULL) WHERE n >= 2 AND p = 1",
    "matrix_questions": f"WITH {_CELLS} SELECT question, " + ", ".join(f"max('a' || question) FILTER (setup = '{s}') AS answer_{s}, max(composite) FILTER (setup = '{s}') AS score_{s}" for s in SETUPS) + ", count(*) AS answered FROM cells WHERE judge = 0 GROUP BY question",
    "extraction_scores": """WITH d AS (SELECT doc_id, doc_id % 8 = 0 AS failed, lang, source, string_split(lower(text), chr(10)) AS claims FROM documents)
      SELECT doc_id AS chunk, failed, CASE WHEN NOT failed THEN round(((contains(lang, substr(lang, 1, 1)))::INT + 1) / 3, 4) END AS entity_recall,
      CASE WHEN NOT failed THEN round((list_bool_or(list_transform(claims, lambda c: contains(c, 'the') AND contains(c, 'and')))::INT + list_bool_or(list_transform(claims, lambda c: contains(c, 'de') AND contains(c, 'le')))::INT) / 2, 4) END AS claim_recall FROM d""",
    "conflict_totals": """SELECT count(*) AS candidates, count(*) FILTER (c) AS conflicts, count(*) FILTER (c AND a) AS across, count(*) FILTER (c AND NOT a) AS within, count(*) FILTER (c AND l_linenumber = 4) AS unanimous, count(*) FILTER (c AND l_linenumber < 4) AS split,
      count(*) FILTER (c AND l_linestatus = 'O') AS factual, round(count(*) FILTER (c) / count(*), 4) AS precision, min(l_discount::DOUBLE) FILTER (c) AS least_ratio FROM (SELECT *, l_returnflag = 'N' AS c, l_suppkey % 5 <> l_partkey % 5 AS a FROM lineitem)""",
    "vote_samples": "SELECT pair, sample, votes, 2 * votes > 3 AS carried FROM (SELECT pair, sample, count(*) AS n, count(*) FILTER (event_type = 'click') AS votes FROM (SELECT user_id % 500 AS pair, event_type, ((row_number() OVER (PARTITION BY user_id % 500 ORDER BY event_id) - 1) // 3)::BIGINT AS sample FROM events) GROUP BY ALL) WHERE n = 3",
    "pair_ledger": "SELECT c_custkey AS position, c_custkey * 7 AS pair, count(user_id) AS repeats, count(*) FILTER (event_type = 'click') AS votes, count(*) FILTER (user_id IS NOT NULL AND event_type NOT IN ('click', 'view')) AS errors FROM customer LEFT JOIN events ON user_id = c_custkey * 7 GROUP BY c_custkey",
    "verdict_order": "SELECT o_custkey % 100 AS document, o_orderkey AS rule, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END, o_orderkey % 13, o_orderkey) AS place FROM orders",
}
