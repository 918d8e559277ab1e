"""Queries over whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import composites as co
from tessera.operators import retrieval
from tessera.plans import critique as cq
from tessera.plans.decisions import _judged
from tessera.plans.links import _CHUNKED, _END
from tessera.plans.retrieval import _DENSE, _SIM, LEXICAL, _docs, _golden, _items, _vectors
from tessera.plans.rollups import _VOTES, _votes
from tessera.sources.tables import table

RUBRICS = {"v1": "first", "v2": "second"}


def index_runs(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("video"), F.filter(F.split("text", "\n"), lambda x: x != "").alias("lines"))
    stored = _docs(spark, sf_dir).select(F.col("doc_id").alias("video"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("video", F.concat_ws(":", F.lit("chunk"), "video", "i").alias("chunk"))
    return co.indexed(docs, stored)


def line_claims(spark, sf_dir):
    return co.claims_from_chunks(_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk"), F.col("source").alias("video"), F.split("text", "\n").alias("said"))).drop("text")


def _hits(spark, sf_dir, scope=None):
    docs = _docs(spark, sf_dir)
    found = retrieval.bm25(docs, _items(spark, sf_dir), k=10)
    named = found.join(docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("video"), "lang"), "doc")
    return named if scope is None else named.where(scope)


def _expected(spark, sf_dir):
    return _golden(spark, sf_dir).join(_docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("source").alias("video")), "doc")


def entry_evaluation(spark, sf_dir):
    return co.evaluated(_hits(spark, sf_dir), _expected(spark, sf_dir), _items(spark, sf_dir), 5)


def filtered_evaluation(spark, sf_dir):
    arms = {"all": _hits(spark, sf_dir), "english": _hits(spark, sf_dir, "lang = 'en'")}
    return co.arms_evaluated(arms, _expected(spark, sf_dir), _items(spark, sf_dir), 10)


def conflict_layer(spark, sf_dir):
    candidates = _judged(spark, sf_dir).drop("votes", "repeats").withColumn("pair", F.col("position") % 997)
    return co.conflict_layer(candidates, _votes(spark, sf_dir)).select("position", "votes", "repeats", F.when(F.col("gate") != "duplicate_evidence", F.col("gate")).alias("early"))


def calibration_probes(spark, sf_dir):
    probes = spark.range(1000).select(F.col("id").alias("pair"), F.when(F.col("id") % 2 == 0, "conflict").otherwise("unrelated").alias("expected"))
    return co.calibration(probes, _votes(spark, sf_dir))


def replayed_choices(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    recorded = e.groupBy((F.col("user_id") % 5).alias("run"), (F.col("user_id") % 200).alias("criterion")).agg(F.min(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("choice"))
    asked = spark.range(1250).select((F.col("id") % 5).alias("run"), F.floor(F.col("id") / 5).alias("criterion"))
    return co.replayed(asked, recorded)


def ablation_table(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cells = li.select(F.concat(F.lit("arm"), F.col("l_linenumber")).alias("arm"), F.col("l_returnflag").alias("metric"), F.when(F.col("l_orderkey") % 9 > 0, F.col("l_quantity").cast("double")).alias("value"))
    return co.ablation_rows(cells, "arm1")


def rescored_run(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 500).alias("cell")).distinct().withColumn("recall", F.lit(0.1))
    return co.rescored(stored, cq._findings(spark, sf_dir), cq._citations(spark, sf_dir), cq._retrieved(spark, sf_dir), cq._matches(spark, sf_dir), cq._criteria(spark, sf_dir))


def answer_pairs(spark, sf_dir):
    answers = _vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 4).alias("question"), F.element_at(F.array(*map(F.lit, ["one", "two", "three", "four"])), (F.col("vec_id") % 4 + 1).cast("int")).alias("setup"), F.col("embedding").alias("vector")).where("question % 9 > 0 or setup <> 'two'")
    return co.answer_likeness(answers, [("one", "two"), ("one", "three")])


def frontier(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    gaps = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("gap"), F.col("embedding").alias("vector"))
    rows = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return co.frontier_round(gaps, rows, rows.where("id % 3 = 0"), 3)


def runner_requests(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return co.single_flight(o.select((F.col("o_custkey") % 100).alias("runner"), F.col("o_orderkey").alias("request"), F.col("o_orderkey").cast("double").alias("at"), (F.col("o_custkey") % 700).cast("double").alias("takes")))


def context_blocks(spark, sf_dir):
    return co.context_block(_docs(spark, sf_dir).select((F.col("doc_id") % 200).alias("answer"), F.col("doc_id").alias("place"), "text"), 3000)


def rubric_versions(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", co.rubric_version(F.concat(F.lit("v"), F.col("n_nationkey")), RUBRICS).alias("rubric"))


def published_packs(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    old = n.where("n_nationkey < 20").select(F.col("n_nationkey").alias("pack"), F.lit(3).alias("version"), F.lit("old").alias("rules"))
    return co.published(old, n.where("n_nationkey > 4").select(F.col("n_nationkey").alias("pack"), (F.col("n_nationkey") % 5 + 1).cast("int").alias("version"), F.lit("new").alias("rules")))


QUERIES = {f.__name__: f for f in (index_runs, line_claims, entry_evaluation, filtered_evaluation, conflict_layer, calibration_probes, replayed_choices, ablation_table, rescored_run, answer_pairs, frontier, runner_requests, context_blocks, rubric_versions, published_packs)}

_EVAL = """hv AS (SELECT query_id, rank, doc, source AS video, lang FROM bm JOIN (SELECT doc_id AS doc, source, lang FROM documents) USING (doc) WHERE rank <= 10),
gv AS (SELECT query_id, doc, source AS video FROM golden JOIN (SELECT doc_id AS doc, source FROM documents) USING (doc))"""


def _evaluated(hits: str, k: int) -> str:
    return f"""(SELECT item_id AS query_id, round(coalesce(d, 0) / docs, 4) AS recall, round(coalesce(v, 0) / videos, 4) AS video_recall, n IS NOT NULL AS answered FROM benchmark
      LEFT JOIN (SELECT query_id, count(DISTINCT doc) AS docs, count(DISTINCT video) AS videos FROM gv GROUP BY query_id) a ON a.query_id = item_id
      LEFT JOIN (SELECT query_id, count(DISTINCT doc) AS d FROM {hits} JOIN gv USING (query_id, doc) WHERE rank <= {k} GROUP BY query_id) b ON b.query_id = item_id
      LEFT JOIN (SELECT h.query_id, count(DISTINCT h.video) AS v FROM {hits} h JOIN gv g ON g.query_id = h.query_id AND g.video = h.video WHERE h.rank <= {k} GROUP BY h.query_id) c ON c.query_id = item_id
      LEFT JOIN (SELECT query_id, count(*) AS n FROM {hits} GROUP BY query_id) e ON e.query_id = item_id)"""


_ENGLISH = "(SELECT * FROM hv WHERE lang = 'en')"
ORACLE = {
    "index_runs": f"SELECT doc_id AS video, count(*) AS stored, greatest(0, 5 - count(*)) AS removed FROM ({_CHUNKED.replace('{end0}', _END.replace('{a}', '0')).replace('{end}', _END.replace('{a}', 'a'))}) GROUP BY doc_id",
    "line_claims": "SELECT 'claim:' || substr(sha256(doc_id || chr(10) || x), 1, 16) AS claim, doc_id::VARCHAR AS chunk, source AS video FROM (SELECT DISTINCT doc_id, source, trim(x) AS x FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM documents)) WHERE x <> ''",
    "entry_evaluation": f"WITH {LEXICAL}, {_EVAL} SELECT * FROM {_evaluated('hv', 5)}",
    "filtered_evaluation": f"WITH {LEXICAL}, {_EVAL} SELECT arm, round(avg(recall), 4) AS recall, round(avg(video_recall), 4) AS video_recall, count(*) FILTER (answered) AS answered FROM (SELECT *, 'all' AS arm FROM {_evaluated('hv', 10)} UNION ALL SELECT *, 'english' FROM {_evaluated(_ENGLISH, 10)}) GROUP BY arm",
    "conflict_layer": f"""WITH {_VOTES}, t AS (SELECT pair, (count(*) FILTER (verdict = 'conflict'))::INT AS votes, count(*)::INT AS repeats FROM votes GROUP BY pair), j AS (SELECT o_orderkey AS k, coalesce(votes, 0)::INT AS votes, coalesce(repeats, 0)::INT AS repeats FROM orders LEFT JOIN t ON pair = o_orderkey % 997)
      SELECT k AS position, votes, repeats, CASE WHEN votes = 0 THEN 'not_a_conflict' WHEN 2 * votes <= repeats THEN 'minority_verdict' WHEN k % 5 = 0 THEN 'unstated_axis' WHEN k % 6 = 0 THEN 'quote_not_in_transcript' WHEN k % 7 = 1 THEN 'quote_is_not_a_position' END AS early FROM j""",
    "calibration_probes": f"WITH {_VOTES}, t AS (SELECT pair, 2 * count(*) FILTER (verdict = 'conflict') > count(*) AS carried FROM votes GROUP BY pair) SELECT range AS pair, CASE WHEN range % 2 = 0 THEN 'conflict' ELSE 'unrelated' END AS expected, carried, coalesce((range % 2 = 0) = carried, false) AS ok FROM range(1000) LEFT JOIN t ON pair = range",
    "replayed_choices": "SELECT run, criterion, choice, n IS NULL AS missing FROM (SELECT range % 5 AS run, range // 5 AS criterion FROM range(1250)) LEFT JOIN (SELECT user_id % 5 AS run, user_id % 200 AS criterion, min(event_id) FILTER (event_type = 'click') AS choice, count(*) AS n FROM events GROUP BY ALL) USING (run, criterion)",
    "ablation_table": """WITH c AS (SELECT 'arm' || l_linenumber AS arm, l_returnflag AS metric, l_quantity::DOUBLE AS v FROM lineitem WHERE l_orderkey % 9 > 0),
      s AS (SELECT arm, metric, max(CASE WHEN i = floor(n / 2)::BIGINT + 1 THEN v END) AS value, min(v) AS low, max(v) AS high, count(*) AS repeats FROM (SELECT *, row_number() OVER (PARTITION BY arm, metric ORDER BY v) AS i, count(*) OVER (PARTITION BY arm, metric) AS n FROM c) GROUP BY arm, metric)
      SELECT s.arm, s.metric, s.value, s.low, s.high, s.repeats, round(s.value - b.value, 4) AS delta, CASE WHEN s.arm <> 'arm1' THEN s.low > b.high END AS beats FROM s LEFT JOIN s b ON b.metric = s.metric AND b.arm = 'arm1'""",
    "rescored_run": f"SELECT cell, 0.1::DOUBLE AS stored, criteria_recall AS now, criteria_recall IS NOT DISTINCT FROM 0.1 AS same FROM (SELECT DISTINCT c_custkey % 500 AS cell FROM customer) LEFT JOIN ({cq.ORACLE['critique_scores']}) USING (cell)",
    "answer_pairs": """WITH a AS (SELECT vec_id // 4 AS question, vec_id % 4 AS s, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE (vec_id // 4) % 9 > 0 OR vec_id % 4 <> 1)
      SELECT question, unnest(['one|two', 'one|three']) AS pair, unnest([round(list_cosine_similarity(max(v) FILTER (s = 0), max(v) FILTER (s = 1)), 6), round(list_cosine_similarity(max(v) FILTER (s = 0), max(v) FILTER (s = 2)), 6)]) AS likeness FROM a GROUP BY question""",
    "frontier": f"""WITH RECURSIVE {_DENSE}, n AS (SELECT query_id, list(vec_id) AS items FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {_SIM} DESC, vec_id) AS r FROM q, e WHERE vec_id % 3 > 0) WHERE r <= 3 GROUP BY query_id),
      o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY query_id) AS n FROM n),
      w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS used, false AS ok UNION ALL SELECT n, CASE WHEN new THEN list_concat(used, items) ELSE used END, new FROM (SELECT o.n, items, used, NOT list_has_all(used, items) AS new FROM w JOIN o ON o.n = w.n + 1))
      SELECT query_id AS gap, unnest(items) AS chunk FROM o JOIN w USING (n) WHERE ok""",
    "runner_requests": """WITH RECURSIVE r AS MATERIALIZED (SELECT o_custkey % 100 AS runner, o_orderkey AS request, o_custkey % 700 AS takes, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS n FROM orders),
      w AS (SELECT runner, 0::BIGINT AS n, -1::BIGINT AS until, false AS ok FROM r GROUP BY runner UNION ALL SELECT r.runner, r.n, CASE WHEN request >= until THEN request + takes ELSE until END, request >= until FROM w JOIN r ON r.runner = w.runner AND r.n = w.n + 1)
      SELECT r.runner, request, ok AS started FROM r JOIN w ON r.runner = w.runner AND r.n = w.n""",
    "context_blocks": "SELECT answer, count(*) FILTER (upto <= 3000) AS parts, coalesce(max(upto) FILTER (upto <= 3000), 0)::BIGINT AS chars, count(*) FILTER (upto > 3000) AS cut FROM (SELECT doc_id % 200 AS answer, sum(length(text)) OVER (PARTITION BY doc_id % 200 ORDER BY doc_id) AS upto FROM documents) GROUP BY answer",
    "rubric_versions": "SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'second' ELSE 'first' END AS rubric FROM nation",
    "published_packs": "SELECT n_nationkey AS pack, (CASE WHEN n_nationkey > 19 OR (n_nationkey > 4 AND n_nationkey % 5 + 1 >= 3) THEN n_nationkey % 5 + 1 ELSE 3 END)::INT AS version, CASE WHEN n_nationkey > 19 OR (n_nationkey > 4 AND n_nationkey % 5 + 1 >= 3) THEN 'new' ELSE 'old' END AS rules FROM nation",
}
