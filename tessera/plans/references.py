"""Queries over references: customers' orders are what an answer retrieved."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import references as rf
from tessera.sources.tables import table


def _retrieved(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("int")
    return o.select(F.col("o_custkey").alias("answer"), place.alias("place"), F.col("o_orderkey").alias("chunk"))


def _answers(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("answer"), F.when(k % 4 > 0, F.concat(F.lit("see ["), k % 9, F.lit("] and ["), k % 3 + 1, F.lit("]"))).otherwise("nothing").alias("text"))


def _labels(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    return c.select(k.alias("answer"), F.explode(F.array(F.concat(F.lit("["), k % 9, F.lit("]")), F.concat(F.lit("[s2."), k % 3 + 1, F.lit("]")), F.lit("[2]"), F.lit("x"))).alias("label"))


def positional_references(spark, sf_dir):
    return rf.by_position(_labels(spark, sf_dir), _retrieved(spark, sf_dir))


def fallback_references(spark, sf_dir):
    return rf.or_fallback(_answers(spark, sf_dir), _retrieved(spark, sf_dir))


def reference_order(spark, sf_dir):
    return rf.ordered(_labels(spark, sf_dir).distinct())


def _calls(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("session"), F.col("l_orderkey").alias("call"), F.col("l_linenumber").alias("place"), (F.col("l_partkey") % 500).alias("chunk"))


def citation_labels(spark, sf_dir):
    return rf.global_labels(_calls(spark, sf_dir).groupBy("session", "call", "place").agg(F.min("chunk").alias("chunk")))


def repaired_citations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.unix_timestamp("ts").cast("double")
    cites = e.where("event_type = 'purchase'").select((F.col("user_id") % 50).alias("video"), F.col("event_id").alias("citation"), at.alias("at"))
    chunks = e.where("event_type = 'click'").select((F.col("user_id") % 50).alias("video"), F.col("event_id").alias("index"), at.alias("start"))
    return rf.repaired(cites, chunks, 1800.0).select("citation", "index")


def context_merge(spark, sf_dir):
    return rf.merged_contexts(_calls(spark, sf_dir).select(F.col("session").alias("answer"), F.col("call").alias("context"), "place", "chunk"))


def hit_pool(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("query_id"), F.col("l_linenumber").alias("list"), (F.col("l_orderkey") % 300).alias("rank"), (F.col("l_partkey") % 200).alias("doc"))
    return rf.unique_pool(lists)


def resolvable_hits(spark, sf_dir):
    hits = _retrieved(spark, sf_dir).select(F.col("answer").alias("query_id"), F.col("place").cast("long").alias("rank"), F.col("chunk").alias("doc"))
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("source"), F.when(F.col("o_orderkey") % 5 > 0, F.lit("u")).otherwise("").alias("url"))
    return rf.resolvable(hits, records, ["source", "url"])


def null_reranked(spark, sf_dir):
    return rf.null_rerank(_retrieved(spark, sf_dir).select(F.col("answer").alias("query_id"), F.col("place").cast("long").alias("rank"), F.col("chunk").alias("doc")), 5)


def context_savings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rf.compared(F.col("text"), F.substring_index("text", "\n", 1)).alias("c")).select("doc_id", "c.*")


def prompt_contexts(spark, sf_dir):
    rows = _retrieved(spark, sf_dir).select("answer", "place", F.when(F.col("chunk") % 2 == 0, F.lit("[head]")).alias("header"), F.col("chunk").cast("string").alias("text"))
    return rf.prompt_context(rows)


QUERIES = {f.__name__: f for f in (positional_references, fallback_references, reference_order, citation_labels, repaired_citations, context_merge, hit_pool, resolvable_hits, null_reranked, context_savings, prompt_contexts)}

_R = "r AS (SELECT o_custkey AS answer, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS place, o_orderkey AS chunk FROM orders)"
_CALLS = "c AS (SELECT l_suppkey % 40 AS session, l_orderkey AS call, l_linenumber AS place, l_partkey % 500 AS chunk FROM lineitem)"
ORACLE = {
    "positional_references": f"WITH {_R} SELECT answer, place AS number, chunk FROM r WHERE place IN (answer % 9, answer % 3 + 1, 2)",
    "fallback_references": f"WITH {_R}, f AS (SELECT * FROM r WHERE answer % 4 > 0 AND place IN (answer % 9, answer % 3 + 1)) SELECT * FROM f UNION ALL SELECT * FROM r WHERE answer NOT IN (SELECT answer FROM f)",
    "reference_order": """WITH l AS (SELECT DISTINCT c_custkey AS answer, unnest(['[' || c_custkey % 9 || ']', '[s2.' || (c_custkey % 3 + 1) || ']', '[2]', 'x']) AS label FROM customer)
      SELECT answer, label, row_number() OVER (PARTITION BY answer ORDER BY CASE WHEN label = 'x' THEN 2 WHEN label LIKE '[s%' THEN 1 ELSE 0 END, TRY_CAST(regexp_extract(label, '(\\d+)\\]$', 1) AS INT), label) AS position FROM l""",
    "citation_labels": f"""WITH {_CALLS}, d AS (SELECT session, call, place, min(chunk) AS chunk FROM c GROUP BY ALL), f AS (SELECT session, chunk, min(call * 10 + place) AS seen FROM d GROUP BY ALL)
      SELECT session, call, place, chunk, label FROM d JOIN (SELECT session, chunk, row_number() OVER (PARTITION BY session ORDER BY seen, chunk) AS label FROM f) USING (session, chunk)""",
    "repaired_citations": """WITH e AS (SELECT user_id % 50 AS video, event_id, floor(epoch(ts)) AS at, event_type FROM events)
      SELECT citation, index FROM (SELECT p.event_id AS citation, c.event_id AS index, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.at - c.at), c.at, c.event_id) AS n FROM (SELECT * FROM e WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') c ON p.video = c.video AND abs(p.at - c.at) <= 1800) WHERE n = 1""",
    "context_merge": f"WITH {_CALLS} SELECT session AS answer, chunk, row_number() OVER (PARTITION BY session ORDER BY min(call * 10 + place), chunk) AS position FROM c GROUP BY session, chunk",
    "hit_pool": """WITH l AS (SELECT l_suppkey % 40 AS query_id, l_linenumber AS list, l_orderkey % 300 AS rank, l_partkey % 200 AS doc FROM lineitem), f AS (SELECT query_id, doc, min(list * 1000 + rank) AS seen FROM l GROUP BY ALL)
      SELECT query_id, doc, (seen // 1000)::INT AS list, seen % 1000 AS rank, row_number() OVER (PARTITION BY query_id ORDER BY seen, doc) AS position FROM f""",
    "resolvable_hits": f"WITH {_R} SELECT answer AS query_id, place::BIGINT AS rank, chunk AS doc FROM r WHERE chunk % 3 > 0 AND chunk % 5 > 0",
    "null_reranked": f"WITH {_R}, k AS (SELECT * FROM r WHERE place <= 5) SELECT answer AS query_id, place::BIGINT AS rank, chunk AS doc, (max(place) OVER (PARTITION BY answer) - place + 1)::DOUBLE AS score FROM k",
    "context_savings": "SELECT doc_id, a AS full_tokens, b AS short_tokens, coalesce(round(100.0::DOUBLE * (a - b) / nullif(a, 0), 2), 0) AS saved FROM (SELECT doc_id, ceil(length(text) / 4)::BIGINT AS a, ceil(length(split_part(text, chr(10), 1)) / 4)::BIGINT AS b FROM documents)",
    "prompt_contexts": f"WITH {_R} SELECT answer, string_agg('[' || place || '] ' || CASE WHEN chunk % 2 = 0 THEN '[head]' || chr(10) ELSE '' END || chunk, chr(10) || chr(10) ORDER BY place) AS context FROM r GROUP BY answer",
}
