"""Queries over what supplied functions return, made from the tables, and over labels and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import documents as dc
from tessera.functions import text as tx
from tessera.operators import contracts as ct
from tessera.sources.tables import table

INTENTS = {"resume": "how to write a resume", "portfolio": "how to show work", "document": "advice about"}


def _fenced(c):
    return F.concat(F.lit("```json\n"), c, F.lit("\n```"))


def extraction_contract(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    entity = lambda name: F.struct(name.alias("name"), F.lit("kind").alias("type"), F.array(F.lit("x")).alias("aliases"))
    relation = lambda a, b: F.struct(a.alias("source"), b.alias("target"), F.lit("t").alias("type"), F.lit(0.5).alias("weight"))
    claim = lambda c: F.struct(c.alias("text"), F.array("lang").alias("entities"), F.lit("for").alias("polarity"))
    made = F.to_json(F.struct(F.lit("other").alias("chunk_id"), F.array(entity(F.col("lang")), entity(F.lit(" ")), entity(F.col("source"))).alias("entities"), F.array(relation(F.col("lang"), F.upper("source")), relation(F.col("lang"), F.lit("nobody")), relation(F.col("lang"), F.upper("lang"))).alias("relations"), F.array(claim(F.substring_index("text", "\n", 1)), claim(F.lit(""))).alias("claims")))
    said = F.when(F.col("doc_id") % 5 == 0, F.lit("not json {")).when(F.col("doc_id") % 5 < 3, _fenced(made)).otherwise(made)
    got = ct.parsed_extraction(d.select("doc_id", said.alias("said")), "said", ["doc_id"])
    return got.select("doc_id", F.size("entities").cast("long").alias("entities"), F.size("relations").cast("long").alias("relations"), F.size("claims").cast("long").alias("claims"), "error")


def built_graph(spark, sf_dir):
    """Entities of a graph built from extractions of all documents, with their relations and claims counted."""
    from tessera.operators import claims

    d = table(spark, sf_dir, "documents")
    entity = lambda name: F.struct(name.alias("name"), F.lit("kind").alias("type"), F.array(F.upper(name)).alias("aliases"))
    relation = F.struct(F.col("lang").alias("source"), F.col("source").alias("target"), F.lit("t").alias("type"), F.lit(0.5).alias("weight"))
    claim = F.struct(F.col("lang").alias("text"), F.array("source", F.lit("nobody")).alias("entities"), F.lit("for").alias("polarity"))
    made = F.to_json(F.struct(F.array(entity(F.col("lang")), entity(F.col("source"))).alias("entities"), F.array(relation).alias("relations"), F.array(claim, claim).alias("claims")))
    parsed = ct.parsed_extraction(d.select(F.col("doc_id").alias("chunk"), F.col("source").alias("video"), _fenced(made).alias("said")), "said", ["chunk", "video"])
    g = claims.graph_built(parsed)
    ends = g["relations"].groupBy(F.col("dst").alias("entity")).agg(F.count("*").alias("relations"))
    about = g["anchors"].groupBy("entity").agg(F.count("*").alias("claims"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return g["entities"].join(ends, "entity", "left").join(about, "entity", "left").select("entity", "name", F.array_join("aliases", ",").alias("aliases"), "mentions", none("relations"), none("claims"))


def _verdict_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    one = lambda rule, verdict, severity: F.struct(rule.cast("string").alias("rule"), verdict.alias("verdict"), severity.alias("severity"), F.col("o_orderstatus").alias("reason"))
    k = F.col("o_orderkey")
    made = F.array(one(k % 3, F.when(k % 2 == 0, "FAIL").otherwise("pass "), F.lit("HIGH")), one(k % 4, F.lit("fail"), F.lit("odd")), one(k % 5, F.lit("perhaps"), F.lit("low")))
    return o.select(k.alias("document"), _fenced(F.to_json(F.struct(made.alias("verdicts")))).alias("said"))


def verdict_contract(spark, sf_dir):
    return ct.parsed_verdicts(_verdict_rows(spark, sf_dir), "document", "said")


def verdict_findings(spark, sf_dir):
    return ct.verdicts_as_findings(verdict_contract(spark, sf_dir), "document")


def probe_contract(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    probes = F.array(F.concat(F.lit("why "), k % 3), F.lit(" "), F.lit("WHY 1"), F.concat(F.lit("how "), k % 2), F.lit("a"), F.lit("b"), F.lit("c"))
    objects = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("who "), k % 7).alias("question")), F.struct(F.lit("").alias("question"))).alias("probes")))
    said = F.when(k % 4 == 0, objects).when(k % 4 == 1, F.lit("nothing")).otherwise(F.to_json(F.struct(probes.alias("probes"))))
    return ct.parsed_probes(c.select(k.alias("unit"), said.alias("said")), "unit", "said")


def finding_contract(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cite = F.array(F.struct(F.lit("v").alias("video_id"), F.lit(1.5).alias("start_seconds"), F.lit("q").alias("quote")))
    one = lambda c, contested, n: F.struct(c.alias("criterion"), contested.alias("contested"), F.array_repeat(cite[0], n).alias("citations"))
    made = F.array(one(F.when(k % 3 > 0, F.concat(F.lit(" c"), k % 10)), k % 2 == 0, (k % 4).cast("int")), one(F.lit("last"), F.lit(None).cast("boolean"), F.lit(1)))
    return ct.parsed_findings(o.select(k.alias("cell"), F.to_json(F.struct(made.alias("findings"))).alias("said")), "cell", "said")


def golden_candidates(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    chunks = F.when(F.col("item_id") % 4 > 0, F.array(F.col("item_id") % 5, F.col("item_id") % 5, F.lit(7).cast("long"))).otherwise(F.array().cast("array<long>"))
    out = ct.candidate_records(items.select(F.col("item_id").alias("position"), F.concat(F.lit(" "), "text").alias("question"), F.lit(None).cast("string").alias("answer"), chunks.alias("chunks")))
    return out.withColumn("chunks", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ","))


def chat_log(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("turn").alias("asked_at"), F.col("text").alias("question"), F.when(F.col("conv_id") % 3 > 0, F.col("text")).alias("answer"))
    return ct.chat_entries(rows).select("entry", "asked_at", "kind")


def _cells(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.date_format("l_shipdate", "yyyy").alias("run"), F.col("l_linenumber").alias("setup"), F.col("l_suppkey").alias("question"), F.when(F.col("l_returnflag") != "R", "a").alias("answer"), F.col("l_linestatus").alias("judge"))


def run_descriptions(spark, sf_dir):
    return ct.run_described(_cells(spark, sf_dir))


def newest_run(spark, sf_dir):
    return ct.run_selected(ct.run_described(_cells(spark, sf_dir)))


def probe_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("run"), F.when(F.col("event_type") != "error", (F.col("event_id") % 97 > 1) | (F.col("user_id") % 40 > 30)).alias("ok"))
    return ct.all_probes_passed(rows.where("ok is not null or run < 5"))


def rejudged_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cells = o.select(F.col("o_orderkey").alias("cell"), F.col("o_totalprice").cast("double").alias("score"), F.lit("old").alias("judge"))
    return ct.rejudged(cells, o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("cell"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(1.0)).alias("score"), F.lit("new").alias("judge")))


def address_guard(spark, sf_dir):
    i = F.col("event_id")
    ip = F.concat_ws(".", i * 7 % 260, i * 13 % 256, i % 7 * 40, i % 256)
    host = F.when(i % 9 == 0, F.concat(F.lit("::FFFF:"), ip)).when(i % 9 == 1, "example.com").otherwise(ip)
    return table(spark, sf_dir, "events").select("event_id", ct.public_address(host).alias("public"))


def text_labels(spark, sf_dir):
    """Labels that go with a chunk: its preview, what is embedded, its reference and its address at a time."""
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://x.example/w?"), F.when(F.col("doc_id") % 3 == 0, F.lit("t=9&v=a")).when(F.col("doc_id") % 3 == 1, F.lit("v=a&t=9&w=b")).otherwise(F.lit("v=a")))
    at = F.when(F.col("doc_id") % 7 > 0, (F.col("doc_id") % 4000).cast("double"))
    return d.select(
        "doc_id",
        tx.preview(F.col("text")).alias("preview"),
        F.md5(F.encode(tx.embedding_text(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("text")), "UTF-8")).alias("embedded"),
        dc.timestamp_url(url, at).alias("address"),
        dc.chunk_reference(F.col("doc_id"), F.col("source"), F.lit("https://x.example/w?v=a"), at, at + 30).alias("reference"),
        dc.wide_behaviour(F.col("doc_id") % 2 == 0, F.col("doc_id") % 3).alias("behaviour"),
        dc.cell_fingerprint({"setup": F.col("lang"), "k": F.col("doc_id"), "none": F.lit(None).cast("string")}).alias("fingerprint"),
        tx.label_number(F.concat(F.lit("[s1."), "doc_id", F.lit("]"))).alias("label"),
    )


def review_queries(spark, sf_dir):
    i = F.col("item_id")
    kind = F.when(i % 3 == 0, "resume").when(i % 3 == 1, "document").otherwise("portfolio")
    question = F.when(i % 2 == 0, F.concat(F.lit("see https://x.example/a "), "text")).otherwise("check https://x.example/a")
    return table(spark, sf_dir, "benchmark").select("item_id", dc.review_query(question, kind, F.when(i % 5 > 0, "films"), INTENTS).alias("asked"))


QUERIES = {f.__name__: f for f in (extraction_contract, built_graph, verdict_contract, verdict_findings, probe_contract, finding_contract, golden_candidates, chat_log, run_descriptions, newest_run, probe_runs, rejudged_cells, address_guard, text_labels, review_queries)}

_CELLS = """(SELECT strftime(l_shipdate, '%Y') AS run, count(DISTINCT l_linenumber) AS setups, count(DISTINCT l_suppkey) AS questions, count(*) FILTER (l_returnflag <> 'R') AS answered, count(*) FILTER (l_returnflag = 'R') AS failed,
  string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS judges, count(DISTINCT l_linestatus) > 1 AS mixed FROM lineitem GROUP BY 1)"""
_VERDICTS = """v AS (SELECT o_orderkey AS document, o_orderstatus AS reason, unnest([(o_orderkey % 3)::VARCHAR, (o_orderkey % 4)::VARCHAR]) AS rule, unnest([CASE WHEN o_orderkey % 2 = 0 THEN 'fail' ELSE 'pass' END, 'fail']) AS verdict, unnest(['high', 'medium']) AS severity, unnest([1, 2]) AS seat FROM orders),
vv AS (SELECT document, rule, arg_min(verdict, seat) AS verdict, arg_min(severity, seat) AS severity, any_value(reason) AS reason FROM v GROUP BY document, rule)"""
_MMSS = "lpad((floor({s} / 60)::INT % 60)::VARCHAR, 2, '0') || ':' || lpad((({s})::INT % 60)::VARCHAR, 2, '0')"
_AT = "CASE WHEN {s} IS NULL THEN 'unknown' WHEN {s} >= 3600 THEN '01:' || " + _MMSS + " ELSE " + _MMSS + " END"
ORACLE = {
    "built_graph": """SELECT entity, entity AS name, upper(entity) AS aliases, mentions, relations, claims FROM (
      SELECT lang AS entity, count(*) AS mentions, 0::BIGINT AS relations, 0::BIGINT AS claims FROM documents GROUP BY lang UNION ALL SELECT source, count(*), count(DISTINCT lang), count(*) FROM documents GROUP BY source)""",
    "extraction_contract": "SELECT doc_id, (CASE WHEN b THEN 0 ELSE 2 END)::BIGINT AS entities, (CASE WHEN b THEN 0 ELSE 1 END)::BIGINT AS relations, (CASE WHEN b OR trim(split_part(text, chr(10), 1)) = '' THEN 0 ELSE 1 END)::BIGINT AS claims, CASE WHEN b THEN 'unreadable' END AS error FROM (SELECT *, doc_id % 5 = 0 AS b FROM documents)",
    "verdict_contract": f"WITH {_VERDICTS} SELECT * FROM vv",
    "verdict_findings": f"WITH {_VERDICTS} SELECT document, 'finding:' || rule AS finding, rule, reason AS detail FROM vv WHERE verdict = 'fail'",
    "probe_contract": """WITH p AS (SELECT c_custkey AS unit, CASE WHEN c_custkey % 4 = 0 THEN ['who ' || c_custkey % 7] WHEN c_custkey % 4 = 1 THEN []::VARCHAR[] WHEN c_custkey % 3 = 1 THEN ['why 1', 'how ' || c_custkey % 2, 'a', 'b', 'c'] ELSE ['why ' || c_custkey % 3, 'WHY 1', 'how ' || c_custkey % 2, 'a', 'b'] END AS l FROM customer)
      SELECT unit, unnest(range(1, len(l) + 1)) AS position, unnest(l) AS question FROM p""",
    "finding_contract": """WITH f AS (SELECT o_orderkey AS cell, CASE WHEN o_orderkey % 3 > 0 THEN 'f1' END AS one, CASE WHEN o_orderkey % 3 > 0 THEN 'f2' ELSE 'f1' END AS two, o_orderkey AS k FROM orders)
      SELECT cell, one AS finding, 'c' || k % 10 AS criterion, k % 2 = 0 AS contested, (k % 4)::INT AS citations FROM f WHERE one IS NOT NULL UNION ALL SELECT cell, two, 'last', false, 1 FROM f""",
    "golden_candidates": "SELECT 'g' || lpad((row_number() OVER (ORDER BY item_id))::VARCHAR, 3, '0') AS id, trim(text) AS question, '' AS answer, item_id % 5 || ',7' AS chunks FROM benchmark WHERE item_id % 4 > 0",
    "chat_log": "SELECT 'chat:' || substr(sha256(turn || chr(10) || text), 1, 16) AS entry, turn AS asked_at, CASE WHEN conv_id % 3 > 0 AND trim(text) <> '' THEN 'answer' ELSE 'failed' END AS kind FROM conversations WHERE role = 'user'",
    "run_descriptions": f"SELECT * FROM {_CELLS}",
    "newest_run": f"SELECT * FROM {_CELLS} ORDER BY run DESC LIMIT 1",
    "probe_runs": "SELECT run, count(*) AS probes, count(*) FILTER (ok) AS passed, bool_and(coalesce(ok, false)) AS all_passed FROM (SELECT user_id % 40 AS run, CASE WHEN event_type <> 'error' THEN event_id % 97 > 1 OR user_id % 40 > 30 END AS ok FROM events) WHERE ok IS NOT NULL OR run < 5 GROUP BY run",
    "rejudged_cells": "SELECT o_orderkey AS cell, CASE WHEN o_orderkey % 6 = 0 THEN 1.0 ELSE o_totalprice::DOUBLE END AS score, CASE WHEN o_orderkey % 6 = 0 THEN 'new' ELSE 'old' END AS judge, o_orderkey % 6 = 0 AS rejudged FROM orders",
    "address_guard": """SELECT event_id, CASE WHEN event_id % 9 = 1 OR a > 255 OR c > 255 THEN NULL ELSE NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
      OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) END AS public FROM (SELECT event_id, event_id * 7 % 260 AS a, event_id * 13 % 256 AS b, event_id % 7 * 40 AS c FROM events)""",
    "text_labels": rf"""WITH d AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat, CASE WHEN doc_id % 7 > 0 THEN (doc_id % 4000)::DOUBLE END AS sec FROM documents)
      SELECT doc_id, CASE WHEN length(flat) > 120 THEN rtrim(substr(flat, 1, 120)) || '...' ELSE flat END AS preview, md5(CASE WHEN doc_id % 2 = 0 THEN source || chr(10) ELSE '' END || text) AS embedded,
      CASE WHEN sec IS NULL THEN 'https://x.example/w?' || CASE doc_id % 3 WHEN 0 THEN 't=9&v=a' WHEN 1 THEN 'v=a&t=9&w=b' ELSE 'v=a' END ELSE 'https://x.example/w?' || CASE doc_id % 3 WHEN 0 THEN 't=' || sec::BIGINT || 's&v=a' WHEN 1 THEN 'v=a&t=' || sec::BIGINT || 's&w=b' ELSE 'v=a&t=' || sec::BIGINT || 's' END END AS address,
      '[' || doc_id || '] video=' || source || ' time=' || {_AT.format(s='sec')} || '-' || {_AT.format(s='(sec + 30)')} || ' url=https://x.example/w?v=a' || CASE WHEN sec IS NULL THEN '' ELSE '&t=' || sec::BIGINT || 's' END AS reference,
      CASE WHEN doc_id % 2 = 1 THEN 'capped' WHEN doc_id % 3 > 0 THEN 'budget+diversity' ELSE 'budget' END AS behaviour,
      substr(sha256('{{"k":' || doc_id || ',"none":null,"setup":"' || lang || '"}}'), 1, 24) AS fingerprint, doc_id::INT AS label FROM d""",
    "review_queries": r"""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN trim(regexp_replace('see ' || text, '\s+', ' ', 'g')) WHEN item_id % 3 = 0 THEN 'how to write a resume' WHEN item_id % 3 = 1 THEN 'advice about' || CASE WHEN item_id % 5 > 0 THEN ' films' ELSE '' END ELSE 'how to show work' END AS asked FROM benchmark""",
}
