"""Queries over a claim store: suppliers are entities, orders are claims about the suppliers that deliver them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import claims as cl
from tessera.sources.tables import table


def _entities(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("mentions"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"))
    return s.select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("Nation "), "s_nationkey")).alias("aliases"), "mentions")


def _claims(spark, sf_dir):
    date = F.when(F.col("o_orderkey") % 11 > 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"), (F.col("o_custkey") % 200).alias("chunk"), (F.col("o_custkey") % 40).alias("video"), date.alias("date"), F.col("o_totalprice").cast("double").alias("start"))


def _anchors(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_suppkey").alias("entity")).distinct()


def _edges(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))


def _members(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("community"))


def _terms(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("nation "), "n_nationkey").alias("term"))


def entity_upserts(spark, sf_dir):
    """Documents' languages and sources as spellings of one another's names, extracted twice."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.concat(F.col("source"), F.lit("!"))).alias("name"), F.col("lang").alias("alias"), F.col("doc_id").alias("chunk"))
    return cl.upsert_entities(d.unionByName(d)).withColumn("aliases", F.array_join("aliases", ","))


def relation_upserts(spark, sf_dir):
    rel = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 60).alias("src"), (F.col("l_partkey") % 60).alias("dst"), F.col("l_linenumber").alias("type"), F.col("l_discount").cast("double").alias("weight"))
    return cl.upsert_relations(rel, _entities(spark, sf_dir).where("entity % 3 > 0"))


def video_claims(spark, sf_dir):
    return cl.claims_of_video(_claims(spark, sf_dir), _anchors(spark, sf_dir).where("entity % 4 = 0"), _entities(spark, sf_dir)).withColumn("names", F.array_join("names", ","))


def seed_claims(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("entity"))
    held = table(spark, sf_dir, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").alias("video"))
    return cl.claims_about(_claims(spark, sf_dir), _anchors(spark, sf_dir), _edges(spark, sf_dir), seeds, 100, held_out=held)


def entity_timeline(spark, sf_dir):
    return cl.timeline(_claims(spark, sf_dir), _anchors(spark, sf_dir))


def community_listing(spark, sf_dir):
    return cl.communities_listed(_members(spark, sf_dir), _anchors(spark, sf_dir).where("claim % 50 = 0")).withColumn("entities", F.array_join("entities", ","))


def community_claims(spark, sf_dir):
    return cl.top_claims(_claims(spark, sf_dir), _anchors(spark, sf_dir), _members(spark, sf_dir), 5)


def entity_listing(spark, sf_dir):
    return cl.entities_listed(_entities(spark, sf_dir), 50).select("entity", "name", "mentions")


def entity_resolution(spark, sf_dir):
    return cl.resolved(_entities(spark, sf_dir), _terms(spark, sf_dir), 10)


def graph_ranking(spark, sf_dir):
    return cl.chunks_by_graph(entity_resolution(spark, sf_dir), _anchors(spark, sf_dir), _claims(spark, sf_dir), 10)


def question_words(spark, sf_dir):
    words = cl.question_terms(F.col("text"), ["that", "with", "from"])
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("terms"), cl.strong_match(words, F.lit("the Nation of thther and ention")).alias("strong"))


def claim_enrichment(spark, sf_dir):
    return cl.chunk_enrichment(_claims(spark, sf_dir), _anchors(spark, sf_dir), _entities(spark, sf_dir)).withColumn("names", F.array_join("names", ","))


def knowledge_graph(spark, sf_dir):
    return cl.graph_view(_entities(spark, sf_dir), _edges(spark, sf_dir), _members(spark, sf_dir), 40)


def graph_references(spark, sf_dir):
    answers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("answer"), F.concat(F.lit("as said ["), F.col("c_custkey") % 5, F.lit("] and ["), F.col("c_custkey") % 3, F.lit("], [x]")).alias("text"))
    labelled = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("answer"), (F.col("o_orderkey") % 7).cast("int").alias("label"), F.col("o_orderkey").alias("claim"), F.col("o_orderkey").alias("chunk"))
    return cl.answer_references(answers, labelled)


QUERIES = {f.__name__: f for f in (entity_upserts, relation_upserts, video_claims, seed_claims, entity_timeline, community_listing, community_claims, entity_listing, entity_resolution, graph_ranking, question_words, claim_enrichment, knowledge_graph, graph_references)}

_STORE = """ent AS (SELECT s_suppkey AS entity, s_name AS name, 'Nation ' || s_nationkey AS alias, count(DISTINCT l_orderkey) AS mentions FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL),
cla AS (SELECT o_orderkey AS claim, o_custkey % 200 AS chunk, o_custkey % 40 AS video, CASE WHEN o_orderkey % 11 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, o_totalprice::DOUBLE AS start FROM orders),
anc AS (SELECT DISTINCT l_orderkey AS claim, l_suppkey AS entity FROM lineitem),
edg AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey % 2 = 0),
mem AS (SELECT s_suppkey AS entity, s_nationkey AS community FROM supplier),
res AS (SELECT query_id, entity, mentions, rank FROM (SELECT n_nationkey AS query_id, entity, mentions, row_number() OVER (PARTITION BY n_nationkey ORDER BY mentions DESC, entity) AS rank
  FROM nation JOIN ent ON contains(lower(alias), 'nation ' || n_nationkey) OR contains(lower(name), 'nation ' || n_nationkey) WHERE n_nationkey < 5) WHERE rank <= 10)"""
_WORDS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: length(w) >= 4 AND w NOT IN ('that', 'with', 'from'))[1:8]"
ORACLE = {
    "entity_upserts": r"""WITH d AS (SELECT CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source || '!' END AS name, lang AS alias, doc_id FROM documents),
      k AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS entity FROM d)
      SELECT entity, min(name) AS name, array_to_string(list_sort(list_filter(list_distinct(list_concat(list(alias), list(name))), lambda x: x <> min(name))), ',') AS aliases, count(DISTINCT doc_id) AS mentions FROM k GROUP BY entity""",
    "relation_upserts": f"WITH {_STORE} SELECT l_suppkey % 60 AS src, l_partkey % 60 AS dst, l_linenumber AS type, max(l_discount::DOUBLE) AS weight FROM lineitem WHERE l_suppkey % 60 <> l_partkey % 60 AND (l_suppkey % 60) % 3 > 0 AND (l_partkey % 60) % 3 > 0 AND l_suppkey % 60 IN (SELECT entity FROM ent) AND l_partkey % 60 IN (SELECT entity FROM ent) GROUP BY ALL",
    "video_claims": f"""WITH {_STORE}, n AS (SELECT claim, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM anc JOIN ent USING (entity) WHERE entity % 4 = 0 GROUP BY claim)
      SELECT video, claim, start, coalesce(names, '') AS names, row_number() OVER (PARTITION BY video ORDER BY start, claim) AS position FROM cla LEFT JOIN n USING (claim)""",
    "seed_claims": f"""WITH {_STORE}, seed AS (SELECT s_suppkey AS entity FROM supplier WHERE s_nationkey = 3),
      about AS (SELECT entity FROM seed UNION SELECT b FROM edg JOIN seed ON a = entity UNION SELECT a FROM edg JOIN seed ON b = entity)
      SELECT claim, chunk, video, date, start FROM cla WHERE claim IN (SELECT claim FROM anc WHERE entity IN (SELECT entity FROM about)) AND video >= 4 ORDER BY coalesce(date, '9999'), video, start, claim LIMIT 100""",
    "entity_timeline": f"WITH {_STORE} SELECT entity, position, claim, date FROM (SELECT entity, claim, date, row_number() OVER (PARTITION BY entity ORDER BY date, video, start, claim) AS position FROM anc JOIN cla USING (claim) WHERE date IS NOT NULL) WHERE position <= 30",
    "community_listing": f"""WITH {_STORE}, n AS (SELECT community, count(DISTINCT claim) AS claims FROM anc JOIN mem USING (entity) WHERE claim % 50 = 0 GROUP BY community)
      SELECT community, entities, coalesce(claims, 0) AS claims FROM (SELECT community, string_agg(DISTINCT entity::VARCHAR, ',' ORDER BY entity::VARCHAR) AS x, array_to_string(list_sort(list(DISTINCT entity)), ',') AS entities, count(DISTINCT entity) AS size FROM mem GROUP BY community) LEFT JOIN n USING (community) WHERE size >= 2 OR coalesce(claims, 0) > 0""",
    "community_claims": f"""WITH {_STORE}, n AS (SELECT community, claim, count(DISTINCT entity) AS anchored FROM anc JOIN mem USING (entity) GROUP BY ALL)
      SELECT community, position, claim, anchored FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY anchored DESC, coalesce(date, '9999'), claim) AS position FROM n JOIN cla USING (claim)) WHERE position <= 5""",
    "entity_listing": f"WITH {_STORE} SELECT entity, name, mentions FROM ent ORDER BY mentions DESC, entity LIMIT 50",
    "entity_resolution": f"WITH {_STORE} SELECT * FROM res",
    "graph_ranking": f"""WITH {_STORE}, ab AS (SELECT query_id, entity, claim, chunk, video, date, start FROM res JOIN anc USING (entity) JOIN cla USING (claim)),
      k AS (SELECT * FROM (SELECT query_id, claim, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(date, '9999'), video, start, claim) AS n FROM (SELECT DISTINCT query_id, claim, date, video, start FROM ab)) WHERE n <= 200),
      p AS (SELECT query_id, chunk, count(DISTINCT entity) AS matched, count(DISTINCT claim) AS claims FROM ab JOIN k USING (query_id, claim) GROUP BY ALL)
      SELECT * FROM (SELECT query_id, chunk, matched, claims, round(matched / total, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, claims DESC, chunk) AS rank FROM p JOIN (SELECT query_id, count(DISTINCT entity) AS total FROM res GROUP BY query_id) USING (query_id)) WHERE rank <= 10""",
    "question_words": f"""SELECT item_id, array_to_string(t, ' ') AS terms, len(list_filter(h, lambda w: length(w) >= 6)) > 0 OR len(h) >= 2 AS strong FROM (SELECT item_id, t, list_distinct(list_filter(t, lambda w: contains('the nation of thther and ention', w))) AS h FROM (SELECT item_id, {_WORDS} AS t FROM benchmark))""",
    "claim_enrichment": f"WITH {_STORE} SELECT chunk, count(DISTINCT claim) AS claims, array_to_string(list_sort(list_filter(list(DISTINCT name), lambda x: x IS NOT NULL)), ',') AS names FROM cla LEFT JOIN (SELECT claim, name FROM anc JOIN ent USING (entity)) USING (claim) GROUP BY chunk",
    "knowledge_graph": f"""WITH {_STORE}, top AS (SELECT entity, mentions FROM ent ORDER BY mentions DESC, entity LIMIT 40), e AS (SELECT a, b FROM edg WHERE a IN (SELECT entity FROM top) AND b IN (SELECT entity FROM top))
      SELECT entity, mentions, community, (SELECT count(*) FROM e WHERE a = entity OR b = entity) AS degree FROM top JOIN mem USING (entity)""",
    "graph_references": r"SELECT c_custkey AS answer, (o_orderkey % 7)::INT AS label, o_orderkey AS chunk FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 7 IN (c_custkey % 5, c_custkey % 3)",
}
