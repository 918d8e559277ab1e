"""Queries that link records, keep keyed tables, and build graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import communities, folds, graph, joins, quotes, store
from tessera.sources.tables import table


def _spans(spark, sf_dir):
    """Events as spans of their user: as many seconds long as their value."""
    e = table(spark, sf_dir, "events")
    start = F.unix_timestamp("ts").cast("double")
    return e.select((F.col("user_id") % 50).alias("video"), "event_id", start.alias("start"), (start + F.round("value")).alias("end"), "event_type")


def citation_spans(spark, sf_dir):
    """Purchases with every view of the same video that holds them, 20 seconds of slack."""
    spans = _spans(spark, sf_dir)
    points = spans.where("event_type = 'purchase'").select("video", F.col("event_id").alias("citation"), F.col("start").alias("at"))
    views = spans.where("event_type = 'view'").select("video", F.col("event_id").alias("chunk"), "start", "end")
    return joins.interval_join(points, views, "video", "at", "start", "end", 20.0).select("citation", "chunk")


def nearest_reference(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    points = spans.where("event_type = 'purchase'").select("video", F.col("event_id").alias("citation"), F.col("start").alias("at"))
    views = spans.where("event_type = 'view'").select("video", F.col("event_id").alias("chunk"), "start")
    return joins.nearest_in_time(points, views, "video", "citation", "at", "start", "chunk", 3600.0)


def exclusive_evidence(spark, sf_dir):
    """Orders that a single supplier delivers."""
    return joins.owned_by_one(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey"), "l_suppkey", "l_orderkey")


def best_criterion(spark, sf_dir):
    """Each part keeps the supplier with the largest quantity."""
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max(F.col("l_quantity").cast("double")).alias("score"))
    return joins.one_to_one(pairs, "l_suppkey", "l_partkey", F.col("score")).where("l_partkey is not null")


def greedy_one_to_one(spark, sf_dir):
    """Parts and suppliers of each line number and month matched one to one by quantity."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("|", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM")).alias("run"), "l_suppkey", "l_partkey", F.col("l_quantity").cast("double").alias("score"))
    pairs = rows.groupBy("run", "l_suppkey", "l_partkey").agg(F.max("score").alias("score"))
    return joins.greedy_matching(pairs, "run", "l_suppkey", "l_partkey", "score", 45.0)


def orders_fully_retrieved(spark, sf_dir):
    """How many orders each supplier of a few nations could fill alone: relational division over parts."""
    li = table(spark, sf_dir, "lineitem")
    wanted = li.select(F.col("l_orderkey").alias("conflict"), F.col("l_partkey").alias("chunk"))
    some = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("finding"))
    have = li.where("l_quantity >= 5").select(F.col("l_suppkey").alias("finding"), F.col("l_partkey").alias("chunk")).join(some, "finding", "left_semi")
    return joins.contains_all(wanted, have, "conflict", "chunk", "finding").groupBy("finding").agg(F.count("*").alias("conflicts"))


def rubric_change(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return joins.set_change(labels.where("quality = 1"), docs.where("lang = 'en'"), "doc_id")


def pack_members(spark, sf_dir):
    """Documents by length, with labels as pins."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    routed = docs.where("lang = 'en'").select("doc_id", F.col("n_chars").alias("score"))
    pins = labels.select("doc_id", (F.col("quality") == 1).alias("included"))
    return joins.overrides(routed, pins, "doc_id")


def latest_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return store.latest(e, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def upsert_documents(spark, sf_dir):
    """Labelled documents rewritten in the table of all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("version"))
    new = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("source", F.lit("label")).withColumn("version", F.lit(-1).cast("long"))
    return store.upsert(docs, new, "doc_id")


def stale_chunks(spark, sf_dir):
    """What a replacement of every source that has labelled documents by just those removes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    new = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return store.replace_group(docs, new, "source", "doc_id")[1]


def read_through(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").where("lang <> 'es'").select("doc_id", F.when(F.col("n_chars") > 100, F.col("source")).alias("title"))
    return store.read_through(table(spark, sf_dir, "documents"), stored, "doc_id", ["title"]).select("doc_id", "status")


def _relations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("m"), (F.col("l_partkey") % 300)).alias("dst"), F.col("l_linenumber").alias("type"), (F.col("l_discount").cast("double") * 5).alias("weight"))


def _mentions(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("claim"), F.concat(F.lit("s"), "l_suppkey").alias("entity")).distinct()


def entity_edges(spark, sf_dir):
    return graph.weighted_edges(_relations(spark, sf_dir), _mentions(spark, sf_dir))


def one_hop(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return graph.neighbourhood(graph.weighted_edges(_relations(spark, sf_dir), _mentions(spark, sf_dir)), seeds)


def graph_communities(spark, sf_dir):
    from tessera.plans.retrieval import knn_graph

    return communities.communities(knn_graph(spark, sf_dir).withColumnRenamed("similarity", "weight"))


def conflict_candidates(spark, sf_dir):
    """Pairs of vectors of different labels in a band of similarity: each row's four best of those that are eligible."""
    from tessera.operators import retrieval

    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    return graph.candidate_pairs(retrieval.dense(vectors, queries, "vec_id", "embedding", 4, 0.1, 0.97, skip_self=True, group_col="label", groups="other"))


def vector_projection(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    mean, axes = graph.principal_axes(vectors, "embedding", 2)
    return graph.project(vectors, "vec_id", "embedding", mean, axes)


def document_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: x != "").alias("lines"))
    return folds.chunks(docs, "doc_id", "lines")


def plain_sections(spark, sf_dir):
    """Blocks between blank lines, white space collapsed, empty ones dropped."""
    blocks = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n").alias("text")).select("conv_id", F.posexplode(blocks).alias("index", "section"))


def representative_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    return folds.round_robin(docs, "lang", "source", "doc_id", 12)


def quote_support(spark, sf_dir):
    """How much of each benchmark item a document that shares its longest word quotes."""
    from tessera.plans.retrieval import golden_pairs

    pairs = golden_pairs(spark, sf_dir)
    texts = pairs.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("quote")), "query_id").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")
    return texts.select("query_id", "doc", quotes.ratios(F.col("quote"), F.col("text")).alias("ratio"))


def located_quotes(spark, sf_dir):
    """All documents that have half of a benchmark item's runs of three words or more."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return quotes.located(items, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))


def quote_sources(spark, sf_dir):
    """The document that holds most of an item, and its own words for it."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return quotes.best_sources(items, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))


QUERIES = {f.__name__: f for f in (located_quotes, quote_sources, citation_spans, nearest_reference, exclusive_evidence, best_criterion, greedy_one_to_one, orders_fully_retrieved, rubric_change, pack_members, latest_state, upsert_documents, stale_chunks, read_through, entity_edges, one_hop, graph_communities, conflict_candidates, vector_projection, document_chunks, plain_sections, representative_rows, quote_support)}

_SPANS = "sp AS (SELECT user_id % 50 AS video, event_id, floor(epoch(ts)) AS start, floor(epoch(ts)) + round(value) AS stop, event_type FROM events)"
_EDGES = """rel AS (SELECT 's' || l_suppkey AS src, 'm' || (l_partkey % 300) AS dst, l_linenumber AS type, max(l_discount::DOUBLE * 5) AS w FROM lineitem GROUP BY ALL),
men AS (SELECT DISTINCT o_orderkey AS claim, 's' || l_suppkey AS entity FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
edges AS (SELECT a, b, round(sum(w), 6) AS weight FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN coalesce(w, 0) = 0 THEN 0.5 ELSE w END AS w FROM rel WHERE src <> dst
  UNION ALL SELECT x.entity, y.entity, 1.0 FROM men x JOIN men y ON x.claim = y.claim AND x.entity < y.entity) GROUP BY ALL)"""

_GREEDY = """WITH RECURSIVE p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, l_suppkey, l_partkey) AS n FROM (
  SELECT l_linenumber || '|' || strftime(l_shipdate, '%Y-%m') AS run, l_suppkey, l_partkey, max(l_quantity::DOUBLE) AS score FROM lineitem GROUP BY ALL) WHERE score >= 45),
w AS (SELECT run, 0::BIGINT AS n, []::BIGINT[] AS ua, []::BIGINT[] AS ub, false AS took FROM p GROUP BY run UNION ALL
  SELECT run, n, CASE WHEN free THEN list_append(ua, l_suppkey) ELSE ua END, CASE WHEN free THEN list_append(ub, l_partkey) ELSE ub END, free
  FROM (SELECT p.run, p.n, p.l_suppkey, p.l_partkey, ua, ub, NOT list_contains(ua, p.l_suppkey) AND NOT list_contains(ub, p.l_partkey) AS free FROM w JOIN p ON p.run = w.run AND p.n = w.n + 1))"""
_CHUNKED = r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents),
u AS (SELECT doc_id, i, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS t FROM (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM s)),
e AS MATERIALIZED (SELECT doc_id, l, len(l) AS n, p FROM s JOIN (SELECT doc_id, list_prepend(0::HUGEINT, list(t ORDER BY i)) AS p FROM u GROUP BY doc_id) USING (doc_id)),
w AS (SELECT doc_id, 0 AS chunk_index, 0::BIGINT AS a, {end0} AS z FROM e UNION ALL
  SELECT doc_id, chunk_index, a, {end} AS z FROM (SELECT e.doc_id, chunk_index + 1 AS chunk_index, e.n, e.p, coalesce(list_min(list_filter(range(a + 1, z), lambda b: e.p[z + 1] - e.p[b + 1] + (z - b - 1) <= 150)), z) AS a FROM w JOIN e ON e.doc_id = w.doc_id AND w.z < e.n))
SELECT doc_id, chunk_index::INT AS chunk_index, regexp_replace(array_to_string(l[a + 1:z], ' '), '^\s+|\s+$', '', 'g') AS text, a::INT AS start_segment, (z - 1)::INT AS end_segment FROM w JOIN e USING (doc_id)"""
_END = "greatest({a} + 1, coalesce(list_max(list_filter(range({a} + 1, n + 1), lambda z: p[z + 1] - p[{a} + 1] + (z - {a} - 1) <= 1200)), 0))"
_RUNS = "SELECT DISTINCT id, run FROM (SELECT id, i, n, concat_ws(' ', w, lead(w) OVER x, lead(w, 2) OVER x) AS run FROM (SELECT {id} AS id, unnest(t) AS w, generate_subscripts(t, 1) AS i, len(t) AS n FROM (SELECT {id}, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS t FROM {table})) WINDOW x AS (PARTITION BY id ORDER BY i)) WHERE i <= greatest(n - 2, 1)"
ORACLE = {
    "located_quotes": f"WITH q AS ({_RUNS.format(id='item_id', table='benchmark')}), d AS ({_RUNS.format(id='doc_id', table='documents')}) SELECT query_id, doc, shared FROM (SELECT q.id AS query_id, d.id AS doc, round(count(*) / any_value(n), 6) AS shared FROM q JOIN d USING (run) JOIN (SELECT id, count(*) AS n FROM q GROUP BY id) s ON s.id = q.id GROUP BY q.id, d.id) WHERE shared >= 0.5",
    "greedy_one_to_one": f"{_GREEDY} SELECT run, l_suppkey, l_partkey, score FROM p JOIN w USING (run, n) WHERE took",
    "document_chunks": _CHUNKED.replace("{end0}", _END.replace("{a}", "0")).replace("{end}", _END.replace("{a}", "a")),
    "citation_spans": f"WITH {_SPANS} SELECT p.event_id AS citation, v.event_id AS chunk FROM sp p JOIN sp v ON p.video = v.video AND p.event_type = 'purchase' AND v.event_type = 'view' AND p.start BETWEEN v.start - 20 AND v.stop + 20",
    "nearest_reference": f"WITH {_SPANS} SELECT citation, chunk, gap FROM (SELECT p.event_id AS citation, v.event_id AS chunk, abs(p.start - v.start) AS gap, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.start - v.start), v.start, v.event_id) AS r FROM sp p JOIN sp v ON p.video = v.video AND p.event_type = 'purchase' AND v.event_type = 'view' AND abs(p.start - v.start) <= 3600) WHERE r = 1",
    "exclusive_evidence": "SELECT min(l_suppkey) AS l_suppkey, l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1",
    "best_criterion": "SELECT l_suppkey, l_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, l_suppkey) AS r FROM (SELECT l_suppkey, l_partkey, max(l_quantity::DOUBLE) AS score FROM lineitem GROUP BY ALL)) WHERE r = 1",
    "orders_fully_retrieved": "WITH have AS (SELECT DISTINCT l_suppkey AS finding, l_partkey AS chunk FROM lineitem WHERE l_quantity >= 5 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)), want AS (SELECT DISTINCT l_orderkey AS conflict, l_partkey AS chunk FROM lineitem), n AS (SELECT conflict, count(*) AS n FROM want GROUP BY conflict) SELECT finding, count(*) AS conflicts FROM (SELECT finding, conflict, count(*) AS m FROM want JOIN have USING (chunk) GROUP BY ALL) JOIN n USING (conflict) WHERE m = n GROUP BY finding",
    "rubric_change": "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'kept' END AS change FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) o FULL JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') n ON o.doc_id = n.doc_id",
    "pack_members": "SELECT *, row_number() OVER (ORDER BY included DESC, score DESC NULLS LAST, doc_id) AS position FROM (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, n_chars AS score, coalesce(quality = 1, true) AS included FROM (SELECT * FROM documents WHERE lang = 'en') d FULL JOIN labels l ON d.doc_id = l.doc_id)",
    "latest_state": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "upsert_documents": "SELECT doc_id, source, n_chars AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'label', CAST(-1 AS BIGINT) FROM labels",
    "stale_chunks": "SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "read_through": "SELECT doc_id, CASE WHEN lang = 'es' THEN 'miss' WHEN n_chars <= 100 THEN 'metadata' ELSE 'hit' END AS status FROM documents",
    "entity_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "one_hop": f"WITH {_EDGES}, seeds AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_nationkey = 3) SELECT node, min(hops)::INT AS hops FROM (SELECT node, 0 AS hops FROM seeds UNION ALL SELECT b, 1 FROM edges JOIN seeds ON a = node UNION ALL SELECT a, 1 FROM edges JOIN seeds ON b = node) GROUP BY node",
    "conflict_candidates": """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
      s AS (SELECT a.vec_id AS p, a.label AS lp, b.vec_id AS q, b.label AS lq, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id <> b.vec_id),
      k AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, q) AS t FROM s WHERE score BETWEEN 0.1 AND 0.97 AND lp <> lq)
      SELECT least(p, q) AS a, greatest(p, q) AS b, max(score) AS similarity FROM k WHERE t <= 4 GROUP BY ALL""",
    "plain_sections": r"""WITH c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id),
      b AS (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM c)
      SELECT conv_id, (unnest(range(len(l))))::INT AS index, unnest(l) AS section FROM b""",
    "representative_rows": "WITH d AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS depth, count(*) OVER (PARTITION BY lang, source) AS n FROM documents) SELECT lang, source, doc_id, depth, position FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY depth, n DESC, source) AS position FROM d) WHERE position <= 12",
}
