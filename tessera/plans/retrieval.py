"""Queries over documents, benchmark items and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics, postings, retrieval
from tessera.operators.checkpoints import scratch, written
from tessera.sources.tables import table

#: One query in fifty rows, against all rows.
EVERY = 50


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def bm25_search(spark, sf_dir):
    return retrieval.bm25(_docs(spark, sf_dir), _items(spark, sf_dir), k=10)


def kept_index_search(spark, sf_dir):
    """A kept index after a change: English documents come again with their source in front, short German ones go."""
    docs = _docs(spark, sf_dir)
    folder = scratch(spark, "index")
    postings.save(postings.inverted(docs), folder, buckets=8)
    postings.upsert(spark, folder, docs.where("lang = 'en'").withColumn("text", F.concat("source", F.lit(" "), "text")), buckets=8)
    postings.delete(spark, folder, docs.where("lang = 'de' and n_chars < 400").select(F.col("doc_id").alias("doc")))
    items = _items(spark, sf_dir)
    index = written(postings.load(spark, folder, items, buckets=8))
    return retrieval.bm25(None, items, k=10, index=index, spread=postings.kept_spread(spark, folder))


def cosine_search(spark, sf_dir):
    return retrieval.term_cosine(_docs(spark, sf_dir), _items(spark, sf_dir), k=10)


def _lists(spark, sf_dir, k=30):
    docs, items = _docs(spark, sf_dir), _items(spark, sf_dir)
    return retrieval.both_lists(retrieval.lexical_index(docs), items, k)


def fuse_rankings(spark, sf_dir):
    return retrieval.fuse(_lists(spark, sf_dir), 10)


def _golden(spark, sf_dir):
    """Documents that hold an item's text, found by an item's words first: a seed join instead of all pairs."""
    from tessera.functions.text import tokens

    docs = _docs(spark, sf_dir).select("doc_id", "text", F.array_distinct(tokens(F.col("text"))).alias("t"))
    items = _items(spark, sf_dir).withColumnRenamed("text", "said").withColumn("rare", F.array_max(F.transform(tokens(F.col("said")), lambda w: F.struct(F.length(w), w.alias("w"))))["w"])
    each = docs.select("doc_id", "text", F.explode("t").alias("rare"))
    return each.join(items, "rare").where(F.contains("text", "said")).select("query_id", F.col("doc_id").alias("doc"))


def golden_pairs(spark, sf_dir):
    return _golden(spark, sf_dir)


def retrieve_hybrid(spark, sf_dir):
    """The flagship: two retrievers, fused, and scored against the documents that hold each item."""
    fused = retrieval.fuse(_lists(spark, sf_dir), 10)
    return metrics.ir_metrics(fused, _golden(spark, sf_dir), _items(spark, sf_dir))


def ablation(spark, sf_dir):
    """Mean metrics of each retriever and their fusion, over all items and by their number of words."""
    lists, golden, items = _lists(spark, sf_dir), _golden(spark, sf_dir), _items(spark, sf_dir)
    arms = {"lexical": lists.where("list = 0"), "cosine": lists.where("list = 1"), "hybrid": retrieval.fuse(lists, 30)}
    domain = items.select("query_id", F.when(F.size(F.split("text", " ")) > 35, "long").otherwise("short").alias("domain"))
    cells = None
    for name, hits in arms.items():
        own = metrics.ir_metrics(hits.select("query_id", "doc", "rank"), golden, items).join(domain, "query_id").withColumn("config", F.lit(name))
        cells = own if cells is None else cells.unionByName(own)
    return metrics.summarise(cells, "config", "domain", ["recall_1", "recall_10", "mrr", "ndcg"])


def ablation_delta(spark, sf_dir):
    overall = ablation(spark, sf_dir).where("overall")
    return metrics.against_baseline(overall, "config", "lexical", ["recall_10", "mrr"])


def rerank_hits(spark, sf_dir):
    docs, items = _docs(spark, sf_dir), _items(spark, sf_dir)
    hits = retrieval.bm25(docs, items, k=30).drop("score")
    joined = hits.join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").join(items.withColumnRenamed("text", "said"), "query_id")
    return retrieval.rerank(joined, retrieval.overlap_score(F.col("said"), F.col("text")), 10).select("query_id", "doc", "score", "rank")


def diverse_sources(spark, sf_dir):
    hits = retrieval.bm25(_docs(spark, sf_dir), _items(spark, sf_dir), k=30).join(_docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "source"), "doc")
    return retrieval.diversify(hits, "source", 1, 10).select("query_id", "doc", "source", "rank", "position")


def source_breadth(spark, sf_dir):
    return diverse_sources(spark, sf_dir).groupBy("query_id").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("hits"))


def neighbour_expansion(spark, sf_dir):
    """Documents of a source as its chunks, by id; hits widened by one on each side."""
    docs = _docs(spark, sf_dir)
    from pyspark.sql import Window

    chunks = docs.select("doc_id", "source", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long").alias("index"))
    hits = retrieval.bm25(docs, _items(spark, sf_dir), k=5).join(chunks.withColumnRenamed("doc_id", "doc"), "doc")
    return retrieval.with_neighbours(hits.select("query_id", "rank", "source", "index"), chunks.select("source", "index"))


def compare_retrievers(spark, sf_dir):
    modes = _lists(spark, sf_dir, 10).select("query_id", F.when(F.col("list") == 0, "bm25").otherwise("cosine").alias("mode"), "doc", "rank")
    return retrieval.compare_modes(modes)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _vector_queries(spark, sf_dir):
    return _vectors(spark, sf_dir).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def dense_search(spark, sf_dir):
    return retrieval.dense(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), "vec_id", "embedding", 10)


def dense_with_floor(spark, sf_dir):
    """Routing: the best five at or above a similarity of 0.25, with one label held out before anything is ranked."""
    kept = _vectors(spark, sf_dir).where("label <> 0")
    return retrieval.dense(kept, _vector_queries(spark, sf_dir), "vec_id", "embedding", 5, 0.25)


def dense_by_label(spark, sf_dir):
    """Three of each label, then the best ten of those."""
    few = retrieval.dense(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), "vec_id", "embedding", 3, group_col="label", groups="each")
    return retrieval.ranked(few.drop("rank").withColumnRenamed("group", "label"), "score", "id", 10)


def knn_graph(spark, sf_dir):
    """Edges between each vector and its four nearest at 0.3 or more; reciprocal ones are one edge."""
    vectors = _vectors(spark, sf_dir)
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = retrieval.dense(vectors, queries, "vec_id", "embedding", 4, 0.3, skip_self=True)
    return hits.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("similarity"))


def knn_degrees(spark, sf_dir):
    edges = knn_graph(spark, sf_dir)
    ends = edges.select(F.col("a").alias("vec_id")).unionByName(edges.select(F.col("b").alias("vec_id"))).groupBy("vec_id").agg(F.count("*").alias("degree"))
    return _vectors(spark, sf_dir).select("vec_id").join(ends, "vec_id", "left").fillna(0, ["degree"])


QUERIES = {f.__name__: f for f in (bm25_search, kept_index_search, cosine_search, fuse_rankings, golden_pairs, retrieve_hybrid, ablation, ablation_delta, rerank_hits, diverse_sources, source_breadth, neighbour_expansion, compare_retrievers, dense_search, dense_with_floor, dense_by_label, knn_graph, knn_degrees)}

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
LEXICAL = rf"""
dt AS (SELECT doc_id AS doc, {_TOK} AS t, source FROM documents),
post AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(t) AS dl, unnest(t) AS term FROM dt) GROUP BY ALL),
sizes AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt WHERE len(t) > 0),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, sizes GROUP BY term, n),
idf AS (SELECT term, CASE WHEN idf < 0 THEN (SELECT avg(idf) * 0.25 FROM raw) ELSE idf END AS idf FROM raw),
want AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
bms AS (SELECT query_id, doc, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM post JOIN want USING (term) JOIN idf USING (term), sizes GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM bms),
norms AS (SELECT doc, sqrt(sum(tf * tf)) AS norm FROM post GROUP BY doc),
qnorms AS (SELECT query_id, sqrt(sum(qtf * qtf)) AS qnorm FROM want GROUP BY query_id),
coss AS (SELECT query_id, doc, round(dot / (norm * qnorm), 6) AS score FROM (SELECT query_id, doc, sum(tf * qtf) AS dot FROM post JOIN want USING (term) GROUP BY ALL) JOIN norms USING (doc) JOIN qnorms USING (query_id)),
co AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM coss),
lists AS (SELECT query_id, doc, score, rank, 0 AS list FROM bm WHERE rank <= 30 UNION ALL SELECT query_id, doc, score, rank, 1 FROM co WHERE rank <= 30),
fsum AS (SELECT query_id, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS seen FROM lists GROUP BY ALL),
fused AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc) AS rank FROM fsum),
golden AS (SELECT DISTINCT item_id AS query_id, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text))
"""


def _metrics(hits: str) -> str:
    return f"""(SELECT q.query_id, CASE WHEN n IS NOT NULL THEN round(coalesce(h1 / n, 0), 4) END AS recall_1, CASE WHEN n IS NOT NULL THEN round(coalesce(h3 / n, 0), 4) END AS recall_3,
  CASE WHEN n IS NOT NULL THEN round(coalesce(h5 / n, 0), 4) END AS recall_5, CASE WHEN n IS NOT NULL THEN round(coalesce(h10 / n, 0), 4) END AS recall_10,
  CASE WHEN n IS NOT NULL THEN round(coalesce(1.0::DOUBLE / first, 0), 4) END AS mrr,
  CASE WHEN n IS NOT NULL THEN round(coalesce(gain / list_sum(list_transform(range(1, least(n, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))), 0), 4) END AS ndcg,
  CASE WHEN n IS NOT NULL THEN round(coalesce(ap / n, 0), 4) END AS average_precision
  FROM (SELECT item_id AS query_id FROM benchmark) q LEFT JOIN (SELECT query_id, count(*)::DOUBLE AS n FROM golden GROUP BY query_id) USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) AS first,
    sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS gain, sum(nth::DOUBLE / rank) AS ap
    FROM (SELECT query_id, doc, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM {hits} h JOIN golden USING (query_id, doc)) GROUP BY query_id) USING (query_id))"""


_ABLATION = f"""cells AS (SELECT *, 'lexical' AS config FROM {_metrics('(SELECT * FROM lists WHERE list = 0)')} UNION ALL SELECT *, 'cosine' FROM {_metrics('(SELECT * FROM lists WHERE list = 1)')}
  UNION ALL SELECT *, 'hybrid' FROM {_metrics('(SELECT * FROM fused WHERE rank <= 30)')}),
dom AS (SELECT item_id AS query_id, CASE WHEN len(string_split(text, ' ')) > 35 THEN 'long' ELSE 'short' END AS domain FROM benchmark),
abl AS (SELECT config, domain, round(avg(recall_1), 4) AS recall_1, round(avg(recall_10), 4) AS recall_10, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, count(*) AS n, grouping(domain) = 1 AS overall
  FROM cells JOIN dom USING (query_id) GROUP BY GROUPING SETS ((config), (config, domain)))"""
_DIVERSE = """dh AS (SELECT query_id, doc, source, rank FROM bm JOIN (SELECT doc_id AS doc, source FROM documents) USING (doc) WHERE rank <= 30),
dp AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 1 AND source <> '' AS parked FROM dh),
dk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY parked, rank) AS place FROM dp),
dv AS (SELECT query_id, doc, source, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM dk WHERE place <= 10)"""
_DENSE = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 50 = 0)"""
_SIM = "round(greatest(-1, least(1, list_cosine_similarity(qv, v))), 6)"
_KNN = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT a.vec_id AS p, b.vec_id AS q, round(greatest(-1, least(1, list_cosine_similarity(a.v, b.v))), 6) AS score FROM e a, e b WHERE a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, q) AS rank FROM s WHERE score >= 0.3),
edges AS (SELECT least(p, q) AS a, greatest(p, q) AS b, max(score) AS similarity FROM k WHERE rank <= 4 GROUP BY ALL)"""

ORACLE = {
    "bm25_search": f"WITH {LEXICAL} SELECT query_id, doc, score, rank FROM bm WHERE rank <= 10",
    "kept_index_search": f"WITH changed AS (SELECT * REPLACE (CASE WHEN lang = 'en' THEN source || ' ' || text ELSE text END AS text) FROM documents WHERE NOT coalesce(lang = 'de' AND n_chars < 400, false)), {LEXICAL.replace('documents', 'changed')} SELECT query_id, doc, score, rank FROM bm WHERE rank <= 10",
    "cosine_search": f"WITH {LEXICAL} SELECT query_id, doc, score, rank FROM co WHERE rank <= 10",
    "fuse_rankings": f"WITH {LEXICAL} SELECT * FROM fused WHERE rank <= 10",
    "golden_pairs": f"WITH {LEXICAL} SELECT * FROM golden",
    "retrieve_hybrid": f"WITH {LEXICAL} SELECT * FROM {_metrics('(SELECT * FROM fused WHERE rank <= 10)')}",
    "ablation": f"WITH {LEXICAL}, {_ABLATION} SELECT * FROM abl",
    "ablation_delta": f"WITH {LEXICAL}, {_ABLATION} SELECT config, round(recall_10 - (SELECT recall_10 FROM abl WHERE overall AND config = 'lexical'), 4) AS recall_10_delta, round(mrr - (SELECT mrr FROM abl WHERE overall AND config = 'lexical'), 4) AS mrr_delta FROM abl WHERE overall",
    "rerank_hits": f"""WITH {LEXICAL}, j AS (SELECT query_id, doc, rank AS before, round(len(list_intersect(list_distinct(qt), t))::DOUBLE / greatest(len(list_distinct(qt)), 1), 6) AS score
      FROM bm JOIN dt USING (doc) JOIN (SELECT item_id AS query_id, {_TOK} AS qt FROM benchmark) USING (query_id) WHERE rank <= 30)
      SELECT * FROM (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM j) WHERE rank <= 10""",
    "diverse_sources": f"WITH {LEXICAL}, {_DIVERSE} SELECT * FROM dv",
    "source_breadth": f"WITH {LEXICAL}, {_DIVERSE} SELECT query_id, count(DISTINCT source) AS sources, count(*) AS hits FROM dv GROUP BY query_id",
    "neighbour_expansion": f"""WITH {LEXICAL}, ch AS (SELECT doc_id AS doc, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS index FROM documents),
      hits AS (SELECT query_id, rank, source, index FROM bm JOIN ch USING (doc) WHERE rank <= 5),
      new AS (SELECT h.query_id, c.source, c.index, min(h.rank) AS rank FROM hits h JOIN ch c ON c.source = h.source AND abs(c.index - h.index) = 1
        WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.query_id = h.query_id AND x.source = c.source AND x.index = c.index) GROUP BY ALL),
      both_ AS (SELECT query_id, source, index, rank, false AS is_hit FROM new UNION ALL SELECT query_id, source, index, rank, true FROM hits)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, is_hit, index) AS position, source, index, is_hit FROM both_""",
    "compare_retrievers": f"""WITH {LEXICAL}, m AS (SELECT query_id, 'bm25' AS mode, doc, rank FROM bm WHERE rank <= 10 UNION ALL SELECT query_id, 'cosine', doc, rank FROM co WHERE rank <= 10),
      a AS (SELECT query_id, count(DISTINCT mode) AS modes FROM m GROUP BY query_id)
      SELECT m.query_id, m.mode, m.doc, m.rank, min(o.rank) AS best_elsewhere, count(DISTINCT o.mode) + 1 = any_value(modes) AS in_all FROM m JOIN a USING (query_id)
      LEFT JOIN m o ON o.query_id = m.query_id AND o.doc = m.doc AND o.mode <> m.mode GROUP BY ALL""",
    "dense_search": f"WITH {_DENSE} SELECT * FROM (SELECT query_id, vec_id AS id, {_SIM} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_SIM} DESC, vec_id) AS rank FROM q, e) WHERE rank <= 10",
    "dense_with_floor": f"WITH {_DENSE} SELECT * FROM (SELECT query_id, vec_id AS id, {_SIM} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_SIM} DESC, vec_id) AS rank FROM q, e WHERE label <> 0 AND {_SIM} >= 0.25) WHERE rank <= 5",
    "dense_by_label": f"""WITH {_DENSE}, f AS (SELECT * FROM (SELECT query_id, vec_id AS id, label, {_SIM} AS score, row_number() OVER (PARTITION BY query_id, label ORDER BY {_SIM} DESC, vec_id) AS n FROM q, e) WHERE n <= 3)
      SELECT * FROM (SELECT id, query_id, score, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""",
    "knn_graph": f"WITH {_KNN} SELECT * FROM edges",
    "knn_degrees": f"WITH {_KNN} SELECT vec_id, count(x) AS degree FROM embeddings LEFT JOIN (SELECT a AS x FROM edges UNION ALL SELECT b FROM edges) ON x = vec_id GROUP BY vec_id",
}
