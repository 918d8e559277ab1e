"""Queries whose result is that of a walk in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import walks
from tessera.plans.corpus import CHUNKS, chunk_rows
from tessera.sources.tables import table


def pair_caps(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pairs = o.select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("chunk_a"), (F.col("o_orderkey") % 997 + 100000).alias("chunk_b"), (F.col("o_custkey") % 7).alias("source_a"), (F.col("o_orderkey") % 5).alias("source_b"))
    return walks.capped_pairs(pairs, 40, 2, 600).select("position")


def novel_evidence(spark, sf_dir):
    """Orders of a customer group that bring a part which none admitted before has."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return walks.admitted(rows.select((F.col("o_custkey") % 60).alias("group"), F.col("o_orderkey").alias("position"), (F.col("l_partkey") % 90).alias("item")))


def distinct_rules(spark, sf_dir):
    """Vectors in order of their ids without those at 0.3 or more to one kept before."""
    return walks.first_apart(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "position"), "position", "embedding", 0.3)


def followup_choice(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    said = F.concat(F.lit("q"), F.col("o_orderkey") % 30)
    return walks.followups(o.select((F.col("o_custkey") % 300).alias("query_id"), F.lit("q1").alias("question"), said.alias("query"), (F.col("o_orderkey") % 30).alias("confidence")).distinct())


def chunk_windows(spark, sf_dir):
    return walks.windows(chunk_rows(spark, sf_dir).select("video", "index", F.col("n_chars").alias("size")), 4000)


def section_choice(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\n")).alias("index", "line"))
    return walks.selected_sections(lines.select("document", "index", (-F.length("line")).alias("rank"), F.length("line").alias("size")), 900)


def sweep_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 200).alias("query_id"), F.col("l_orderkey").alias("position")).agg(F.collect_set(F.col("l_partkey") % 70).alias("chunks"))
    return walks.swept(rows, 2)


QUERIES = {f.__name__: f for f in (pair_caps, novel_evidence, distinct_rules, followup_choice, chunk_windows, section_choice, sweep_outcomes)}

ORACLE = {
    "pair_caps": """WITH RECURSIVE o AS MATERIALIZED (SELECT o_orderkey AS position, o_custkey AS a, o_orderkey % 997 + 100000 AS b, least(o_custkey % 7, o_orderkey % 5) * 10 + greatest(o_custkey % 7, o_orderkey % 5) AS s, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders),
      w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS c, []::BIGINT[] AS t, false AS ok UNION ALL SELECT n, CASE WHEN free THEN list_concat(c, [a, b]) ELSE c END, CASE WHEN free THEN list_append(t, s) ELSE t END, free
        FROM (SELECT o.n, a, b, s, c, t, len(list_filter(c, lambda x: x = a)) < 2 AND len(list_filter(c, lambda x: x = b)) < 2 AND len(list_filter(t, lambda x: x = s)) < 40 AS free FROM w JOIN o ON o.n = w.n + 1))
      SELECT position FROM o JOIN w USING (n) WHERE ok ORDER BY position LIMIT 600""",
    "novel_evidence": """WITH RECURSIVE r AS MATERIALIZED (SELECT g, p, items, row_number() OVER (PARTITION BY g ORDER BY p) AS n FROM (SELECT o_custkey % 60 AS g, o_orderkey AS p, list(DISTINCT l_partkey % 90) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)),
      w AS (SELECT g, 0::BIGINT AS n, []::BIGINT[] AS used, false AS ok FROM r GROUP BY g UNION ALL SELECT g, n, CASE WHEN new THEN list_distinct(list_concat(used, items)) ELSE used END, new FROM (SELECT r.g, r.n, items, used, NOT list_has_all(used, items) AS new FROM w JOIN r ON r.g = w.g AND r.n = w.n + 1))
      SELECT r.g AS "group", p AS position FROM r JOIN w ON r.g = w.g AND r.n = w.n WHERE ok""",
    "distinct_rules": """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
      d AS MATERIALIZED (SELECT a.vec_id AS p, list(b.vec_id) FILTER (b.vec_id IS NOT NULL) AS before, row_number() OVER (ORDER BY a.vec_id) AS n FROM e a LEFT JOIN e b ON b.vec_id < a.vec_id AND round(greatest(-1, least(1, list_cosine_similarity(a.v, b.v))), 6) >= 0.3 GROUP BY a.vec_id),
      w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept, false AS ok UNION ALL SELECT n, CASE WHEN free THEN list_append(kept, p) ELSE kept END, free FROM (SELECT d.n, p, kept, NOT coalesce(list_has_any(kept, before), false) AS free FROM w JOIN d ON d.n = w.n + 1))
      SELECT p AS position FROM d JOIN w USING (n) WHERE ok""",
    "followup_choice": """WITH RECURSIVE q AS MATERIALIZED (SELECT query_id, q, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, q) AS n FROM (SELECT DISTINCT o_custkey % 300 AS query_id, 'q' || (o_orderkey % 30) AS q, o_orderkey % 30 AS c FROM orders)),
      w AS (SELECT query_id, 0::BIGINT AS n, ['q1'] AS seen FROM q GROUP BY query_id UNION ALL SELECT w.query_id, q.n, CASE WHEN len(seen) <= 3 AND len(list_filter(seen, lambda s: levenshtein(s, q.q) <= 1)) = 0 THEN list_append(seen, q.q) ELSE seen END FROM w JOIN q ON q.query_id = w.query_id AND q.n = w.n + 1)
      SELECT query_id, (unnest(range(len(seen) - 1)))::INT AS position, unnest(seen[2:]) AS query FROM (SELECT query_id, arg_max(seen, n) AS seen FROM w GROUP BY query_id)""",
    "chunk_windows": f"""WITH RECURSIVE {CHUNKS}, l AS (SELECT video, list(n_chars ORDER BY index) AS s FROM ch GROUP BY video),
      w AS (SELECT video, s, index, index AS low, index AS high, true AS l, true AS r, 4000 - s[index + 1] AS room, 0 AS turn FROM (SELECT video, s, unnest(range(len(s))) AS index FROM l) UNION ALL
        SELECT video, s, index, low - gl::INT, high + gr::INT, gl, gr, room1 - CASE WHEN gr THEN s[high + 2] ELSE 0 END, turn + 1 FROM (
          SELECT *, coalesce(r AND high + 1 < len(s) AND s[high + 2] <= room1, false) AS gr FROM (SELECT *, room - CASE WHEN gl THEN s[low] ELSE 0 END AS room1 FROM (SELECT *, coalesce(l AND low > 0 AND s[low] <= room, false) AS gl FROM w WHERE l OR r))))
      SELECT video, index, arg_max(low, turn) AS low, arg_max(high, turn) AS high FROM w GROUP BY video, index""",
    "section_choice": """WITH RECURSIVE s AS (SELECT doc_id, i, length(x) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY length(x) DESC, i) AS n, sum(length(x)) OVER (PARTITION BY doc_id) AS whole FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
      m AS MATERIALIZED (SELECT * FROM s),
      w AS (SELECT doc_id, 0::BIGINT AS n, 900::BIGINT AS room, 0 AS taken, false AS ok FROM m WHERE whole > 900 GROUP BY doc_id UNION ALL
        SELECT doc_id, n, CASE WHEN fits THEN room - size ELSE room END, taken + fits::INT, fits FROM (SELECT m.doc_id, m.n, room, size, taken, size <= room OR taken = 0 AS fits FROM w JOIN m ON m.doc_id = w.doc_id AND m.n = w.n + 1))
      SELECT doc_id AS document, i AS index FROM m WHERE whole <= 900 UNION ALL SELECT m.doc_id, i FROM m JOIN w ON m.doc_id = w.doc_id AND m.n = w.n WHERE ok""",
    "sweep_outcomes": """WITH RECURSIVE r AS MATERIALIZED (SELECT q, p, items, row_number() OVER (PARTITION BY q ORDER BY p) AS n FROM (SELECT l_orderkey % 200 AS q, l_orderkey AS p, list(DISTINCT l_partkey % 70) AS items FROM lineitem GROUP BY ALL)),
      w AS (SELECT q, 0::BIGINT AS n, []::BIGINT[] AS seen, false AS ok FROM r GROUP BY q UNION ALL SELECT q, n, CASE WHEN new THEN list_distinct(list_concat(seen, items)) ELSE seen END, new FROM (SELECT r.q, r.n, items, seen, len(list_filter(items, lambda x: NOT list_contains(seen, x))) >= 2 AS new FROM w JOIN r ON r.q = w.q AND r.n = w.n + 1))
      SELECT r.q AS query_id, p AS position, CASE WHEN ok THEN 'merged' ELSE 'no_new_evidence' END AS outcome FROM r JOIN w ON r.q = w.q AND r.n = w.n""",
}
