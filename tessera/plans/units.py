"""Queries over themes, communities and packs: order priorities are themes, suppliers creators, nations packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import units as un
from tessera.plans.claims import _anchors, _claims, _entities, _members
from tessera.sources.tables import table


def _themes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_suppkey % 5 > 0").select((F.col("l_partkey") % 90).alias("theme"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk"), (F.col("l_orderkey") % 300).alias("video"), F.when(F.col("l_partkey") % 90 < 4, F.lit(1)).otherwise(F.col("l_suppkey") % 6).alias("creator"), F.col("l_returnflag").alias("domain"))


def _pack(spark, sf_dir):
    return spark.range(40).select((F.col("id") * 7).alias("video"))


def theme_units(spark, sf_dir):
    return un.theme_units(_themes(spark, sf_dir), _pack(spark, sf_dir))


def community_units(spark, sf_dir):
    return un.community_units(_members(spark, sf_dir), _entities(spark, sf_dir).drop("aliases"), _anchors(spark, sf_dir), _claims(spark, sf_dir), spark.range(9).select(F.col("id").alias("video")))


def arm_units(spark, sf_dir):
    arms = {"themes": theme_units(spark, sf_dir), "none": theme_units(spark, sf_dir).limit(0)}
    return un.eligible(un.selected(arms, "themes")).select("theme", "chunks")


def _clusters(spark, sf_dir):
    t = _themes(spark, sf_dir)
    return t.groupBy(F.concat_ws("-", "theme", "domain").alias("cluster")).agg(F.count("*").alias("size"), F.count_distinct("video").alias("videos"), F.min("chunk").alias("first"))


def cluster_order(spark, sf_dir):
    return un.clusters_ordered(_clusters(spark, sf_dir))


def theme_videos(spark, sf_dir):
    return un.theme_videos(_themes(spark, sf_dir))


def theme_purity(spark, sf_dir):
    return un.theme_purity(_themes(spark, sf_dir))


def theme_detail(spark, sf_dir):
    chunks = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk"), F.col("l_returnflag").alias("title"))
    return un.theme_detail(_themes(spark, sf_dir), chunks, 17)


def soft_memberships(spark, sf_dir):
    soft = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 2000).alias("chunk"), F.col("l_linenumber").alias("cluster")).agg((F.max("l_discount").cast("double")).alias("weight")).where("weight >= 0.05")
    out = un.membership_columns(soft)
    return out.select("chunk", "clusters", "best", F.array_join(F.transform(F.map_keys("weights"), lambda k: k.cast("string")), ",").alias("keys"))


def intruder_probes(spark, sf_dir):
    return un.intruders(_themes(spark, sf_dir).select("theme", "chunk"))


def conflict_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    conflicts = o.select(F.col("o_orderkey").alias("conflict"), F.col("o_custkey").alias("chunk_a"), (F.col("o_custkey") + 700).alias("chunk_b"), F.col("o_totalprice").cast("double").alias("similarity"))
    return un.conflicts_listed(conflicts, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk"), F.col("c_nationkey").alias("video")))


def pack_listing(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("pack"), (F.col("c_custkey") % 3 > 0).alias("included"))
    rules = table(spark, sf_dir, "supplier").where("s_nationkey < 15").select(F.col("s_nationkey").alias("pack"))
    return un.packs_listed(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pack")), members, rules)


def override_writes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("pack"), F.col("c_custkey").alias("video"), (F.col("c_custkey") % 2 == 0).alias("included"))
    written = c.where("video % 5 = 0").withColumn("included", F.when(F.col("video") % 15 > 0, F.lit(True)))
    return un.with_override(c.where("video % 3 = 0"), written)


def quote_resolution(spark, sf_dir):
    return un.pack_checks(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 30).alias("pack"), (F.col("l_quantity").cast("double") / 50).alias("ratio")))


def routed_members(spark, sf_dir):
    summaries = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("pack"), F.col("c_custkey").alias("video")).agg(F.max(F.col("o_totalprice").cast("double")).alias("score"))
    pins = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_nationkey").alias("pack"), F.col("c_custkey").alias("video"), (F.col("c_custkey") % 2 == 0).alias("included"))
    return un.member_routes(summaries, table(spark, sf_dir, "customer").where("c_custkey % 4 = 1").select(F.col("c_custkey").alias("video")), pins, 10)


def changed_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    after = d.select(F.col("doc_id").alias("key"), F.md5(F.encode("text", "UTF-8")).alias("digest"))
    before = d.where("doc_id % 3 > 0").select(F.col("doc_id").alias("key"), F.md5(F.encode(F.when(F.col("doc_id") % 5 > 0, F.col("text")).otherwise("old"), "UTF-8")).alias("digest"))
    return un.added(before, after)


def pack_details(spark, sf_dir):
    packs = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("pack"))
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("pack"), (F.col("c_custkey") % 100).alias("video"), (F.col("c_custkey") % 3 > 0).alias("included"))
    rules = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pack"), F.col("s_suppkey").alias("rule"))
    evidence = table(spark, sf_dir, "lineitem").where("l_suppkey % 9 > 0 and l_quantity > 45").select(F.col("l_suppkey").alias("rule"), (F.col("l_orderkey") % 100).alias("video"))
    return un.pack_detail(packs, members, rules, evidence)


QUERIES = {f.__name__: f for f in (pack_details, theme_units, community_units, arm_units, cluster_order, theme_videos, theme_purity, theme_detail, soft_memberships, intruder_probes, conflict_list, pack_listing, override_writes, quote_resolution, routed_members, changed_documents)}

_T = "t AS (SELECT l_partkey % 90 AS theme, l_orderkey * 10 + l_linenumber AS chunk, l_orderkey % 300 AS video, CASE WHEN l_partkey % 90 < 4 THEN 1 ELSE l_suppkey % 6 END AS creator, l_returnflag AS domain FROM lineitem WHERE l_suppkey % 5 > 0)"
_UNITS = f"""{_T}, i AS (SELECT * FROM t WHERE video % 7 = 0 AND video < 280), u AS (SELECT theme, sum(n)::BIGINT AS chunks, count(*) AS creators, round(max(n) / sum(n), 4) AS share FROM (SELECT theme, creator, count(*) AS n FROM i GROUP BY ALL) GROUP BY theme HAVING sum(n) >= 5),
tu AS (SELECT *, reason IS NULL AS eligible FROM (SELECT theme, chunks, videos, creators, share, CASE WHEN videos < 2 THEN 'few_videos' WHEN creators < 2 THEN 'few_creators' WHEN share > 0.8 THEN 'one_creator' END AS reason FROM u JOIN (SELECT theme, count(DISTINCT video) AS videos FROM i GROUP BY theme) USING (theme)))"""
ORACLE = {
    "pack_details": """WITH m AS (SELECT DISTINCT c_nationkey AS pack, c_custkey % 100 AS video FROM customer WHERE c_custkey % 3 > 0), e AS (SELECT l_suppkey AS rule, l_orderkey % 100 AS video FROM lineitem WHERE l_suppkey % 9 > 0 AND l_quantity > 45)
      SELECT s_nationkey AS pack, s_suppkey AS rule, count(e.video) AS citations, count(DISTINCT e.video) AS videos, count(*) FILTER (e.video IS NOT NULL AND m.video IS NULL) AS outside FROM supplier LEFT JOIN e ON rule = s_suppkey LEFT JOIN m ON m.pack = s_nationkey AND m.video = e.video WHERE s_nationkey < 20 GROUP BY ALL""",
    "theme_units": f"WITH {_UNITS} SELECT * FROM tu",
    "arm_units": f"WITH {_UNITS} SELECT theme, chunks FROM tu WHERE eligible",
    "community_units": """WITH m AS (SELECT s_suppkey AS entity, s_nationkey AS community FROM supplier), a AS (SELECT DISTINCT l_orderkey AS claim, l_suppkey AS entity FROM lineitem),
      e AS (SELECT entity, community, s_name AS name, row_number() OVER (PARTITION BY community ORDER BY mentions DESC, entity) AS n FROM m JOIN supplier ON s_suppkey = entity JOIN (SELECT entity, count(*) AS mentions FROM a GROUP BY entity) USING (entity))
      SELECT community, entities, claims, videos, title FROM (SELECT community, count(*) AS entities FROM m GROUP BY community HAVING count(*) >= 5)
      JOIN (SELECT community, count(DISTINCT claim) AS claims, count(DISTINCT o_custkey % 40) AS videos FROM a JOIN m USING (entity) JOIN orders ON o_orderkey = claim WHERE o_custkey % 40 < 9 GROUP BY community) USING (community)
      JOIN (SELECT community, string_agg(name, ', ' ORDER BY n) AS title FROM e WHERE n <= 6 GROUP BY community) USING (community)""",
    "cluster_order": f"WITH {_T} SELECT *, row_number() OVER (ORDER BY videos < 2, size DESC, first, cluster) AS place FROM (SELECT theme || '-' || domain AS cluster, count(*) AS size, count(DISTINCT video) AS videos, min(chunk) AS first FROM t GROUP BY theme, domain)",
    "theme_videos": f"WITH {_T} SELECT theme, video, count(*) AS members, row_number() OVER (PARTITION BY theme ORDER BY count(*) DESC, video) AS position FROM t GROUP BY theme, video",
    "theme_purity": f"""WITH {_T}, c AS (SELECT theme, creator, n, sum(n) OVER (PARTITION BY theme) AS total, row_number() OVER (PARTITION BY theme ORDER BY n DESC, creator DESC) AS r FROM (SELECT theme, creator, count(*) AS n FROM t GROUP BY ALL)),
      d AS (SELECT theme, max(n) AS d FROM (SELECT theme, domain, count(*) AS n FROM t GROUP BY ALL) GROUP BY theme)
      SELECT *, off_share > 0.2 AS impure FROM (SELECT theme, creator AS top_creator, round(n / total, 4) AS top_share, round(1 - d / total, 4) AS off_share FROM c JOIN d USING (theme) WHERE r = 1)""",
    "theme_detail": f"WITH {_T} SELECT chunk, l_returnflag AS title FROM t JOIN lineitem ON chunk = l_orderkey * 10 + l_linenumber WHERE theme = 17 AND l_quantity > 10",
    "soft_memberships": "SELECT chunk, count(*) AS clusters, arg_max(cluster, weight * 100 - cluster / 100.0) AS best, string_agg(cluster::VARCHAR, ',' ORDER BY cluster) AS keys FROM (SELECT l_orderkey % 2000 AS chunk, l_linenumber AS cluster, max(l_discount)::DOUBLE AS weight FROM lineitem GROUP BY ALL) WHERE weight >= 0.05 GROUP BY chunk",
    "intruder_probes": f"""WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY md5(theme || '|' || chunk), chunk) AS n FROM (SELECT DISTINCT theme, chunk FROM t)), f AS (SELECT theme, coalesce(lead(theme) OVER (ORDER BY theme), min(theme) OVER ()) AS other FROM (SELECT DISTINCT theme FROM t)),
      b AS (SELECT theme, chunk, false AS intruder FROM r WHERE n <= 4 UNION ALL SELECT f.theme, r.chunk, true FROM f JOIN r ON r.theme = f.other AND r.n = 1 WHERE f.theme <> f.other)
      SELECT *, row_number() OVER (PARTITION BY theme ORDER BY md5(chunk || '|' || theme), chunk) AS position FROM b""",
    "conflict_list": "SELECT o_orderkey AS conflict, o_custkey AS chunk_a, o_custkey + 700 AS chunk_b, o_totalprice::DOUBLE AS similarity, a.c_nationkey AS video_a, b.c_nationkey AS video_b FROM orders JOIN customer a ON a.c_custkey = o_custkey JOIN customer b ON b.c_custkey = o_custkey + 700",
    "pack_listing": "SELECT n_nationkey AS pack, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 3 > 0) AS members, CASE WHEN n_nationkey < 15 THEN (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) ELSE 0 END AS rules, n_nationkey < 15 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS built FROM nation",
    "override_writes": "SELECT c_nationkey AS pack, c_custkey AS video, CASE WHEN c_custkey % 5 = 0 THEN true ELSE c_custkey % 2 = 0 END AS included FROM customer WHERE (c_custkey % 3 = 0 OR c_custkey % 5 = 0) AND c_custkey % 15 > 0",
    "quote_resolution": "SELECT *, quotes = resolved AS ok FROM (SELECT l_suppkey % 30 AS pack, count(*) AS quotes, count(*) FILTER (l_quantity::DOUBLE / 50 >= 0.9) AS resolved, round(count(*) FILTER (l_quantity::DOUBLE / 50 >= 0.9) / count(*), 4) AS resolution FROM lineitem GROUP BY 1)",
    "routed_members": """WITH s AS (SELECT c_nationkey AS pack, c_custkey AS video, max(o_totalprice::DOUBLE) AS score FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 4 <> 1 GROUP BY ALL),
      r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY score DESC, video) AS n FROM s) WHERE n <= 10), p AS (SELECT c_nationkey AS pack, c_custkey AS video, c_custkey % 2 = 0 AS pin FROM customer WHERE c_custkey % 7 = 0)
      SELECT *, row_number() OVER (PARTITION BY pack ORDER BY included DESC, score DESC NULLS LAST, video) AS position FROM (SELECT coalesce(r.pack, p.pack) AS pack, coalesce(r.video, p.video) AS video, score, coalesce(pin, true) AS included FROM r FULL JOIN p ON r.pack = p.pack AND r.video = p.video)""",
    "changed_documents": "SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'changed' END AS change FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 5 = 0 AND text <> 'old')",
}
