"""Queries over sections of pages, layouts and soft clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import documents, themes
from tessera.sources.tables import table


def page_sections(spark, sf_dir):
    return documents.sections(table(spark, sf_dir, "pages"), "page_id", "html")


def conversation_sections(spark, sf_dir):
    """Turns as plain documents."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 100 + F.col("turn")).alias("page_id"), "text")
    return documents.sections(turns, "page_id", "text", html=False).select("page_id", "index", "heading", "text", "title")


def layout(spark, sf_dir):
    points = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("x"), (F.col("s_nationkey") * 100.0).cast("double").alias("y"))
    return themes.normalised_layout(points)


def layout_digest(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"))
    return themes.layout_fingerprint(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), edges)


def soft_themes(spark, sf_dir):
    return themes.soft_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


QUERIES = {f.__name__: f for f in (page_sections, conversation_sections, layout, layout_digest, soft_themes)}

_MARK = "('0x' || substr(md5({x}), 1, 15))::BIGINT"
ORACLE = {
    "page_sections": r"""
      WITH tokens AS (
        SELECT page_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '<(script|style)[^>]*>[\s\S]*?</(script|style)>', '<skipped>', 'g'), '<!--[\s\S]*?-->|<[^>]*>|[^<]+') AS t FROM pages)
      ), named AS (
        SELECT *, CASE WHEN tok[1] <> '<' THEN 'text' ELSE lower(regexp_extract(tok, '^<(/?[a-zA-Z][a-zA-Z0-9]*)', 1)) END AS tag FROM tokens
      ), kinds AS (
        SELECT page_id, pos, CASE
            WHEN tag = 'text' AND trim(tok, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) = '' THEN 'blank' WHEN tag = 'text' THEN 'text' WHEN tag = 'title' THEN 'title' WHEN tag = '/title' THEN 'titled' WHEN regexp_full_match(tag, 'h[1-6]') THEN 'heading' WHEN regexp_full_match(tag, '/h[1-6]') THEN 'headed'
            WHEN ltrim(tag, '/') IN ('p','div','section','article','main','aside','nav','header','footer','li','ul','ol','dl','dt','dd','tr','td','th','table','blockquote','pre','figure','figcaption','br','hr','form','label') THEN CASE WHEN tag[1] = '/' THEN 'end' ELSE 'block' END END AS kind,
          replace(replace(replace(replace(tok, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS said FROM named
      ), placed AS (
        SELECT *, coalesce(last_value(CASE WHEN kind IN ('title', 'titled') THEN kind END IGNORE NULLS) OVER w, '') = 'title' AS titled,
          coalesce(last_value(CASE WHEN kind IN ('heading', 'headed', 'block') THEN kind END IGNORE NULLS) OVER w, '') = 'heading' AS heading, count(*) FILTER (kind = 'heading') OVER w AS h
        FROM kinds WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
      ), titles AS (
        SELECT page_id, trim(regexp_replace(string_agg(said, ' ' ORDER BY pos), '[ \t\x{00a0}]+', ' ', 'g')) AS title FROM placed WHERE kind = 'text' AND titled GROUP BY page_id
      ), headings AS (
        SELECT * FROM (SELECT page_id, h, trim(regexp_replace(string_agg(said, '' ORDER BY pos), '[ \t\x{00a0}]+', ' ', 'g')) AS said FROM placed WHERE kind = 'text' AND heading AND NOT titled GROUP BY page_id, h) WHERE said <> ''
      ), texts AS (
        SELECT page_id, s, array_to_string(list_filter(list_transform(string_split(string_agg(CASE WHEN kind = 'text' THEN said ELSE chr(10) END, '' ORDER BY pos), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x{00a0}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS said
        FROM (SELECT p.*, (SELECT coalesce(max(h.h), 0) FROM headings h WHERE h.page_id = p.page_id AND h.h <= p.h) AS s FROM placed p WHERE kind IN ('block', 'end') OR kind = 'text' AND NOT heading AND NOT titled) GROUP BY page_id, s
      ), found AS (
        SELECT coalesce(t.page_id, h.page_id) AS page_id, coalesce(t.s, h.h) AS s, coalesce(h.said, '') AS heading, coalesce(t.said, '') AS said FROM texts t FULL JOIN headings h ON t.page_id = h.page_id AND t.s = h.h WHERE coalesce(h.said, '') <> '' OR coalesce(t.said, '') <> ''
      ), starts AS (
        SELECT *, sum((length(said) >= 40 OR first)::INT) OVER (PARTITION BY page_id ORDER BY s) AS part FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY s) = 1 AS first FROM found)
      ), parts AS (
        SELECT page_id, (part - 1)::INT AS index, min_by(heading, s) AS heading, string_agg(CASE WHEN s = lo THEN nullif(said, '') ELSE concat_ws(chr(10), nullif(heading, ''), nullif(said, '')) END, chr(10) ORDER BY s) AS text
        FROM (SELECT *, min(s) OVER (PARTITION BY page_id, part) AS lo FROM starts) GROUP BY page_id, part
      )
      SELECT p.page_id, coalesce(t.title, first_value(p.heading) OVER (PARTITION BY p.page_id ORDER BY p.index), '') AS title, p.index, p.heading, coalesce(p.text, '') AS text FROM parts p LEFT JOIN titles t USING (page_id)""",
    "conversation_sections": r"""WITH b AS (SELECT conv_id * 100 + turn AS page_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(regexp_replace(y, '[ \t\x{00a0}]+', ' ', 'g'))), lambda y: y <> ''), chr(10))), lambda x: x <> '') AS l FROM conversations WHERE text IS NOT NULL),
      e AS (SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS s FROM b), g AS (SELECT *, sum((i = 0 OR length(s) >= 40)::INT) OVER (PARTITION BY page_id ORDER BY i) AS part FROM e)
      SELECT page_id, (part - 1)::INT AS index, '' AS heading, string_agg(s, chr(10) ORDER BY i) AS text, '' AS title FROM g GROUP BY page_id, part""",
    "layout": """WITH p AS (SELECT s_suppkey, s_acctbal::DOUBLE AS x, s_nationkey * 100.0::DOUBLE AS y FROM supplier), b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p)
      SELECT s_suppkey, round((x - (lx + hx) / 2) / greatest(hx - lx, hy - ly), 6) AS x, round((y - (ly + hy) / 2) / greatest(hx - lx, hy - ly), 6) AS y FROM p, b""",
    "layout_digest": f"""SELECT * FROM (SELECT count(*) AS nodes, (sum({_MARK.format(x='s_suppkey::VARCHAR')}) % 1152921504606846976)::BIGINT AS node_mark FROM supplier), (SELECT count(*) AS edges, (sum({_MARK.format(x="a || '|' || b")}) % 1152921504606846976)::BIGINT AS edge_mark FROM (SELECT DISTINCT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b FROM lineitem))""",
}
