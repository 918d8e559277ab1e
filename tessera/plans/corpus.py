"""Queries over documents as a chunk corpus: ten documents are the chunks of a video, a source is a channel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import corpus
from tessera.sources.tables import table


def chunk_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("v"), F.floor(F.col("doc_id") / 10)).alias("video"), (F.col("doc_id") % 10).alias("index"), F.col("source").alias("channel"), "doc_id", "lang", "n_chars", "text")


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("v"), F.floor(F.col("doc_id") / 10)).alias("video"), "quality", "toxic")


def _toxic(spark, sf_dir):
    return _labelled(spark, sf_dir).where("toxic = 1")


def video_chunks(spark, sf_dir):
    return corpus.of_videos(chunk_rows(spark, sf_dir), _labelled(spark, sf_dir)).select("video", "index", "channel")


def chunk_listing(spark, sf_dir):
    return corpus.listed(chunk_rows(spark, sf_dir).where("lang = 'en'")).select("video", "index", "position", "total")


def lexical_corpus(spark, sf_dir):
    """The chunks of the channel src1 outside videos with toxic documents, with their number of tokens."""
    kept = corpus.scoped(chunk_rows(spark, sf_dir), channel=CHANNEL, held_out=_toxic(spark, sf_dir))
    return kept.select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("tokens")).where("tokens > 0")


def video_scope(spark, sf_dir):
    return corpus.scoped(chunk_rows(spark, sf_dir), video="v7").select("video", "index", "channel")


def channel_videos(spark, sf_dir):
    return corpus.videos_of_channels(chunk_rows(spark, sf_dir), "doc_id", _toxic(spark, sf_dir))


def chunk_counts(spark, sf_dir):
    asked = _labelled(spark, sf_dir).select("video").unionByName(spark.range(3).select(F.concat(F.lit("none"), "id").alias("video")))
    return corpus.counted(chunk_rows(spark, sf_dir).where("lang = 'de'"), asked)


def raw_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stored = corpus.with_body(docs, corpus.raw_key(F.col("doc_id")), ["doc_id", "text", "lang", "source", "n_chars"])
    keys = docs.where("doc_id % 50 = 0").select(corpus.raw_key(F.col("doc_id")).alias("key"))
    found = corpus.looked_up(stored, keys, "doc_id long, text string, lang string, source string, n_chars long")
    return found.select("key", "doc_id", "lang", "source", "n_chars", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def metadata_backfill(spark, sf_dir):
    videos = chunk_rows(spark, sf_dir).groupBy("video").agg(F.min("channel").alias("channel_name"), F.min("lang").alias("title"), F.min("doc_id").alias("d"))
    named = videos.select("video", F.when(F.col("d") % 3 == 0, F.concat(F.lit("c"), "d")).when(F.col("d") % 3 == 1, "").alias("channel_id"), "channel_name", "title", F.lit("2024-01-01").alias("upload_date"))
    return corpus.with_identity(chunk_rows(spark, sf_dir).select("video", "index"), named)


def summary_states(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video"), F.when(F.col("lang") == "en", F.col("source")).when(F.col("lang") == "fr", "  ").alias("summary"))
    stored = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("video")).agg(F.concat(F.lit("m"), F.max("quality")).alias("model"))
    return corpus.summary_status(raw, stored, "m1")


def contextual_headers(spark, sf_dir):
    chunks = chunk_rows(spark, sf_dir).select(F.col("doc_id").alias("chunk"), F.col("channel").alias("header"))
    contexts = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("chunk")).agg(F.when(F.max("quality") == 1, "on good writing").otherwise(" ").alias("context"))
    return corpus.situated(chunks, contexts)


def index_reports(spark, sf_dir):
    stored = chunk_rows(spark, sf_dir).select("video", F.col("doc_id").alias("chunk"))
    new = chunk_rows(spark, sf_dir).where("n_chars > 500").select("video", F.col("doc_id").alias("chunk"))
    return corpus.index_report(stored, new)


def cell_cache(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("fingerprint"))
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fingerprint"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice").cast("double")).alias("value"), F.when(F.col("o_orderstatus") == "O", "failed").alias("error"))
    return corpus.cached_cells(wanted, corpus.cacheable(cells))


def transcript_stages(spark, sf_dir):
    docs = chunk_rows(spark, sf_dir).groupBy("video").agg(F.count("*").alias("segments"))
    return corpus.transcript_rows(docs, chunk_rows(spark, sf_dir).where("lang = 'es'"), _labelled(spark, sf_dir).where("quality = 1"))


def indexed_updates(spark, sf_dir):
    """Contexts of given chunks: a lookup by key."""
    keys = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk")).distinct()
    return contextual_headers(spark, sf_dir).join(keys, "chunk", "left_semi").select("chunk", "header")


CHANNEL = "src1"
QUERIES = {f.__name__: f for f in (video_chunks, chunk_listing, lexical_corpus, video_scope, channel_videos, chunk_counts, raw_lookup, metadata_backfill, summary_states, contextual_headers, index_reports, cell_cache, transcript_stages, indexed_updates)}

CHUNKS = "ch AS (SELECT 'v' || (doc_id // 10) AS video, doc_id % 10 AS index, source AS channel, doc_id, lang, n_chars, text FROM documents), lab AS (SELECT 'v' || (doc_id // 10) AS video, quality, toxic FROM labels)"
_HEADERS = "SELECT d.doc_id AS chunk, d.source || CASE WHEN g = 1 THEN chr(10) || 'on good writing' ELSE '' END AS header, coalesce(g = 1, false) AS situated FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS g FROM labels GROUP BY doc_id) l USING (doc_id)"
ORACLE = {
    "video_chunks": f"WITH {CHUNKS} SELECT video, index, channel FROM ch WHERE video IN (SELECT video FROM lab)",
    "chunk_listing": f"WITH {CHUNKS} SELECT video, index, row_number() OVER (PARTITION BY video ORDER BY index) AS position, count(*) OVER (PARTITION BY video) AS total FROM ch WHERE lang = 'en'",
    "lexical_corpus": f"WITH {CHUNKS} SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tokens FROM ch WHERE channel = '{CHANNEL}' AND video NOT IN (SELECT video FROM lab WHERE toxic = 1) AND len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0",
    "video_scope": f"WITH {CHUNKS} SELECT video, index, channel FROM ch WHERE video = 'v7'",
    "channel_videos": f"WITH {CHUNKS} SELECT channel, video, row_number() OVER (PARTITION BY channel ORDER BY min(doc_id), video) AS position FROM ch WHERE video NOT IN (SELECT video FROM lab WHERE toxic = 1) GROUP BY channel, video",
    "chunk_counts": f"WITH {CHUNKS}, asked AS (SELECT DISTINCT video FROM lab UNION ALL SELECT 'none' || range FROM range(3)) SELECT video, count(index) AS chunks, count(index) > 0 AS has_any FROM asked LEFT JOIN (SELECT * FROM ch WHERE lang = 'de') USING (video) GROUP BY video",
    "raw_lookup": "SELECT 'raw_transcript:' || doc_id AS key, doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents WHERE doc_id % 50 = 0",
    "metadata_backfill": f"""WITH {CHUNKS}, v AS (SELECT video, min(channel) AS name, min(lang) AS title, min(doc_id) AS d FROM ch GROUP BY video)
      SELECT video, index, CASE WHEN d % 3 = 0 THEN 'c' || d ELSE 'name:' || name END AS channel_key, title, '2024-01-01' AS upload_date FROM ch JOIN v USING (video)""",
    "summary_states": "SELECT doc_id AS video, CASE WHEN q = 1 THEN 'hit' WHEN q IS NOT NULL THEN 'refresh' WHEN lang = 'en' THEN 'indexed' ELSE 'created' END AS status FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)",
    "contextual_headers": _HEADERS,
    "index_reports": f"WITH {CHUNKS} SELECT video, count(*) FILTER (n_chars > 500) AS stored, count(*) FILTER (n_chars <= 500) AS removed FROM ch GROUP BY video HAVING count(*) FILTER (n_chars > 500) > 0",
    "cell_cache": "SELECT o_orderkey AS fingerprint, CASE WHEN o_orderkey % 3 > 0 AND o_orderstatus <> 'O' THEN o_totalprice::DOUBLE END AS value, o_orderkey % 3 > 0 AND o_orderstatus <> 'O' AS hit FROM orders WHERE o_orderkey % 5 = 0",
    "transcript_stages": f"""WITH {CHUNKS} SELECT video, segments, chunks, has_summary, CASE WHEN chunks = 0 THEN 'raw' WHEN NOT has_summary THEN 'chunked' ELSE 'summarised' END AS stage FROM (
      SELECT video, count(*) AS segments, count(*) FILTER (lang = 'es') AS chunks, video IN (SELECT video FROM lab WHERE quality = 1) AS has_summary FROM ch GROUP BY video)""",
    "indexed_updates": f"SELECT chunk, header FROM ({_HEADERS}) WHERE chunk IN (SELECT doc_id FROM labels WHERE toxic = 1)",
}
