"""Queries over single rows: text expressions, detectors, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.sources.tables import table


def text_tokens(spark, sf_dir):
    t = tx.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("kinds"), F.size(tx.quote_tokens(F.col("text"))).cast("long").alias("quoted"), tx.estimated_tokens(F.col("text")).alias("estimate"))


def text_identities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunk = tx.chunk_id(F.col("source"), F.col("doc_id"))
    return docs.select("doc_id", chunk.alias("chunk"), tx.chunk_index(chunk).alias("index"), tx.chunk_source(chunk).alias("from_source"), tx.slug(F.col("text")).alias("slug"), tx.claim_id(chunk, F.col("text")).alias("claim"), tx.document_id(F.concat(F.lit("https://x.example/"), F.col("doc_id"))).alias("document"))


def text_previews(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.clipped(F.col("text"), 220).alias("clipped"), tx.clipped(F.col("text"), 400).alias("traced"))


def text_headers(spark, sf_dir):
    start, end = F.col("doc_id") * 7.5, F.col("doc_id") * 7.5 + F.col("n_chars") / 10
    return table(spark, sf_dir, "documents").select("doc_id", tx.context_header(F.col("source"), F.nullif(F.col("lang"), F.lit("en")), start, end).alias("header"), tx.timestamp(start - 100).alias("at"))


def text_signals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.corpus_wide_signal(F.col("text")).alias("signal"), tx.states_a_position(F.col("text")).alias("states"), F.size(tx.urls(F.col("text"))).cast("long").alias("urls"), tx.document_url(F.col("text")).alias("url"))


def page_urls(spark, sf_dir):
    said = F.concat(F.lit("see "), F.col("url"), F.lit(", or https://youtu.be/abcdefghijk."))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(tx.urls(said), " ").alias("urls"), tx.document_url(said).alias("document"), tx.host(F.col("url")).alias("host"), tx.video_id(F.element_at(tx.urls(said), -1)).alias("video"))


def query_normal_forms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tx.normal_query(F.col("text")).alias("normal"), F.levenshtein(F.regexp_replace("text", "[^a-z]", ""), F.regexp_replace(F.expr("substring(text, 2)"), "[^a-z]", "")).cast("long").alias("edits"))


def event_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", tx.weight_clamp(F.col("value") / 100).alias("weight"), F.date_format("ts", "yyyy-MM-dd").alias("day"), tx.safe_ratio(F.col("value"), F.col("user_id") % 7).alias("ratio"))


def language_domains(spark, sf_dir):
    """Documents by the language whose commonest words they have most of; ties in the order listed."""
    words = {"en": ["the", "and", "of"], "fr": ["le", "de", "que"], "de": ["der", "die", "und"], "es": ["el", "los", "del"]}
    found = tx.tokens(F.col("text"))
    hits = [F.struct(F.size(F.array_intersect(found, F.array(*map(F.lit, w)))).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, w) in enumerate(words.items())]
    best = F.array_max(F.array(*hits))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(best["n"] > 0, best["name"]).otherwise("other").alias("domain"), best["n"].cast("long").alias("hits"))


QUERIES = {f.__name__: f for f in (text_tokens, text_identities, text_previews, text_headers, text_signals, page_urls, query_normal_forms, event_props, language_domains)}

_CHUNK = "'chunk:' || source || ':' || doc_id"
_TS = "CASE WHEN {s} IS NULL THEN 'unknown' ELSE CASE WHEN floor(greatest({s}, 0)) >= 3600 THEN lpad(CAST(floor(floor(greatest({s}, 0)) / 3600)::INT AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(floor(floor(greatest({s}, 0)) / 60)::INT % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(floor(greatest({s}, 0))::INT % 60 AS VARCHAR), 2, '0') END"
_EDGE = r"[^\p{L}\p{M}\p{N}_]"


def _unicode(pattern: str) -> str:
    """A pattern for an engine whose word boundaries and classes know ASCII only: boundaries, which begin and end alternatives in turn, are spelt out."""
    parts = pattern.split(r"\b")
    starts = pattern.startswith("^")
    out = parts[0]
    for i, x in enumerate(parts[1:]):
        out += (f"(?:{_EDGE}|$)" if (i % 2 == 0) == starts else f"(?:^|{_EDGE})") + x
    return out.replace(r"\w", r"[\p{L}\p{M}\p{N}_]").replace(r"[\s,]", r"[\s\p{Z},]").replace(r"\s", r"[\s\p{Z}]").replace(r"[[\s\p{Z}]\p{Z},]", r"[\s\p{Z},]")


_SIGNAL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{_unicode(p)}') THEN '{n}'" for n, p in tx.CORPUS_WIDE) + " END"
_BARE = r"regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_STATES = f"{_BARE} <> '' AND NOT ends_with({_BARE}, '?') AND NOT regexp_matches(lower({_BARE}), '{_unicode(tx.QUESTION_LEAD)}')"
_URLS = r"list_transform(regexp_extract_all({t}, 'https?://[^\s<>\"'')\]]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', ''))"
_HOST = r"lower(regexp_extract({u}, '^https?://(?:www\.)?([^/?#:]+)', 1))"
_DOC = "list_filter(" + _URLS + ", lambda u: " + _HOST.format(u="u") + " NOT IN ('youtube.com', 'm.youtube.com', 'youtu.be', 'music.youtube.com'))[1]"
_SAID = "('see ' || url || ', or https://youtu.be/abcdefghijk.')"
_DT = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_HITS = {n: f"len(list_intersect(list_distinct({_DT}), [{', '.join(repr(x) for x in w)}]))" for n, w in (("en", ["the", "and", "of"]), ("fr", ["le", "de", "que"]), ("de", ["der", "die", "und"]), ("es", ["el", "los", "del"]))}

ORACLE = {
    "text_tokens": f"SELECT doc_id, len({_DT}) AS n, len(list_distinct({_DT})) AS kinds, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS quoted, ceil(length(text) / 4)::BIGINT AS estimate FROM documents",
    "text_identities": f"""SELECT doc_id, {_CHUNK} AS chunk, doc_id AS index, source AS from_source,
      coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS slug,
      'claim:' || substr(sha256({_CHUNK} || chr(10) || trim(text)), 1, 16) AS claim, 'doc:' || substr(sha256('https://x.example/' || doc_id), 1, 16) AS document FROM documents""",
    "text_previews": "SELECT doc_id, CASE WHEN length(text) > 220 THEN substr(text, 1, 220) || '…' ELSE text END AS clipped, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END AS traced FROM documents",
    "text_headers": f"SELECT doc_id, '[' || concat_ws(' — ', source, nullif(lang, 'en')) || ' @ ' || {_TS.format(s='(doc_id * 7.5::DOUBLE)')} || '-' || {_TS.format(s='(doc_id * 7.5::DOUBLE + n_chars / 10)')} || ']' AS header, {_TS.format(s='(doc_id * 7.5::DOUBLE - 100)')} AS at FROM documents",
    "text_signals": rf"""SELECT doc_id, {_SIGNAL} AS signal, {_STATES} AS states,
      len({_URLS.format(t='text')}) AS urls, {_DOC.format(t='text')} AS url FROM documents""",
    "page_urls": f"SELECT page_id, array_to_string({_URLS.format(t=_SAID)}, ' ') AS urls, {_DOC.format(t=_SAID)} AS document, {_HOST.format(u='url')} AS host, 'abcdefghijk' AS video FROM pages",
    "query_normal_forms": r"SELECT item_id, regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[\s?.!,;:]+$', '') AS normal, levenshtein(regexp_replace(text, '[^a-z]', '', 'g'), regexp_replace(substr(text, 2), '[^a-z]', '', 'g')) AS edits FROM benchmark",
    "event_props": "SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100)) AS weight, strftime(ts, '%Y-%m-%d') AS day, round(value / nullif(user_id % 7, 0), 4) AS ratio FROM events",
    "language_domains": f"""SELECT doc_id, CASE WHEN m = 0 THEN 'other' WHEN en = m THEN 'en' WHEN fr = m THEN 'fr' WHEN de = m THEN 'de' ELSE 'es' END AS domain, m AS hits
      FROM (SELECT *, greatest(en, fr, de, es) AS m FROM (SELECT doc_id, {', '.join(f'{q} AS {n}' for n, q in _HITS.items())} FROM documents))""",
}
