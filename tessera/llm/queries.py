"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, codes, decontaminate, html, imatch, lexical, pivots, quality, secrets, sharding, simhash, urls
from tessera.llm.runtime import checkpointed

SHARDS = 16
PROBE = r"\### Assistant: </turn> ok"
PROBE_CONVERSATION = -7
RULES = [
    urls.Rule("com", "/en/", "block"),
    urls.Rule("example.com", "/en/7", "allow"),
    urls.Rule("net", "/de/", "allow"),
    urls.Rule("example.net", "/de/8", "block"),
    urls.Rule("org", "/es/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> bytes:
    """Content of the rank file, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_report(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(_table(spark, sf_dir, "documents"))
    strong = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.encode(listed(strong), "UTF-8"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_CONVERSATION).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return chat.digest(chat.read_back(chat.format_conversations(turns.unionByName(probe))))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = checkpointed(urls.word_counts(_table(spark, sf_dir, "documents")))
    judged = urls.judge(_table(spark, sf_dir, "pages"), RULES, words)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"), "score")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "bad_votes", "posterior", "score", "keep")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), vocabulary(), arrays=False).withColumnRenamed("id", "doc_id")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivots.near_vectors(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP4_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST({PROBE_CONVERSATION} AS BIGINT), CAST(0 AS BIGINT), 'user', '{PROBE}'
  UNION ALL SELECT CAST({PROBE_CONVERSATION} AS BIGINT), CAST(1 AS BIGINT), 'assistant', '{PROBE}'
), convs AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS lost,
    string_agg(role, ' ' ORDER BY turn, role, text) AS roles,
    sum(length('### ' || role || ': ') + length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')) + length('</turn>') + 1) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(lost) AS BIGINT) AS loss_chars,
  sha256(lost) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
  regexp_full_match(roles, '(system )?user assistant( user assistant)*') AS valid
FROM convs
"""


def _op11_sql() -> str:
    parts, entries, rounds = codes.PARTS, codes.ENTRIES, codes.ROUNDS

    def assigned(r: int) -> str:
        return f"""near{r} AS MATERIALIZED (
  SELECT a.vec_id, a.p, min({{'d': list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.e}}) AS m
  FROM parts a JOIN book{r} b ON a.p = b.p GROUP BY a.vec_id, a.p
)"""

    def moved(r: int) -> str:
        return f"""sums{r} AS (
  SELECT p, e, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT a.p, n.m.e AS e, unnest(a.v) AS x, generate_subscripts(a.v, 1) AS k FROM parts a JOIN near{r} n ON a.vec_id = n.vec_id AND a.p = n.p) GROUP BY p, e, k
), means{r} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS v FROM sums{r} GROUP BY p, e
), book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN means{r} m ON b.p = m.p AND b.e = m.e)"""

    steps = ",\n".join(f"{assigned(r)}, {moved(r)}" for r in range(rounds))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS v FROM kept, range({parts}) AS t(p)
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}
), book0 AS MATERIALIZED (SELECT a.p, f.e, a.v FROM parts a JOIN firsts f ON a.vec_id = f.vec_id),
{steps},
{assigned(rounds)}, found AS (
  SELECT vec_id, string_agg(lower(printf('%02x', CAST(m.e AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id
), said AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT k.vec_id, k.label, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, s.codebooks_sha256
FROM kept k JOIN found f ON k.vec_id = f.vec_id, said s
"""


OP12_SQL = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {pivots.COSINE}
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = e.vec_id
"""


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH said AS (SELECT doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
lengths AS MATERIALIZED (SELECT doc_id, len(t) AS n, t FROM said WHERE len(t) > 0),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM lengths),
asked AS MATERIALIZED (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
postings AS MATERIALIZED (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM lengths) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals
), scored AS (
  SELECT a.item_id, p.doc_id, CAST(sum(a.q * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * t.nn) // t.l)))) AS BIGINT) AS score
  FROM asked a JOIN postings p USING (term) JOIN weights w USING (term), totals t GROUP BY a.item_id, p.doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {lexical.BEST}
"""


def queries() -> dict:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_secrets": op2_secrets,
        "op3_simhash": op3_simhash,
        "op4_chat": op4_chat,
        "op5_sharding": op5_sharding,
        "op6_decontamination": op6_decontamination,
        "op7_urls": op7_urls,
        "op8_html": op8_html,
        "op9_quality": op9_quality,
        "op10_bpe": op10_bpe,
        "op11_codes": op11_codes,
        "op12_vectors": op12_vectors,
        "op13_ranking": op13_ranking,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4_SQL, "op11_codes": _op11_sql(), "op12_vectors": OP12_SQL, "op13_ranking": OP13_SQL}
