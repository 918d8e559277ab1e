"""Queries that decide about rows: document kinds, composites, listing windows, gates, numbering, interleaving."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import documents as dc
from tessera.operators import adjudication, gates
from tessera.operators.checkpoints import scratch
from tessera.sources import landing
from tessera.sources.tables import table

AFTER = "1995-06-01"


def document_kinds(spark, sf_dir):
    """Kinds of all documents, with the source as a host and the language as a heading."""
    docs = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://"), F.coalesce("source", F.lit("")), F.lit(".example/"), F.col("doc_id"))
    kind = dc.document_kind(url, F.lit("Listing"), F.array("lang"), F.array("text"))
    return docs.select("doc_id", kind.alias("kind"), dc.coverage_warning(kind, "no criteria").alias("warning"))


def composite_scores(spark, sf_dir):
    """Composites of scores derived from ids, some of them missing."""
    i = F.col("doc_id")
    scores = F.create_map(
        F.lit("faithfulness"), F.when(i % 7 != 0, (i % 11) / 10.0),
        F.lit("coverage"), F.when(i % 3 != 0, (i % 5) / 4.0),
        F.lit("specificity"), (i % 9) / 8.0,
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", dc.composite(scores).alias("c"))
    return docs.select("doc_id", "c.*", F.round(dc.efficiency(F.col("c.composite"), F.col("n_chars")), 6).alias("efficiency"))


def listing_window(spark, sf_dir):
    """The first five orders of each customer's list before it reaches one that is older than the date."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    found = landing.published_between(orders, "o_custkey", "o_orderkey", "day", after=F.lit(AFTER).cast("date"), limit=5)
    return found.select("o_custkey", "o_orderkey")


def reference_numbers(spark, sf_dir):
    """Suppliers of each order, numbered by the line on which they occur first."""
    return gates.numbered(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber").withColumn("number", F.col("number").cast("long"))


def _judged(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.when(k % 7 == 1, "why is that so").otherwise("they hold this")
    return table(spark, sf_dir, "orders").select(
        k.alias("position"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("chunk_a"),
        F.concat(F.lit("k"), k % 997).alias("chunk_b"),
        (k % 4).cast("int").alias("votes"),
        F.lit(3).alias("repeats"),
        F.when(k % 5 != 0, "axis").alias("axis"),
        F.lit("why").alias("why"),
        F.when(k % 6 != 0, said).alias("span_a"),
        F.lit("others hold that").alias("span_b"),
        (F.col("o_totalprice") / 1e6).alias("similarity"),
    )


def conflict_gates(spark, sf_dir):
    return gates.conflict_gates(_judged(spark, sf_dir)).select("position", "gate")


def near_misses(spark, sf_dir):
    return gates.near_misses(_judged(spark, sf_dir)).select("position", "votes")


def interleaved_lists(spark, sf_dir):
    """Longest documents in turn with those that come first, forty in all."""
    docs = table(spark, sf_dir, "documents")
    return gates.interleave(docs.select("doc_id", (-F.col("n_chars")).alias("rank")), docs.select("doc_id", F.col("doc_id").alias("rank")), "doc_id", "rank", 40)


def _verdict(a: str, b: str, attempt: int) -> str:
    if b == "P":
        raise RuntimeError("no answer")
    return "conflict" if (len(a) + attempt) % 3 else "unrelated"


def kept_verdicts(spark, sf_dir):
    """Votes on all orders after a run of two looks that goes on with a third: the first two are not asked again."""
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_a"), F.col("o_custkey").alias("chunk_b"), F.col("o_orderpriority").alias("text_a"), F.col("o_orderstatus").alias("text_b"))
    folder = scratch(spark, "verdicts")
    adjudication.adjudicated(pairs, 2, _verdict, folder, "run", commits=2)
    return adjudication.votes(adjudication.adjudicated(pairs, 3, _verdict, folder, "run", commits=2))


QUERIES = {f.__name__: f for f in (kept_verdicts, document_kinds, composite_scores, listing_window, reference_numbers, conflict_gates, near_misses, interleaved_lists)}


def _any(text: str, signals: tuple[str, ...]) -> str:
    return "(" + " + ".join("CAST(contains({}, '{}') AS INT)".format(text, s.replace("'", "''")) for s in signals) + ")"


_WHOLE, _NAMES = "('listing ' || lower(coalesce(lang, '') || ' ' || coalesce(text, '')))", "('listing ' || lower(coalesce(lang, '')))"
_ON = lambda ds: "(" + " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in ds) + ")"
_KIND = f"""CASE WHEN {_any(f'substr({_WHOLE}, 1, 400)', dc.COVER_LETTER_SIGNALS)} + {_any(_NAMES, dc.COVER_LETTER_SIGNALS)} + {_any(_WHOLE, dc.COVER_LETTER_SIGNOFFS)} > 0 THEN 'cover_letter'
  WHEN {_any(_NAMES, dc.RESUME_SIGNALS)} >= 2 OR regexp_matches({_NAMES}, '\\b(resum[eé]s?|curriculum vitae)\\b') THEN 'resume'
  WHEN {_ON(dc.PROFILE_HOSTS)} OR {_any(_WHOLE, dc.PROFILE_SIGNALS)} >= 2 THEN 'profile'
  WHEN {_ON(dc.PORTFOLIO_HOSTS)} OR {_any(_WHOLE, dc.PORTFOLIO_SIGNALS)} > 0 THEN 'portfolio' ELSE 'document' END"""

_WALK = """WITH RECURSIVE j AS (SELECT o_orderkey AS position, o_custkey AS a, o_orderkey % 997 AS b, CASE WHEN o_orderkey % 4 = 0 THEN 'not_a_conflict' WHEN o_orderkey % 4 < 2 THEN 'minority_verdict' WHEN o_orderkey % 5 = 0 THEN 'unstated_axis'
  WHEN o_orderkey % 6 = 0 THEN 'quote_not_in_transcript' WHEN o_orderkey % 7 = 1 THEN 'quote_is_not_a_position' END AS gate FROM orders),
o AS MATERIALIZED (SELECT position, a, b, row_number() OVER (ORDER BY position) AS n FROM j WHERE gate IS NULL),
w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS ua, []::BIGINT[] AS ub, false AS won UNION ALL
  SELECT n, CASE WHEN free THEN list_append(ua, a) ELSE ua END, CASE WHEN free THEN list_append(ub, b) ELSE ub END, free FROM (SELECT o.n, a, b, ua, ub, NOT list_contains(ua, a) AND NOT list_contains(ub, b) AS free FROM w JOIN o ON o.n = w.n + 1))"""
_TURNS = """WITH RECURSIVE l AS (SELECT list(doc_id ORDER BY n_chars DESC, doc_id) AS a FROM documents), m AS (SELECT list(doc_id ORDER BY doc_id) AS b FROM documents),
w AS (SELECT -1 AS position, NULL::BIGINT AS doc_id, []::BIGINT[] AS taken UNION ALL
  SELECT position + 1, x, list_append(taken, x) FROM (SELECT position, taken, CASE WHEN (position + 1) % 2 = 0 THEN list_filter(a[1:80], lambda k: NOT list_contains(taken, k))[1] ELSE list_filter(b[1:80], lambda k: NOT list_contains(taken, k))[1] END AS x FROM w, l, m WHERE position < 39))"""
ORACLE = {
    "kept_verdicts": """SELECT o_orderkey AS chunk_a, o_custkey AS chunk_b, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE (SELECT count(*) FROM range(3) t(i) WHERE (length(o_orderpriority) + i) % 3 > 0)::INT END AS votes, 3::INT AS repeats, CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 0 END::INT AS errors FROM orders""",
    "conflict_gates": f"{_WALK} SELECT position, CASE WHEN gate IS NOT NULL THEN gate WHEN NOT won THEN 'duplicate_evidence' END AS gate FROM j LEFT JOIN (SELECT position, won FROM o JOIN w USING (n)) USING (position)",
    "interleaved_lists": f"{_TURNS} SELECT position::INT AS position, doc_id FROM w WHERE position >= 0",
    "document_kinds": f"""SELECT doc_id, kind, CASE WHEN kind = 'document' THEN 'no criteria' END AS warning
      FROM (SELECT doc_id, {_KIND} AS kind FROM (SELECT *, lower(coalesce(source, '') || '.example') AS host FROM documents))""",
    "composite_scores": """WITH s AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 11) / 10.0::DOUBLE END AS f, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 5) / 4.0::DOUBLE END AS c, (doc_id % 9) / 8.0::DOUBLE AS p FROM documents),
      w AS (SELECT *, CASE WHEN f IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END + 0.15::DOUBLE + CASE WHEN c IS NULL THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS used,
        coalesce(f * 0.2::DOUBLE, 0) + p * 0.15::DOUBLE + coalesce(c * 0.1::DOUBLE, 0) AS total FROM s),
      u AS (SELECT *, round(total / used, 4) AS uncapped, NOT coalesce(f >= 0.6::DOUBLE, false) AS breached FROM w),
      h AS (SELECT *, CASE WHEN breached THEN least(uncapped, 0.5::DOUBLE) ELSE uncapped END AS composite FROM u)
      SELECT doc_id, composite, uncapped, round(used, 4) AS weight_used, breached, composite < uncapped AS capped, round(composite * 1000 / nullif(n_chars, 0), 6) AS efficiency FROM h""",
    "listing_window": f"""WITH o AS (SELECT o_custkey, o_orderkey, min(CASE WHEN CAST(o_orderdate AS DATE) < DATE '{AFTER}' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS stop FROM orders),
      k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM o WHERE stop IS NULL OR o_orderkey < stop)
      SELECT o_custkey, o_orderkey FROM k WHERE n <= 5""",
    "reference_numbers": """SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first, l_suppkey) AS number
      FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first FROM lineitem GROUP BY ALL)""",
    "near_misses": """SELECT o_orderkey AS position, CAST(o_orderkey % 4 AS INT) AS votes FROM orders WHERE o_orderkey % 4 = 1
      ORDER BY o_totalprice / 1e6 DESC, 'c' || o_custkey, 'k' || (o_orderkey % 997) LIMIT 25""",
}
