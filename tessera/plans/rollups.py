"""Queries that summarise: listings, shares, leaderboards, votes, pivots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.sources.tables import table


def corpus_listing(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counts = labels.groupBy("doc_id").agg(F.count("*").alias("labels"))
    return docs.join(counts, "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.coalesce("labels", F.lit(0))).alias("labels"), F.sum("n_chars").alias("chars"))


def channel_rollup(spark, sf_dir):
    """Shares of sources, with the skew that is worth a warning and the upper median size."""
    docs = table(spark, sf_dir, "documents")
    per = docs.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"))
    total = Window.partitionBy()
    share = F.round(F.col("n") / F.sum("n").over(total), 4)
    sizes = metrics.spread(docs, "source", "n_chars")
    return per.select("source", "n", "langs", share.alias("share")).join(sizes, "source").select("*", F.when(F.col("share") >= 0.5, "warn").when(F.col("share") >= 0.4, "note").otherwise("ok").alias("skew"))


def domain_mix(spark, sf_dir):
    n = F.count("*")
    per = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(n.alias("n"))
    return per.select("source", "lang", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 4).alias("share"))


def top_creator(spark, sf_dir):
    """The commonest language of each source with its share; ties to the larger name."""
    per = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    best = per.groupBy("source").agg(F.max(F.struct("n", "lang")).alias("b"), F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return best.select("source", F.col("b.lang").alias("top"), F.round(F.col("b.n") / F.col("total"), 4).alias("share"), "kinds")


def _cells(spark, sf_dir):
    """Line items as scored cells: line numbers as setups, suppliers as entries; returned items have failed."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("setup"), F.col("l_suppkey").alias("entry"))
    return per.agg(F.when(F.max(F.col("l_returnflag")) != "A", F.round(F.avg(F.col("l_discount").cast("double")), 6)).alias("score"), F.max(F.col("l_quantity").cast("double")).alias("seconds"), F.count("*").alias("tokens"))


def leaderboard(spark, sf_dir):
    return metrics.leaderboard(_cells(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


def matrix_pivot(spark, sf_dir):
    """Mean price by return flag, one column for each line number."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", F.col("l_extendedprice").cast("double").alias("p"))
    return rows.groupBy("l_returnflag").pivot("l_linenumber", [1, 2, 3, 4, 5, 6, 7]).agg(F.round(F.avg("p"), 2))


def run_summary(spark, sf_dir):
    """Means over orders by priority, overall too; open orders are errors and don't count."""
    rows = table(spark, sf_dir, "orders").withColumn("v", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice").cast("double")))
    out = rows.groupingSets([[], ["o_orderpriority"]], "o_orderpriority").agg(F.count("*").alias("n"), F.count("v").alias("answered"), F.round(F.avg("v"), 2).alias("mean"))
    return out


def run_diff(spark, sf_dir):
    """Mean discount of suppliers, first lines against second ones."""
    cells = _cells(spark, sf_dir).where("score is not null")
    pick = lambda setup: cells.where(F.col("setup") == setup).select("entry", "score")
    return metrics.diff(pick("line1"), pick("line2"), "entry", "score", 0.02)


def _votes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    verdict = F.when(F.col("event_type") == "click", "conflict").when(F.col("event_type") == "view", "unrelated").when(F.col("event_type") == "purchase", "complementary")
    return e.select((F.col("user_id") % 997).alias("pair"), F.col("event_id").alias("attempt"), verdict.alias("verdict"))


def vote_tally(spark, sf_dir):
    return metrics.tally(_votes(spark, sf_dir)).withColumn("chance", F.round("chance", 6))


def vote_histogram(spark, sf_dir):
    return metrics.tally(_votes(spark, sf_dir)).groupBy("n", "conflict").agg(F.count("*").alias("pairs"))


def consensus(spark, sf_dir):
    return metrics.consensus(_votes(spark, sf_dir).select(F.col("pair").alias("criterion"), F.col("verdict").alias("choice")))


def recall_spread(spark, sf_dir):
    return metrics.spread(table(spark, sf_dir, "events").withColumn("value", F.round("value", 4)), "event_type", "value")


def ingestion_counters(spark, sf_dir):
    """Outcomes by day; a day with an error is failed."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    is_type = lambda t: F.sum(F.when(F.col("event_type") == t, 1).otherwise(0))
    return e.groupBy("day").agg(F.count("*").alias("n"), is_type("click").alias("clicks"), is_type("error").alias("errors")).withColumn("status", F.when(F.col("errors") > 0, "failed").otherwise("done"))


def coverage_profile(spark, sf_dir):
    """Documents of each source that are labelled and not."""
    docs, read = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("r", F.lit(1))
    per = docs.join(read, "doc_id", "left").groupBy("source").agg(F.count("*").alias("chunks"), F.count("r").alias("read"))
    return per.withColumn("unread", F.col("chunks") - F.col("read"))


def theme_statistics(spark, sf_dir):
    """Labels of vectors as themes: sizes, and how many are large."""
    per = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("themes"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.sum(F.when(F.col("n") >= 20, 1).otherwise(0)).alias("large"), F.round(F.avg("n"), 4).alias("mean"))


def set_digest(spark, sf_dir):
    """One digest of the document ids of each source and language, whatever their order: nothing is gathered."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id").distinct()
    mark = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.groupBy("source", "lang").agg(F.bit_xor(mark).alias("mark"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (corpus_listing, channel_rollup, domain_mix, top_creator, leaderboard, matrix_pivot, run_summary, run_diff, vote_tally, vote_histogram, consensus, recall_spread, ingestion_counters, coverage_profile, theme_statistics, set_digest)}

_CELLS = """cells AS (SELECT 'line' || l_linenumber AS setup, l_suppkey AS entry, CASE WHEN max(l_returnflag) <> 'A' THEN round(avg(l_discount::DOUBLE), 6) END AS score, max(l_quantity::DOUBLE) AS seconds, count(*) AS tokens FROM lineitem GROUP BY ALL)"""
_VOTES = "votes AS (SELECT user_id % 997 AS pair, event_id AS attempt, CASE event_type WHEN 'click' THEN 'conflict' WHEN 'view' THEN 'unrelated' WHEN 'purchase' THEN 'complementary' END AS verdict FROM events)"
_CHANCE = "round(coalesce(list_sum(list_transform(list_filter(range(1, count(*) + 1), lambda k: 2 * k > count(*)), lambda k: exp(lgamma(count(*) + 1) - lgamma(k + 1) - lgamma(count(*) - k + 1)) * pow(count(*) FILTER (verdict = 'conflict') / count(*), k) * pow(1 - count(*) FILTER (verdict = 'conflict') / count(*), count(*) - k))), 0), 6)"
_SPREAD = "(SELECT {g}, min(v) AS low, max(CASE WHEN i = floor(n / 2)::BIGINT + 1 THEN v END) AS median, max(v) AS high FROM (SELECT {g}, {v} AS v, row_number() OVER (PARTITION BY {g} ORDER BY {v}) AS i, count(*) OVER (PARTITION BY {g}) AS n FROM {t} WHERE {v} IS NOT NULL) GROUP BY {g})"

ORACLE = {
    "corpus_listing": "SELECT source, count(*) AS documents, CAST(sum(coalesce(labels, 0)) AS BIGINT) AS labels, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents LEFT JOIN (SELECT doc_id, count(*) AS labels FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY source",
    "channel_rollup": f"SELECT *, CASE WHEN share >= 0.5 THEN 'warn' WHEN share >= 0.4 THEN 'note' ELSE 'ok' END AS skew FROM (SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, round(count(*) / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY source) JOIN {_SPREAD.format(g='source', v='n_chars', t='documents')} USING (source)",
    "domain_mix": "SELECT source, lang, round(n / sum(n) OVER (PARTITION BY source), 4) AS share FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)",
    "top_creator": "SELECT source, lang AS top, round(n / total, 4) AS share, kinds FROM (SELECT *, sum(n) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS kinds, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang DESC) AS r FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)) WHERE r = 1",
    "leaderboard": f"""WITH {_CELLS}, race AS (SELECT *, count(*) OVER (PARTITION BY entry) AS n, row_number() OVER (PARTITION BY entry ORDER BY score DESC, setup) AS p FROM cells WHERE score IS NOT NULL),
      w AS (SELECT setup, count(*) AS contests, count(*) FILTER (p = 1) AS wins FROM race WHERE n >= 2 GROUP BY setup),
      m AS (SELECT setup, round(avg(score), 4) AS score, count(score) AS answered, count(*) FILTER (score IS NULL) AS failed, round(avg(seconds), 4) AS seconds, round(avg(tokens), 4) AS tokens FROM cells GROUP BY setup)
      SELECT setup, score, answered, failed, seconds, tokens, coalesce(contests, 0) AS contests, coalesce(wins, 0) AS wins, round(coalesce(wins, 0) / nullif(coalesce(contests, 0), 0), 4) AS win_rate, row_number() OVER (ORDER BY score DESC NULLS LAST, setup) AS place FROM m LEFT JOIN w USING (setup)""",
    "matrix_pivot": "SELECT l_returnflag, " + ", ".join(f'round(avg(l_extendedprice::DOUBLE) FILTER (l_linenumber = {m}), 2) AS "{m}"' for m in range(1, 8)) + " FROM lineitem GROUP BY l_returnflag",
    "run_summary": "SELECT o_orderpriority, count(*) AS n, count(v) AS answered, round(avg(v), 2) AS mean FROM (SELECT o_orderpriority, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice::DOUBLE END AS v FROM orders) GROUP BY GROUPING SETS ((), (o_orderpriority))",
    "run_diff": f"WITH {_CELLS} SELECT *, CASE WHEN change > 0.02 THEN 'better' WHEN change < -0.02 THEN 'worse' ELSE 'same' END AS verdict FROM (SELECT a.entry, a.score AS before, b.score AS after, round(b.score - a.score, 6) AS change FROM cells a JOIN cells b ON a.entry = b.entry AND a.setup = 'line1' AND b.setup = 'line2' WHERE a.score IS NOT NULL AND b.score IS NOT NULL)",
    "vote_tally": f"WITH {_VOTES} SELECT pair, count(*)::INT AS n, (count(*) FILTER (verdict = 'conflict'))::INT AS conflict, count(*) FILTER (verdict IS NULL) AS errors, 2 * count(*) FILTER (verdict = 'conflict') > count(*) AS carried, count(DISTINCT verdict) = 1 AND count(verdict) = count(*) AS unanimous, 3 * count(*) FILTER (verdict = 'conflict') >= count(*) AND 3 * count(*) FILTER (verdict = 'conflict') < 2 * count(*) AS undecided, min(attempt) FILTER (verdict = 'conflict') AS first_conflict, {_CHANCE} AS chance FROM votes GROUP BY pair",
    "vote_histogram": f"WITH {_VOTES} SELECT n::INT AS n, conflict::INT AS conflict, count(*) AS pairs FROM (SELECT count(*) AS n, count(*) FILTER (verdict = 'conflict') AS conflict FROM votes GROUP BY pair) GROUP BY ALL",
    "consensus": f"WITH {_VOTES} SELECT pair AS criterion, nullif(key, '') AS choice, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY n DESC, key DESC) AS r FROM (SELECT pair, coalesce(verdict, '') AS key, count(*) AS n FROM votes GROUP BY ALL)) WHERE r = 1",
    "recall_spread": "SELECT * FROM " + _SPREAD.format(g="event_type", v="round(value, 4)", t="events"),
    "ingestion_counters": "SELECT *, CASE WHEN errors > 0 THEN 'failed' ELSE 'done' END AS status FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL)",
    "coverage_profile": "SELECT source, count(*) AS chunks, count(r) AS read, count(*) - count(r) AS unread FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 1 AS r FROM labels) USING (doc_id) GROUP BY source",
    "theme_statistics": "SELECT count(*) AS themes, max(n) AS largest, min(n) AS smallest, count(*) FILTER (n >= 20) AS large, round(avg(n), 4) AS mean FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)",
    "set_digest": "SELECT source, lang, bit_xor(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT) AS mark, count(*) AS n FROM (SELECT DISTINCT source, lang, doc_id FROM documents) GROUP BY source, lang",
}
