"""Whole runs put together from other operators: indexing, evaluation, the conflict layer, ablations, frontier rounds, published tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import claim_id
from tessera.operators import corpus, critique, folds, gates, metrics, retrieval, store, walks


def indexed(docs: DataFrame, stored: DataFrame, target: int = 1200, overlap: int = 150) -> DataFrame:
    """``(video, stored, removed)`` after documents (``video, lines``) were chunked and each replaced what was stored (``video, chunk``) of it."""
    made = folds.chunks(docs, "video", "lines", target, overlap)
    new = made.select("video", F.concat_ws(":", F.lit("chunk"), "video", "chunk_index").alias("chunk"))
    return corpus.index_report(stored, new)


def claims_from_chunks(chunks: DataFrame) -> DataFrame:
    """``(claim, chunk, video, text)`` of chunks with an array ``said``: each statement once in its chunk, named by chunk and text; blank ones are left out."""
    each = chunks.select("chunk", "video", F.explode(F.array_distinct(F.transform("said", lambda x: F.trim(x)))).alias("text")).where("text <> ''")
    return each.select(claim_id(F.col("chunk"), F.col("text")).alias("claim"), "chunk", "video", "text")


def evaluated(hits: DataFrame, golden: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """``(query_id, recall, video_recall, answered)``: recall of expected chunks and of their videos in the first ``k``; null for a question that expects nothing.

    ``hits`` has ``query_id, rank, doc, video``, ``golden`` ``query_id, doc, video``.
    """
    top = hits.where(F.col("rank") <= k)
    wanted = golden.groupBy("query_id").agg(F.count_distinct("doc").alias("docs"), F.count_distinct("video").alias("videos"))
    met = top.join(golden.select("query_id", "doc"), ["query_id", "doc"], "left_semi").groupBy("query_id").agg(F.count_distinct("doc").alias("d"))
    seen = top.select("query_id", "video").join(golden.select("query_id", "video").distinct(), ["query_id", "video"], "left_semi").groupBy("query_id").agg(F.count_distinct("video").alias("v"))
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    out = questions.select("query_id").join(wanted, "query_id", "left").join(met, "query_id", "left").join(seen, "query_id", "left").join(n, "query_id", "left")
    ratio = lambda a, b: F.when(F.col(b).isNotNull(), F.round(F.coalesce(a, F.lit(0)) / F.col(b), 4))
    return out.select("query_id", ratio("d", "docs").alias("recall"), ratio("v", "videos").alias("video_recall"), F.col("n").isNotNull().alias("answered"))


def arms_evaluated(arms: dict[str, DataFrame], golden: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """``(arm, recall, video_recall, answered)``: means over questions of each arm, nulls left out."""
    parts = [evaluated(hits, golden, questions, k).withColumn("arm", F.lit(name)) for name, hits in arms.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("arm").agg(F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("video_recall"), 4).alias("video_recall"), F.count_if("answered").alias("answered"))


def conflict_layer(candidates: DataFrame, votes: DataFrame) -> DataFrame:
    """Candidate pairs with their votes tallied and put through the gates: ``candidates`` has what the gates read but the votes, with ``pair``."""
    tally = metrics.tally(votes).select("pair", F.col("conflict").alias("votes"), F.col("n").alias("repeats"))
    judged = candidates.join(tally, "pair", "left").withColumn("votes", F.coalesce("votes", F.lit(0))).withColumn("repeats", F.coalesce("repeats", F.lit(0)))
    return gates.conflict_gates(judged)


def calibration(probes: DataFrame, votes: DataFrame) -> DataFrame:
    """``(pair, expected, carried, ok)``: known pairs whose majority has to be what is expected; a probe without votes is not ok."""
    tally = metrics.tally(votes).select("pair", "carried")
    out = probes.join(tally, "pair", "left")
    return out.withColumn("ok", F.coalesce((F.col("expected") == "conflict") == F.col("carried"), F.lit(False)))


def replayed(asked: DataFrame, recorded: DataFrame) -> DataFrame:
    """``asked`` (``run, criterion``) with the ``choice`` that was recorded for it; what was never asked is ``missing``, which is not a null choice."""
    known = recorded.select("run", "criterion", "choice", F.lit(True).alias("__k"))
    return asked.join(known, ["run", "criterion"], "left").withColumn("missing", F.col("__k").isNull()).drop("__k")


def ablation_rows(repeats: DataFrame, baseline: str) -> DataFrame:
    """``(arm, metric, value, low, high, repeats, delta, beats)`` of repeated cells ``(arm, metric, value)``: medians and ranges; an arm beats the baseline if its lowest is above the baseline's highest."""
    per = repeats.where("value is not null").groupBy("arm", "metric").agg(F.count("*").alias("repeats"))
    keyed = repeats.withColumn("__g", F.concat_ws("|", "arm", "metric"))
    spread = metrics.spread(keyed, "__g", "value")
    out = per.withColumn("__g", F.concat_ws("|", "arm", "metric")).join(spread, "__g").select("arm", "metric", F.col("median").alias("value"), "low", "high", "repeats")
    base = out.where(F.col("arm") == baseline).select("metric", F.col("value").alias("b"), F.col("high").alias("bh"))
    return out.join(base, "metric", "left").select("arm", "metric", "value", "low", "high", "repeats", F.round(F.col("value") - F.col("b"), 4).alias("delta"), F.when(F.col("arm") != baseline, F.col("low") > F.col("bh")).alias("beats"))


def rescored(stored: DataFrame, findings: DataFrame, citations: DataFrame, retrieved: DataFrame, matches: DataFrame, criteria: DataFrame) -> DataFrame:
    """``(cell, stored, now, same)``: a committed run's recall beside what the rules of today give; cells that are gone have no score now."""
    now = critique.scored(findings, citations, retrieved, matches, criteria).select("cell", F.col("criteria_recall").alias("now"))
    return stored.select("cell", F.col("recall").alias("stored")).join(now, "cell", "left").withColumn("same", F.col("stored").eqNullSafe(F.col("now")))


def answer_likeness(answers: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(question, pair, likeness)``: cosines of named answers' vectors of each question; null where one is missing. ``answers`` has ``question, setup, vector``."""
    pick = {s: F.max(F.when(F.col("setup") == s, F.col("vector"))).alias(s) for p in pairs for s in p}
    wide = answers.groupBy("question").agg(*pick.values())
    each = F.array(*(F.struct(F.lit(f"{a}|{b}").alias("pair"), F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.round(retrieval.cosine(F.col(a), F.col(b)), 6)).alias("likeness")) for a, b in pairs))
    return wide.select("question", F.explode(each).alias("p")).select("question", "p.*")


def frontier_round(gaps: DataFrame, chunks: DataFrame, read: DataFrame, k: int) -> DataFrame:
    """``(gap, chunk)``: each gap's ``k`` nearest chunks that are not read yet, for gaps that in their order still bring a chunk of their own. ``gaps`` has ``gap, vector``, ``chunks`` ``id, vector``."""
    unread = chunks.join(read.select("id").distinct(), "id", "left_anti")
    near = retrieval.dense(unread, gaps.select(F.col("gap").alias("query_id"), "vector"), "id", "vector", k).select(F.lit(0).alias("group"), F.col("query_id").alias("position"), F.col("id").alias("item"))
    kept = walks.admitted(near)
    return near.join(kept, ["group", "position"], "left_semi").select(F.col("position").alias("gap"), F.col("item").alias("chunk"))


def single_flight(requests: DataFrame) -> DataFrame:
    """``(runner, request, started)``: requests ``(runner, request, at, takes)`` in order; one is refused while an accepted one is still running.

    A runner's requests are sorted and walked by one task, which holds only until when the runner is busy. Before a time
    that is missing nothing is known, after an accepted request of unknown length neither.
    """
    rows = requests.select(F.xxhash64("runner").alias("h"), "runner", F.col("at").cast("double").alias("at"), "request", F.col("takes").cast("double").alias("takes"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    walk = rows.repartition("h").sortWithinPartitions("h", "runner", "at", "request", "takes")
    return walk.mapInArrow(_flown, f"runner {kinds['runner']}, request {kinds['request']}, started boolean")


def _flown(batches):
    """Rows ``(h, runner, at, request, takes)`` come by runner and in order."""
    now, until, first = None, None, True
    for batch in batches:
        ok = []
        for runner, at, takes in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4)), strict=True):
            if first or runner != now:
                now, until, first = runner, float("-inf"), False
            free = None if at is None or until is None else at >= until
            if free:
                until = None if takes is None else at + takes
            ok.append(free)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(3), pa.array(ok, pa.bool_())], ["runner", "request", "started"])


def context_block(parts: DataFrame, budget: int) -> DataFrame:
    """``(answer, parts, chars, cut)``: how many parts of each answer, in order, fit the budget; all after the first misfit are cut. ``parts`` has ``answer, place, text``."""
    order = Window.partitionBy("answer").orderBy("place")
    sized = parts.withColumn("upto", F.sum(F.length("text")).over(order))
    return sized.groupBy("answer").agg(F.count_if(F.col("upto") <= budget).alias("parts"), F.coalesce(F.max(F.when(F.col("upto") <= budget, F.col("upto"))), F.lit(0)).alias("chars"), F.count_if(F.col("upto") > budget).alias("cut"))


def rubric_version(asked: Column, known: dict[str, str], default: str = "v1") -> Column:
    """The rubric of a version; that of the default for an unknown or missing one."""
    out = F.lit(known[default])
    for name, text in known.items():
        out = F.when(asked == name, text).otherwise(out)
    return out


def published(catalogue: DataFrame, packs: DataFrame) -> DataFrame:
    """The catalogue after packs ``(pack, version, rules)`` were published: an older version never replaces a newer one."""
    newer = packs.join(catalogue.select("pack", F.col("version").alias("__v")), "pack", "left").where("__v is null or version >= __v").drop("__v")
    return store.upsert(catalogue, newer, "pack")


def save_table(rows: DataFrame, folder: str, name: str) -> None:
    """A table replaced as a whole, in the shared folder; an empty one wipes it."""
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def save_run(rows: DataFrame, folder: str, kind: str, run: str) -> str:
    """A run's rows as JSON under its own name, written once: a run that exists is an error."""
    path = f"{folder.rstrip('/')}/{kind}-{run}"
    rows.write.mode("errorifexists").json(path)
    return path
