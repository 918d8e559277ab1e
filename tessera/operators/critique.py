"""Scoring of critiques and runs: grounding, gates, leaks, coverage, ballots, winners and extraction recall.

``findings`` has ``cell, finding``; ``citations`` has ``finding, chunk``; ``retrieved`` says which ``finding`` saw which
``chunk``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import chunk_source

RESOLVED_FROM = 0.8


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 4)


def gate(findings: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``(cell, findings, without, gradable)``: a cell can be graded only if each of its findings has a retrieval of its own."""
    own = retrieved.select("finding", F.lit(1).alias("r")).distinct()
    per = findings.join(own, "finding", "left").groupBy("cell").agg(F.count("*").alias("findings"), F.count_if(F.col("r").isNull()).alias("without"))
    return per.withColumn("gradable", F.col("without") == 0)


def grounded(findings: DataFrame, citations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``(cell, finding, owned, grounded)``: a citation counts if its finding retrieved the chunk, and then if no other finding of the cell has it as well."""
    seen = citations.select("finding", "chunk").distinct().join(retrieved, ["finding", "chunk"], "left_semi").join(findings, "finding")
    sole = seen.groupBy("cell", "chunk").agg(F.count("*").alias("n"), F.min("finding").alias("finding")).where("n = 1")
    owned = sole.groupBy("cell", "finding").agg(F.count("*").alias("owned"))
    out = findings.join(owned, ["cell", "finding"], "left").withColumn("owned", F.coalesce("owned", F.lit(0)))
    return out.select("cell", "finding", "owned", (F.col("owned") > 0).alias("grounded"))


def leaks(outputs: DataFrame, held_out: DataFrame) -> DataFrame:
    """``(cell, video, chunks)``: held-out videos whose chunks (``chunk:<video>:<n>``) appear in a cell's output."""
    named = outputs.select("cell", "chunk", chunk_source(F.col("chunk")).alias("video")).where("video <> ''")
    return named.join(held_out.select("video").distinct(), "video", "left_semi").groupBy("cell", "video").agg(F.count_distinct("chunk").alias("chunks"))


def contested_coverage(conflicts: DataFrame, findings: DataFrame, citations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``(cell, available, named, coverage)``: conflicts both of whose chunks the cell retrieved, and those of them that one finding cites both of. No conflict available: no coverage.

    ``conflicts`` has ``conflict, chunk_a, chunk_b``. Each side is joined on chunks; cells are never paired with conflicts.
    """
    had = retrieved.join(findings, "finding").select("cell", "chunk").distinct()
    cited = citations.join(findings, "finding").select("cell", "finding", "chunk").distinct()

    def both(rows: DataFrame, keys: list[str]) -> DataFrame:
        a = rows.join(conflicts.select("conflict", F.col("chunk_a").alias("chunk")), "chunk").select(*keys, "conflict")
        b = rows.join(conflicts.select("conflict", F.col("chunk_b").alias("chunk")), "chunk").select(*keys, "conflict")
        return a.join(b, [*keys, "conflict"], "left_semi").distinct()

    available = both(had, ["cell"])
    named = both(cited, ["cell", "finding"]).select("cell", "conflict").distinct().join(available, ["cell", "conflict"], "left_semi")
    per = available.groupBy("cell").agg(F.count("*").alias("available")).join(named.groupBy("cell").agg(F.count("*").alias("named")), "cell", "left")
    out = findings.select("cell").distinct().join(per, "cell", "left")
    return out.select("cell", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("named", F.lit(0)).alias("named"), _ratio(F.coalesce("named", F.lit(0)), F.col("available")).alias("coverage"))


def grouped_recall(criteria: DataFrame, reached: DataFrame) -> DataFrame:
    """``(cell, reached, total, recall)``: groups of criteria of which a cell reaches one at least. ``criteria`` has ``criterion, group``, ``reached`` ``cell, criterion``."""
    total = criteria.agg(F.count_distinct("group").alias("total"))
    per = reached.join(criteria, "criterion").groupBy("cell").agg(F.count_distinct("group").alias("reached"))
    return per.crossJoin(total).withColumn("recall", _ratio(F.col("reached"), F.col("total")))


def scored(findings: DataFrame, citations: DataFrame, retrieved: DataFrame, matches: DataFrame, criteria: DataFrame) -> DataFrame:
    """``(cell, criteria_recall, evidence_precision, provenance)``: null where a cell cannot be graded, with ungated twins.

    Recall is the share of criteria that a grounded finding matches, precision that of grounded findings, provenance
    that of citations whose chunk their finding retrieved. ``matches`` has ``finding, criterion``.
    """
    ok = gate(findings, retrieved)
    base = grounded(findings, citations, retrieved)
    n = criteria.agg(F.count_distinct("criterion").alias("n"))
    hit = matches.join(base.where("grounded"), "finding").groupBy("cell").agg(F.count_distinct("criterion").alias("hit"))
    loose = matches.join(findings, "finding").groupBy("cell").agg(F.count_distinct("criterion").alias("loose"))
    precision = base.groupBy("cell").agg(_ratio(F.count_if("grounded"), F.count("*")).alias("p"))
    said = citations.select("finding", "chunk").distinct().join(findings, "finding")
    backed = said.join(retrieved.select("finding", "chunk", F.lit(1).alias("r")).distinct(), ["finding", "chunk"], "left").groupBy("cell").agg(_ratio(F.count("r"), F.count("*")).alias("v"))
    out = ok.join(hit, "cell", "left").join(loose, "cell", "left").join(precision, "cell").join(backed, "cell", "left").crossJoin(n)
    gated = lambda c: F.when(F.col("gradable"), c)
    return out.select(
        "cell",
        "gradable",
        gated(_ratio(F.coalesce("hit", F.lit(0)), F.col("n"))).alias("criteria_recall"),
        gated(F.col("p")).alias("evidence_precision"),
        gated(F.col("v")).alias("provenance"),
        _ratio(F.coalesce("loose", F.lit(0)), F.col("n")).alias("ungated_recall"),
        F.col("p").alias("ungated_precision"),
    )


def provenance_sets(retrieved: DataFrame, findings: DataFrame) -> DataFrame:
    """``(cell, findings, sets)``: how many different sets of chunks a cell's findings retrieved. One set for many findings means a shared retrieval.

    A chunk that a finding retrieved twice tells its set from one that has it once. A set is two 64-bit digests of its
    chunks and their counts, so no task gathers it.
    """
    each = retrieved.groupBy("finding", "chunk").agg(F.count("*").alias("n"))
    one = each.groupBy("finding").agg(F.bit_xor(F.xxhash64("chunk", "n")).alias("x"), F.bit_xor(F.xxhash64("n", "chunk")).alias("y"), F.sum("n").alias("n"))
    return one.join(findings, "finding").groupBy("cell").agg(F.count("*").alias("findings"), F.count_distinct("x", "y", "n").alias("sets"))


def with_provenance(findings: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``findings`` with the number and the digest of what each retrieved; null where that is unknown, which is not the same as nothing."""
    one = retrieved.groupBy("finding").agg(F.count("chunk").alias("chunks"), F.min("chunk").alias("first"))
    return findings.join(one, "finding", "left")


def fabricated(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations of chunks that do not exist."""
    return citations.join(chunks.select("chunk").distinct(), "chunk", "left_anti")


def checked(candidates: DataFrame) -> DataFrame:
    """``(citation, chunk, ratio, outcome)`` of ``(citation, chunk, ratio)``: the best candidate by ratio, then chunk; ``no_chunk`` if all are null, ``below`` if it quotes too little."""
    best = candidates.groupBy("citation").agg(F.max(F.when(F.col("chunk").isNotNull(), F.struct("ratio", "chunk"))).alias("b"))
    outcome = F.when(F.col("b").isNull(), "no_chunk").when(F.col("b.ratio") >= RESOLVED_FROM, "resolved").otherwise("below")
    return best.select("citation", F.col("b.chunk").alias("chunk"), F.col("b.ratio").alias("ratio"), outcome.alias("outcome"))


def ballots(repeats: DataFrame, consensus: DataFrame) -> DataFrame:
    """``(criterion, choice, votes, chosen, agrees)``: how often each choice was made beside the consensus; criteria that nobody answered go.

    ``repeats`` has ``run, criterion, choice``, ``consensus`` has ``criterion, choice``.
    """
    answered = repeats.groupBy("criterion").agg(F.count("choice").alias("n")).where("n > 0").select("criterion")
    votes = repeats.join(answered, "criterion", "left_semi").groupBy("criterion", "choice").agg(F.count("*").alias("votes"))
    out = votes.join(consensus.withColumnRenamed("choice", "chosen"), "criterion", "left")
    return out.withColumn("agrees", F.col("choice").eqNullSafe(F.col("chosen")))


def winners_by_judge(cells: DataFrame) -> DataFrame:
    """``(judge, question, setup, composite)``: the best setup of each question with two answers or more of one judge; the first listed wins ties. ``cells`` has ``judge, question, setup, position, composite``."""
    order = Window.partitionBy("judge", "question").orderBy(F.desc("composite"), "position")
    all_ = Window.partitionBy("judge", "question")
    good = cells.where("composite is not null").withColumn("__n", F.count("*").over(all_)).withColumn("__p", F.row_number().over(order))
    return good.where("__n >= 2 and __p = 1").select("judge", "question", "setup", "composite")


def question_rows(cells: DataFrame, setups: list[str]) -> DataFrame:
    """One row a question with each setup's answer and score: setup-major runs turned question-major. ``cells`` has ``question, setup, answer, score``."""
    pick = lambda s, c: F.max(F.when(F.col("setup") == s, F.col(c)))
    return cells.groupBy("question").agg(*(pick(s, c).alias(f"{c}_{s}") for s in setups for c in ("answer", "score")), F.count("answer").alias("answered"))


def extraction_recall(labels: DataFrame, extracted: DataFrame) -> DataFrame:
    """``(chunk, failed, entity_recall, claim_recall)``: labelled entities that an extracted one holds or is held by, and keyword
    groups all of whose words are in one claim. A missing extraction is a failure; nothing to find is no recall.

    ``labels`` has ``chunk, entities, keywords`` (slugs; arrays of words), ``extracted`` ``chunk, found, claims``.
    """
    both = labels.join(extracted, "chunk", "left")
    met = F.filter("entities", lambda e: F.exists("found", lambda x: F.contains(x, e) | F.contains(e, x)))
    said = F.filter("keywords", lambda k: F.exists("claims", lambda c: F.forall(k, lambda w: F.contains(F.lower(c), w))))
    failed = F.col("found").isNull()
    return both.select("chunk", failed.alias("failed"), F.when(~failed, _ratio(F.size(met), F.size("entities"))).alias("entity_recall"), F.when(~failed, _ratio(F.size(said), F.size("keywords"))).alias("claim_recall"))


def conflict_statistics(pairs: DataFrame) -> DataFrame:
    """One row over judged pairs (``channel_a, channel_b, votes, repeats, axis, gate, ratio``): conflicts across and within channels, unanimous and split, precision over all candidates, least quote ratio."""
    conflict = F.col("gate").isNull()
    across = F.col("channel_a") != F.col("channel_b")
    n = F.count_if(conflict)
    return pairs.agg(
        F.count("*").alias("candidates"),
        n.alias("conflicts"),
        F.count_if(conflict & across).alias("across"),
        F.count_if(conflict & ~across).alias("within"),
        F.count_if(conflict & (F.col("votes") == F.col("repeats"))).alias("unanimous"),
        F.count_if(conflict & (F.col("votes") < F.col("repeats"))).alias("split"),
        F.count_if(conflict & (F.col("axis") == "factual")).alias("factual"),
        _ratio(n, F.count("*")).alias("precision"),
        F.min(F.when(conflict, F.col("ratio"))).alias("least_ratio"),
    )


def subsample_verdicts(votes: DataFrame, size: int = 3) -> DataFrame:
    """``(pair, sample, votes, carried)``: attempts in their order in disjoint samples of ``size``, each with its own majority; what is left over goes. ``votes`` has ``pair, attempt, conflict``."""
    place = F.row_number().over(Window.partitionBy("pair").orderBy("attempt")) - 1
    per = votes.withColumn("sample", F.floor(place / size)).groupBy("pair", "sample").agg(F.count("*").alias("n"), F.count_if("conflict").alias("votes"))
    return per.where(F.col("n") == size).select("pair", "sample", "votes", (2 * F.col("votes") > size).alias("carried"))


def vote_ledger(candidates: DataFrame, votes: DataFrame) -> DataFrame:
    """``(position, pair, repeats, votes, errors)`` of every candidate, in candidate order, also those without a vote. ``votes`` has ``pair, verdict``; a null verdict is an error."""
    per = votes.groupBy("pair").agg(F.count("*").alias("repeats"), F.count_if(F.col("verdict") == "conflict").alias("votes"), F.count_if(F.col("verdict").isNull()).alias("errors"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return candidates.select("position", "pair").join(per, "pair", "left").select("position", "pair", none("repeats"), none("votes"), none("errors"))


def verdicts_sorted(verdicts: DataFrame, order: list[str], severities: list[str], by: str) -> DataFrame:
    """``verdicts`` of each document (column ``by``) with ``place``: by verdict, severity, position in the pack, id. What is in no list comes last."""
    at = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0).cast("long")), F.lit(len(names) + 1).cast("long"))
    window = Window.partitionBy(by).orderBy(at("verdict", order), at("severity", severities), "position", "rule")
    return verdicts.withColumn("place", F.row_number().over(window).cast("long"))
