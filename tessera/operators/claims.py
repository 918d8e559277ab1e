"""A store of entities, claims and communities as tables: upserts, lookups and rankings.

``entities`` has ``entity, name, aliases, mentions``; ``claims`` has ``claim, chunk, video, date, start``; ``anchors``
says which ``claim`` is about which ``entity``; ``members`` has ``entity, community``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import claim_id, slug

STRONG_LETTERS, STRONG_WORDS = 6, 2
UNKNOWN_DATE = "9999"


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """``(entity, name, aliases, mentions)`` of ``(name, alias, chunk)``: one entity for each slug, its smallest spelling, all other names, and how many chunks name it.

    Repeating an extraction changes nothing.
    """
    keyed = mentions.withColumn("entity", slug(F.col("name")))
    merged = keyed.groupBy("entity").agg(F.min("name").alias("name"), F.collect_set("alias").alias("a"), F.collect_set("name").alias("n"), F.count_distinct("chunk").alias("mentions"))
    return merged.select("entity", "name", F.array_sort(F.array_except(F.array_union("a", "n"), F.array("name"))).alias("aliases"), "mentions")


def upsert_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """``(src, dst, type, weight)``: the largest weight of each directed pair and type; loops and ends that are no entity go."""
    known = entities.select("entity")
    kept = relations.where("src <> dst").join(known.withColumnRenamed("entity", "src"), "src", "left_semi").join(known.withColumnRenamed("entity", "dst"), "dst", "left_semi")
    return kept.groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"))


def claims_of_video(claims: DataFrame, anchors: DataFrame, entities: DataFrame) -> DataFrame:
    """``(video, claim, start, names)``: each video's claims with the names that they are about, in order of their start; claims about nothing have an empty list."""
    names = anchors.join(entities.select("entity", "name"), "entity").groupBy("claim").agg(F.array_sort(F.collect_set("name")).alias("names"))
    out = claims.join(names, "claim", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    order = Window.partitionBy("video").orderBy("start", "claim")
    return out.select("video", "claim", "start", "names", F.row_number().over(order).cast("long").alias("position"))


def claims_about(claims: DataFrame, anchors: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int, hops: int = 1, held_out: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` claims, by date, video and start, about the seeds or (one hop) what an edge joins to them; claims of held-out videos go before the limit. No date comes last."""
    about = seeds.select("entity")
    if hops:
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        about = about.unionByName(ends.join(about.withColumnRenamed("entity", "a"), "a").select(F.col("b").alias("entity")))
    found = claims.join(anchors.join(about.distinct(), "entity", "left_semi").select("claim").distinct(), "claim", "left_semi")
    if held_out is not None:
        found = found.join(held_out.select("video").distinct(), "video", "left_anti")
    return found.orderBy(F.coalesce("date", F.lit(UNKNOWN_DATE)), "video", "start", "claim").limit(limit)


def timeline(claims: DataFrame, anchors: DataFrame, limit: int = 30) -> DataFrame:
    """``(entity, position, claim, date)``: the first dated claims about each entity."""
    dated = anchors.join(claims.where("date is not null"), "claim")
    order = Window.partitionBy("entity").orderBy("date", "video", "start", "claim")
    return dated.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= limit).select("entity", "position", "claim", "date")


def communities_listed(members: DataFrame, anchors: DataFrame, least: int = 2) -> DataFrame:
    """``(community, entities, claims)`` by claims: their entities and how many distinct claims are about them; small ones without claims go."""
    sizes = members.groupBy("community").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    n = anchors.join(members, "entity").groupBy("community").agg(F.count_distinct("claim").alias("claims"))
    return sizes.join(n, "community", "left").withColumn("claims", F.coalesce("claims", F.lit(0))).where((F.size("entities") >= least) | (F.col("claims") > 0))


def top_claims(claims: DataFrame, anchors: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``(community, position, claim, anchored)``: each community's claims by how many of its entities they are about, then by date."""
    n = anchors.join(members, "entity").groupBy("community", "claim").agg(F.count_distinct("entity").alias("anchored"))
    order = Window.partitionBy("community").orderBy(F.desc("anchored"), F.coalesce("date", F.lit(UNKNOWN_DATE)), "claim")
    return n.join(claims.select("claim", "date"), "claim").withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= k).select("community", "position", "claim", "anchored")


def entities_listed(entities: DataFrame, limit: int = 2000) -> DataFrame:
    """The most mentioned entities."""
    return entities.orderBy(F.desc("mentions"), "entity").limit(limit)


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def holding(names: DataFrame, terms: DataFrame, q: int = 3) -> DataFrame:
    """``names`` joined with the ``terms`` (query_id, term) that their ``said`` holds, whatever the case.

    Both sides meet on one run of ``q`` characters of the term, the one that fewest names have, and are then compared:
    an equality join, however many names and terms there are. Shorter terms meet on their whole. Empty terms are none.
    """
    asked = terms.where("term <> ''").select("query_id", F.lower("term").alias("__term")).distinct()
    size = F.least(F.length("__term"), F.lit(q)).alias("n")
    # one to q
    sizes = sorted(r["n"] for r in asked.select(size).distinct().collect())
    low = names.withColumn("__low", F.lower("said"))
    if not sizes:
        return low.drop("__low").crossJoin(asked.select("query_id").limit(0))
    held = low.withColumn("__gram", F.explode(F.flatten(F.array(*(_grams(F.col("__low"), n) for n in sizes)))))
    runs = asked.select("*", F.explode(F.coalesce(*(F.when(size == n, _grams(F.col("__term"), n)) for n in sizes))).alias("__gram"))
    counts = held.join(runs.select("__gram").distinct(), "__gram", "left_semi").groupBy("__gram").agg(F.count("*").alias("__n"))
    rarest = runs.join(counts, "__gram", "left").groupBy("query_id", "__term").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)), "__gram"))["__gram"].alias("__gram"))
    return held.join(rarest, "__gram").where(F.contains("__low", "__term")).drop("__low", "__gram", "__term")


def resolved(entities: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """``(query_id, entity, mentions, rank)``: entities whose name or an alias holds a term of the query, whatever the case.

    ``terms`` has ``query_id, term``.
    """
    names = entities.select("entity", "mentions", F.explode(F.concat(F.array("name"), "aliases")).alias("said"))
    hits = holding(names, terms).select("query_id", "entity", "mentions").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("mentions"), "entity")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def question_terms(question: Column, stopwords: list[str], least: int = 4, most: int = 8) -> Column:
    """The first words of four letters or more that are no stopwords, in small letters, repeats kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.slice(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stopwords)), 1, most)


def strong_match(words: Column, name: Column) -> Column:
    """Whether a name holds a word of six letters or more, or two distinct ones."""
    held = F.array_distinct(F.filter(words, lambda w: F.contains(F.lower(name), w)))
    return F.exists(held, lambda w: F.length(w) >= STRONG_LETTERS) | (F.size(held) >= STRONG_WORDS)


def chunks_by_graph(resolved_entities: DataFrame, anchors: DataFrame, claims: DataFrame, k: int, most_claims: int = 200) -> DataFrame:
    """``(query_id, chunk, matched, claims, score, rank)``: chunks by how many of a query's entities their claims are about, then by claims.

    Of each query the first ``most_claims`` claims by date count; the score is the share of the query's entities.
    """
    about = resolved_entities.select("query_id", "entity").join(anchors, "entity").join(claims, "claim")
    first = about.select("query_id", "claim", "date", "video", "start").distinct()
    order = Window.partitionBy("query_id").orderBy(F.coalesce("date", F.lit(UNKNOWN_DATE)), "video", "start", "claim")
    kept = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most_claims).select("query_id", "claim")
    per = about.join(kept, ["query_id", "claim"], "left_semi").groupBy("query_id", "chunk").agg(F.count_distinct("entity").alias("matched"), F.count_distinct("claim").alias("claims"))
    total = resolved_entities.groupBy("query_id").agg(F.count_distinct("entity").alias("total"))
    order = Window.partitionBy("query_id").orderBy(F.desc("matched"), F.desc("claims"), "chunk")
    out = per.join(total, "query_id").withColumn("score", F.round(F.col("matched") / F.col("total"), 4)).withColumn("rank", F.row_number().over(order).cast("long"))
    return out.where(F.col("rank") <= k).select("query_id", "chunk", "matched", "claims", "score", "rank")


def chunk_enrichment(claims: DataFrame, anchors: DataFrame, entities: DataFrame) -> DataFrame:
    """``(chunk, claims, names)``: how many claims each chunk has, and the names that they are about."""
    named = anchors.join(entities.select("entity", "name"), "entity").select("claim", "name")
    return claims.select("claim", "chunk").join(named, "claim", "left").groupBy("chunk").agg(F.count_distinct("claim").alias("claims"), F.array_sort(F.collect_set("name")).alias("names"))


def graph_view(entities: DataFrame, edges: DataFrame, members: DataFrame, most: int = 2000) -> DataFrame:
    """``(entity, mentions, community, degree)`` of the most mentioned entities, with the edges between them counted."""
    top = entities_listed(entities, most).select("entity", "mentions")
    ends = edges.join(top.select(F.col("entity").alias("a")), "a", "left_semi").join(top.select(F.col("entity").alias("b")), "b", "left_semi")
    degree = ends.select(F.col("a").alias("entity")).unionByName(ends.select(F.col("b").alias("entity"))).groupBy("entity").agg(F.count("*").alias("degree"))
    return top.join(members, "entity", "left").join(degree, "entity", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def answer_references(answers: DataFrame, labelled: DataFrame) -> DataFrame:
    """``(answer, label, chunk)``: the labelled claims that an answer's text cites as ``[n]``, each once. ``labelled`` has ``answer, label, claim, chunk``."""
    cited = answers.select("answer", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1)).cast("array<int>"))).alias("label"))
    return labelled.join(cited, ["answer", "label"], "left_semi").select("answer", "label", "chunk")


def graph_built(extractions: DataFrame) -> dict[str, DataFrame]:
    """The tables ``entities, relations, claims, anchors`` of parsed extractions (``chunk, video, entities, relations, claims``): all chunks merged, claims named by chunk and text and anchored only to entities of their own extraction."""
    named = extractions.select("chunk", F.explode("entities").alias("e"))
    mentions = named.select(F.col("e.name").alias("name"), F.explode(F.concat(F.coalesce("e.aliases", F.array().cast("array<string>")), F.array("e.name"))).alias("alias"), "chunk")
    entities = upsert_entities(mentions)
    stated = extractions.select(F.explode("relations").alias("r")).select(slug(F.col("r.source")).alias("src"), slug(F.col("r.target")).alias("dst"), F.col("r.type").alias("type"), F.coalesce("r.weight", F.lit(0.5)).alias("weight"))
    said = extractions.select("chunk", "video", F.transform("entities", lambda e: slug(e["name"])).alias("own"), F.explode("claims").alias("c"))
    claims = said.select(claim_id(F.col("chunk").cast("string"), F.col("c.text")).alias("claim"), "chunk", "video", F.col("c.text").alias("text"), F.array_intersect(F.transform(F.coalesce("c.entities", F.array().cast("array<string>")), slug), "own").alias("about"))
    return {
        "entities": entities,
        "relations": upsert_relations(stated, entities),
        "claims": claims.select("claim", "chunk", "video", "text").dropDuplicates(["claim"]),
        "anchors": claims.select("claim", F.explode("about").alias("entity")).distinct(),
    }
