"""URL filters: rules by host and path, then segmented host words judged by multinomial naive Bayes.

Runs of letters in host and path are split into words by the likeliest sequence
under a unigram model (Viterbi). A URL with some of a few given unwanted terms
among its words is a first example of what to block; naive Bayes counts over all
URLs carry that over to the words that go with them.

Neither model is held in one place, so no word is left out for being rare: each
distinct run is joined with the words that occur in it, and each distinct URL's
tokens with their odds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import checkpointed, slices

#: Words up to this length are joined by each part of a run, longer ones by their first so many letters and then compared.
PIECE = 24
#: Terms that mark a first example of an unwanted URL.
UNWANTED = (
    "ads adserver adult bet bets betting casino cheap cialis clickbait escort fakes farm free gamble gambling hentai jackpot keygen loan loans lottery "
    "malware nude payday phish phishing pills poker porn replica sex slots spam spyware torrent track tracker tracking viagra warez win xxx"
).split()
#: A URL is a first example if this many of its distinct words are unwanted terms.
TERMS_NEEDED = 2
#: Unwanted terms are words, however rare: they count at least as one of so many running words.
ONE_IN = 10_000
#: What an unknown letter costs more than the rarest word.
UNKNOWN_START, UNKNOWN_LETTER = 3.0, 2.0
#: Log odds are summed in whole billionths, so that the order of summing does not matter.
UNIT = 1_000_000_000


@dataclass(frozen=True)
class Rule:
    """Holds for a host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case and path, as written otherwise; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does. Of equally long ones the first listed counts."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)``: running words of all rows, in small letters, with how often they occur."""
    words = texts.select(F.explode(F.split(F.lower(F.col(text_col)), r"[\x00-\x60\x7b-\x7f]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def runs(host: Column, path: Column) -> Column:
    """Runs of letters and of digits of the host but its last label, then of the path in small letters; a run of digits is ``#``."""
    most = F.substring_index(host, ".", -1)
    front = F.substring(host, F.lit(1), F.length(host) - F.length(most))
    return F.transform(F.regexp_extract_all(F.concat(front, F.lit("/"), F.lower(path)), F.lit(r"(\p{L}+|\p{Nd}+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\p{Nd}+$"), "#").otherwise(x))


def cheapest(name: str, arcs: list[tuple[int, int, float]], unknown: float) -> list[str]:
    """The cheapest split of a run (Viterbi). ``arcs`` are (end, length, cost) of known words in it; any other piece is unknown.

    An unknown piece costs more with each letter than any known word; of equally cheap splits the one whose last piece
    is longest counts.
    """
    by_end: dict[int, list[tuple[int, float]]] = {}
    for end, n, cost in arcs:
        by_end.setdefault(end, []).append((n, cost))
    size = len(name)
    best, back = [0.0] + [math.inf] * size, [0] * (size + 1)
    # the cheapest unknown piece that ends here begins where the best split so far, less its letters' cost, is least
    low, low_at = 0.0, 0
    for end in range(1, size + 1):
        best[end], back[end] = low + unknown + UNKNOWN_LETTER * end, low_at
        for n, cost in sorted(by_end.get(end, ()), reverse=True):
            total = best[end - n] + cost
            if total < best[end] or total == best[end] and end - n < back[end]:
                best[end], back[end] = total, end - n
        if best[end] - UNKNOWN_LETTER * end < low:
            low, low_at = best[end] - UNKNOWN_LETTER * end, end
    words, at = [], size
    while at:
        words.append(name[back[at] : at])
        at = back[at]
    return words[::-1]


def segmented(names: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """``(name, words)`` of distinct ``names``. ``words`` has ``word`` and ``n``; ``total`` is the sum of ``n``.

    A run meets a word where it holds it: short words by all parts of the run up to their length, longer ones by their
    beginning. A run's words are gathered beside it, at most as many as it has parts.
    """
    size = F.length("name")
    start = names.select("name", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    part = start.select("name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(PIECE), size - F.col("start") + 1))).alias("length"))
    short = part.select("name", F.col("name").substr(F.col("start"), F.col("length")).alias("word"), "start").join(words.where(F.length("word") <= PIECE), "word")
    beginnings = start.where(size - F.col("start") >= PIECE).select("name", "start", F.col("name").substr(F.col("start"), F.lit(PIECE)).alias("begins"))
    long = beginnings.join(words.where(F.length("word") > PIECE).withColumn("begins", F.substring("word", 1, PIECE)), "begins")
    long = long.where(F.col("name").substr(F.col("start"), F.length("word")) == F.col("word"))
    cost = F.log(F.lit(float(total + 1)) / F.col("n"))
    arc = F.struct((F.col("start") - 1 + F.length("word")).cast("int").alias("end"), F.length("word").alias("length"), cost.alias("cost"))
    arcs = short.select("name", arc.alias("arc")).unionByName(long.select("name", arc.alias("arc"))).groupBy("name").agg(F.collect_list("arc").alias("arcs"))
    unknown = math.log(total + 1) + UNKNOWN_START

    def run(batches):
        for batch in slices(batches):
            names, arcs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [cheapest(x, [(a["end"], a["length"], a["cost"]) for a in y or ()], unknown) for x, y in zip(names, arcs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    return names.select("name").join(arcs, "name", "left").select("name", "arcs").mapInArrow(run, "name string, words array<string>")


def judge(pages: DataFrame, rules: list[Rule], words: DataFrame, id_col: str = "page_id", url_col: str = "url", unwanted: tuple[str, ...] = tuple(UNWANTED), needed: int = TERMS_NEEDED) -> DataFrame:
    """``(id, host, path, rule, verdict, score, words)`` of every row. ``words`` has ``word`` and ``n``.

    ``verdict`` is the longest fitting rule's; where none fits, ``block`` if naive Bayes finds that likelier than
    ``allow``. ``score`` is the log odds, also where a rule decides. Null and unreadable URLs have no words and are
    allowed unless a rule fits. Equal URLs are judged once; repeated rows stay; other columns are ignored; an empty
    table gives no rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = checkpointed(rows.groupBy("host", "path").agg(F.count("*").alias("rows")))
    said = urls.select("host", "path", F.posexplode(runs(F.col("host"), F.col("path"))).alias("at", "name"))
    names = said.where("name <> '#'").select("name").distinct()
    total = words.agg(F.sum("n")).first()[0] or 0
    sure = spark.createDataFrame([(w, 1 + total // ONE_IN) for w in dict.fromkeys(unwanted)], "word string, n long")
    known = words.select("word", F.col("n").cast("long").alias("n")).unionByName(sure).groupBy("word").agg(F.max("n").alias("n"))
    split = checkpointed(segmented(names, known, total))
    # the hash makes Spark shuffle for this join alone, so that it can split a run that most URLs have
    h = F.xxhash64("name").alias("h")
    met = said.select("*", h).join(split.select("*", h), ["name", "h"], "left").select("host", "path", "at", F.coalesce("words", F.array("name")).alias("words"))
    of_url = met.groupBy("host", "path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    tokens = checkpointed(urls.join(of_url, ["host", "path"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>"))))
    bad = (F.size(F.array_intersect(F.array_distinct("words"), F.array(*map(F.lit, unwanted)))) >= needed).alias("bad")
    marked = tokens.select("*", bad)
    odds, prior = log_odds(marked)
    each = tokens.select("host", "path", F.explode("words").alias("token"))
    h = F.xxhash64("token").alias("h")
    summed = each.select("*", h).join(odds.select("*", h), ["token", "h"]).groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    scored = tokens.join(summed, ["host", "path"], "left").select("host", "path", ((F.coalesce("odds", F.lit(0)) + F.lit(prior)) / UNIT).alias("score"), "words")
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    judged = scored.select("host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score", "words")
    h = F.xxhash64("host", "path").alias("h")
    return rows.select("*", h).join(judged.select("*", h), ["host", "path", "h"]).select("id", "host", "path", "rule", "verdict", "score", "words")


def log_odds(marked: DataFrame) -> tuple[DataFrame, int]:
    """``(token, odds)`` of ``words`` by ``bad``, with one added to each count, and the classes' odds, in billionths. ``rows`` is how often a row counts.

    Without examples to block, nothing is likelier blocked.
    """
    counts = marked.select("bad", "rows", F.explode("words").alias("token")).groupBy("token").agg(
        F.sum(F.when(F.col("bad"), F.col("rows")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("rows"))).alias("good")
    )
    classes = marked.agg(F.sum(F.when(F.col("bad"), F.col("rows")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("rows"))).alias("good")).first()
    counts = checkpointed(counts)
    sums = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("n")).first()
    if not classes["bad"]:
        return counts.select("token", F.lit(0).cast("long").alias("odds")), -UNIT
    apart = math.log((sums["bad"] or 0) + sums["n"]) - math.log((sums["good"] or 0) + sums["n"])
    odds = F.log(F.col("bad") + 1.0) - F.log(F.col("good") + 1.0) - F.lit(apart)
    return counts.select("token", F.round(odds * UNIT).cast("long").alias("odds")), round(UNIT * math.log(classes["bad"] / max(1, classes["good"])))
