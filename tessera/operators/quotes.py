"""Quotes against their sources: which of a quote's words a source holds in blocks, its own words for them, and the source itself.

Blocks are found by seeds: every word of the quote that the source has at some place is a seed, seeds that go on along
both texts are a run, and the longest run inside both gaps between two blocks is the next block. The work is in the
number of seeds, not in the product of the texts.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import quote_tokens

WORD = re.compile(r"[a-z0-9']+")
#: Share of a quote's words that its source has to hold.
LEAST_RATIO = 0.8
#: A span of more than so many times the quote's words, and some to spare, is stitched together and no quote.
MOST_LONGER, SPARE = 3, 4
#: Words of a conflict's quote at least.
LEAST_WORDS = 10
#: Words of the runs on which quotes and sources meet.
SHINGLE = 3


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """``(start in a, start in b, words)`` of matching blocks in order: the longest first, then the same to its left and right.

    Of equally long blocks the first in ``a`` counts, then the first in ``b``. Neighbouring blocks stay apart.
    """
    numbers = {w: n for n, w in enumerate(dict.fromkeys(a))}
    held = np.array([numbers.get(w, -1) for w in b], dtype=np.int64)
    order = np.argsort(held, kind="stable")
    known = held[order]
    own = np.array([numbers[w] for w in a], dtype=np.int64)
    low, high = np.searchsorted(known, own), np.searchsorted(known, own, "right")
    i = np.repeat(np.arange(len(a)), high - low)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[i]] if len(i) else i
    # seeds of one diagonal that follow each other are one run
    along = np.lexsort((i, j - i))
    i, j = i[along], j[along]
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(i) != 1) | (np.diff(j) != 1)))) if len(i) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.concatenate((starts, [len(i)])))
    found, gaps = [], [(i[starts], j[starts], size, 0, len(a), 0, len(b))]
    while gaps:
        x, y, n, alo, ahi, blo, bhi = gaps.pop()
        # what of each run is inside both gaps
        skip = np.maximum(np.maximum(alo - x, blo - y), 0)
        left = np.minimum(np.minimum(ahi - x, bhi - y), n) - skip
        inside = left > 0
        x, y, n = (x + skip)[inside], (y + skip)[inside], left[inside]
        if not len(n):
            continue
        best = np.lexsort((y, x, -n))[0]
        s, t, k = int(x[best]), int(y[best]), int(n[best])
        found.append((s, t, k))
        before, after = (x < s) & (y < t), (x + n > s + k) & (y + n > t + k)
        gaps.append((x[before], y[before], n[before], alo, s, blo, t))
        gaps.append((x[after], y[after], n[after], s + k, ahi, t + k, bhi))
    return sorted(found)


def ratio(quote: str | None, source: str | None) -> float:
    """Share of the quote's words that are in blocks; 0 for an empty quote."""
    a = words(quote)
    return sum(k for *_, k in blocks(a, words(source))) / len(a) if a else 0.0


def snap(quote: str | None, source: str | None) -> tuple[str, float, int]:
    """The source's own words from the first block to the last, the ratio, and where they start; nothing and ratio 0 for a span that is too long."""
    a, spots = words(quote), list(re.finditer(r"[A-Za-z0-9']+", source or ""))
    if not a or not spots:
        return "", 0.0, 0
    met = blocks(a, [m[0].lower() for m in spots])
    if not met:
        return "", 0.0, 0
    first, last = met[0][1], met[-1][1] + met[-1][2] - 1
    if last - first + 1 > MOST_LONGER * len(a) + SPARE:
        return "", 0.0, 0
    start = spots[first].start()
    return source[start : spots[last].end()], sum(k for *_, k in met) / len(a), start


def verbatim(quote: str | None, source: str | None, least_words: int = LEAST_WORDS, least: float = LEAST_RATIO) -> str | None:
    """Whole words of the source, with their punctuation, from the first block to the last; null if the quote is short or held too little."""
    a, whole = words(quote), (source or "").split()
    if len(a) < least_words:
        return None
    owner = [(n, w) for n, word in enumerate(whole) for w in words(word)]
    met = blocks(a, [w for _, w in owner])
    if not met or sum(k for *_, k in met) / len(a) < least:
        return None
    return " ".join(whole[owner[met[0][1]][0] : owner[met[-1][1] + met[-1][2] - 1][0] + 1])


def ratios(quote: Column, source: Column) -> Column:
    @F.pandas_udf("double")
    def run(q: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([round(ratio(x, y), 6) for x, y in zip(q, s, strict=True)])

    return run(quote, source)


def snapped(quote: Column, source: Column, least: float = LEAST_RATIO) -> Column:
    """Struct of ``span``, ``ratio`` and ``at``, the characters before it; nulls if the source holds too little of the quote."""

    @F.pandas_udf("span string, ratio double, at long")
    def run(q: pd.Series, s: pd.Series) -> pd.DataFrame:
        found = [snap(x, y) for x, y in zip(q, s, strict=True)]
        return pd.DataFrame([(span, round(r, 4), at) if span and r >= least else (None, None, None) for span, r, at in found], columns=["span", "ratio", "at"]).astype({"span": object, "ratio": float, "at": "Int64"})

    return run(quote, source)


def reconciled(evidence: DataFrame, excerpts: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """``(rule, chunk, span, at, ratio)``: quotes with the excerpt that their number names, each chunk and span of a rule once, the first row of the evidence counting.

    ``evidence`` has ``rule, place, number, quote``, ``excerpts`` has ``number`` (from 1), ``chunk, text, start, end``. A
    number that names none, an empty quote and one that its excerpt does not hold are dropped. The time of a quote is
    as far into its excerpt as its first word is into the text.
    """
    met = evidence.where(F.trim("quote") != "").join(excerpts, "number").withColumn("f", snapped(F.col("quote"), F.col("text"), least))
    share = F.col("f.at") / F.greatest(F.length("text"), F.lit(1))
    start, end = F.coalesce("start", F.lit(0.0)), F.coalesce("end", "start", F.lit(0.0))
    good = met.where(F.col("f.span").isNotNull()).select("rule", "place", "chunk", F.col("f.span").alias("span"), F.round(start + share * F.greatest(F.lit(0.0), end - start), 2).alias("at"), F.col("f.ratio").alias("ratio"))
    once = good.groupBy("rule", "chunk", "span").agg(F.min(F.struct("place", "at", "ratio")).alias("x"))
    return once.select("rule", "chunk", "span", "x.at", "x.ratio")


def _with_runs(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``r``, the different runs of ``n`` words of ``text``; the whole of a shorter text."""
    t = F.col("t")
    # the words beside themselves, shifted: in proportion to the text, however the optimiser places the columns
    cut = reduce(lambda said, k: F.zip_with(said, F.slice(t, k + 1, F.size(t)), lambda x, y: F.concat_ws(" ", x, y)), range(1, n), t)
    cut = F.slice(cut, 1, F.greatest(F.size(t) - n + 1, F.lit(0)))
    runs = F.when(F.size(t) >= n, cut).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("t", quote_tokens(F.col("text"))).withColumn("r", F.array_distinct(runs)).drop("t")


def located(quotes: DataFrame, sources: DataFrame, least_shared: float = 0.5, n: int = SHINGLE) -> DataFrame:
    """``(query_id, doc, shared)``: the sources that have at least this share of a quote's different runs of ``n`` words.

    ``quotes`` has ``query_id, text``, ``sources`` has ``doc, text``. Sources meet quotes on equal runs, of which those
    that no quote has are dropped where they are read; a shorter quote is one run and meets sources that are just that.
    """
    wanted = _with_runs(quotes.select("query_id", "text"), n).select("query_id", F.size("r").alias("runs"), F.explode("r").alias("run"))
    have = _with_runs(sources.select("doc", "text"), n).select("doc", F.explode("r").alias("run"))
    met = have.join(wanted, "run").groupBy("query_id", "doc", "runs").agg(F.count("*").alias("n"))
    return met.withColumn("shared", F.round(F.col("n") / F.col("runs"), 6)).where(F.col("shared") >= least_shared).select("query_id", "doc", "shared")


def best_sources(quotes: DataFrame, sources: DataFrame, least: float = LEAST_RATIO, least_shared: float = 0.5) -> DataFrame:
    """``(query_id, doc, span, ratio, at)``: of the located sources that hold a quote the one that holds most of it, ties to the smaller id."""
    pairs = located(quotes, sources, least_shared).join(quotes.withColumnRenamed("text", "quote"), "query_id").join(sources, "doc")
    found = pairs.withColumn("f", snapped(F.col("quote"), F.col("text"), least)).where(F.col("f.span").isNotNull())
    order = Window.partitionBy("query_id").orderBy(F.col("f.ratio").desc(), "doc")
    return found.withColumn("n", F.row_number().over(order)).where("n = 1").select("query_id", "doc", "f.span", "f.ratio", "f.at")
