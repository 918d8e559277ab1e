"""Document kinds, review queries, references, composites and fingerprints as column expressions."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import timestamp

# The words and hosts by which kinds of documents are told apart.
RESUME_SIGNALS = (
    "work experience",
    "professional experience",
    "employment history",
    "work history",
    "education",
    "certifications",
    "professional summary",
    "career summary",
    "references available",
)
RESUME_NAME = r"(?U)\b(resum[eé]s?|curriculum vitae)\b"
COVER_LETTER_SIGNALS = ("dear hiring", "dear sir", "dear ", "cover letter")
COVER_LETTER_SIGNOFFS = ("yours sincerely", "yours faithfully", "kind regards")
COVER_LETTER_OPENING = 400
PROFILE_SIGNALS = ("connections", "followers", "endorsements", "recommendations received")
PROFILE_HOSTS = ("linkedin.com",)
PORTFOLIO_SIGNALS = (
    "portfolio",
    "selected work",
    "selected systems",
    "selected projects",
    "case study",
    "case studies",
    "my projects",
    "featured project",
    "things i've built",
    "things i have built",
)
PORTFOLIO_HOSTS = ("github.io", "vercel.app", "netlify.app", "pages.dev", "surge.sh")
#: Weights of the eight-metric rubric.
DEPTH_WEIGHTS = {
    "faithfulness": 0.20,
    "context_precision": 0.10,
    "answer_relevancy": 0.10,
    "insight_depth": 0.20,
    "specificity": 0.15,
    "coverage": 0.10,
    "evidence_breadth": 0.10,
    "calibration": 0.05,
}


def _hits(text: Column, signals: tuple[str, ...]) -> Column:
    return functools.reduce(operator.add, [text.contains(s).cast("int") for s in signals])


def _on(host: Column, domains: tuple[str, ...]) -> Column:
    """The host is one of the domains or a subdomain of one."""
    return functools.reduce(operator.or_, [(host == d) | host.endswith("." + d) for d in domains])


def document_kind(url: Column, title: Column, headings: Column, texts: Column) -> Column:
    """``cover_letter``, ``resume``, ``profile``, ``portfolio`` or ``document``, the first that fits.

    ``headings`` and ``texts`` are arrays, one element a section. A title or heading names a résumé, body text does
    not; a letter opens or signs off like one. Nulls count as empty.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    none = F.array().cast("array<string>")
    names = F.lower(F.concat_ws(" ", blank(title), F.transform(F.coalesce(headings, none), blank)))
    parts = F.flatten(F.transform(F.arrays_zip(F.coalesce(headings, none).alias("h"), F.coalesce(texts, none).alias("t")), lambda s: F.array(blank(s["h"]), blank(s["t"]))))
    whole = F.lower(F.concat_ws(" ", blank(title), parts))
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    letter = (_hits(F.substring(whole, 1, COVER_LETTER_OPENING), COVER_LETTER_SIGNALS) > 0) | (_hits(names, COVER_LETTER_SIGNALS) > 0) | (_hits(whole, COVER_LETTER_SIGNOFFS) > 0)
    return (
        F.when(letter, "cover_letter")
        .when(names.rlike(RESUME_NAME) | (_hits(names, RESUME_SIGNALS) >= 2), "resume")
        .when(_on(host, PROFILE_HOSTS) | (_hits(whole, PROFILE_SIGNALS) >= 2), "profile")
        .when(_on(host, PORTFOLIO_HOSTS) | (_hits(whole, PORTFOLIO_SIGNALS) > 0), "portfolio")
        .otherwise("document")
    )


def coverage_warning(kind: Column, message: str) -> Column:
    """The message for a kind that could not be named, else null."""
    return F.when(kind == "document", F.lit(message))


def review_query(question: Column, kind: Column, topic: Column, intents: Mapping[str, str], least_words: int = 4) -> Column:
    """The question without addresses if it has words enough; else the intent of the kind, with the topic where the kind has no name."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(question, F.lit("")), r"https?://\S+", " "), r"\s+", " "))
    named = functools.reduce(lambda c, k: c.when(kind == k, intents[k]), [k for k in intents if k != "document"], F.when(F.lit(False), ""))
    generic = F.trim(F.concat_ws(" ", F.lit(intents["document"]), F.nullif(topic, F.lit(""))))
    return F.when(F.size(F.filter(F.split(bare, " "), lambda w: w != "")) >= least_words, bare).otherwise(F.coalesce(named, generic))


def wide_behaviour(cap_lifted: Column, per_source: Column) -> Column:
    """``capped``, ``budget`` or ``budget+diversity`` from two switches."""
    return F.when(~cap_lifted, "capped").when(per_source > 0, "budget+diversity").otherwise("budget")


def timestamp_url(url: Column, seconds: Column) -> Column:
    """The address with its parameter ``t`` set to whole seconds, not below zero; unchanged without a time."""
    at = F.concat(F.lit("t="), F.greatest(F.lit(0), seconds.cast("long")).cast("string"), F.lit("s"))
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    base = F.regexp_replace(url, r"#.*$", "")
    query = F.regexp_extract(base, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & (p != "t") & ~p.startswith("t="))
    before = F.filter(F.split(F.regexp_extract(F.concat(F.lit("&"), query), r"^(.*?)&t(?:=|&|$)", 1), "&"), lambda p: p != "")
    has_t = F.concat(F.lit("&"), query).rlike(r"&t(=|&|$)")
    n = F.when(has_t, F.size(before)).otherwise(F.size(kept))
    placed = F.concat(F.slice(kept, 1, n), F.array(at), F.slice(kept, n + 1, F.size(kept)))
    return F.when(seconds.isNull(), url).otherwise(F.concat(F.regexp_replace(base, r"\?.*$", ""), F.lit("?"), F.array_join(placed, "&"), fragment))


def chunk_reference(number: Column, video: Column, url: Column, start: Column, end: Column) -> Column:
    """``[n] video=... time=...-... url=...``."""
    return F.concat(F.lit("["), number.cast("string"), F.lit("] video="), video, F.lit(" time="), timestamp(start), F.lit("-"), timestamp(end), F.lit(" url="), timestamp_url(url, start))


def unfenced(text: Column) -> Column:
    """Text without a code fence around it, as models put around JSON."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


def section_indices(labels: Column, allowed: Column) -> Column:
    """Distinct 0-based indices among the allowed ones, ascending, from 1-based labels such as ``§3`` or ``#2``."""
    numbers = F.transform(labels, lambda s: F.try_to_number(F.regexp_replace(F.trim(s), "^[§#]+", ""), F.lit("999999")).cast("int") - 1)
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & F.array_contains(allowed, n))))


def efficiency(composite: Column, tokens: Column) -> Column:
    """Composite per thousand tokens; null where either is missing or there are none."""
    return F.try_divide(composite * 1000, F.nullif(tokens, F.lit(0)))


def composite(scores: Column, weights: Mapping[str, float] = DEPTH_WEIGHTS, floor: float | None = 0.6, maximum: float = 0.5) -> Column:
    """Struct of the weighted mean of a map of scores, over the metrics that have one.

    Null and NaN are missing. With a floor, faithfulness below it or missing breaches it: ``maximum`` caps the mean,
    and ``capped`` says whether that changed it. No metric scored: all null, nothing breached.
    """
    value = lambda m: F.nanvl(F.element_at(scores, m).cast("double"), F.lit(None).cast("double"))
    total = functools.reduce(operator.add, [F.coalesce(value(m) * w, F.lit(0.0)) for m, w in weights.items()])
    used = functools.reduce(operator.add, [F.when(value(m).isNotNull(), w).otherwise(0.0) for m, w in weights.items()])
    plain = F.when(used > 0, F.round(total / used, 4))
    low = F.lit(False) if floor is None else (used > 0) & ~F.coalesce(value("faithfulness") >= floor, F.lit(False))
    held = F.when(low, F.least(plain, F.lit(maximum))).otherwise(plain)
    return F.struct(held.alias("composite"), plain.alias("uncapped"), F.round(used, 4).alias("weight_used"), low.alias("breached"), F.coalesce(held < plain, F.lit(False)).alias("capped"))


def cell_fingerprint(fields: Mapping[str, Column]) -> Column:
    """24 hexadecimal digits of the SHA-256 of the fields as JSON, keys sorted, nulls kept."""
    named = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.substring(F.sha2(F.encode(F.to_json(named, {"ignoreNullFields": "false"}), "UTF-8"), 256), 1, 24)


def corpus_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """One row ``(digest, n)`` that tells whether two tables hold the same distinct rows, in any order.

    Four 64-bit slices of each row's SHA-256 are combined by exclusive or, so partial results merge before the
    shuffle and no task gathers the ids. An empty table has a digest too.
    """
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    digest = F.sha2(F.encode(text, "UTF-8"), 256)
    part = lambda i: F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long")
    mixed = rows.select(*columns).distinct().select(*[part(i).alias(f"p{i}") for i in range(4)])
    sums = mixed.agg(*[F.coalesce(F.bit_xor(f"p{i}"), F.lit(0)).alias(f"x{i}") for i in range(4)], F.count("*").alias("n"))
    return sums.select(F.substring(F.sha2(F.encode(F.concat_ws("|", *[f"x{i}" for i in range(4)], "n"), "UTF-8"), 256), 1, 16).alias("digest"), "n")
