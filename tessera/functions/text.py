"""Text expressions: tokens, slugs, identities, previews, labels and detectors. All stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The families of corpus-wide questions, first match wins, and the openers of questions.
SOURCE_NOUN = r"(?:videos?|transcripts?|episodes?|channels?|creators?|speakers?|corpus|corpora)"
CORPUS_WIDE = (
    ("corpus", r"\bcorp(?:us|ora)\b"),
    (
        "all-sources",
        rf"\b(?:all|every|each|both|these|those)\s+(?:of\s+)?(?:the\s+)?(?:\w+[- ])?{SOURCE_NOUN}\b"
        r"|\bthe\s+(?:\w+-\w+|\w+)\s+(?:videos|transcripts|episodes|channels)\b"
        r"|\bthe\s+(?:videos|transcripts|episodes|channels)\b",
    ),
    (
        "across-sources",
        r"\b(?:across|throughout|among|amongst|between|within|in)\s+"
        rf"(?:all\s+|both\s+|these\s+|those\s+|this\s+|the\s+|your\s+|our\s+)*{SOURCE_NOUN}\b",
    ),
    (
        "aggregate",
        r"\b(?:recurring|recurrent|repeatedly|in\s+common|common\s+(?:themes?|threads?|advice|ground)"
        r"|(?:main|key|central|overall|broad|overarching)\s+(?:themes?|threads?|takeaways?)"
        r"|consensus|(?:generally|widely)\s+agree|across\s+the\s+board"
        r"|(?:repeat|agree|disagree|converge|differ)s?\s+(?:on|about|across)|how\s+often)\b",
    ),
    (
        "over-time",
        r"\b(?:evolve[ds]?|evolving|evolution|over\s+time|change[ds]?\s+over"
        r"|shift(?:ed|s)?\s+(?:over|between|across)|trend(?:s|ed)?\s+(?:over|across)|develop(?:ed|s)?\s+over)\b",
    ),
)
QUESTION_LEAD = (
    r"^(?:so|and|but|well|like|now|i mean|you know|right|okay|ok)?[\s,]*"
    r"(?:what|who|whom|whose|which|when|where|why|how|is|are|was|were|do|does|did|"
    r"has|have|had|can|could|should|would|will|shall|am|any(?:one|body))\b"
)
URL = r"https?://[^\s<>\"')\]]+"
VIDEO_HOSTS = ("youtube.com", "m.youtube.com", "youtu.be", "music.youtube.com")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; other letters separate. Null: no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def quote_tokens(text: Column) -> Column:
    """Like :func:`tokens`, with apostrophes inside."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))


def slug(name: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, none at the ends; ``unknown`` if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("unknown"))


def short_hash(prefix: str, text: Column, digits: int = 16) -> Column:
    """Prefix and the first hexadecimal digits of the SHA-256 of the text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, digits))


def claim_id(chunk_id: Column, text: Column) -> Column:
    return short_hash("claim:", F.concat_ws("\n", chunk_id, F.trim(text)))


def document_id(url: Column) -> Column:
    return short_hash("doc:", url)


def chunk_id(source: Column, index: Column) -> Column:
    return F.concat_ws(":", F.lit("chunk"), source, index)


def chunk_index(chunk: Column) -> Column:
    """Index of ``chunk:<source>:<n>``; 0 if it is none."""
    return F.coalesce(F.nullif(F.regexp_extract(chunk, r"^chunk:[^:]*:(\d+)$", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))


def chunk_source(chunk: Column) -> Column:
    """Source of ``chunk:<source>:<n>``; empty if it is none."""
    return F.regexp_extract(chunk, r"^chunk:([^:]*):\d+$", 1)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def preview(text: Column, size: int = 120, mark: str = "...") -> Column:
    """White space collapsed; the first characters with a mark if there are more."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.substring(flat, 1, size)), F.lit(mark))).otherwise(flat)


def clipped(text: Column, size: int = 220, mark: str = "…") -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def timestamp(seconds: Column) -> Column:
    """``MM:SS``, with hours in front only where there are any; ``unknown`` for null, zero for negative."""
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours, minutes = F.floor(s / 3600).cast("int"), F.floor(s / 60).cast("int") % 60
    plain = F.concat_ws(":", two(minutes), two(s % 60))
    return F.when(seconds.isNull(), "unknown").when(hours > 0, F.concat_ws(":", two(hours), plain)).otherwise(plain)


def context_header(channel: Column, title: Column, start: Column, end: Column) -> Column:
    """``[channel — title @ mm:ss-mm:ss]``; null if both names are null."""
    name = F.concat_ws(" — ", channel, title)
    return F.when(channel.isNotNull() | title.isNotNull(), F.concat(F.lit("["), name, F.lit(" @ "), timestamp(start), F.lit("-"), timestamp(end), F.lit("]")))


def embedding_text(header: Column, text: Column) -> Column:
    return F.concat_ws("\n", header, text)


def corpus_wide_signal(question: Column) -> Column:
    """The first family whose pattern occurs; null if none does. Letters of any script are letters."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CORPUS_WIDE):
        out = F.when(F.lower(question).rlike("(?U)" + pattern), name).otherwise(out)
    return out


def states_a_position(text: Column) -> Column:
    """False for blank texts and questions."""
    said = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return (said != "") & ~said.endswith("?") & ~F.lower(said).rlike("(?U)" + QUESTION_LEAD)


def urls(text: Column) -> Column:
    """All web addresses, without punctuation that follows them."""
    return F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://(?:www\.)?([^/?#:]+)", 1))


def document_url(text: Column) -> Column:
    """The first address whose host is not a video host; null if there is none."""
    return F.get(F.filter(urls(text), lambda u: ~host(u).isin(*VIDEO_HOSTS)), F.lit(0))


def video_id(url: Column) -> Column:
    """An eleven-character id given bare or in the usual address forms; null if there is none."""
    found = [F.regexp_extract(url, p, 1) for p in (r"^([A-Za-z0-9_-]{11})$", r"[?&]v=([A-Za-z0-9_-]{11})(?:&|#|$)", r"/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})(?:[/?#]|$)", r"youtu\.be/([A-Za-z0-9_-]{11})(?:[/?#]|$)")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def normal_query(text: Column) -> Column:
    """White space collapsed, lower case, punctuation at the end cut."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), r"[\s?.!,;:]+$", "")


def label_number(label: Column) -> Column:
    """2 for ``[2]``, 3 for ``[s1.3]``; null otherwise."""
    return F.nullif(F.regexp_extract(label, r"^\[(?:s\d+\.)?(\d+)\]$", 1), F.lit("")).cast("int")


def weight_clamp(weight: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))


def safe_ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """Null for a zero denominator."""
    return F.round(F.try_divide(a, b), digits)


def undecided(votes: Column, n: Column) -> Column:
    """Whether a third or more but less than two thirds agree, in whole numbers."""
    return (3 * votes >= n) & (3 * votes < 2 * n)


def _log_factorial(n: Column) -> Column:
    """Exact to a double's precision: from a table up to 20, by Stirling's series beyond."""
    x = F.greatest(n, F.lit(20)).cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def majority_chance(votes: Column, n: Column) -> Column:
    """Chance that more than half of n draws with probability votes / n come out; null for no draws.

    The first term beyond the middle comes from logarithms, each other one from that before it, away from the mean, so
    terms only fall: to less than 1e-40 of the first after seven roots of n, where a double's sum has long stood still.
    """
    p = F.try_divide(votes, n)
    # the side that the mean is not on
    low = F.least(p, 1 - p)
    few = p <= 0.5
    half = F.floor(n / 2).cast("int")
    # the most draws of either kind on that side of the middle: more than half that come out, or half or more that don't
    m = F.when(few, half + 1).otherwise(n - half).cast("int")
    first = F.exp(_log_factorial(n) - _log_factorial(m) - _log_factorial(n - m) + m * F.log(low) + F.when(n > m, (n - m) * F.log(1 - low)).otherwise(0.0))
    odds = low / (1 - low)
    steps = F.sequence(F.lit(0), F.least(n - m, F.ceil(7 * F.sqrt(n))).cast("int"))
    none = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    total = F.aggregate(steps, none, lambda s, j: F.struct((s["term"] * (n - m - j) / (m + j + 1) * odds).alias("term"), (s["sum"] + s["term"]).alias("sum")))["sum"]
    tail = F.when(low > 0, first * total).otherwise(0.0)
    return F.when(n > 0, F.when(few, tail).otherwise(1 - tail))
