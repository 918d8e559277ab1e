"""Secret scans with multipart credential linking.

Strong patterns are found alone. Access identifiers, secrets without a label
and endpoints are weak: each is reported only where complementary parts
co-occur in its scope, found by an interval join of the parts' windows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import slices

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of 32 or more: the same as all maximal runs without the shorter ones.
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
IDENTIFIER = re.compile(r"""(?ai:access_key_id|client_id|account_id|user_?name|user_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{4,})""")
#: A token of 32 or more, of the URL-safe alphabet too, or of 20 or more letters and digits.
UNLABELLED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{32,}={0,2}|[A-Za-z0-9]{20,})(?![A-Za-z0-9+/=_-])")
#: A value under a name that has a keyword anywhere, as in SECRET_ACCESS_KEY=. Names are taken whole.
NAMED = re.compile(r"""(?a:(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]{8,}))""")
#: An endpoint is a scheme, ``://`` and what follows up to white space, quotes or angle brackets.
IN_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
AFTER_SCHEME = re.compile(r"""[^\s"'<>]+""")
#: Kinds in the order in which spans that begin together are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: Code points between parts of one credential at most. A scope also ends at an empty line.
REACH = 200
PLACEHOLDER = "[SECRET]"

Span = tuple[str, int, int]


def strong(text: str) -> list[Span]:
    """Labelled assignments, access keys and hexadecimal runs, leftmost and non-overlapping for each kind."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def endpoints(text: str) -> list[Span]:
    """Endpoints, leftmost and non-overlapping, looked for from each ``://``, so that long runs of letters are walked once."""
    found: list[Span] = []
    at = end = 0
    while (i := text.find("://", at)) >= 0:
        start = i
        while start > end and text[start - 1] in IN_SCHEME:
            start -= 1
        while start < i and not text[start].isalpha():
            start += 1
        rest = AFTER_SCHEME.match(text, i + 3) if start < i else None
        if rest:
            found.append(("linked_endpoint", start, rest.end()))
        at = rest.end() if rest else i + 3
        end = at if rest else end
    return found


def _linked(parts: list[Span], others: list[Span], text: str) -> set[Span]:
    """All parts and all others that are in reach and scope of each other without overlapping.

    Spans of one kind never overlap, so that few of them fit into the reach of a part, however long the text is.
    """
    by_kind: dict[str, list[Span]] = {}
    for q in sorted(others, key=lambda s: s[1]):
        by_kind.setdefault(q[0], []).append(q)
    kinds = [(own, [q[1] for q in own], [q[2] for q in own]) for own in by_kind.values()]
    found: set[Span] = set()
    for p in parts:
        _, start, end = p
        low, high = max(0, start - REACH), end + REACH
        # an empty line ends the scope
        if (at := text.rfind("\n\n", low, start)) >= 0:
            low = at + 1
        if (at := text.find("\n\n", end, high)) >= 0:
            high = at + 1
        for own, starts, ends in kinds:
            before = own[bisect_left(ends, low) : bisect_right(ends, start)]
            after = own[bisect_left(starts, end) : bisect_right(starts, high)]
            if before or after:
                found.update((p, *before, *after))
    return found


def scan(text: str | None) -> list[Span]:
    """All spans ``(kind, start, end)`` of a text, by start, then kind. Null and empty texts have none."""
    text = text or ""
    found = strong(text)
    ids = [s for s in found if s[0] == "access"]
    low = text.lower()
    if "_id" in low or "user" in low:
        ids += [("linked_id", m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
    if ids:
        taken = sorted((s[1], s[2]) for s in found)
        named = [("linked_secret", m.start(), m.end()) for m in NAMED.finditer(text) if _named(m[1], m[2])] if any(k in low for k in KEYWORDS) else []
        starts = [s[1] for s in named]
        # a value belongs to its name's span
        inside = lambda m: (i := bisect_right(starts, m.start())) and m.end() <= named[i - 1][2]
        weak = [*named, *(("linked_secret", m.start(), m.end()) for m in UNLABELLED.finditer(text) if _mixed(m[0]) and not inside(m))]
        # the furthest end of what starts before a place tells whether anything reaches into it
        starts_taken, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        weak = [w for w in weak if not (i := bisect_left(starts_taken, w[2])) or reach[i - 1] <= w[1]]
        secrets = [*weak, *(s for s in found if s[0] != "access")]
        whole = _linked(secrets, ids, text)
        ends = endpoints(text) if whole else []
        linked = {*whole, *(_linked(ends, list(whole), text).intersection(ends))}
        found += [s for s in linked if s[0].startswith("linked")]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def _mixed(token: str) -> bool:
    """Whether it holds small and capital letters and digits, as random keys do and words don't."""
    return any(c.islower() for c in token) and any(c.isupper() for c in token) and any(c.isdigit() for c in token)


def _named(name: str, value: str) -> bool:
    """Whether a name is that of a secret and the value has letters and digits."""
    name = name.lower()
    return any(k in name for k in KEYWORDS) and any(c.isalpha() for c in value) and any(c.isdigit() for c in value)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each maximal run of overlapping spans replaced by a placeholder."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], PLACEHOLDER]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """``(id, spans)`` of every row and, if asked for, ``text`` without what was found, null if it was null.

    Offsets count code points, ends are exclusive. Texts are scanned whole. Repeated rows stay, other columns are
    ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            spans = [scan(t) for t in texts]
            out = [batch.column(0), pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], kind)]
            if redacted:
                out.append(pa.array([redact(t, x) for t, x in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["id", "spans", "text"][: len(out)])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans {SPANS}" + ", text string" * redacted)
