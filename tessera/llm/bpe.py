"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become symbols (a class array plus two look-ahead facts), and each
symbol is a function on the states of a small automaton that says where pieces
begin. Composition of such functions is associative, so the states are found by
a scan over function ids: a table lookup for each doubling of the reach. After
a few doublings every composed function is constant, and the scan ends. No
regular expression takes part. The pieces are slices of the encoded text,
merged once and then found in a cache; their offsets stay beside the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import slices

# Symbols: other, letter, number, whitespace before more of it or the end, space before something else, other
# whitespace before something else, apostrophe of a two- or three-character contraction, start of a text.
O, L, N, WS, SPACE, LAST, SHORT, LONG, START = range(9)
# States: nothing to continue, in letters, in numbers, in others, after a joining space, in whitespace, two or one
# letters of a contraction left. The last state means that a contraction's letters were read and nothing continues.
FRESH, IN_L, IN_N, IN_O, JOIN, IN_WS, TWO, ONE = range(8)
STATES = 8

#: Code points at once; texts are never split for this, so one longer text is taken whole.
CHUNK = 1 << 20
#: Pieces kept with their ids; the cache is emptied beyond it.
CACHE = 1 << 18
#: Pieces of more bytes than this are merged but not kept.
CACHED_BYTES = 64

#: Control characters that have the White_Space property.
CONTROL_SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85)
#: Letters and numbers that Unicode 16 added to 15.1, which Python 3.13's tables hold.
ADDED_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
ADDED_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)


@lru_cache(None)
def classes() -> np.ndarray:
    """O, L, N or WS of each code point: general categories L* and N* and the White_Space property of Unicode 16."""
    kinds = {"L": L, "N": N, "Z": WS}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], O) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    table[list(CONTROL_SPACES)] = WS
    for kind, added in ((L, ADDED_LETTERS), (N, ADDED_NUMBERS)):
        for first, last in added:
            table[first : last + 1] = kind
    return table


def _step(state: int, symbol: int) -> int:
    """The state after a symbol."""
    if symbol in (SHORT, LONG) and state in (IN_O, JOIN):
        symbol = O
    if symbol == L and state in (TWO, ONE):
        return ONE if state == TWO else FRESH
    return {O: IN_O, L: IN_L, N: IN_N, WS: IN_WS, SPACE: JOIN, LAST: FRESH, SHORT: ONE, LONG: TWO, START: FRESH}[symbol]


def _begins(state: int, symbol: int) -> bool:
    """Whether a piece begins at a symbol read in a state."""
    joined = {O: (IN_O, JOIN), L: (IN_L, JOIN, TWO, ONE), N: (IN_N, JOIN), WS: (IN_WS,), SHORT: (IN_O, JOIN), LONG: (IN_O, JOIN)}
    return state not in joined.get(symbol, ())


@lru_cache(None)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions that symbols compose to: (id of each symbol, composition table, value at FRESH, whether constant)."""
    base = [tuple(_step(s, x) for s in range(STATES)) for x in range(9)]
    ids = {f: i for i, f in enumerate(dict.fromkeys(base))}
    todo = list(ids)
    while todo:
        f = todo.pop()
        for g in list(ids):
            for h in (tuple(g[s] for s in f), tuple(f[s] for s in g)):
                if h not in ids:
                    ids[h] = len(ids)
                    todo.append(h)
    all_f = list(ids)
    table = np.array([[ids[tuple(g[s] for s in f)] for g in all_f] for f in all_f], dtype=np.uint16)
    return np.array([ids[f] for f in base], dtype=np.uint16), table, np.array([f[FRESH] for f in all_f], dtype=np.uint8), np.array([len(set(f)) == 1 for f in all_f])


@lru_cache(None)
def _starts_table() -> np.ndarray:
    return np.array([[_begins(s, x) for x in range(9)] for s in range(STATES)])


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point of texts laid end to end, which begin at ``text_starts``."""
    n = len(points)
    first = np.zeros(n + 1, dtype=bool)
    first[text_starts] = True
    first[n] = True
    symbol = classes()[points]
    white = symbol == WS
    # whitespace directly before something else
    before = np.zeros(n, dtype=bool)
    before[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    symbol[before] = np.where(points[before] == 0x20, SPACE, LAST)
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        ahead = np.zeros(n + 2, dtype=np.uint32)
        ahead[:n] = points
        one, two = ahead[quote + 1], ahead[quote + 2]
        in_one = ~first[quote + 1]
        in_two = in_one & ~first[np.minimum(quote + 2, n)]
        symbol[quote[in_one & np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = np.zeros(len(quote), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        symbol[quote[in_two & pair]] = LONG
    # state before each code point: the functions of all before it composed, a start of text being constant
    base, compose, at_fresh, constant = _monoid()
    f = base[symbol]
    f[text_starts[text_starts < n]] = compose[base[START], f[text_starts[text_starts < n]]]
    reach = 1
    while reach < n and not constant[f].all():
        g = f.copy()
        g[reach:] = compose[f[:-reach], f[reach:]]
        f, reach = g, 2 * reach
    state = np.zeros(n, dtype=np.uint8)
    state[1:] = at_fresh[f[:-1]]
    state[first[:n]] = FRESH
    return _starts_table()[state, symbol] | first[:n]


class Codec:
    """Encodes and decodes by a table of ranks, as read from a ``.tiktoken`` file's lines."""

    def __init__(self, lines: bytes):
        pairs = (line.split() for line in lines.splitlines() if line.strip())
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.named = {str(i).encode(): b for b, i in self.ranks.items()}
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: whole if it has a rank, else the adjacent pair of lowest rank, leftmost first, is joined again and again."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            gone = end[i]
            alive[gone] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _missing(self, piece: bytes) -> bytes:
        ids = b",".join(b"%d" % i for i in self.merge(piece))
        if len(piece) <= CACHED_BYTES:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray]]:
        """For each text, its ids in decimal joined by commas, and the offsets in bytes at which its pieces begin. Null: empty."""
        whole = [x or "" for x in texts]
        at = 0
        while at < len(whole):
            to, size = at, 0
            while to < len(whole) and (to == at or size + len(whole[to]) <= CHUNK):
                size += len(whole[to])
                to += 1
            yield from self._encode(whole[at:to])
            at = to

    def _encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        text_starts = np.cumsum([0, *map(len, texts)])
        starts = np.flatnonzero(piece_starts(points, text_starts)) if len(points) else np.zeros(0, dtype=np.int64)
        wide = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        offset = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(wide, out=offset[1:])
        data, bounds = joined.encode("utf-8"), offset[np.append(starts, len(points))]
        get, missing = self.cache.get, self._missing
        cuts = np.searchsorted(starts, text_starts)
        for i in range(len(texts)):
            own = bounds[cuts[i] : cuts[i + 1] + 1]
            edges = own.tolist()
            ids = [get(p) or missing(p) for p in [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]]
            yield b",".join(ids), own[:-1] - own[0]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids in decimal joined by commas."""
        return b"".join(map(self.named.__getitem__, ids.split(b","))) if ids else b""


_CODECS: dict[tuple[int, int], Codec] = {}


def codec_for(lines: bytes) -> Codec:
    """One codec for each vocabulary and Python worker."""
    key = (len(lines), hash(lines))
    if key not in _CODECS:
        _CODECS[key] = Codec(lines)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", arrays: bool = True) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if ``arrays``, ``ids`` and ``piece_offsets``.

    ``vocabulary`` is the content of a rank file, a few MB at most, broadcast to the executors, which need not have it.
    ``decoded_sha256`` is of the bytes that the ids decode to. Null and empty texts have no ids. Texts are taken whole.
    Repeated rows stay, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    extra = ", ids array<int>, piece_offsets array<int>" if arrays else ""

    def run(batches):
        codec = codec_for(shared.value)
        for batch in slices(batches):
            n, ids_sha, decoded_sha, ids, offsets = [], [], [], [], []
            for joined, at in codec.encode(batch.column(1).to_pylist()):
                n.append(joined.count(b",") + 1 if joined else 0)
                ids_sha.append(hashlib.sha256(joined).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(joined)).hexdigest())
                if arrays:
                    ids.append(np.array(joined.split(b",") if joined else [], dtype=np.int32))
                    offsets.append(at.astype(np.int32))
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if arrays:
                out += [pa.array(x, pa.list_(pa.int32())) for x in (ids, offsets)]
                names += ["ids", "piece_offsets"]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")


def decode(encoded: DataFrame, vocabulary: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of each row's ids decoded as UTF-8; ids that cut a character give replacement characters."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def text(ids):
        codec = codec_for(shared.value)
        return ids.map(lambda x: None if x is None else codec.decode(b",".join(b"%d" % i for i in x)).decode("utf-8", "replace"))

    return encoded.withColumn(out_col, text(ids_col))
