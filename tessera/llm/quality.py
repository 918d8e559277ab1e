"""Quality classifier from weak labels.

Overlapping heuristics vote ``bad``, ``good`` or nothing on each document.
Expectation-maximisation over the counts of all vote patterns estimates how
often each heuristic accuses good and bad documents, and with that each
pattern's probability of being bad. These posteriors train a linear scorer over hashed features, which
then judges every document.
"""

from __future__ import annotations

import math
import operator
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import slices

NOTHING, GOOD, BAD = 0, 1, 2
#: Features are hashed into this many weights.
DIMENSIONS = 1 << 14
#: Rows that train the scorer: about so many at most, drawn by a hash of id and text; all rows of a smaller table. Votes are counted over all rows.
TRAINING_ROWS = 4000
EPOCHS, RATE, DECAY = 300, 0.5, 1e-5
THRESHOLD = 0.5
#: Pseudo-documents that stand for what is known before any is read, as (not accused, accused): of good and of bad ones
#: for each heuristic, and (good, bad) for the share. They count as this many documents, however many there are.
GOOD_BEFORE, BAD_BEFORE, SHARE_BEFORE = (9.9, 0.1), (1.0, 1.0), (9.0, 1.0)
CACHED_WORDS = 1 << 18

CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SMALL = bytes(range(ord("a"), ord("z") + 1))
SYMBOLS = b"#$%&*+<=>@\\^_`{|}~!"
#: Letters of any script, as bytes: those of ASCII and all that is not ASCII.
LETTERS = CAPITALS + SMALL + bytes(range(128, 256))
SPACES = b" \t\n\r\x0b\x0c"


def measures(text: str) -> dict[str, float]:
    """Shares that the heuristics look at. Those of words are of running words, that of lines of lines."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    capitals, small = n - len(data.translate(None, CAPITALS)), n - len(data.translate(None, SMALL))
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    count = max(1, len(words))
    # of words that do not begin with a letter that has no case, as in many scripts
    small_starts = uncased = 0
    for w in words:
        c = w[0]
        if c.islower():
            small_starts += 1
        elif c > "\x7f" and c.isalpha() and not c.isupper():
            uncased += 1
    return {
        "words": len(words),
        "capitals": capitals / max(1, capitals + small),
        "symbols": (n - len(data.translate(None, SYMBOLS))) / count,
        "bars": data.count(b"|") / count,
        "distinct": len(set(words)) / count,
        "echo": sum(map(operator.eq, words, words[1:])) / count,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "letters": sum(map(len, words)) / count,
        "alphabet": (n - len(data.translate(None, LETTERS))) / max(1, len(data.translate(None, SPACES))),
        "starts": small_starts / max(1, len(words) - uncased) if len(words) > uncased else 1.0,
    }


def _above(name: str, bad: float, good: float):
    return lambda m: BAD if m[name] > bad else GOOD if m[name] < good else NOTHING


def _below(name: str, bad: float, good: float):
    return lambda m: NOTHING if m["words"] < 20 else BAD if m[name] < bad else GOOD if m[name] > good else NOTHING


#: Fixed thresholds; a document of fewer than 20 words says nothing about repetition or shares. The last two look at what several
#: kinds of defects have in common, so that each kind is seen by more than one labeller.
LABELLERS = {
    "shouting": lambda m: NOTHING if m["words"] < 5 else _above("capitals", 0.3, 0.15)(m),
    "symbols": _above("symbols", 0.5, 0.1),
    "table": _above("bars", 0.1, 0.01),
    "vocabulary": lambda m: NOTHING if m["words"] < 20 else BAD if m["distinct"] < max(0.05, 0.3 - m["words"] / 40_000) else GOOD if m["distinct"] > 0.4 else NOTHING,
    "echo": lambda m: NOTHING if m["words"] < 20 else BAD if m["echo"] > 0.2 else GOOD if m["echo"] < 0.05 else NOTHING,
    "lines": lambda m: NOTHING if m["words"] < 20 else BAD if m["lines"] > 0.5 else GOOD if m["lines"] < 0.2 else NOTHING,
    "long words": lambda m: NOTHING if m["words"] < 5 else BAD if m["letters"] > 25 else GOOD if 2 < m["letters"] < 12 else NOTHING,
    "alphabet": _below("alphabet", 0.8, 0.9),
    "starts": _below("starts", 0.55, 0.65),
}


def votes(m: dict[str, float]) -> int:
    """All labellers' votes as one number in base three, the first labeller's as its last digit."""
    return sum(vote(m) * 3**i for i, vote in enumerate(LABELLERS.values()))


def expectation_maximisation(patterns: dict[int, int], rounds: int = 500, labellers: int = len(LABELLERS)) -> tuple[dict[int, float], np.ndarray]:
    """Each pattern's probability of being bad, and each labeller's chance of accusing a good and a bad document.

    Labellers are independent given the class. Each looks for a defect of its own, so that few bad documents are accused
    by many; bad is what has a defect that some labeller sees, so a document that none accuses is good, and the bad
    class's chances are those given at least one accusation. Accusations that meet less often than false alarms would
    by chance then speak for a labeller, and those that fall on accused and other documents alike speak against it. A
    kind of defect much rarer than others is known if two labellers or more see it. A
    labeller that says nothing, because a document is too short for it, tells nothing. No patterns: no probabilities.
    """
    codes = np.array(sorted(patterns), dtype=np.int64)
    n = np.array([patterns[c] for c in codes.tolist()], dtype=float)
    vote = codes[:, None] // 3 ** np.arange(labellers) % 3
    said, accused = vote != NOTHING, vote == BAD
    seen = accused.any(axis=1)
    bad = np.where(seen, 0.9, 0.0)
    chance = np.full((2, labellers), 0.5)
    for _ in range(rounds if len(codes) else 0):
        before = bad
        share = (n @ bad + SHARE_BEFORE[1]) / (n.sum() + sum(SHARE_BEFORE))
        good_n, bad_n = n * (1 - bad), n * bad
        # from documents that none or only one accuses, so that what two labellers accuse together is never a false alarm of each
        few = good_n * (accused.sum(axis=1) <= 1)
        chance[0] = (few @ accused + GOOD_BEFORE[1]) / (few @ said + sum(GOOD_BEFORE))
        # documents of the bad class that none would accuse count too: so many for each that is seen
        missed = np.clip(np.where(said, 1 - chance[1], 1.0).prod(axis=1), 0.0, 0.999)
        chance[1] = (bad_n @ accused + BAD_BEFORE[1]) / ((bad_n / (1 - missed)) @ said + sum(BAD_BEFORE))
        chance = np.clip(chance, 1e-9, 1 - 1e-9)
        # of those that are accused
        missed = np.clip(np.where(said, 1 - chance[1], 1.0).prod(axis=1), 0.0, 1 - 1e-9)
        logs = [np.where(accused, np.log(c), np.where(said, np.log1p(-c), 0.0)).sum(axis=1) for c in chance]
        odds = math.log(share / (1 - share)) + logs[1] - np.log1p(-missed) - logs[0]
        bad = np.where(seen, 1 / (1 + np.exp(-np.clip(odds, -30, 30))), 0.0)
        if np.abs(bad - before).max() < 1e-7:
            break
    return dict(zip(codes.tolist(), bad.tolist(), strict=True)), chance


def _slot(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "replace")) % DIMENSIONS


def _shape(word: str) -> str:
    """A word's first and last three characters, each letter as its class, and its length in steps of three."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in (word[:1] + word[-3:]))
    return f"{kinds} {min(len(word), 30) // 3}"


class Features:
    """Hashed features: shares of words by shape, and each measure in steps."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def __call__(self, text: str, m: dict[str, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values of one text."""
        m = m or measures(text)
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        shares: Counter = Counter()
        for word, n in Counter(text.split()).items():
            slot = cache.get(word)
            if slot is None:
                slot = cache[word] = _slot("shape " + _shape(word))
            shares[slot] += n
        total = max(1, m["words"])
        slots, values = list(shares), [x / total for x in shares.values()]
        for name, x in m.items():
            step = int(math.log2(1 + x)) if name in ("words", "letters") else int(min(x, 2.0) * 10)
            slots.append(_slot(f"measure {name} {step}"))
            values.append(0.5)
        slots.append(_slot("bias"))
        values.append(1.0)
        return np.array(slots), np.array(values)


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on soft targets, by full-batch gradient steps scaled by each weight's past gradients."""
    w, past = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8)
    if not rows:
        return w
    of = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    slot, value = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[slot] * value, minlength=len(rows)), -30, 30)))
        g = np.bincount(slot, ((p - target) / len(rows))[of] * value, minlength=DIMENSIONS) + DECAY * w
        past += g * g
        w -= RATE * g / np.sqrt(past)
    return w


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``(id, text, bad_votes, posterior, score, keep)`` of every row.

    ``posterior`` is the label model's probability of being bad, ``score`` the scorer's; ``keep`` is ``score < 0.5``.
    Null texts count as empty, get no votes on repetition, and like all short texts are kept unless other features
    speak against it; ``text`` stays null. Repeated rows stay. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        for batch in slices(batches):
            found = Counter(votes(measures(t or "")) for t in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])

    # at most three to the power of the labellers' number
    table = rows.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns = {r["pattern"]: r["n"] for r in table}
    posterior, _ = expectation_maximisation(patterns)
    total = sum(patterns.values())

    def features(batches):
        make = Features()
        for batch in slices(batches):
            out = [(votes(m := measures(t or "")), *make(t or "", m)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))], ["pattern", "slots", "shares"])

    scale = 1_000_000_000
    drawn = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(scale)) < int(scale * min(1.0, training_rows / max(1, total))))
    sample = drawn.select("text").mapInArrow(features, "pattern long, slots array<long>, shares array<double>").collect()
    sample.sort(key=lambda r: (r["pattern"], r["slots"], r["shares"]))
    weights = train([(np.array(r["slots"]), np.array(r["shares"])) for r in sample], np.array([posterior.get(r["pattern"], 0.5) for r in sample]))
    model = spark.sparkContext.broadcast((weights, posterior))

    def score(batches):
        w, known = model.value
        make = Features()
        for batch in slices(batches):
            bad, prior, scores = [], [], []
            for t in batch.column(1).to_pylist():
                m = measures(t or "")
                v = votes(m)
                slots, shares = make(t or "", m)
                bad.append(sum(v // 3**i % 3 == BAD for i in range(len(LABELLERS))))
                prior.append(known.get(v, 0.5))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[slots] @ shares))))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bad, pa.int32()), pa.array(prior, pa.float64()), pa.array(scores, pa.float64())], ["id", "text", "bad_votes", "posterior", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"id {kind}, text string, bad_votes int, posterior double, score double")
    return scored.withColumn("keep", F.col("score") < THRESHOLD)
