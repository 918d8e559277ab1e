"""Blocks of quotes against the standard library's, spans, evidence and the search for sources."""

import difflib
import random

from pyspark.sql import functions as F

from tessera.operators import quotes


def test_blocks_are_those_of_longest_matches_first():
    r = random.Random(5)
    for n in range(10_000):
        size = r.choice([2, 5, 40])
        a, b = ([f"w{r.randrange(size)}" for _ in range(r.choice([0, 1, 7, 30]))] for _ in range(2))
        if r.random() < 0.5 and a:
            at = r.randrange(len(b) + 1)
            b = b[:at] + [x for x in a if r.random() < 0.85] + b[at:]
        met = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        # neighbouring blocks are one there
        want = {(m.a + k, m.b + k) for m in met for k in range(m.size)}
        assert {(i + k, j + k) for i, j, size in quotes.blocks(a, b) for k in range(size)} == want, (n, a, b)
        assert quotes.ratio(" ".join(a), " ".join(b)) == (sum(m.size for m in met) / len(a) if a else 0.0)


def test_long_quotes_take_time_by_their_seeds():
    a = [f"w{i}" for i in range(30_000)]
    b = a[:10_000] + ["x"] * 50_000 + a[12_000:]
    assert sum(k for *_, k in quotes.blocks(a, b)) == 28_000


def test_spans_are_the_sources_own_words():
    said = "One, two three four five six seven eight nine TEN eleven"
    assert quotes.verbatim("two three four five six seven eight nine ten eleven", said) == said[5:]
    assert quotes.verbatim("two three", said) is None and quotes.verbatim("a b c d e f g h i j k", said) is None and quotes.verbatim(None, None) is None
    assert quotes.verbatim("one two three four five six seven eight nine ten", "so (One, two, three four five six seven eight nine TEN!) and") == "(One, two, three four five six seven eight nine TEN!)"
    assert quotes.snap("the THREE four", said) == ("three four", 2 / 3, said.index("three"))
    assert quotes.snap("", said) == quotes.snap("a", "") == quotes.snap("zzz", said) == ("", 0.0, 0)
    # too far apart to be one quote
    assert quotes.snap("one eleven", "one " + "x " * 20 + "eleven") == ("", 0.0, 0)


def test_evidence(spark):
    source = "Well, they said: the quick brown fox jumps over the lazy dog. The quick brown fox jumps over the lazy dog, twice."
    evidence = spark.createDataFrame([("r", 2, 1, "the quick brown fox"), ("r", 1, 1, "The quick brown fox!"), ("r", 3, 2, "the quick brown fox"), ("r", 4, 9, "x"), ("r", 5, 1, " "), ("r", 6, 1, None), ("s", 7, 1, "they said twice")], "rule string, place int, number long, quote string")
    excerpts = spark.createDataFrame([(1, "c1", source, 10.0, 110.0), (2, "c2", "other words", 0.0, 1.0)], "number long, chunk string, text string, start double, end double")
    (row,) = quotes.reconciled(evidence, excerpts).collect()
    assert (row.rule, row.chunk, row.span, row.ratio) == ("r", "c1", "the quick brown fox", 1.0)
    assert row.at == round(10 + 100 * source.index("the quick") / len(source), 2)


def test_sources_are_found_among_all(spark):
    r = random.Random(8)
    text = lambda n: " ".join(r.choice(["the", "a", "of", *(f"w{i}" for i in range(50))]) for _ in range(n))
    docs = [(i, text(r.choice([1, 30, 200]))) for i in range(150)] + [(900, None), (901, "")]
    asked = [(i, " ".join(x for x in docs[i][1].split()[3:20] if r.random() < 0.95)) for i in range(60)] + [(100, None), (101, "two words"), (102, "nowhere at all in any of these")]
    docs += [(902, "Two words!"), (903, "more than two words")]
    left, right = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc long, text string")
    runs = lambda t: {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if (w := quotes.words(t)) else set()
    share = {(q, d): len(runs(t) & runs(s)) / len(runs(t)) for q, t in asked if runs(t) for d, s in docs}
    found = {(x.query_id, x.doc): x.shared for x in quotes.located(left, right).collect()}
    assert found == {k: round(v, 6) for k, v in share.items() if v >= 0.5} and (101, 902) in found and (101, 903) not in found
    best = {x.query_id: (x.doc, x.ratio) for x in quotes.best_sources(left, right).collect()}
    want = {}
    for (q, d), v in sorted(share.items()):
        span, held, _ = quotes.snap(dict(asked)[q], dict(docs)[d])
        if v >= 0.5 and span and held >= 0.8 and (q not in want or round(held, 4) > want[q][1]):
            want[q] = (d, round(held, 4))
    assert best == want and len(best) > 20
    # no join of all pairs
    assert "NestedLoop" not in quotes.located(left, right)._jdf.queryExecution().executedPlan().toString()
    assert left.select(quotes.ratios(F.col("text"), F.lit("two words")).alias("r")).where("r = 1").count() == 1
