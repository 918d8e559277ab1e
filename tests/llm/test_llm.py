"""Small tables against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import base64
import hashlib
import itertools
import pathlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, chat, components, decontaminate, html, imatch, quality, queries, runtime, secrets, sharding, simhash, urls

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string, spans string, __row string"


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", "z", "w") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DDL)


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


ODD = [None, "", " ", "a", prose(1), prose(1), prose(2, 5000), "naïve ﬁ 漢字 🙂 'll don't\n\n  x", prose(3) + ".", "\x1c\x85\u00a0z"]


# --- SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_query_matches_brute_force(spark):
    r = random.Random(5)
    texts = list(ODD)
    for i in range(40):
        words = prose(100 + i % 8, 300).split()
        words[r.randrange(300)] = "changed"
        texts.append(" ".join(words))
    found = {x.id: x for x in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(x.fp.hex(), 16) for i, x in found.items()} == prints
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {i: x.component_id for i, x in found.items()} == plain_components(pairs, prints)


@pytest.mark.parametrize("block", [4, 4096])
def test_links_connect_what_is_near_in_dense_groups(spark, block):
    r = random.Random(9)
    values = {r.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        for _ in range(6):
            x = v
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            values.add(x)
    df = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fp binary")
    edges = [(int(e.a.hex(), 16), int(e.b.hex(), 16)) for e in simhash.links(df, block=block).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    near = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 4]
    assert plain_components(edges, values) == plain_components(near, values)


def test_golay_anchors_cover():
    v = np.array([random.Random(1).getrandbits(23) for _ in range(500)])
    of, anchor, home = simhash.anchors(v, 4)
    assert home.sum() == 500 and len(set(zip(of.tolist(), anchor.tolist(), strict=True))) == len(of)


def test_near_copies_go_and_others_stay(spark):
    base = [prose(i, 200) for i in range(30)]
    copies = []
    for i in range(15):
        w = base[i].split()
        w[100] = "other"
        copies.append(" ".join(w))
    kept = {r.doc_id for r in simhash.keep_first(docs(spark, [*base, *copies, base[3], None, ""])).collect()}
    assert kept == {*range(30), 46}


def test_rows_that_share_an_id_stay_unless_they_are_copies(spark):
    a, b = prose(1, 90), prose(2, 90)
    rows = docs(spark, [a, a, b, "x " + b, None, None, a], [7, 7, 7, 3, None, None, None])
    kept = sorted((str(r.doc_id), r.text or "") for r in simhash.keep_first(rows.withColumn("key", F.lit(1)).withColumn("text_hash", F.lit(2))).collect())
    assert kept == sorted([("7", a), ("3", "x " + b), ("None", ""), ("None", ""), ("None", a)])
    assert simhash.keep_first(docs(spark, [])).count() == 0


def passages(r, n, similarity):
    """Pairs of texts of 300 words at just over a similarity: a passage appended, one replaced, single words changed."""
    for i in range(n):
        w = prose(r.randrange(10**9), 300).split()
        new = prose(r.randrange(10**9), 300).split()
        k = int(300 * (1 - similarity) / (1 + similarity))
        at = r.randrange(300 - k)
        yield w, w + new[: int(296 * (1 / similarity - 1))]
        yield w, [*w[:at], *new[: k - 5], *w[at + k - 5 :]]
        changed = list(w)
        for spot in range(2, 300, 300 // max(1, (k // 5))):
            changed[spot] = "changed"
        yield w, changed


def test_near_copies_write_files_by_rows_and_not_by_partitions(spark, monkeypatch):
    many = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in many}
    runtime.ensure_checkpoint_dir(spark)
    folder = pathlib.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    # a chain of copies, each an edit of the one before, and texts that are no copies
    chain = [prose(7, 300).split()]
    for i in range(12):
        chain.append([*chain[-1][: 20 * i], f"edit{i}", *chain[-1][20 * i + 1 :]])
    rows = docs(spark, [*map(" ".join, chain), *(prose(100 + i, 100) for i in range(20)), prose(100, 100)]).coalesce(2)
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        for size, most in ((runtime.FILE_ROWS, 20), (8, 60)):
            monkeypatch.setattr(runtime, "FILE_ROWS", size)
            old = set(folder.rglob("part-*"))
            assert sorted(r.doc_id for r in simhash.keep_first(rows).collect()) == [0, *range(13, 33)]
            assert 0 < len(set(folder.rglob("part-*")) - old) <= most
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_near_copies_at_the_limit_are_found_wherever_the_edits_are():
    r = random.Random(3)
    for similarity, least in ((0.8, 0.9), (0.85, 0.98), (0.9, 1.0)):
        found = total = 0
        for a, b in passages(r, 100, similarity):
            x, y = (simhash.sketch(" ".join(t)) for t in (a, b))
            own, other = simhash.shingles(" ".join(a)), simhash.shingles(" ".join(b))
            if len(own & other) >= similarity * len(own | other):
                total += 1
                near = (int.from_bytes(x[0][:128]) ^ int.from_bytes(y[0][:128])).bit_count() <= simhash.NEAR_COPIES.key_limit
                found += near and any(p == q for p, q in zip(x[1], y[1], strict=True))
        assert total > 200 and found >= least * total, (similarity, found, total)
    apart = [(simhash.sketch(" ".join(a))[0], simhash.sketch(" ".join(b))[0]) for a, b in passages(r, 100, 0.6)]
    assert sum((int.from_bytes(a[:128]) ^ int.from_bytes(b[:128])).bit_count() <= simhash.NEAR_COPIES.key_limit for a, b in apart) == 0


@pytest.mark.parametrize("block", [4, 4096])
def test_near_copies_are_those_of_all_pairs(spark, block):
    r = random.Random(3)
    texts = [" ".join(t) for pair in passages(r, 25, 0.85) for t in pair]
    group = prose(3000, 200).split()
    texts += [" ".join([*group[: 4 * i], prose(3100 + i, 12), *group[4 * i :]]) for i in range(40)]
    made = [simhash.sketch(t) for t in texts]
    near = lambda a, b: (int.from_bytes(made[a][0][:128]) ^ int.from_bytes(made[b][0][:128])).bit_count() <= simhash.NEAR_COPIES.key_limit
    met = lambda a, b: any(p == q for p, q in zip(made[a][1], made[b][1], strict=True))
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if near(a, b) and met(a, b)]
    want = plain_components(pairs, range(len(texts)))
    assert len(pairs) > 300 and len({*want.values()}) > 20
    if block == 4096:
        assert {x.id: x.component_id for x in simhash.near_copies(docs(spark, texts)).collect()} == want
    unique = {x[0]: x for x in made}
    reps = spark.createDataFrame([(bytearray(x[0][-16:]), bytearray(x[0]), x[1]) for x in unique.values()], "fp binary, sketch binary, bands array<long>")
    edges = [(bytes(e.a), bytes(e.b)) for e in simhash.copy_links(reps, block=block).collect()]
    prints = [x[0][-16:] for x in made]
    assert {(min(x), max(x)) for x in edges} <= {(min(prints[a], prints[b]), max(prints[a], prints[b])) for a, b in pairs}
    assert len({*plain_components(edges, prints).values()}) == len({*want.values()})


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**{i: 100 for i in range(100, 141)}, 7: 7, **{i: 7 for i in range(200, 260)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- BPE


def test_bpe_is_the_library(spark):
    data = queries.vocabulary()
    codec = bpe.Codec(data)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(2)
    letters = list("'strevmld abcÉ12٣  \n\t\x85\x1c!.,漢🙂") + ["'s", "'ll", " '", "<|endoftext|>"]
    texts = [*ODD, "=!" * 4000, "a" * 9000, *("".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(1500))]
    for text, (ids, offsets) in zip(texts, codec.encode(texts), strict=True):
        want = library.encode_ordinary(text or "")
        assert ids == b",".join(b"%d" % i for i in want) and codec.decode(ids) == (text or "").encode()
        assert len(offsets) == 0 if not text else offsets[0] == 0
    rows = {x.id: x for x in bpe.decode(bpe.encode(docs(spark, ODD), data), data).collect()}
    assert all(rows[i].decoded == (t or "") and rows[i].n_tokens == len(rows[i].ids) for i, t in enumerate(ODD))
    assert base64.b64decode(data.split()[0]) in codec.ranks


# --- I-Match


def test_edit_report(spark):
    texts = [*ODD, *(prose(i, 80) for i in range(50, 80))]
    rows = {r.doc_id: r for r in imatch.edit_report(docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (text == edited) <= (rows[i].fingerprint == rows[i].edited_fingerprint)
    assert rows[0].fingerprint == rows[1].fingerprint and rows[4].fingerprint == rows[5].fingerprint != rows[6].fingerprint
    assert rows[4].near_next == 1.0 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows.values())
    long = [r for i, r in rows.items() if i >= len(ODD)]
    assert sum(r.near_edited for r in long) > 10 * sum(r.near_next for r in long[:-1])


def test_fingerprints_are_those_of_a_plain_walk(spark):
    hot = prose(900, 60)
    texts = [*ODD, *[hot] * 40, *(prose(i, 80) + " " + hot[: 5 * (i % 7)] for i in range(50, 110))]
    split = lambda t: {w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w}
    distinct = {t or "" for t in texts}
    df = {}
    for t in distinct:
        for w in split(t):
            df[w] = df.get(w, 0) + 1
    band = {w for w, n in df.items() if n >= imatch.RAREST * len(distinct) and n <= max(1.0, imatch.COMMONEST * len(distinct))}
    assert split(hot) & band
    hit = lambda w, k: xxhash.xxh64_intdigest(w.encode(), xxhash.xxh64_intdigest((101 + k).to_bytes(4, "little"), 42)) % 2 ** (k // imatch.PER_LEVEL + 1) == 0
    drawn = lambda w: sum(hit(w, k) << k for k in range(imatch.PARTS))
    wanted = {}
    for i, t in enumerate(texts):
        for k in range(imatch.PARTS):
            state = 42
            for w in sorted(split(t) & band, key=lambda w: w.encode()):
                if drawn(w) >> k & 1:
                    state = xxhash.xxh64_intdigest(drawn(w).to_bytes(4, "little"), xxhash.xxh64_intdigest(w.encode(), state))
            wanted[i, k] = 0 if state == 42 else state
    rows = {r.doc_id: r for r in imatch.edit_report(docs(spark, texts)).collect()}
    for i in range(len(texts)):
        parts = [f"{wanted[i, k] >> 32:08x}" for k in range(imatch.PARTS)]
        if any(p != "0" * 8 for p in parts):
            assert rows[i].fingerprint == "".join(parts)
        other = rows[(i + 1) % len(texts)].fingerprint
        mine = rows[i].fingerprint
        pairs = [(mine[8 * k : 8 * k + 8], other[8 * k : 8 * k + 8]) for k in reversed(range(imatch.PARTS))]
        pairs = [p for p in pairs if p != ("0" * 8, "0" * 8)][: imatch.COMPARED]
        assert rows[i].near_next == pytest.approx(sum(x == y for x, y in pairs) / max(1, len(pairs)))
    # a group of copies that is a third of the rows keeps its terms
    assert len({rows[i].fingerprint for i in range(len(ODD), len(ODD) + 40)}) == 1 and rows[len(ODD)].near_edited > 0


def test_edit_report_of_one_and_no_document(spark):
    assert imatch.edit_report(docs(spark, ["one text"])).first().near_next == 1.0
    assert imatch.edit_report(docs(spark, [])).count() == 0
    twice = imatch.edit_report(docs(spark, ["a b", "a b", "c d"], [1, 1, None])).collect()
    assert len(twice) == 3 and sorted(map(twice.count, twice)) == [1, 2, 2]


# --- Secrets


def plain_strong(text):
    text = text or ""
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secrets(spark):
    r = random.Random(4)
    parts = ["token", "=", ":", " ", "passwd", "API_KEY", "secret", '"', "abcdefgh", "short", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef" * 2, "\n\n", "é", "Kelvin\u212aey=abcdefghi"]
    texts = [*ODD, *("".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(400))]
    for x in secrets.find(docs(spark, texts), redacted=True).collect():
        strong = sorted((s.kind, s.start, s.end) for s in x.spans if not s.kind.startswith("linked"))
        assert strong == plain_strong(texts[x.id])
        assert x.spans == sorted(x.spans, key=lambda s: (s.start, secrets.ORDER[s.kind]))


def test_weak_parts_need_each_other():
    key, name = "wJalrXUtnFEMI7K7MDENGbPxRfiCYEXAMPLEKEY1", "AKIA" + "Q" * 16
    assert secrets.scan(key) == [] and secrets.scan("see https://db.example/x") == []
    kinds = [s[0] for s in secrets.scan(f"{name} {key} at https://db.example/x")]
    assert kinds == ["access", "linked_secret", "linked_endpoint"]
    assert [s[0] for s in secrets.scan(f"{name}\n\n{key}")] == ["access"]
    assert [s[0] for s in secrets.scan(f"{name}{' ' * 300}{key}")] == ["access"]
    text = f"a {name} b"
    assert secrets.redact(text, secrets.scan(text)) == f"a {secrets.PLACEHOLDER} b" and secrets.redact(None, []) is None


def test_env_files_and_url_safe_keys():
    access, key = "AKIA" + "Q" * 16, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    shown = lambda text: secrets.redact(text, secrets.scan(text)).replace(secrets.PLACEHOLDER, "#")
    assert shown(f"AWS_ACCESS_KEY_ID={access}\nAWS_SECRET_ACCESS_KEY={key}\n") == "AWS_#\n#\n"
    assert shown(f"AWS_ACCESS_KEY_ID = {access}\nAWS_SECRET_ACCESS_KEY = {key}\n") == "AWS_#\n#\n"
    assert shown(f"{access}\nKEY={key}\n") == "#\nKEY=#\n"
    for value in ("a-B3_" * 8, "_Ab3" * 8, "Ab3d" * 5, "aB3/+" * 7 + "=="):
        assert shown(f"client_id: 0815bbbb x={value} y") == "# x=# y" and shown(f"client_id: 0815bbbb {value}.") == "# #."
        assert shown(f"x={value} y") == f"x={value} y"
    assert shown("client_id=0815bbbb client_secret_key=short-1234") == "# #"
    assert shown("client_id: 0815bbbb token_type: Bearertype") == "client_id: 0815bbbb token_type: Bearertype"
    assert len(secrets.scan("user_id: abcd " + "secret" * 100_000)) == 0


def test_every_part_in_reach_is_linked():
    key = "wJalrXUtnFEMI7K7MDENGbPxRfiCYEXAMPLEKEY1"
    text = f"account_id: 4711aaaa client_id: 0815bbbb {key} and user_id: later12"
    assert secrets.redact(text, secrets.scan(text)) == "{0} {0} {0} and {0}".format(secrets.PLACEHOLDER)
    # the nearest identifier holds the hexadecimal run itself
    spans = secrets.scan("client_id: 0815bbbb user_id: " + "0123456789abcdef" * 2)
    assert [s[0] for s in spans] == ["linked_id", "hex"]
    # reach and scope, against all pairs
    r = random.Random(6)
    pieces = [f" {key} ", " user_id: abcd1234 ", " client_id=zzzz ", "\n\n", "\n", " " * 70, "x" * 90, " https://a.example/b ", " AKIA" + "Q" * 16 + " "]
    for _ in range(300):
        text = "".join(r.choice(pieces) for _ in range(r.randint(2, 12)))
        meet = lambda x, y: x[2] <= y[1] <= x[2] + secrets.REACH and "\n\n" not in text[x[2] : y[1]]
        spans = lambda kind, p: [(kind, m.start(), m.end()) for m in p.finditer(text)]
        ids = [*spans("access", secrets.ACCESS), *spans("linked_id", secrets.IDENTIFIER)]
        keys = spans("linked_secret", re.compile(key))
        whole = {z for x in keys for y in ids if meet(x, y) or meet(y, x) for z in (x, y)}
        ends = {x for x in spans("linked_endpoint", re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+""")) if any(meet(x, y) or meet(y, x) for y in whole)}
        assert {s for s in secrets.scan(text) if s[0] != "access"} == {s for s in whole | ends if s[0] != "access"}


def test_endpoints_and_overlaps_are_those_of_a_plain_walk():
    r = random.Random(7)
    plain = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+""")
    for _ in range(500):
        text = "".join(r.choice(["ab", "1", "+", "://", ":", "/", " ", "'", "é", "x.y"]) for _ in range(r.randint(1, 14)))
        assert secrets.endpoints(text) == [("linked_endpoint", m.start(), m.end()) for m in plain.finditer(text)]


def test_long_tokens_and_many_parts_take_no_more_than_their_share():
    key = "wJalrXUtnFEMI7K7MDENGbPxRfiCYEXAMPLEKEY1"
    for text in (f"client_id: 0815bbbb {key} x://y " + "Ab1+" * 250_000, f"client_id: 0815bbbb {key} 0123456789abcdef0123456789abcdef " * 5000, "user_id" + " " * 500_000 + "user_id" * 50_000):
        began = time.time()
        secrets.scan(text)
        assert time.time() - began < 20


def test_secrets_of_repeated_rows_and_no_rows(spark):
    twice = secrets.find(docs(spark, ["token=abcdefgh1"] * 2 + [None], [1, 1, None])).collect()
    assert [len(x.spans) for x in twice] == [1, 1, 0] and secrets.find(docs(spark, [])).count() == 0


# --- Chat


def test_chat_round_trip(spark):
    said = [r"\### Assistant: </turn> ok", "", None, "\\", "\\\\h\\e", "###", "####", "</turn></turn>\n", "a\nb", "### User: x</turn>\n", "\\\\###\\"]
    rows = [(c, t, role, said[(c + t) % len(said)]) for c in range(len(said)) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(99, 0, "assistant", "x"), (98, 0, None, "y"), (None, None, "user", "z"), (97, 0, "### odd: </turn>", "w"), (96, 0, "user", "q"), (96, 1, "assistant", "q"), (96, 1, "assistant", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("t", F.lit(2))
    read = {x.conv_id: x for x in chat.read_back(chat.format_conversations(turns)).collect()}
    got = {x.conv_id: x for x in chat.digest(chat.read_back(chat.format_conversations(turns))).collect()}
    for conv in {r[0] for r in rows}:
        own = [(role or "", text or "") for c, _, role, text in rows if c == conv]
        assert [(t.role, t.text) for t in read[conv].turns] == own
        lost = "".join(text for role, text in own if role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
    assert got[0].valid and not got[99].valid and not got[98].valid and not got[96].valid
    assert chat.format_conversations(turns.limit(0)).count() == 0


# --- Sharding


def test_shards_balance_with_a_hot_group(spark):
    texts = ["hot text"] * 3000 + [prose(i, 20 + i % 50) for i in range(6000)] + [None, ""]
    rows = sharding.assign(docs(spark, texts), 16).collect()
    sizes, counts = np.zeros(16), np.zeros(16)
    slots = {}
    for r in rows:
        assert r["size"] == len((texts[r.id] or "").encode()) + 1
        sizes[r.shard] += r["size"]
        counts[r.shard] += 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sizes.max() <= 1.02 * sizes.mean() and sizes.min() >= 0.98 * sizes.mean()
    again = {r.id: (r.shard, r.slot) for r in sharding.assign(docs(spark, texts).repartition(5), 16).collect()}
    assert again == {r.id: (r.shard, r.slot) for r in rows}
    assert sharding.assign(docs(spark, []), 16).count() == 0


def test_packing_is_the_greedy_walk():
    r = random.Random(12)
    for shards in (1, 3, 16):
        units = [[r.randint(1, 50), r.randint(1, 9), 1] for _ in range(60)] + [[400, 1, 1], [5, 90, 1]]
        total = [sum(u[d] for u in units) for d in range(3)]
        left = [[1.0] * 3 for _ in range(shards)]
        share = [[u[d] / total[d] * shards for d in range(3)] for u in units]
        want = [0] * len(units)
        for i in sorted(range(len(units)), key=lambda i: (-sum(share[i]), i)):
            fits = [s for s in range(shards) if all(left[s][d] >= share[i][d] - 1e-12 for d in range(3))]
            at = max(fits, key=lambda s: (round(sum(left[s][d] * share[i][d] for d in range(3)), 12), -s)) if fits else max(range(shards), key=lambda s: (left[s][0], -s))
            want[i] = at
            left[at] = [left[at][d] - share[i][d] for d in range(3)]
        assert sharding.pack(np.array(units, dtype=float), shards).tolist() == want


def test_groups_of_equal_texts_stay_whole(spark):
    r = random.Random(13)
    texts = ["hot text"] * 2000 + [None] * 30 + [""] * 30
    for i in range(1500):
        texts += [prose(i, r.randint(20, 60))] * r.choice([1, 1, 1, 2, 3, 6, 20])
    ids = [None if i % 500 == 7 else i for i in range(len(texts))]
    rows = sharding.assign(docs(spark, texts, ids).withColumn("piece", F.lit(1)).withColumn("group", F.lit(2)), 16).collect()
    shards = {}
    for x in rows:
        shards.setdefault(texts[x.id] or "" if x.id is not None else "hot text", set()).add(x.shard)
    assert [t for t, s in shards.items() if len(s) > 1] == ["hot text"]
    sizes = np.bincount([x.shard for x in rows], [x["size"] for x in rows], minlength=16)
    assert sizes.max() <= 1.02 * sizes.mean() and sizes.min() >= 0.98 * sizes.mean()


# --- Decontamination


def test_matches_find_reordered_copies_and_leave_others(spark):
    item = prose(77, 40)
    words = item.split()
    turned = " ".join(words[20:] + ["between"] + words[:20])
    part = " ".join(words[:20])
    texts = [*ODD, prose(5) + " " + item.upper() + " " + prose(6), turned, part, "x " + item + " " + item, "Too, SHORT!", "it is too short", item, item]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, prose(78, 50))], "item_id long, text string")
    found = {(r.id, r.item_id): r for r in decontaminate.matches(docs(spark, texts), bench).collect()}
    n = len(ODD)
    assert set(found) == {(n, 1), (n + 1, 1), (n + 3, 1), (n + 4, 3), (n + 6, 1), (n + 7, 1)} and found[n + 1, 1].tiles == 2 and found[n, 1].coverage == 1.0
    assert {r.doc_id for r in decontaminate.without_matches(docs(spark, texts), bench).collect()} == {*range(len(texts))} - {n, n + 1, n + 3, n + 4, n + 6, n + 7}
    assert decontaminate.without_matches(docs(spark, texts[:3]).withColumn("__bad", F.lit(1)), bench).columns[-1] == "__bad"
    assert decontaminate.matches(docs(spark, texts), bench.limit(0)).count() == 0


def test_tiles_match_repeated_longest_search():
    r = random.Random(8)
    for _ in range(60):
        item = [r.randint(1, 6) for _ in range(30)]
        text = [r.randint(1, 6) for _ in range(40)] + item[10:25] + item[:8]
        index = decontaminate.Index([(1, " ".join(f"w{x}" for x in item))])
        got = [t for found in index.search([" ".join(f"w{x}" for x in text)], coverage=0.0) for t in found[3]]
        crowded = decontaminate.Index([(1, " ".join(f"w{x}" for x in item))], pairs=0)
        by_length = [t for found in crowded.search([" ".join(f"w{x}" for x in text)], coverage=0.0) for t in found[3]]
        few = decontaminate.Index([(1, " ".join(f"w{x}" for x in item)), (2, "w1 w2 w3 w4 w5 w6")], pairs=20)
        alone = [t for found in few.search([" ".join(f"w{x}" for x in text)], coverage=0.0) if found[1] == 1 for t in found[3]]
        marked_i, marked_t, want = set(), set(), []
        while True:
            best = None
            for i in range(30):
                for j in range(len(text)):
                    k = 0
                    while i + k < 30 and j + k < len(text) and item[i + k] == text[j + k] and i + k not in marked_i and j + k not in marked_t:
                        k += 1
                    if k >= 5 and (best is None or k > best[0]):
                        best = (k, i, j)
            if not best:
                break
            want.append(best)
            marked_i.update(range(best[1], best[1] + best[0]))
            marked_t.update(range(best[2], best[2] + best[0]))
        assert got == want == by_length == alone


def test_repeated_words_are_tiled_without_listing_pairs():
    for words, item in ((["a"] * 200_000, ["a"] * 2000), ((["a", "b", "c"] * 70_000)[:200_000], ["b", "c", "a"] * 600)):
        began = time.time()
        (found,) = decontaminate.Index([(1, " ".join(item))]).search([" ".join(words)])
        assert found[3][0][0] == len(item) and time.time() - began < 20


# --- URLs


def test_urls(spark):
    pages = ["https://WWW.Example.com/en/7x?q#f", "http://a.example.net/de/81", "x.example.net/de/", None, "http://b.net/de/1", "ftp://org/es/2", "http://notcom/en/", "https://x.example.com#/en/", "http://casinowin.example.org/", "http://a://b/c"]
    df = spark.createDataFrame([(i if i else None, u, "h", "n") for i, u in enumerate(pages * 3)], "page_id long, url string, host string, words string")
    words = spark.createDataFrame([(w, 1000) for w in ("casino", "win", "the", "word")], "word string, n long")
    rows = {r.id or 0: r for r in urls.judge(df, queries.RULES, words).collect()}
    assert len(rows) == 30
    assert [(rows[i].host, rows[i].path) for i in range(5)] == [("www.example.com", "/en/7x"), ("a.example.net", "/de/81"), ("", ""), ("", ""), ("b.net", "/de/1")]
    assert [rows[i].rule for i in range(8)] == ["example.com/en/7", "example.net/de/8", None, None, "net/de/", "org/es/", None, None]
    assert [rows[i].verdict for i in range(9)] == ["allow", "block", "allow", "allow", "allow", "block", "allow", "allow", "block"]
    assert rows[8].words == ["casino", "win", "example"] and rows[0].words == ["www", "example", "en", "#", "x"] and rows[3].words == []
    assert urls.judge(df.limit(0), queries.RULES, words).count() == 0 and urls.judge(df, [], words.limit(0), unwanted=()).count() == 30
    # naive Bayes by hand
    bad = [i for i in range(30) if {"casino", "win"} <= {*rows[i].words}]
    count = lambda w, ids: sum(rows[i].words.count(w) for i in ids)
    good = [i for i in range(30) if i not in bad]
    tokens = {w for r in rows.values() for w in r.words}
    size = lambda ids: sum(len(rows[i].words) for i in ids) + len(tokens)
    for r in rows.values():
        want = np.log(len(bad) / len(good)) + sum(np.log((count(w, bad) + 1) / size(bad)) - np.log((count(w, good) + 1) / size(good)) for w in r.words)
        assert r.score == pytest.approx(want, abs=1e-6)


def test_splits_are_the_cheapest_and_no_word_is_left_out(spark):
    r = random.Random(1)
    counts = {"".join(r.choice("ab") for _ in range(r.randint(1, 4))): r.randint(1, 50) for _ in range(12)} | {"c" * 30 + "d": 3, "e" * 24: 1, "e" * 25: 2, "漢字": 5}
    names = ["".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(100)] + ["c" * 30 + "da", "e" * 24 + "a", "e" * 25, "q" * 40, "漢字ab", "z"]
    total = sum(counts.values())
    unknown = np.log(total + 1) + urls.UNKNOWN_START
    price = lambda w: np.log((total + 1) / counts[w]) if w in counts else unknown + urls.UNKNOWN_LETTER * len(w)
    df = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    split = {x.name: x.words for x in urls.segmented(df, spark.createDataFrame(list(counts.items()), "word string, n long"), total).collect()}
    for name in names:
        assert "".join(split[name]) == name
        if len(name) <= 9:
            cuts = [[*c] for k in range(len(name)) for c in itertools.combinations(range(1, len(name)), k)]
            best = min(sum(price(name[a:b]) for a, b in zip([0, *c], [*c, len(name)], strict=True)) for c in cuts)
            assert sum(map(price, split[name])) == pytest.approx(best)
    assert split["c" * 30 + "da"][0] == "c" * 30 + "d" and split["e" * 25] == ["e" * 25] and split["e" * 24 + "a"][0] == "e" * 24 and split["q" * 40] == ["q" * 40]


# --- HTML


def test_html(spark):
    page = """<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><div class="ad">Buy, now. Please!</div><article><header><h1>A &amp; B</h1></header>
    <p>One<b> two</b>,\n three.<p>Four&nbsp;<script>if (a < b) "</p>"</script>five<div class="comments"><p>Nice, post!</p></div></article><footer>(c)</footer></body></html>"""
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "just text"), (5, "x", "<article>" * 2000 + "deep"), (6, "y", "<p>cut <b")], "page_id long, url string, html string")
    rows = {r.id: r.text for r in html.extract(pages).collect()}
    odd = html.extract(pages.unionByName(pages).withColumn("id", F.lit(1)).withColumn("text", F.lit("x")).withColumn("page_id", F.nullif("page_id", F.lit(1))))
    assert sorted(((r.id or 0), r.text) for r in odd.collect()) == sorted((0 if i == 1 else i, t) for i, t in rows.items() for _ in range(2))
    assert html.extract(pages.limit(0)).count() == 0
    assert rows == {1: "A & B\nOne two, three.\nFour five", 2: "", 3: "", 4: "just text", 5: "deep", 6: "cut"}


def page_like(r, marked=True):
    """A page and its article's text; without names if not ``marked``."""
    menu = "".join(f"<li><a href=/{i}>{prose(r.randrange(10**6), 1)}</a></li>" for i in range(8))
    body = [prose(r.randrange(10**6), r.randint(25, 90)).replace(" ", ", ", 3) + "." for _ in range(r.randint(3, 8))]
    article = "<h1>A title</h1>" + "".join(f"<p>{x}</p>" for x in body)
    comments = "".join(f"<div><p>{prose(r.randrange(10**6), 2)}</p></div>" for _ in range(3))
    if marked:
        page = f"<body><nav><ul>{menu}</ul></nav><div class=ad>Buy now.</div><article>{article}</article><footer>(c) x</footer>"
    else:
        page = f"<body><div><ul>{menu}</ul></div><div>Buy now.</div><div>{article}<div>{comments}</div></div><div>(c) x</div>"
    return page, "\n".join(["A title", *body])


@pytest.mark.parametrize("marked", [True, False])
def test_paths_decide_with_and_without_names(marked):
    r = random.Random(21)
    for _ in range(40):
        page, want = page_like(r, marked)
        assert html.main_text(page) == want


def test_names_vote_and_lines_lose_only_what_is_excluded():
    body = [prose(i, 60) + "." for i in range(4)]
    p = ["<p>" + x + "</p>" for x in body]
    whole = "\n".join(body)
    text = lambda inner: html.main_text(f"<body><nav><a href=/>Menu</a></nav><article>{inner}</article><footer>x</footer>")
    # excluded text in a line, at its start, inside and at its end, never shows
    for tag, name in (("span", "ad"), ("small", "promo"), ("b", "ad-slot")):
        ad = f'<{tag} class="{name}">Buy now</{tag}>'
        for line in (f"{ad} Real text.", f"Real {ad} text.", f"Real text. {ad}"):
            assert text(f"<p>{line}</p>" + "".join(p)) == "Real text.\n" + whole
    assert text("".join(p) + '<p><span class="ad">Buy now</span></p>') == whole
    # names that say more than that something is an advert or a header
    assert text('<div class="article-header"><h1>T</h1></div>' + "".join(p)) == "T\n" + whole
    assert text("".join(p[:2]) + '<section id="legal-analysis">' + "".join(p[2:]) + "</section>") == whole
    assert text("".join(p[:2]) + '<div class="notice-period">' + p[2] + "</div>" + p[3]) == whole
    assert text('<h2 class="header">T</h2>' + "".join(p)) == "T\n" + whole
    # names that say just that
    for name in ("ad", "ad-slot", "comments-area", "sidebar left", "cookie-banner", "social-share", "newsletter-box"):
        assert text("".join(p) + f'<div class="{name}"><p>{body[0]}</p></div>') == whole
    # doubted and without the ratio of content
    assert text("".join(p) + '<div class="promo-summer"><p>Buy now</p></div>') == whole


def test_text_of_random_pages_is_that_of_a_plain_reader():
    """Articles of known elements, some excluded, against what was put in."""
    r = random.Random(31)
    for _ in range(60):
        parts, want = [], []
        for _ in range(r.randint(3, 9)):
            said = prose(r.randrange(10**6), r.randint(30, 60)) + "."
            kind = r.randrange(6)
            if kind == 0:
                parts.append(f'<div class="ad"><p>{said}</p></div>')
            elif kind == 1:
                parts.append(f"<aside><p>{said}</p></aside><script>{said}</script>")
            else:
                inner = said.replace(" ", r.choice([" ", " <b>", " <span class=ad>no</span> ", "\n\t", "&#32;"]), 1)
                parts.append(f"<p>{inner}</b></p>" if "<b>" in inner else f"<{(t := r.choice(['p', 'li', 'blockquote']))}>{inner}</{t}>")
                want.append(said)
        page = f"<html><head><title>x</title></head><body><header>Site</header><article>{''.join(parts)}</article><div class=comments><p>{prose(5, 40)}</p></div></body>"
        assert html.main_text(page) == "\n".join(want), page


def test_main_parts_of_other_shapes():
    body = [prose(i, 60) + "." for i in range(6)]
    p = ["<p>" + x + "</p>" for x in body]
    cards = "<div class=cards><article>teaser</article></div>"
    assert html.main_text("<main>" + "".join(p) + cards + "</main>") == "\n".join(body)
    assert html.main_text("<body><article>" + "".join(p[:3]) + "</article><article>" + "".join(p[3:]) + "</article><div>x</div>") == "\n".join(body)
    assert html.main_text("<div><h1>T</h1><div>" + "".join(p) + "<ul><li>one<li>two</ul></div></div><div>x</div>") == "\n".join(["T", *body, "one", "two"])


def test_ratios_are_those_of_all_pairs():
    r = random.Random(22)
    for _ in range(20):
        found, _ = html.blocks(page_like(r, r.random() < 0.5)[0])
        text = lambda b: len(b.text) - min(b.linked, len(b.text))
        marks = lambda b: sum(c in html.PUNCTUATION for c in b.text)
        mean = lambda f, b: sum(f(c) for c in found if c.path == b.path) / sum(c.path == b.path for c in found)
        want = []
        for i, b in enumerate(found):
            near = [(np.exp(-0.5 * (i - j) ** 2) * (1 if b.path == c.path else html.OTHER_PATH), c) for j, c in enumerate(found) if abs(i - j) <= 2]
            total = sum(w for w, _ in near)
            want.append((sum(w * mean(text, c) for w, c in near) / total * (1 + sum(w * mean(marks, c) for w, c in near) / total)) ** 0.5)
        assert np.allclose(html.fused_ratios(found), want)


def test_pages_cost_no_more_for_being_deep():
    for page in ("<div>x " * 20_000, "<b><div>" * 20_000 + "</b>" * 20_000, "<p>x</i>" * 20_000, "<ul><li>x" * 20_000, "<p '" * 20_000, "<p><td>" + "<i>" * 20_000 + "<div></div>" * 20_000):
        began = time.time()
        html.main_text(page)
        assert time.time() - began < 20


# --- Quality


def test_quality(spark):
    good = [prose(i, 80) for i in range(80)]
    bad = [" ".join(f"{w}###" for w in prose(i, 80).split()) for i in range(8)] + ["word " * 60] * 5 + [prose(i, 60).upper() for i in range(6)]
    rows = {r.id: r for r in quality.classify(docs(spark, [*good, *bad, *ODD[:4]])).collect()}
    twice = quality.classify(docs(spark, [good[0], good[0], bad[0]], [4, 4, None]).withColumn("score", F.lit(1)).withColumn("keep", F.lit(2)))
    assert sorted((str(r.id), r.text) for r in twice.collect()) == sorted([("4", good[0]), ("4", good[0]), ("None", bad[0])])
    assert all(rows[i].keep for i in range(80)) and not any(rows[i].keep for i in range(80, 99)) and all(rows[i].keep for i in range(99, 103))
    assert quality.classify(docs(spark, [])).count() == 0
    posterior, chance = quality.expectation_maximisation({})
    assert posterior == {}


def planted(kinds, false_alarms, n, seed, labellers=5):
    """Counts of vote patterns: ``kinds`` are (share, chance of each labeller to accuse), all others are good."""
    r = np.random.default_rng(seed)
    share = [s for s, _ in kinds]
    kind = r.choice(len(kinds) + 1, n, p=[*share, 1 - sum(share)])
    chance = np.array([*(c for _, c in kinds), false_alarms])[kind]
    accused = r.random((n, labellers)) < chance
    codes = (np.where(accused, quality.BAD, quality.GOOD) * 3 ** np.arange(labellers)).sum(axis=1)
    return codes, kind


def test_accuracies_are_those_of_planted_labellers():
    good, bad = [0.001, 0.01, 0.05, 0.002, 0.2], [0.9, 0.6, 0.8, 0.4, 0.2]
    codes, _ = planted([(0.1, bad)], good, 200_000, 1)
    posterior, chance = quality.expectation_maximisation(dict(zip(*(x.tolist() for x in np.unique(codes, return_counts=True)), strict=True)), labellers=5)
    assert np.abs(chance[0] - good).max() < 0.02 and np.abs(chance[1] - bad).max() < 0.06
    # the last one accuses both alike: its word alone says nothing, that of the first does
    alone = lambda i: sum((quality.BAD if j == i else quality.GOOD) * 3**j for j in range(5))
    assert posterior[alone(4)] < 0.1 and posterior[alone(0)] > 0.5 > posterior[sum(3**j for j in range(5))] == 0.0


@pytest.mark.parametrize("kinds", [[(0.03, [0.99, 0, 0, 0, 0]), (0.03, [0, 0.99, 0, 0, 0]), (0.03, [0, 0, 0.99, 0, 0])], [(0.06, [0.9, 0.9, 0.1, 0, 0]), (0.001, [0, 0, 0, 0.95, 0.95])]])
def test_kinds_that_do_not_overlap_and_rare_kinds_are_bad_and_clean_ones_good(kinds):
    codes, kind = planted(kinds, [1e-4] * 5, 100_000, 2)
    posterior, _ = quality.expectation_maximisation(dict(zip(*(x.tolist() for x in np.unique(codes, return_counts=True)), strict=True)), labellers=5)
    bad = np.array([posterior[c] for c in codes.tolist()]) >= 0.5
    for k in range(len(kinds)):
        assert bad[kind == k].mean() > 0.9
    assert bad[kind == len(kinds)].mean() < 0.001


# --- All of them


def test_very_long_texts(spark):
    long = prose(7, 250_000)
    assert len(long) > 1_200_000
    rows = docs(spark, [long, "short", long + " x"])
    found = {r.id: r for r in simhash.near_duplicates(rows).collect()}
    assert int(found[0].fp.hex(), 16) == plain_fingerprint(long)
    assert {r.doc_id for r in simhash.keep_first(rows).collect()} == {0, 1}
    assert [len(r.fingerprint) for r in imatch.edit_report(rows).collect()] == [8 * imatch.PARTS] * 3
    assert sum(r["size"] for r in sharding.assign(rows).collect()) == sum(len(t.encode()) + 1 for t in (long, "short", long + " x"))
    assert quality.classify(rows).where("keep").count() == 3
    bench = spark.createDataFrame([(1, " ".join(long.split()[1000:1050]))], "item_id long, text string")
    assert sorted(r.id for r in decontaminate.matches(rows, bench).collect()) == [0, 2]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Codec(queries.vocabulary()).ranks, special_tokens={})
    assert {r.id: r.n_tokens for r in bpe.encode(rows, queries.vocabulary(), arrays=False).collect()}[0] == len(library.encode_ordinary(long))


def test_no_rows_and_repeated_rows(spark):
    none = docs(spark, [])
    assert simhash.near_duplicates(none).count() == 0 and bpe.encode(none, queries.vocabulary()).count() == 0
    item = prose(70, 40)
    twice = docs(spark, [item, item, None], [5, 5, None])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.id for r in decontaminate.matches(twice, bench).collect()] == [5, 5] and decontaminate.without_matches(twice, bench).count() == 1
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.without_matches(none, bench).count() == 0
    assert sorted(r.n_tokens for r in bpe.encode(twice, queries.vocabulary()).collect())[0] == 0
    assert [r.component_id for r in simhash.near_duplicates(twice).where("id = 5").collect()] == [5, 5]


# --- Pipeline


def test_pipeline(spark, tmp_path):
    item = prose(500, 40)
    texts = [prose(i, 90) for i in range(40)] + [prose(0, 90), "x " + prose(1, 90), "SHOUT IT LOUD " * 30, prose(60, 50) + " " + item, prose(61, 50) + " token = abcdefgh12345678", None, ""]
    docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in bpe.decode(corpus_pipeline.run(spark, str(tmp_path)), queries.vocabulary()).collect()}
    assert set(rows) == {*range(40), 44, 45}
    assert rows[44].decoded.endswith(secrets.PLACEHOLDER) and rows[7].decoded == texts[7]


def test_pipeline_stages_take_nulls_repeats_and_empty_tables(spark, tmp_path):
    item = prose(500, 40)
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, prose(1, 90), None, None, None), (1, prose(1, 90), None, None, None), (None, prose(2, 90), "en", None, 1), (None, item, "en", "s", None), (3, None, None, "s", 0)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    spark.createDataFrame([], plain).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/some/benchmark.parquet")
    # a column more than documents has goes, and does not clash with the stages' own names
    spark.createDataFrame(rows, plain).withColumn("id", F.lit("x")).write.parquet(f"{tmp_path}/some/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    kept = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()]
    assert sorted(kept, key=str) == [1, 3, None]
