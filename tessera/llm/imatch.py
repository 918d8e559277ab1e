"""I-Match document fingerprints, with DataFrame functions only.

Terms whose inverse document frequency lies in a band form the lexicon. Of the
distinct terms that a text has in it, sorted, those in each of twenty-four
randomised subsets are hashed one after the other: three subsets each hold from
a half down to a 256th of all terms. Each hash gives a 32-bit part of the
fingerprint.
Sparse subsets survive more edits, dense ones tell short texts apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.runtime import checkpointed

PARTS, PER_LEVEL = 24, 3
#: Terms in more than this share of all texts are dropped (a low inverse document frequency).
COMMONEST = 0.2
#: So are terms in fewer than this share, which bounds the lexicon, whatever the corpus: a text's mean number of terms over this share.
RAREST = 0.0005
#: A lexicon of at most this many terms is broadcast; a larger one is joined by a shuffle.
BROADCAST_TERMS = 400_000
#: What separates terms: all of ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
#: Likeness looks at so many parts, those of the sparsest subsets that have terms in either text.
COMPARED = 6


def terms(text: Column) -> Column:
    """Distinct lower-case terms."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != ""))


def lexicon(texts: DataFrame, text_col: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """``(term, drawn)`` of the terms in the band, with the subsets that each is in as bits. Every text counts; a group of equal ones counts once, so that its copies cannot push its terms out of the band."""
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    groups = checkpointed(texts.select(h.alias("h")).groupBy("h").agg(F.count("*").alias("n")))
    n = groups.count()
    copied = groups.where("n > 1")
    small = copied.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    each = texts.select(h.alias("h"), F.col(text_col).alias("text")).join(F.broadcast(copied) if small else copied, "h", "left")
    terms_of = each.select(F.explode(terms(F.col("text"))).alias("term"), (F.lit(1.0) / F.coalesce("n", F.lit(1))).alias("weight"))
    # rounded, so that the order of summing does not matter
    df = terms_of.groupBy("term").agg(F.round(F.sum("weight"), 6).alias("df"))
    drawn = F.lit(0)
    for k in range(PARTS):
        mask = (1 << (k // PER_LEVEL + 1)) - 1
        drawn = drawn + F.when(F.xxhash64(F.lit(101 + k), "term").bitwiseAND(F.lit(mask)) == 0, 1 << k).otherwise(0)
    return df.where((F.col("df") >= rarest * n) & (F.col("df") <= max(1.0, commonest * n))).select("term", drawn.cast("int").alias("drawn"))


def digest(sorted_terms: Column, k: int) -> Column:
    """Of an array of ``(term, drawn)``, the 64-bit hash of those in the k-th subset one after the other; zero if there are none."""
    h = F.xxhash64(F.filter(sorted_terms, lambda t: t["drawn"].bitwiseAND(F.lit(1 << k)) != 0))
    return F.nullif(h, F.xxhash64(F.array().cast("array<string>")))


def fingerprints(rows: DataFrame, text_cols: list[str], words: DataFrame) -> DataFrame:
    """``rows`` with ``<column>_fp`` in place of each text column: 96 bytes, four for each part.

    A part is zero if a text has no term in its subset. If that holds for all parts, they all hold a hash of the
    whole text, so equal texts always have equal fingerprints, empty ones too. Null texts count as empty. Repeated
    rows are worked on once and come back as often as they were. ``words`` is a lexicon.
    """
    keys = [c for c in rows.columns if c not in text_cols]
    plain = [F.xxhash64(F.coalesce(F.col(c), F.lit(""))).alias(f"__x_{c}") for c in text_cols]
    texts = [F.struct(F.lit(i).alias("side"), F.coalesce(F.col(c), F.lit("")).alias("text")) for i, c in enumerate(text_cols)]
    small = words.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    sided = rows.select(*keys, *plain, F.explode(F.array(*texts)).alias("__t"))
    # an empty term keeps rows that have none, and counts repeated ones
    each = sided.select("*", F.explode(F.concat(F.array(F.lit("")), terms(F.col("__t.text")))).alias("term"), F.col("__t.side").alias("__side")).drop("__t")
    joined = each.join(F.broadcast(words) if small else words, "term", "left").where((F.col("term") == "") | F.col("drawn").isNotNull())
    own = lambda i: F.when((F.col("__side") == i) & (F.col("term") != ""), F.struct("term", "drawn"))
    # no row number is needed: rows that agree in all this have the same fingerprints
    found = joined.groupBy(*keys, *(f"__x_{c}" for c in text_cols)).agg(
        *(F.sort_array(F.collect_set(own(i))).alias(f"__s{i}") for i in range(len(text_cols))),
        F.count_if((F.col("__side") == 0) & (F.col("term") == "")).alias("__n"),
    )
    upper = lambda h: F.lpad(F.hex(F.shiftrightunsigned(F.coalesce(h, F.lit(0).cast("long")), 32)), 8, "0")
    shown = [F.concat(*(upper(digest(F.col(f"__s{i}"), k)) for k in range(PARTS))).alias(f"__p{i}") for i in range(len(text_cols))]
    parts = found.select(*keys, *(f"__x_{c}" for c in text_cols), "__n", *shown)
    whole = lambda c: F.repeat(F.lpad(F.hex(f"__x_{c}"), 16, "0"), PARTS // 2)
    out = [F.unhex(F.when(F.col(f"__p{i}") == "0" * 8 * PARTS, whole(c)).otherwise(F.col(f"__p{i}"))).alias(f"{c}_fp") for i, c in enumerate(text_cols)]
    done = parts.select(*keys, "__n", *out)
    return done.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "__n")).alias("__i")).drop("__n", "__i")


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints in hexadecimal digits, the share of equal parts among the sparsest ``COMPARED`` ones that are not zero in both: 1 for equal fingerprints."""
    digits = lambda x, k: x.substr(8 * k + 1, F.lit(8))
    parts = F.transform(F.sequence(F.lit(PARTS - 1), F.lit(0), F.lit(-1)), lambda k: F.struct(digits(a, k).alias("x"), digits(b, k).alias("y")))
    filled = F.slice(F.filter(parts, lambda p: (p["x"] != "0" * 8) | (p["y"] != "0" * 8)), 1, COMPARED)
    return F.size(F.filter(filled, lambda p: p["x"] == p["y"])) / F.greatest(F.size(filled), F.lit(1))


def followers(ids: DataFrame, key: str) -> DataFrame:
    """``(key, next_key)`` of distinct keys in ascending order, the first one after the last.

    Keys are dealt out by ranges. Only the first and last key of each range, two numbers a partition, are gathered.
    """
    ranged = checkpointed(ids.select(key).distinct().repartitionByRange(key).select(key, F.spark_partition_id().alias("__p")))
    ends = sorted((r["__p"], r["first"], r["last"]) for r in ranged.groupBy("__p").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect())
    inner = ranged.select(key, F.lead(key).over(Window.partitionBy("__p").orderBy(key)).alias("next_key"))
    if not ends:
        return inner
    kind = ranged.schema[key].dataType.simpleString()
    seams = ids.sparkSession.createDataFrame([(e[2], ends[(i + 1) % len(ends)][1]) for i, e in enumerate(ends)], f"{key} {kind}, __seam {kind}")
    return inner.join(F.broadcast(seams), key, "left").select(key, F.coalesce("next_key", "__seam").alias("next_key"))


def edited_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """Every row with the last ``1/share`` of its code points replaced by as many first ones of the next document.

    Returns ``__key, __next, id, n_chars, text, edited``. The next document has the next larger id, after the largest
    the smallest; a null id sorts first. Rows that share an id share the next document; of several rows that share
    the next id, the text that sorts first counts. Null texts are empty.
    """
    # both joins below read these columns and no others, so that the texts are shuffled once for the two
    none = F.lit(-(2**63))
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), none).alias("__key"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    cut = F.floor(F.length("text") / share).cast("int")
    order = checkpointed(followers(base, "__key"))
    need = base.groupBy("__key").agg(F.max(cut).alias("__cut"))
    before = order.join(need, "__key").select(F.col("next_key").alias("__key"), F.col("__key").alias("__to"), "__cut")
    heads = base.join(before, "__key").select(F.col("__to").alias("__key"), F.col("text").substr(F.lit(1), F.col("__cut")).alias("__head"))
    heads = heads.groupBy("__key").agg(F.min("__head").alias("__head"))
    n = F.length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("__head").substr(F.lit(1), cut))
    return base.join(order, "__key").join(heads, "__key").select("__key", F.col("next_key").alias("__next"), F.nullif("__key", none).cast(docs.schema[id_col].dataType).alias("id"), n.cast("long").alias("n_chars"), "text", edited.alias("edited"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, and how near they and the next document's are."""
    words = checkpointed(lexicon(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))))
    rows = edited_with_next(docs, id_col, text_col).withColumn("edited_sha256", F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256)))
    done = checkpointed(fingerprints(rows, ["text", "edited"], words))
    following = done.groupBy(F.col("__key").alias("__next")).agg(F.min("text_fp").alias("__next_fp"))
    shown = lambda c: F.lower(F.hex(c))
    return done.join(following, "__next").select(
        F.col("id").alias(id_col),
        "n_chars",
        shown("edited_sha256").alias("edited_sha256"),
        shown("text_fp").alias("fingerprint"),
        shown("edited_fp").alias("edited_fingerprint"),
        likeness(F.hex("text_fp"), F.hex("edited_fp")).alias("near_edited"),
        likeness(F.hex("text_fp"), F.hex("__next_fp")).alias("near_next"),
    )
