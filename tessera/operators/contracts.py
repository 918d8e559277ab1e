"""What supplied functions have to return: parsers of their JSON, shaping and provenance. All stay in the JVM.

Texts may have a code fence around the JSON. What breaks the contract is marked or left out as each function says; it
never fails the batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.documents import unfenced
from tessera.functions.text import short_hash, slug
from tessera.operators.checkpoints import placed

EXTRACTION = "entities array<struct<name:string,type:string,aliases:array<string>>>, relations array<struct<source:string,target:string,type:string,weight:double>>, claims array<struct<text:string,entities:array<string>,polarity:string>>"
VERDICTS = ("fail", "pass", "not_applicable")
SEVERITIES = ("high", "medium", "low")
PROBES = 5


def parsed_extraction(rows: DataFrame, text: str, stamps: list[str]) -> DataFrame:
    """``stamps`` with ``entities, relations, claims, error``: a chunk's extraction, its ids taken from the chunk whatever the text says.

    Unreadable JSON gives empty lists and an error. Entities without a name, relations with an end that is no entity of
    the extraction and claims without a text are left out.
    """
    got = F.from_json(unfenced(F.col(text)), EXTRACTION)
    read = rows.select(*stamps, F.get_json_object(unfenced(F.col(text)), "$").isNotNull().alias("ok"), got.alias("x"))
    said = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    none = F.from_json(F.lit('{"entities": [], "relations": [], "claims": []}'), EXTRACTION)
    listed = lambda c: F.coalesce(F.col(f"x.{c}"), none[c])
    entities = F.filter(listed("entities"), lambda e: said(e["name"]))
    names = F.transform(F.col("entities"), lambda e: slug(e["name"]))
    known = lambda c: F.array_contains(names, slug(c))
    out = read.withColumn("entities", entities)
    return out.select(
        *stamps,
        "entities",
        F.filter(listed("relations"), lambda r: known(r["source"]) & known(r["target"]) & (slug(r["source"]) != slug(r["target"]))).alias("relations"),
        F.filter(listed("claims"), lambda c: said(c["text"])).alias("claims"),
        F.when(~F.col("ok") | F.col("x").isNull(), "unreadable").alias("error"),
    )


def parsed_verdicts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, rule, verdict, severity, reason)`` of texts that are ``{"verdicts": [...]}``; unknown verdicts are left out, an unknown severity is ``medium``, of several for a rule the first counts."""
    kind = "array<struct<rule:string,verdict:string,severity:string,reason:string>>"
    each = rows.select(key, F.posexplode(F.from_json(F.get_json_object(unfenced(F.col(text)), "$.verdicts"), kind)).alias("at", "v"))
    low = lambda c: F.lower(F.trim(c))
    good = each.where(low(F.col("v.verdict")).isin(*VERDICTS) & (F.coalesce("v.rule", F.lit("")) != ""))
    first = good.groupBy(key, F.col("v.rule").alias("rule")).agg(F.min(F.struct("at", "v"))["v"].alias("v"))
    severity = F.when(low(F.col("v.severity")).isin(*SEVERITIES), low(F.col("v.severity"))).otherwise("medium")
    return first.select(key, "rule", low(F.col("v.verdict")).alias("verdict"), severity.alias("severity"), F.col("v.reason").alias("reason"))


def verdicts_as_findings(verdicts: DataFrame, key: str) -> DataFrame:
    """``(key, finding, rule, detail)``: one finding for each failed rule, named by its rule."""
    failed = verdicts.where("verdict = 'fail'")
    return failed.select(key, F.concat(F.lit("finding:"), F.col("rule")).alias("finding"), "rule", F.coalesce("reason", F.lit("")).alias("detail"))


def parsed_probes(rows: DataFrame, key: str, text: str, most: int = PROBES) -> DataFrame:
    """``(key, position, question)`` of texts that are ``{"probes": [...]}`` of questions or objects with one; blank and repeated ones are left out, ``most`` at most."""
    raw = F.from_json(F.get_json_object(unfenced(F.col(text)), "$.probes"), "array<string>")
    question = lambda s: F.trim(F.coalesce(F.get_json_object(s, "$.question"), F.when(~s.startswith("{"), s)))
    each = rows.select(key, F.posexplode(F.transform(raw, question)).alias("at", "question")).where("coalesce(question, '') <> ''")
    once = each.groupBy(key, F.lower("question").alias("low")).agg(F.min(F.struct("at", "question")).alias("f"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("f.at"))
    return once.select(key, place.cast("long").alias("position"), "f.question").where(F.col("position") <= most)


def parsed_findings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, finding, criterion, contested, citations)`` of texts that are ``{"findings": [...]}``: numbered ``f1`` and on, those without a criterion left out before they are numbered."""
    kind = "array<struct<criterion:string,contested:boolean,citations:array<struct<video_id:string,start_seconds:double,quote:string>>>>"
    got = F.from_json(F.get_json_object(unfenced(F.col(text)), "$.findings"), kind)
    kept = F.filter(got, lambda x: F.coalesce(F.trim(x["criterion"]), F.lit("")) != "")
    each = rows.select(key, F.posexplode(kept).alias("at", "f"))
    return each.select(key, F.concat(F.lit("f"), F.col("at") + 1).alias("finding"), F.trim("f.criterion").alias("criterion"), F.coalesce("f.contested", F.lit(False)).alias("contested"), F.size(F.coalesce("f.citations", F.array().cast("array<struct<video_id:string,start_seconds:double,quote:string>>"))).alias("citations"))


def candidate_records(rows: DataFrame, prefix: str = "g") -> DataFrame:
    """Question candidates ``(position, question, answer, chunks)`` shaped for review: ``id`` by position, texts trimmed, each chunk once; those without a question or chunk are left out before they are numbered."""
    good = rows.where("coalesce(trim(question), '') <> '' and size(chunks) > 0")
    return placed(good, "position").select(F.concat(F.lit(prefix), F.lpad(F.col("place").cast("string"), 3, "0")).alias("id"), F.trim("question").alias("question"), F.coalesce(F.trim("answer"), F.lit("")).alias("answer"), F.array_distinct("chunks").alias("chunks"))


def chat_entries(rows: DataFrame) -> DataFrame:
    """``rows`` (``asked_at, question, answer``) with ``entry``, the same for the same question at the same time, and the kind: ``answer`` or ``failed``."""
    name = short_hash("chat:", F.concat_ws("\n", F.col("asked_at").cast("string"), "question"))
    return rows.select(name.alias("entry"), "*", F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", "failed").otherwise("answer").alias("kind"))


def run_described(cells: DataFrame) -> DataFrame:
    """``(run, setups, questions, answered, failed, judges, mixed)`` of runs of cells ``(run, setup, question, answer, judge)``."""
    return cells.groupBy("run").agg(
        F.count_distinct("setup").alias("setups"),
        F.count_distinct("question").alias("questions"),
        F.count("answer").alias("answered"),
        F.count_if(F.col("answer").isNull()).alias("failed"),
        F.array_join(F.array_sort(F.collect_set("judge")), ",").alias("judges"),
        (F.count_distinct("judge") > 1).alias("mixed"),
    )


def run_selected(runs: DataFrame, wanted: str | None = None) -> DataFrame:
    """The run that is asked for, else the newest by name. A run that does not exist is an error."""
    if wanted is None:
        return runs.join(runs.agg(F.max("run").alias("run")), "run", "left_semi")
    found = runs.where(F.col("run") == wanted)
    if found.isEmpty():
        raise ValueError(f"no run {wanted}")
    return found


def all_probes_passed(probes: DataFrame) -> DataFrame:
    """``(run, probes, passed, all_passed)``: a run's calibration probes; no probe is no pass."""
    return probes.groupBy("run").agg(F.count("*").alias("probes"), F.count_if("ok").alias("passed"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("all_passed"))


def rejudged(cells: DataFrame, scores: DataFrame) -> DataFrame:
    """``cells`` (``cell, score, judge``) with the scores of another judge where it gave one; a cell that it could not judge keeps what it had, marked."""
    new = scores.select("cell", F.col("score").alias("new_score"), F.col("judge").alias("new_judge"))
    both = cells.join(new, "cell", "left")
    done = F.col("new_score").isNotNull()
    return both.select("cell", F.coalesce("new_score", "score").alias("score"), F.when(done, F.col("new_judge")).otherwise(F.col("judge")).alias("judge"), done.alias("rejudged"))


def built_as(prefixes: DataFrame, digest: str) -> DataFrame:
    """The longest prefix of a corpus ``(size, digest)`` that has a given digest: how large it was when something was built."""
    return prefixes.where(F.col("digest") == digest).agg(F.max("size").alias("size"))


def _public_v4(n: list[Column]) -> Column:
    """Whether four numbers are an address outside all closed blocks."""
    closed = (
        n[0].isin(0, 10, 127) | (n[0] >= 224) | ((n[0] == 100) & n[1].between(64, 127)) | ((n[0] == 169) & (n[1] == 254)) | ((n[0] == 172) & n[1].between(16, 31)) | ((n[0] == 192) & (n[1] == 168))
        | ((n[0] == 192) & (n[1] == 0) & ((n[2] == 2) | (n[2] == 0) & ~n[3].isin(9, 10))) | ((n[0] == 198) & n[1].isin(18, 19)) | ((n[0] == 198) & (n[1] == 51) & (n[2] == 100)) | ((n[0] == 203) & (n[1] == 0) & (n[2] == 113))
    )
    return ~closed


def _given(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), then), 1)


OCTET = r"(0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"


def _groups(text: Column) -> Column:
    """The eight numbers of an IPv6 address in small letters; null if it is none."""
    tail = rf"^(.*:){OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
    n = [F.regexp_extract(text, tail, i + 2).try_cast("int") for i in range(4)]
    pair = lambda x, y: F.lower(F.hex(x * 256 + y))
    plain = F.when(text.rlike(tail), F.concat(F.regexp_extract(text, tail, 1), pair(n[0], n[1]), F.lit(":"), pair(n[2], n[3]))).otherwise(text)

    def split(plain: Column) -> Column:
        gap = F.contains(plain, F.lit("::"))
        side = lambda i: F.filter(F.split(F.substring_index(plain, "::", i), ":"), lambda x: x != "")
        well = plain.rlike(r"^[0-9a-f:]+$") & ~plain.rlike(r":::|::.*::|^:[^:]|[^:]:$|[0-9a-f]{5}")
        sides = F.struct(side(1).alias("left"), F.when(gap, side(-1)).otherwise(F.array().cast("array<string>")).alias("right"))

        def whole(s: Column) -> Column:
            missing = F.lit(8) - F.size(s["left"]) - F.size(s["right"])
            full = F.concat(s["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), s["right"])
            return F.when(well & F.when(gap, missing >= 1).otherwise(missing == 0), F.transform(full, lambda x: F.conv(x, 16, 10).cast("int")))

        return _given(sides, whole)

    return _given(plain, split)


def public_address(host: Column) -> Column:
    """Whether an IP address may be fetched: not private, loopback, link-local, shared, multicast, reserved or unspecified. Other texts: null.

    IPv6 addresses that hold an IPv4 one, mapped or by the well-known prefix for translation, are judged by it.
    """
    text = F.lower(host)
    numbers = F.transform(F.split(text, r"\."), lambda x: x.try_cast("int"))
    v4 = _given(numbers, lambda n: _public_v4([F.get(n, F.lit(i)) for i in range(4)]))
    return F.when(text.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), v4).when(F.contains(text, F.lit(":")), _given(_groups(text), _public_v6))


def _public_v6(groups: Column) -> Column:
    g = [F.get(groups, F.lit(i)) for i in range(8)]
    zeros = lambda a, b: reduce(lambda x, y: x & y, [g[i] == 0 for i in range(a, b)])
    inner = [F.floor(g[6] / 256), g[6] % 256, F.floor(g[7] / 256), g[7] % 256]
    holds_v4 = zeros(0, 5) & (g[5] == 0xFFFF) | (g[0] == 0x64) & (g[1] == 0xFF9B) & zeros(2, 6)
    # blocks of 2000::/3 that are not for general use, and what of them is all the same
    special = (g[0] == 0x2001) & (g[1] < 0x200)
    open_ = (g[1] == 1) & zeros(2, 7) & g[7].isin(1, 2) | (g[1] == 3) | (g[1] == 4) & (g[2] == 0x112) | g[1].between(0x20, 0x3F)
    closed = special & ~open_ | (g[0] == 0x2001) & (g[1] == 0xDB8) | (g[0] == 0x2002) | (g[0] == 0x3FFF) & (g[1] < 0x1000)
    return F.when(holds_v4, _public_v4(inner)).otherwise(g[0].between(0x2000, 0x3FFF) & ~closed | g[0].between(0xFEC0, 0xFEFF))
