"""Functions that a user supplies (models, judges, extractors), applied to columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import short_hash


def hashed_embedding(text: Column, dims: int = 256) -> Column:
    """Unit vectors of signed word hashes: an embedder without a model, the same on every machine. No words: zeros."""

    @F.pandas_udf("array<float>")
    def run(column: pd.Series) -> pd.Series:
        def one(s: str | None) -> list[float]:
            h = np.fromiter((xxhash.xxh64_intdigest(w) for w in (s or "").lower().split()), dtype=np.uint64)
            v = np.bincount((h % np.uint64(dims)).astype(np.int64), weights=np.where(h >> np.uint64(63), -1.0, 1.0), minlength=dims)
            return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32).tolist()

        return column.map(one)

    return run(text)


def pair_scores(left: Column, right: Column, score: Callable[[list[str], list[str]], list[float]]) -> Column:
    """A score of each pair of texts from a function over a batch, such as a reranker."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(score(a.tolist(), b.tolist()), dtype="float64")

    return run(left, right)


def generated(rows: DataFrame, text_col: str, make: Callable[[str], str], out: str, attempts: int = 2) -> DataFrame:
    """``rows`` with ``out``, what ``make`` returns with white space collapsed, and ``<out>_error``.

    A call that fails or returns nothing is tried again; after ``attempts`` the row keeps a null and the last error, and
    other rows are not affected. A null text is not given to the function. Names must be free.
    """
    names = rows.columns
    if {out, f"{out}_error"} & set(names):
        raise ValueError(f"columns {out} and {out}_error must be free")

    def one(text: str | None) -> tuple[str | None, str | None]:
        error = "no text"
        for _ in range(attempts if text is not None else 0):
            try:
                if said := " ".join((make(text) or "").split()):
                    return said, None
                error = "empty result"
            except Exception as e:  # noqa: BLE001 - whatever a user's function raises belongs to this row
                error = f"{type(e).__name__}: {e}"
        return None, error

    @F.pandas_udf("value string, error string")
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in column], columns=["value", "error"])

    called = rows.withColumn("__made", run(F.col(text_col)))
    return called.select(*names, F.col("__made.value").alias(out), F.col("__made.error").alias(f"{out}_error"))


def expanded(questions: DataFrame, cache: DataFrame, expand: Callable[[str], list[str]], kind: str, model: str, salt: str = "", keep_question: bool = True, limit: int = 4) -> tuple[DataFrame, DataFrame]:
    """(``(query_id, position, query, degraded)``, new cache rows) of ``(query_id, question)``.

    Distinct questions not in ``cache`` (``key, variants``) are given to ``expand`` once each. A failed or empty
    expansion leaves the question alone, marked as degraded, and is not cached. Variants equal but for case count
    once; with ``keep_question`` the question is first and ``limit`` bounds its variants, else they replace it.
    """
    keyed = questions.select("query_id", "question", short_hash("", F.concat_ws("|", F.lit(kind), F.lit(model), F.lit(salt), "question"), 64).alias("key"))
    missing = keyed.select("key", "question").distinct().join(cache.select("key"), "key", "left_anti")

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        def one(q: str | None) -> list[str] | None:
            try:
                return [v.strip() for v in expand(q) if v and v.strip()] or None if q is not None else None
            except Exception:  # noqa: BLE001 - a failed expansion degrades to the question
                return None

        return column.map(one)

    # written once, so that a lost executor or a second reader cannot call the function again with another result
    from tessera.operators.checkpoints import checkpointed

    fresh = checkpointed(missing.select("key", run("question").alias("variants"))).where("variants is not null")
    known = keyed.join(cache.select("key", "variants").unionByName(fresh), "key", "left")
    own = F.array("question") if keep_question else F.array().cast("array<string>")
    listed = F.when(F.col("variants").isNull(), F.array("question")).otherwise(F.concat(own, "variants"))
    rows = known.select("query_id", F.col("variants").isNull().alias("degraded"), F.posexplode(listed).alias("at", "query"))
    once = rows.groupBy("query_id", "degraded", F.lower("query").alias("__low")).agg(F.min(F.struct("at", "query")).alias("f"))
    placed = once.select("query_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("f.at")) - 1).alias("position"), "f.query", "degraded")
    return placed.where(F.col("position") < limit + (1 if keep_question else 0)), fresh


def judged(pairs: DataFrame, repeats: int, judge: Callable[[pd.DataFrame], Iterator[str] | list[str]], pair_col: str = "pair") -> DataFrame:
    """``(pair, attempt, verdict)``: every pair judged ``repeats`` times, each attempt on its own.

    ``judge`` gets one row of ``pairs`` as a frame with its attempt; a failure gives that attempt a null, which stays
    in the denominator of the vote.
    """
    attempts = pairs.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    kind = pairs.schema[pair_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for i in range(len(batch)):
                try:
                    said.append(next(iter(judge(batch.iloc[i : i + 1]))))
                except Exception:  # noqa: BLE001 - belongs to this attempt
                    said.append(None)
            yield pd.DataFrame({pair_col: batch[pair_col], "attempt": batch["attempt"], "verdict": said})

    return attempts.mapInPandas(run, f"{pair_col} {kind}, attempt int, verdict string")
