"""All registered queries with their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import claims, composites, context, contracts, corpus, critique, decisions, links, packs, references, retrieval, rollups, scalars, themes, units, walks

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (retrieval, scalars, rollups, links, decisions, packs, corpus, claims, references, critique, units, context, walks, contracts, themes, composites)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
