"""All queries on the reference's operators and on the general data problems, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import knowledge, portable, quantities, relations, stores

_MODULES = (knowledge, relations, stores, quantities)
_TABLES = re.compile(r"\b(region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|parsed_docs|chunks|file_inventory|graph_nodes|sheet_readings|canonical_entities|mix_targets|subject_areas|subject_labels)\b")


def _as_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        for name in {m for m in _TABLES.findall(re.sub(r"'[^']*'", "''", sql))}:
            table(spark, d, name).createOrReplaceTempView(name)
        return spark.sql(sql)

    return run


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.queries().items()} | {k: _as_query(s) for k, s in portable.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.oracle_sql().items()} | dict(portable.QUERIES)
