"""Registry of the drainage engine's queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analysis, crossings, layers, terrain

FLAGSHIP = "flow_chain"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**terrain.QUERIES, **analysis.QUERIES, **crossings.QUERIES, **layers.QUERIES}
ORACLE_SQL: dict[str, str] = {**terrain.ORACLE_SQL, **analysis.ORACLE_SQL, **crossings.ORACLE_SQL, **layers.ORACLE_SQL}
