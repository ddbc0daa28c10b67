"""The core queries, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_checks, queries_core, queries_data

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {**queries_core.QUERIES, **queries_data.QUERIES, **queries_checks.QUERIES}
