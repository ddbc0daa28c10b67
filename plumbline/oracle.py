"""DuckDB statements for the core queries that SQL can express."""

from __future__ import annotations

from . import queries_checks, queries_core, queries_data

ORACLE: dict[str, str] = {**queries_core.ORACLE, **queries_data.ORACLE, **queries_checks.ORACLE}
