"""All lineage queries and their DuckDB SQL."""

from __future__ import annotations

from . import mixture_queries, name_queries, report_queries, table_queries, zoo_queries  # noqa: F401  (they register themselves)
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
