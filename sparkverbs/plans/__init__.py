"""Registered queries over the fixture tables, each with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

from . import analysis, columns, functions, grouping, joining, ordering, reading, reshaping, scalars, studies  # noqa: F401
from .registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
