"""Registry of the core library's queries: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from .queries import dsl, more, sim, stats  # noqa: F401
from .queries.common import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
