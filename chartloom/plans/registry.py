"""Name -> query and name -> DuckDB SQL of all registered queries."""

from __future__ import annotations

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
