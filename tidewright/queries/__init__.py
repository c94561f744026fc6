"""Registered queries of the engine's own operators, each beside the DuckDB SQL that says the same."""

from __future__ import annotations

import importlib

from .base import ORACLES, QUERIES

for _topic in ("values", "routing", "flow", "ledger", "snapshot", "sinks", "status", "flagship"):
    importlib.import_module(f"{__name__}.{_topic}")

__all__ = ["ORACLES", "QUERIES"]
