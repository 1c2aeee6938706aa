"""All registered queries over the driver's tables, with their DuckDB counterparts."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

for _part in ("scores", "accounts", "store", "labels", "texts", "shelf", "cases", "reports", "told", "categories", "streams", "labelling", "layers", "picks", "evaluating", "domain"):
    importlib.import_module(f"opinara.plans.{_part}")
