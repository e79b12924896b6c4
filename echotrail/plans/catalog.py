"""Imports every query module, filling the registry."""

from __future__ import annotations

import importlib

from echotrail.plans.registry import ORACLES, QUERIES

MODULES = ["metric_queries", "profile_queries", "projection_queries", "window_queries",
           "localization_queries", "cascade_queries", "join_queries", "decision_queries",
           "source_queries", "quality_queries"]

for _name in MODULES:
    importlib.import_module(f"echotrail.plans.{_name}")

__all__ = ["QUERIES", "ORACLES"]
