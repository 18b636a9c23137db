"""Registered queries over the test tables and their oracles."""

from __future__ import annotations

import importlib
import importlib.util
from types import ModuleType

MODULES = [
    "scalar_checks", "source_checks", "config_checks", "catalog_checks", "workload_checks", "fleet_checks",
    "rule_checks", "issue_checks", "drift_checks", "correlation_checks", "assessment_checks", "mart_checks",
]


def load() -> ModuleType:
    """The registry with every check registered."""
    for name in MODULES:
        if importlib.util.find_spec(f"checks.{name}"):
            importlib.import_module(f"checks.{name}")
    return importlib.import_module("checks.registry")
