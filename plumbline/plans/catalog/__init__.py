"""All registered queries."""

import importlib

from plumbline.plans.catalog.registry import ORACLES, QUERIES

for _name in ("sources", "cleaning", "behavior", "texts", "evaluate", "graphs", "models", "streams", "copies"):
    importlib.import_module(f"plumbline.plans.catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]
