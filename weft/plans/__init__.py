"""Registered queries by family; importing this package registers them all."""

import importlib

from weft.plans.registry import ORACLES, QUERIES

for _family in ("corpus", "scoring", "telemetry", "packing", "rollouts", "objectives", "sources", "streams", "prompts"):
    importlib.import_module(f"weft.plans.{_family}")

__all__ = ["ORACLES", "QUERIES"]
