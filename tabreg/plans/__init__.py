"""Registered query plans (Spark DataFrame plans plus their DuckDB oracle text)."""

from __future__ import annotations

import importlib

MODULES = ("q_evaluate", "q_profile", "q_rank", "q_history", "q_columns", "q_models", "q_report")


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"tabreg.plans.{m}")
