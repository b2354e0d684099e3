"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ("q_panel", "q_portfolio", "q_model", "q_five", "q_sources", "q_relational", "q_studies", "q_configs")


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"checks.{m}")


load()
