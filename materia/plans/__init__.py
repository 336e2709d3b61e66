"""Named queries over the tables, by family."""

from __future__ import annotations

import importlib

MODULES = ("evidence", "texts", "profiles", "catalogs", "resolution", "landings", "pages", "notes", "risks", "history", "normalisation", "prescriptions", "messages", "policy", "audits")


def load() -> None:
    """Import every family, which registers its queries."""
    for name in MODULES:
        importlib.import_module(f"materia.plans.{name}")
