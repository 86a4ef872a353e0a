"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("tabular", "measures", "sequences", "features", "signals", "models", "clusterings", "waves", "fits", "numbers", "relations", "scores")


def collect(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(importlib.import_module(f"quarry.plans.{name}"), kind))
    return found
