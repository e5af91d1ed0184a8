"""Named query plans. Importing the area modules fills the catalogue."""

from __future__ import annotations

import importlib

from quirecheck.plans.registry import QUERIES, Query

AREAS = ["text", "checks", "expressions", "structure", "layout", "codes", "regions", "compare", "raster", "tiles", "reports", "edits", "incremental"]


def all_queries() -> dict[str, Query]:
    for area in AREAS:
        importlib.import_module(f"quirecheck.plans.{area}")
    return QUERIES
