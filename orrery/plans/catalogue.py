"""All queries: importing the modules registers them."""

from __future__ import annotations

from orrery.plans import dashboard, encoding, files, hierarchy, relations, rollups, scene, similarity, texts  # noqa: F401
from orrery.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
