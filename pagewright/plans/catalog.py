"""All queries of the engine with their SQL counterparts."""

from __future__ import annotations

from . import lines, rasters, regions, services, translation

MODULES = [translation, lines, regions, rasters, services]
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict = {k: s for m in MODULES for k, s in m.ORACLES.items()}
