"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import doors, drawn, fabric, ledgers, meshes, rasters, records, reports, shapes, sights, solids, variants, views

FLAGSHIP = "viewshed_count"
MODULES = (views, records, meshes, sights, shapes, rasters, reports, solids, ledgers, fabric, doors, drawn, variants)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
