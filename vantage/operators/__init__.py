"""Dataflow operators over grids, rays, walls and records."""
