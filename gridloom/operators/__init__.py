"""Operators on keyed tables, rasters, geometries and spatial designs."""
