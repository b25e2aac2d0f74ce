"""Incremental forms of the zonal operators."""
