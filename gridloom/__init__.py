"""Gridded geospatial analytics and spatially honest model validation on Spark."""
