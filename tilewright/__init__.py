"""Tiled spatial and raster analytics on Spark DataFrames."""
