"""Operators on slides, tiles, pixels and cells: DataFrame in, DataFrame out."""
