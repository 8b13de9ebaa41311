"""Kept cells back to the tiles that were asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 224


def rescale(cells: DataFrame, ratio: float) -> DataFrame:
    """Boxes, centroids and contours times ratio; nothing to do for 1."""
    if ratio == 1:
        return cells
    out = cells.withColumns({c: F.col(c) * ratio for c in ("y0", "y1", "x0", "x1", "cx", "cy")})
    if "contour" in cells.columns:
        out = out.withColumn("contour", F.transform("contour", lambda p: F.struct((p["x"] * ratio).alias("x"), (p["y"] * ratio).alias("y"))))
    return out


def with_tile(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """The tile that holds a cell's centroid, and box and centroid relative to it. Nothing is clipped."""
    rows = cells.withColumns({"tile_col": F.floor(F.col("cx") / tile), "tile_row": F.floor(F.col("cy") / tile)})
    moved = {c: F.col(c) - F.col(t) * tile for c, t in (("y0", "tile_row"), ("y1", "tile_row"), ("x0", "tile_col"), ("x1", "tile_col"), ("cx", "tile_col"), ("cy", "tile_row"))}
    if "contour" in cells.columns:
        moved["contour"] = F.transform("contour", lambda p: F.struct((p["x"] - F.col("tile_col") * tile).alias("x"), (p["y"] - F.col("tile_row") * tile).alias("y")))
    return rows.withColumns(moved)


def assign(tiles: DataFrame, cells: DataFrame, tile: int = TILE, slide: str = "slide") -> DataFrame:
    """Every tile with its cells, one row each; a tile without cells has one row with nulls. Cells outside all tiles go."""
    rows = with_tile(cells, tile).withColumnRenamed(slide, "_s")
    on = (F.col(slide) == F.col("_s")) & (F.col("col") == F.col("tile_col")) & (F.col("row") == F.col("tile_row"))
    return tiles.join(rows, on, "left").drop("_s", "tile_col", "tile_row")


def number(rows: DataFrame, keys: tuple[str, ...] = ("slide", "tile_seq")) -> DataFrame:
    """cell_id from 0 within each tile, safe cells first, then seq; null for a tile without cells."""
    at = Window.partitionBy(*keys).orderBy(F.desc("safe"), "seq")
    return rows.withColumn("cell_id", F.when(F.col("seq").isNotNull(), F.row_number().over(at) - 1))


def collected(rows: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """One row a tile with the list of its cells in their order."""
    some = F.when(F.col("cell_id").isNotNull(), F.struct("cell_id", *fields))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(some)).alias("cells"))
