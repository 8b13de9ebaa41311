"""Cells from window to slide coordinates, and how they lie in their window.

Boxes are y0, y1, x0, x1 (top, down, left, right). The offset of a window is col * core - overlap, also at column 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, OVERLAP = 784, 64
TILES = "array<struct<col:long,row:long>>"


def offset(index: Column, window: int = WINDOW, overlap: int = OVERLAP, edge_origin: str = "formula") -> Column:
    """edge_origin="pyramid": the first window has no margin before it, so it starts at 0."""
    out = index * (window - 2 * overlap) - overlap
    return F.when(index == 0, F.lit(0)).otherwise(out) if edge_origin == "pyramid" else out


def flags(window: int = WINDOW, overlap: int = OVERLAP) -> dict[str, Column]:
    """safe: inside the margin; touching: at an edge; and which edges."""
    box = [F.col(c) for c in ("y0", "y1", "x0", "x1")]
    low, high = F.least(*box), F.greatest(*box)
    side = lambda c, at: (F.col(c) == at).cast("int")
    return {
        "safe": (low >= overlap) & (high <= window - overlap),
        "touching": (high == window) | (low == 0),
        "at_top": side("y0", 0), "at_down": side("y1", window), "at_left": side("x0", 0), "at_right": side("x1", window),
    }


def neighbours() -> Column:
    """Windows beyond the touched edge: one at a side; three at a corner, clockwise; null for none, opposite and more sides."""
    dx, dy = F.col("at_right") - F.col("at_left"), F.col("at_down") - F.col("at_top")
    sides = F.col("at_top") + F.col("at_down") + F.col("at_left") + F.col("at_right")
    cell = lambda x, y: F.struct((F.col("icol") + x).cast("long").alias("col"), (F.col("irow") + y).cast("long").alias("row"))
    up, diagonal, across = cell(F.lit(0), dy), cell(dx, dy), cell(dx, F.lit(0))
    return (
        F.when((sides == 1), F.array(diagonal))
        .when((sides == 2) & (dx * dy == -1), F.array(up, diagonal, across))
        .when((sides == 2) & (dx * dy == 1), F.array(across, diagonal, up))
        .otherwise(F.lit(None).cast(TILES))
    )


def project(cells: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, edge_origin: str = "formula") -> DataFrame:
    """Add flags and neighbours, and move box, centroid (to whole pixels, half to even) and contour to slide coordinates."""
    rows = cells.withColumns(flags(window, overlap)).withColumn("border_tiles", neighbours())
    rows = rows.withColumns({"off_x": offset(F.col("icol"), window, overlap, edge_origin), "off_y": offset(F.col("irow"), window, overlap, edge_origin)})
    moved = {c: F.col(c) + F.col(o) for c, o in (("y0", "off_y"), ("y1", "off_y"), ("x0", "off_x"), ("x1", "off_x"))}
    moved |= {"cx": F.rint(F.col("cx") + F.col("off_x")), "cy": F.rint(F.col("cy") + F.col("off_y"))}
    if "contour" in cells.columns:
        moved["contour"] = F.transform("contour", lambda p: F.struct((p["x"] + F.col("off_x")).alias("x"), (p["y"] + F.col("off_y")).alias("y")))
    return rows.withColumns(moved)
