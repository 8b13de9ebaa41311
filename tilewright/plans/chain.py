"""Whole chains: duplicates at window borders, tissue, and a run over slides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrangement import repaired
from ..functions.geometry import shoelace, with_common_area
from ..functions.packed import gray
from ..operators import assign, dedup, tissue
from ..operators.project import OVERLAP, WINDOW, project
from ..sources import documents, maps
from ..sources.shared import stored


def unique_cells(cells: DataFrame, threshold: float = 0.01, polygons: bool = False, leaf: int = dedup.LEAF, slide: str = "slide", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """From cells in window coordinates (with area) to those kept in slide coordinates.

    Project, drop edge cells that a neighbour window sees whole, one cell for each centroid, one for each group of overlaps. seq must be unique in a slide.
    polygons: verify overlaps on contours; else boxes are the outlines.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    kept, edges = overlaps(project(cells, window, overlap), threshold, polygons, leaf, slide)
    return dedup.largest_of_each(kept, edges, slide)


def overlaps(cells: DataFrame, threshold: float = 0.01, polygons: bool = False, leaf: int = dedup.LEAF, slide: str = "slide") -> tuple[DataFrame, DataFrame]:
    """From projected cells those left after the border rule and one for each centroid, stored, with a number `uid`, and the pairs of them that overlap.

    Contours stay out of the join of boxes: they are fetched for the pairs whose boxes overlap. With polygons a contour that crosses or touches itself stands for the largest part that it
    encloses, whose area becomes the cell's; contours themselves stay as they are.
    """
    kept = dedup.keep_first(dedup.retain_border(cells, slide), slide)
    kept = repaired(kept) if polygons else kept
    kept = stored(kept.withColumn("uid", F.monotonically_increasing_id()), "cells")
    pairs = dedup.box_pairs(kept.select(slide, "uid", "seq", "area", "y0", "y1", "x0", "x1"), leaf, slide, threshold)
    if polygons:
        ring = kept.select(F.col("uid").alias("_of"), F.col("outline").alias("_ring"))
        for s in "ab":
            pairs = pairs.join(ring.withColumnRenamed("_ring", f"ring_{s}"), F.col(f"uid_{s}") == F.col("_of")).drop("_of")
        pairs = with_common_area(pairs, "ring_a", "ring_b").drop("ring_a", "ring_b")
    return kept.drop("outline"), dedup.overlap_edges(pairs, "inter" if polygons else "box_area", threshold)


def fix_borders(cells: DataFrame, tiles: DataFrame, ratio: float = 1.0, tile: int = assign.TILE, slide: str = "slide", **options) -> DataFrame:
    """The kept cells in each asked-for tile, in tile coordinates, numbered from 0; tiles without cells stay, with nulls."""
    kept = assign.rescale(unique_cells(cells, slide=slide, **options), ratio)
    return assign.number(assign.assign(tiles, kept, tile, slide), (slide, "tile_seq"))


def with_area(cells: DataFrame) -> DataFrame:
    return cells.withColumn("area", shoelace(F.col("contour")))


def detect_tissue(pixels: DataFrame, size: int | Column, height: int | Column, width: int | Column, most: float = 0.2, keys: tuple[str, ...] = ("slide_id",)) -> DataFrame:
    """Tiles with tissue, from thumbnail pixels (keys, y, x, r, g, b). Their order is that of row and col; whoever numbers them sorts."""
    rows = pixels.withColumn("q", F.floor(gray(F.col("r"), F.col("g"), F.col("b"))))
    return tissue.tissue_tiles(rows, size, height, width, most, "q", keys)


def run(windows: DataFrame, tiles: DataFrame, provider, ratio: float = 1.0, tile: int = assign.TILE, maps_at: str | None = None, batch: int = 16, decoder: str = maps.DECODER) -> tuple[DataFrame, DataFrame]:
    """Windows (slide_id, icol, irow, and path and level if the provider reads pixels) through a provider to one row a tile with its cells, and the status of each slide. tiles
    (slide_id, col, row, tile_seq, and level, else 0) are `tile` wide; ratio leads from the windows' pixels to theirs.

    maps_at: keep raw maps there, and go on from those of a run that broke off. A slide of which a window could not be read, predicted or turned into cells, or whose maps are missing, is one
    row of status and has no tiles; the others are not affected. A slide without cells has its tiles all the same.
    """
    tiles = tiles.withColumn("level", F.lit(0)) if "level" not in tiles.columns else tiles
    found = maps.spill(windows, provider, maps_at, batch=batch, decoder=decoder) if maps_at else maps.predict(windows, provider, batch, decoder)
    seen = stored(maps.detect(found, provider.classes, provider.mpp), "detections")
    failed = maps.failures(seen)
    bad = stored(failed.union(maps.unmatched(windows, seen).join(failed, "slide_id", "left_anti")), "failures")
    good = lambda rows: rows.join(bad.select("slide_id"), "slide_id", "left_anti")
    cells = maps.numbered(maps.cells_of(good(seen))).withColumnsRenamed({"top": "y0", "down": "y1", "left": "x0", "right": "x1", "slide_id": "slide"})
    done = fix_borders(with_area(cells), good(tiles).withColumnRenamed("slide_id", "slide"), ratio, tile, polygons=True, window=provider.tile, overlap=provider.overlap)
    lists = done.withColumns({
        "coordinates": F.transform("contour", lambda p: F.array(p["x"], p["y"])), "centroid": F.array("cx", "cy"), "confidence": F.col("prob"),
        "x": F.col("col"), "y": F.col("row"), "width": F.lit(tile), "height": F.lit(tile),
    })
    out = stored(documents.tile_rows(lists, provider.name, provider.mpp), "tiles")
    have = out.select(F.col("slide").alias("slide_id"), F.lit("ok").alias("_s")).distinct()
    status = good(tiles.select("slide_id").union(windows.select("slide_id")).distinct()).join(have, "slide_id", "left")
    status = status.select("slide_id", F.lit("document").alias("stage"), F.coalesce("_s", F.lit("no_tiles")).alias("status"), F.lit(None).cast("string").alias("message"))
    return out, bad.union(status)
