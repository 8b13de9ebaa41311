"""Grids of tiles: coarser grids, first tiles, batches, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packed import once


def check(tiles: DataFrame) -> DataFrame:
    """The tiles, if they have whole-numbered col and row."""
    kinds = dict(tiles.dtypes)
    if any(kinds.get(c) not in ("int", "bigint", "smallint", "tinyint") for c in ("col", "row")):
        raise ValueError("tiles need whole-numbered columns col and row")
    return tiles


def core_size(window: int = 784, overlap: int = 64) -> int:
    return window - 2 * overlap


def grid(slides: DataFrame, tile: int, width: str = "width", height: str = "height") -> DataFrame:
    """All tiles of each slide."""
    cols = F.sequence(F.lit(0), (F.ceil(F.col(width) / tile) - 1).cast("int"))
    rows = F.sequence(F.lit(0), (F.ceil(F.col(height) / tile) - 1).cast("int"))
    return slides.withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols))


def retile(tiles: DataFrame, size: int, target: int, level: int, target_level: int, keys: tuple[str, ...] = ("slide",), cover: str = "corner") -> DataFrame:
    """The windows of a coarser grid that the tiles' upper left corners fall into (cover="full": all that they touch).

    Sizes are compared at the tiles' level; equal sizes leave the tiles as they are, repeated ones included.
    """
    wide = target * 2.0 ** (level - target_level)
    if wide == size:
        return tiles.select(*keys, "col", "row")
    at = lambda c, more: F.floor((F.col(c) * size + more) / F.lit(wide)).cast("long")
    if cover == "full":
        rows = tiles.withColumn("_c", F.explode(F.sequence(at("col", 0), at("col", size - 1)))).withColumn("_r", F.explode(F.sequence(at("row", 0), at("row", size - 1))))
        return rows.select(*keys, F.col("_c").alias("col"), F.col("_r").alias("row")).distinct()
    return tiles.select(*keys, at("col", 0).alias("col"), at("row", 0).alias("row")).distinct()


def numbered(tiles: DataFrame, keys: tuple[str, ...] = ("slide",), name: str = "tile_seq") -> DataFrame:
    """Row-major place of each tile of a slide, from 1."""
    return tiles.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("row", "col")).cast("long"))


def first_tiles(tiles: DataFrame, n: int | None, keys: tuple[str, ...] = ("slide",)) -> DataFrame:
    """The first n tiles of each slide in row-major order; None: all."""
    rows = numbered(tiles, keys)
    return rows if n is None else rows.where(F.col("tile_seq") <= n)


def random_tiles(tiles: DataFrame, n: int, seed: int, keys: tuple[str, ...] = ("slide",)) -> DataFrame:
    """n tiles of each slide in a seeded order, that of a product hash of row and column."""
    mixed = F.pmod(F.col("row").cast("long") * 73_856_093 + F.col("col").cast("long") * 19_349_663 + F.lit(seed * 83_492_791), F.lit(4_294_967_291))
    at = Window.partitionBy(*keys).orderBy(mixed, "row", "col")
    return tiles.withColumn("_r", F.row_number().over(at)).where(F.col("_r") <= n).drop("_r")


def with_metadata(tiles: DataFrame, level: int, slide: str = "slide") -> DataFrame:
    """Name of the slide, level and number of its tiles beside each tile."""
    sizes = tiles.groupBy(F.col(slide).alias("_s")).agg(F.count("*").alias("slide_length"))
    return tiles.join(sizes, F.col(slide) == F.col("_s")).drop("_s").withColumn("level", F.lit(level))


def batches(seq: Column, size: int) -> tuple[Column, Column]:
    """Batch number from 0 of a place from 1, and the batch's name."""
    number = F.floor((seq - 1) / size).cast("long")
    return number, F.concat(F.lit("batch_"), F.lpad(number.cast("string"), 5, "0"))


def pad(values: Column, height: int, width: int, to: int) -> Column:
    """A packed raster with zeros added below and on the right, to a square."""
    inside = lambda i: (F.floor(i / to) < height) & (i % to < width)
    at = lambda v, i: F.element_at(v, (F.floor(i / to) * width + i % to + 1).cast("int"))
    return once(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(to * to - 1)), lambda i: F.when(inside(i), at(v, i)).otherwise(F.lit(0))))
