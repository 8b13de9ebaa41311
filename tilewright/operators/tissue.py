"""Where a slide holds tissue: threshold of the gray histogram, share of bright pixels in each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def otsu(pixels: DataFrame, value: str = "q", keys: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """(keys, threshold): the value that best separates the histogram below or at it from the rest; first on ties.

    Values are integer bins; there are at most as many rows a slide as bins after the first aggregation. A constant image's
    threshold is its value.
    """
    counts = pixels.groupBy(*keys, F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    up = Window.partitionBy(*keys).orderBy("v")
    all_ = Window.partitionBy(*keys)
    rows = counts.withColumns({"w": F.sum("n").over(up), "s": F.sum(F.col("n") * F.col("v")).over(up), "w_all": F.sum("n").over(all_), "s_all": F.sum(F.col("n") * F.col("v")).over(all_)})
    gap = (F.col("s") * F.col("w_all") - F.col("s_all") * F.col("w")).cast("double")
    between = F.round(gap * gap / (F.col("w") * (F.col("w_all") - F.col("w"))), 6)
    rows = rows.withColumn("between", F.when(F.col("w") < F.col("w_all"), between).otherwise(F.lit(-1.0)))
    return rows.groupBy(*keys).agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("threshold"))


def bright(pixels: DataFrame, thresholds: DataFrame, value: str = "q", keys: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    return pixels.join(thresholds, list(keys)).withColumn("bright", (F.col(value) > F.col("threshold")).cast("int"))


def thumbnail(pixels: DataFrame, factor: int, values: tuple[str, ...] = ("r", "g", "b"), keys: tuple[str, ...] = ("slide_id",)) -> DataFrame:
    """Means of square blocks of pixels; blocks at the edges may be smaller."""
    at = [F.floor(F.col(c) / factor).alias(c) for c in "yx"]
    return pixels.groupBy(*keys, *at).agg(*[F.avg(v).alias(v) for v in values])


def blocks(pixels: DataFrame, size: int | Column, height: int | Column, width: int | Column, value: str = "bright", keys: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Mean of whole blocks; pixels beyond the last whole block are left out. Size, height and width may be columns."""
    end = lambda n: F.floor((F.lit(n) if isinstance(n, int) else n) / size) * size
    whole = pixels.where((F.col("y") < end(height)) & (F.col("x") < end(width)))
    return whole.groupBy(*keys, F.floor(F.col("y") / size).alias("row"), F.floor(F.col("x") / size).alias("col")).agg(F.avg(value).alias("share"))


def tissue_tiles(pixels: DataFrame, size: int | Column, height: int | Column, width: int | Column, most: float = 0.2, value: str = "q", keys: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Tiles whose share of bright pixels is below `most`."""
    lit = bright(pixels, otsu(pixels, value, keys), value, keys)
    return blocks(lit, size, height, width, "bright", keys).where(F.col("share") < most)
