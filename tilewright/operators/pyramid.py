"""Resolutions of slides and the levels of their pyramids. Failures are values of a status column, never errors of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Microns in the units that a resolution may be given in.
MICRONS = {"cm": 10000.0, "mm": 1000.0, "centimeter": 10000.0, "millimeter": 1000.0, "inch": 25400.0}
# Smallest object and size of the derivative kernel by working resolution.
PARAMETERS = {0.5: (5, 11), 0.25: (10, 21)}


def mpp(mpp_x: Column, x_resolution: Column, unit: Column) -> Column:
    """Microns a pixel, or null: the mpp if given; a resolution under 1 is one itself, else units are divided by it."""
    table = F.create_map(*[F.lit(x) for k, v in MICRONS.items() for x in (k, v)])
    per_unit = F.try_element_at(table, unit)
    return F.coalesce(mpp_x, F.when(x_resolution < 1, x_resolution).otherwise(per_unit / x_resolution))


def mpp_of(properties: Column) -> Column:
    """The same from a slide's property map."""
    at = lambda k: F.try_element_at(properties, F.lit(k))
    return mpp(at("openslide.mpp-x").cast("double"), at("tiff.XResolution").cast("double"), at("tiff.ResolutionUnit"))


def level_count(width: Column, height: Column) -> Column:
    """Levels of a pyramid that halves down to one pixel."""
    return (F.ceil(F.log2(F.greatest(width, height).cast("double"))) + 1).cast("int")


def ladder(slides: DataFrame, finest: str = "mpp", levels: str = "n_levels", default: float = 0.25) -> DataFrame:
    """One row a level: level and its mpp; the last level is the finest, each one before has twice its mpp."""
    rows = slides.withColumn("level", F.explode(F.sequence(F.lit(0), F.col(levels) - 1)))
    return rows.withColumn("level_mpp", F.coalesce(F.col(finest), F.lit(default)) * F.pow(F.lit(2.0), F.col(levels) - 1 - F.col("level")))


def nearest_level(finest: Column, levels: Column, target: float, rtol: float = 0.2, default: float = 0.25) -> tuple[Column, Column, Column]:
    """Level, its mpp and a status: the nearest in mpp, the coarser on ties; not available if it is off by more than rtol."""
    base = F.coalesce(finest, F.lit(default))

    def step(i: Column) -> Column:
        at = base * F.pow(F.lit(2.0), levels - 1 - i)
        return F.struct(F.abs(at - target).alias("off"), i.alias("level"), at.alias("mpp"))

    # the levels on both sides of the target, one more each for what the logarithm rounds, and both ends; all levels where it tells nothing
    doubled = F.greatest(F.lit(-2), F.least(levels.cast("long"), F.floor(F.log2(F.lit(target) / F.nullif(base, F.lit(0.0)))))).cast("int")
    near = F.array_min(F.array(*[step(F.greatest(F.lit(0), F.least(levels - 1, levels - 1 - doubled - d))) for d in (-1, 0, 1, 2)], step(F.lit(0)), step(levels - 1)))
    every = F.array_min(F.transform(F.sequence(F.lit(0), levels - 1), step))
    best = F.when((base > 0) & (base < float("inf")) & (levels >= 1) & (F.lit(target) > 0), near).otherwise(every)
    return best["level"], best["mpp"], F.when(best["off"] / target > rtol, "mpp_not_available").otherwise("ok")


def preferred(finest: Column, levels: Column, choices: tuple[float, ...] = (0.25, 0.5), **options) -> tuple[Column, Column, Column]:
    """The first of the choices that is available: chosen mpp, level, status."""
    chosen, level = F.lit(None).cast("double"), F.lit(None).cast("int")
    for target in reversed(choices):
        at, _, status = nearest_level(finest, levels, target, **options)
        chosen, level = F.when(status == "ok", F.lit(target)).otherwise(chosen), F.when(status == "ok", at).otherwise(level)
    return chosen, level, F.when(chosen.isNull(), "mpp_not_available").otherwise("ok")


def parameters(mpp: Column) -> tuple[Column, Column]:
    """Smallest object and kernel size for a working mpp; null for any other."""
    small, kernel = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (s, n) in PARAMETERS.items():
        small, kernel = F.when(mpp == k, s).otherwise(small), F.when(mpp == k, n).otherwise(kernel)
    return small, kernel


def scale(from_level: int, to_level: int) -> float:
    """Factor of coordinates from one level to another."""
    return 2.0 ** (to_level - from_level)
