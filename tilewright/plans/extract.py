"""From slide files to documents: open, find tissue, read windows, predict, join, write.

A slide is its path; a path that is given twice is worked on once. One slide's failure, wherever it comes, is one row of status, and the others are finished.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..models import by_resolution
from ..operators import pyramid, tiling
from ..operators.assign import TILE
from ..sources import documents, files, maps
from ..sources.shared import stored
from ..sources.slides import load_decoder
from .chain import detect_tissue, run

#: Resolution of the asked-for tiles and of the thumbnails, in microns a pixel.
BASE, COARSE = 0.5, 8.0


def named(paths: DataFrame) -> DataFrame:
    """Distinct paths with slide_id, the path itself, and name, the file's own; files of one name in several folders get a mark that follows from the path."""
    rows = paths.dropDuplicates(["path"]).withColumn("slide_id", F.col("path")).withColumn("_file", F.element_at(F.split("path", "/"), -1))
    many = F.count("*").over(Window.partitionBy("_file")) > 1
    return rows.withColumn("name", F.when(many, F.concat("_file", F.lit("-"), F.substring(F.sha2("path", 256), 1, 12))).otherwise(F.col("_file"))).drop("_file")


def opened(slides: DataFrame, decoder: str = maps.DECODER) -> DataFrame:
    """slides (slide_id, name, path, size, changed) with width, height, properties and error, which is null where the slide could be opened."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path in frame["path"]:
                try:
                    s = load_decoder(decoder).open(path.removeprefix("file:"))
                    rows.append((int(s.width), int(s.height), dict(s.properties), None))
                except Exception as e:  # whatever a decoder raises belongs to this slide
                    rows.append((None, None, None, maps.told(e)))
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(rows, columns=["width", "height", "properties", "error"])], axis=1)

    own = ["slide_id", "name", "path", "size", "changed"]
    schema = "slide_id string, name string, path string, size long, changed long, width long, height long, properties map<string,string>, error string"
    return slides.select(own).mapInPandas(read, schema)


#: Side of the squares that thumbnails are read in.
STRIP = 64


def thumbnails(slides: DataFrame, decoder: str = maps.DECODER) -> DataFrame:
    """(slide_id, row, col, w, r, g, b, error) of slides (slide_id, path, width, height, factor): the slide at a level where `factor`, a power of two, pixels of level 0 make one a side, read in squares of
    STRIP pixels of it, one row each with its pixels packed. A square that cannot be read is a row with an error."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, s = None, None
        for frame in frames:
            rows = []
            for t in frame.itertuples(index=False):
                try:
                    if t.path != path:
                        path, s = t.path, None
                        s = load_decoder(decoder).open(t.path.removeprefix("file:"))
                    if s is None:
                        raise ValueError("the slide could not be opened")
                    h, w, data = s.read(int(t.factor).bit_length() - 1, t.col, t.row, STRIP, 0)
                    px = np.frombuffer(data, np.uint8).reshape(h * w, 3).astype(np.int16)
                    rows.append((t.slide_id, t.row, t.col, w, px[:, 0], px[:, 1], px[:, 2], None))
                except Exception as e:  # whatever a decoder raises belongs to this slide
                    rows.append((t.slide_id, t.row, t.col, 0, None, None, None, maps.told(e)))
            yield pd.DataFrame(rows, columns=["slide_id", "row", "col", "w", "r", "g", "b", "error"])

    squares = lambda c: F.explode(F.sequence(F.lit(0), F.ceil(F.floor(F.col(c) / F.col("factor")) / STRIP).cast("int") - 1))
    parts = slides.where("width >= factor AND height >= factor").withColumn("row", squares("height")).withColumn("col", squares("width"))
    schema = "slide_id string, row int, col int, w int, r array<short>, g array<short>, b array<short>, error string"
    return parts.select("slide_id", "path", "factor", "row", "col").repartition("slide_id", "row").mapInPandas(read, schema)


def pixels(squares: DataFrame) -> DataFrame:
    """(slide_id, y, x, r, g, b) of the pixels of thumbnails."""
    rows = squares.where("error IS NULL").select("slide_id", "row", "col", "w", F.posexplode(F.arrays_zip("r", "g", "b")).alias("at", "p"))
    return rows.select("slide_id", (F.col("row") * STRIP + F.floor(F.col("at") / F.col("w"))).alias("y"), (F.col("col") * STRIP + F.col("at") % F.col("w")).alias("x"), *[F.col(f"p.{c}").cast("double").alias(c) for c in "rgb"])


def planned(slides: DataFrame, choices: Sequence[float]) -> DataFrame:
    """Slides with the levels they are worked at, counted down from the finest (down_*), the level of the tiles in the slide's pyramid, the chosen resolution of
    the windows, the factor of the thumbnail, and a status that says which resolution is not available."""
    rows = slides.withColumn("mpp", pyramid.mpp_of(F.col("properties"))).withColumn("n_levels", pyramid.level_count(F.col("width"), F.col("height")))
    target, level, chosen = pyramid.preferred(F.col("mpp"), F.col("n_levels"), tuple(sorted(choices)))
    base, _, based = pyramid.nearest_level(F.col("mpp"), F.col("n_levels"), BASE)
    coarse, _, seen = pyramid.nearest_level(F.col("mpp"), F.col("n_levels"), COARSE)
    rows = rows.withColumns({"target_mpp": target, "_window": level, "_chosen": chosen, "level": base, "_based": based, "_coarse": coarse, "_seen": seen})
    down = lambda c: F.col("n_levels") - 1 - F.col(c)
    fits = F.when(F.col("_chosen") != "ok", F.col("_chosen")).when(F.col("_based") != "ok", F.col("_based")).otherwise(F.col("_seen"))
    rows = rows.withColumns({"down_window": down("_window"), "down_base": down("level"), "factor": F.pow(F.lit(2), down("_coarse")).cast("int"), "fits": fits})
    return rows.drop("_window", "_chosen", "_based", "_coarse", "_seen")


def extract(spark: SparkSession, patterns: Sequence[str], export_dir: str | None, provider, **options) -> tuple[DataFrame, DataFrame]:
    """extract_paths() of what the patterns match."""
    return extract_paths(files.collect_paths(spark, patterns), export_dir, provider, **options)


def extract_paths(paths: DataFrame, export_dir: str | None, provider, decoder: str = maps.DECODER, tile: int = TILE, n_tiles: int | None = None, most: float = 0.2, batch: int = 16, maps_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """From paths (path, size, changed) to tiles with their cells, one row each (`documents.of_tiles` makes whole documents of them), written as NAME/cell_masks.json under export_dir if given,
    and a status (slide, stage, status, message, path) of each slide. Only documents of slides that were finished now are replaced.

    `provider` is one model or several of different resolutions: a slide gets that of the finest one it has. Raw maps are kept under maps_at, if given, until the documents
    are written."""
    spark = paths.sparkSession
    models = by_resolution(provider if isinstance(provider, (list, tuple)) else [provider])
    slides = stored(opened(named(paths), decoder), "slides")
    good = stored(planned(slides.where("error IS NULL"), list(models)), "levels")
    fit = good.where("fits = 'ok'")
    seen = stored(thumbnails(fit, decoder), "thumbnails")
    first = F.min(F.struct("row", "col", "error"))
    unread = stored(seen.where("error IS NOT NULL").groupBy("slide_id").agg(first.alias("e")).select("slide_id", F.lit("tissue").alias("stage"), F.lit("failed").alias("status"), F.col("e.error").alias("message")), "unread")
    usable = fit.join(unread.select("slide_id"), "slide_id", "left_anti")
    block = F.floor(tile * F.pow(F.lit(2.0), F.col("down_base")) / F.col("factor")).cast("int")  # a tile in pixels of the thumbnail
    edges = usable.select("slide_id", block.alias("_block"), *[F.floor(F.col(c) / F.col("factor")).alias(f"_{c}") for c in ("height", "width")])
    found = detect_tissue(pixels(seen).join(edges, "slide_id"), F.col("_block"), F.col("_height"), F.col("_width"), most).select("slide_id", "col", "row")
    about = ["path", "size", "changed", "down_window"]
    tiles = stored(tiling.first_tiles(found, n_tiles, ("slide_id",)).join(usable.select("slide_id", "level", "target_mpp", *about), "slide_id"), "tiles")
    none = F.lit(None).cast("string").alias("message")
    status = [
        slides.where("error IS NOT NULL").select("slide_id", F.lit("open").alias("stage"), F.lit("failed").alias("status"), F.col("error").alias("message")),
        good.where("fits <> 'ok'").select("slide_id", F.lit("level").alias("stage"), F.col("fits").alias("status"), none),
        unread,
        usable.select("slide_id").join(tiles.select("slide_id").distinct(), "slide_id", "left_anti").select("slide_id", F.lit("tissue").alias("stage"), F.lit("no_tissue").alias("status"), none),
    ]
    made, used = [], []
    for mpp, model in sorted(models.items()):
        own = tiles.where(F.col("target_mpp") == mpp)
        steps = int(round(np.log2(BASE / mpp)))  # levels between the tiles and the windows
        core = tiling.core_size(model.tile, model.overlap)
        windows = tiling.retile(own, tile, core, 0, steps, ("slide_id", *about), cover="full")
        windows = stored(windows.select("slide_id", *about[:3], F.col("down_window").cast("int").alias("level"), F.col("col").cast("int").alias("icol"), F.col("row").cast("int").alias("irow")), "windows")
        rows, done = run(windows, own.drop("target_mpp", *about), model, mpp / BASE, tile, maps_at, batch, decoder)
        made.append(rows)
        status.append(done)
        used.append((windows, model))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(union(parts[1:]))
    names = slides.select("slide_id", "name", "path")
    out = union(made).withColumnRenamed("slide", "slide_id").join(names, "slide_id").withColumnRenamed("name", "slide").drop("slide_id", "path")
    if export_dir:
        documents.write(out, export_dir)
        if maps_at:
            for windows, model in used:
                maps.sweep(spark, maps_at, windows, model, decoder)
    return out, stored(union(status).join(names, "slide_id").select(F.col("name").alias("slide"), "stage", "status", "message", "path"), "status")
