"""Instances of packed rasters: floods from markers, and the corner points of their borders. One raster a row; tasks take a batch of rasters at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packed import once
from ..functions.raster import outlines, watershed


def minima(values: Column, height: int, width: int, inside: Column) -> Column:
    """Whether each pixel of a packed raster is inside and lower than those of its four neighbours that are."""

    def marked(s: Column) -> Column:
        def least(i: Column) -> Column:
            beside = [(i % width > 0, -1), (i % width < width - 1, 1), (i >= width, -width), (i < (height - 1) * width, width)]
            lower = F.get(s["inside"], i)
            for there, step in beside:
                lower &= ~there | ~F.coalesce(F.get(s["inside"], i + step), F.lit(False)) | (F.get(s["v"], i) < F.get(s["v"], i + step))
            return lower

        return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), least)

    return once(F.struct(values.alias("v"), inside.alias("inside")), marked)


def _rasters(column: pa.Array, height: int, width: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), height, width)


def basins(rows: DataFrame, key: str, height: int, width: int, surface: str = "surface", markers: str = "markers", inside: str = "inside") -> DataFrame:
    """(key, y, x, label) of every pixel that a flood reaches, from packed rasters: heights, marker numbers (0 for none) and whether a pixel is inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_rasters(batch.column(i), height, width, kind) for i, kind in ((1, float), (2, int), (3, bool))]
            labels = np.stack([watershed(*p) for p in zip(*parts, strict=True)]) if len(batch) else np.zeros((0, height, width), int)
            i, y, x = np.nonzero(labels)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(y), pa.array(x), pa.array(labels[i, y, x].astype(np.int64))], [key, "y", "x", "label"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, surface, markers, inside).mapInArrow(run, f"{key} {kind}, y long, x long, label long")


def corners(pixels: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """(key, label, ordinal, x, y): the corner points of each label's border, in order from the first pixel on, from labelled pixels (key, y, x, label). Borders of fewer than three
    pixels have no points."""
    packed = pixels.groupBy(key).agg(F.collect_list(F.struct((F.col("y") * width + F.col("x")).alias("at"), "label")).alias("p"))  # a raster's own pixels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, label = (batch.column(i).flatten().to_numpy() for i in (1, 2))
            size = np.diff(batch.column(1).offsets.to_numpy())
            flat = np.zeros((len(batch), height * width), np.int64)
            flat[np.repeat(np.arange(len(batch)), size), at] = label
            found = [(i, name, ring) for i, raster in enumerate(flat.reshape(-1, height, width)) for name, ring in outlines(raster, 3).items()]
            n = np.array([len(r) for _, _, r in found], np.int64)
            points = np.concatenate([r for _, _, r in found]) if found else np.zeros((0, 2))
            each = lambda v: np.repeat(np.array(v, np.int64), n)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each([i for i, _, _ in found]))), pa.array(each([k for _, k, _ in found])), pa.array(np.arange(n.sum()) - each(np.cumsum(n) - n)), pa.array(points[:, 0].astype(np.int64)), pa.array(points[:, 1].astype(np.int64))],
                [key, "label", "ordinal", "x", "y"],
            )

    kind = pixels.schema[key].dataType.simpleString()
    return packed.select(key, "p.at", "p.label").mapInArrow(run, f"{key} {kind}, label long, ordinal long, x long, y long")
