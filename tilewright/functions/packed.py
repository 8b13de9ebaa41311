"""Expressions on rasters packed into one array a row, row-major. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the channels in a gray value; mean and deviation of the channels of normalised pixels.
LUMA = (0.2125, 0.7152, 0.0722)
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def gray(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def normalised(value: Column, channel: int) -> Column:
    return (value / 255.0 - MEAN[channel]) / DEVIATION[channel]


def once(value: Column, use) -> Column:
    """use(value) with the value computed once a row: a plain expression would be computed again for every element of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def minmax(values: Column) -> Column:
    """Scaled to 0..1; a constant raster becomes 0."""

    def scaled(s: Column) -> Column:
        low, high = s["low"], s["high"]
        return F.transform(s["values"], lambda v: F.when(high > low, (v - low) / (high - low)).otherwise(F.lit(0.0)))

    return once(F.struct(values.alias("values"), F.array_min(values).alias("low"), F.array_max(values).alias("high")), scaled)


def quantised(values: Column, most: int = 255) -> Column:
    return F.transform(minmax(values), lambda v: F.floor(v * most).cast("int"))


def _mirror(i: Column, n: int) -> Column:
    """Index with the border pixel as the axis."""
    return F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)


def filtered(values: Column, height: int, width: int, kernel: list[list[int]]) -> Column:
    """Correlation with a small odd kernel, mirrored at the border."""
    ry, rx = len(kernel) // 2, len(kernel[0]) // 2

    def one(i: Column, v: Column) -> Column:
        y, x = F.floor(i / width), i % width
        total = F.lit(0)
        for dy, row in enumerate(kernel):
            for dx, k in enumerate(row):
                if k:
                    at = _mirror(y + dy - ry, height) * width + _mirror(x + dx - rx, width) + 1
                    total = total + k * F.element_at(v, at.cast("int"))
        return total

    return once(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: one(i, v)))


GAUSS = [[1, 2, 1], [2, 4, 2], [1, 2, 1]]
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]


def softmax(values: Column) -> Column:
    high = F.array_max(values)
    e = once(F.struct(values.alias("v"), high.alias("high")), lambda s: F.transform(s["v"], lambda v: F.exp(v - s["high"])))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return once(F.struct(e.alias("e"), total.alias("total")), lambda s: F.transform(s["e"], lambda x: x / s["total"]))


def arg_max(values: Column) -> Column:
    """Place of the greatest, from 0; the first on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
