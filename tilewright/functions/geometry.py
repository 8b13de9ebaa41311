"""Polygons: rings as expressions, and exact areas of overlap in numpy.

A ring is a list of points, closed or not. The interior is taken by the even-odd rule, so crossing rings have an area as well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def closed(ring: Column) -> Column:
    """The ring with its first point again at the end, if it is not there."""
    return F.when(F.size(ring) == 0, ring).when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def shoelace(ring: Column) -> Column:
    """Area of a simple ring of points (x, y); 0 below three points."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crossed = F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(crossed, F.lit(0.0), lambda a, v: a + v)) / 2)


#: Numbers that are worked on at once.
HELD = 1 << 21


def _padded(rings: list[np.ndarray]) -> np.ndarray:
    """Edges (pairs, most, 4) of some rings; level edges bound no slab and are nan, as is what fills up."""
    n = np.array([len(r) for r in rings])
    out = np.full((len(rings), max(1, n.max(initial=0)), 4), np.nan)
    row, at = np.repeat(np.arange(len(rings)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    flat = np.concatenate(rings) if len(rings) else np.zeros((0, 2))
    nxt = np.arange(1, len(flat) + 1)
    last = np.cumsum(n) - 1
    nxt[last[n > 0]] = (np.cumsum(n) - n)[n > 0]
    edges = np.concatenate((flat, flat[nxt]), axis=1) if len(flat) else np.zeros((0, 4))
    edges[edges[:, 1] == edges[:, 3]] = np.nan
    out[row, at] = edges
    return out


def _spans(edges: np.ndarray, mid: np.ndarray) -> np.ndarray:
    """Where the edges cross some heights (pairs, heights), sorted, inf for none: (pairs, heights, crossings), their number even."""
    x0, y0, x1, y1 = (edges[:, None, :, k] for k in range(4))
    y = mid[:, :, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where((y0 < y) != (y1 < y), x0 + (y - y0) / (y1 - y0) * (x1 - x0), np.inf)
    x[np.isnan(x)] = np.inf
    x.sort(axis=2)
    most = int(np.isfinite(x).sum(2).max(initial=0))
    return x[:, :, : most + most % 2]


def _common_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    every = np.concatenate((a, b), axis=1)
    x0, y0, x1, y1 = (every[..., k] for k in range(4))
    dx, dy = x1 - x0, y1 - y0
    i, j = np.triu_indices(every.shape[1], 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cross = dx[:, i] * dy[:, j] - dy[:, i] * dx[:, j]
        ox, oy = x0[:, j] - x0[:, i], y0[:, j] - y0[:, i]
        t, u = (ox * dy[:, j] - oy * dx[:, j]) / cross, (ox * dy[:, i] - oy * dx[:, i]) / cross
        met = np.where((cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), y0[:, i] + t * dy[:, i], np.nan)
        edge = lambda f, e: f(e[..., [1, 3]].reshape(len(e), -1), axis=1)
        low, high = np.maximum(edge(np.nanmin, a), edge(np.nanmin, b)), np.minimum(edge(np.nanmax, a), edge(np.nanmax, b))
        cuts = np.concatenate((y0, y1, met), axis=1)
        cuts[~((cuts >= low[:, None]) & (cuts <= high[:, None]))] = np.nan
    cuts.sort(axis=1)  # nan last
    cuts = cuts[:, : max(1, int((~np.isnan(cuts)).sum(1).max(initial=0)))]
    tall = np.nan_to_num(np.diff(cuts, axis=1))
    mid = np.where(tall > 0, (cuts[:, :-1] + cuts[:, 1:]) / 2, np.nan)
    total = np.zeros(len(a))
    step = max(1, HELD // max(1, len(a) * every.shape[1]))
    for s in range(0, mid.shape[1], step):
        xa, xb = _spans(a, mid[:, s : s + step]), _spans(b, mid[:, s : s + step])
        length = np.zeros(xa.shape[:2])
        for k in range(0, xa.shape[2], 2):
            for m in range(0, xb.shape[2], 2):
                with np.errstate(invalid="ignore"):
                    part = np.minimum(xa[..., k + 1], xb[..., m + 1]) - np.maximum(xa[..., k], xb[..., m])
                length += np.where(part > 0, part, 0)
        total += (length * tall[:, s : s + step]).sum(1)
    return total


def common_areas(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Common areas of rings (n, 2), pair by pair.

    Between neighbouring heights of vertices and crossings the covered length is linear in height, so its value in the middle
    times the height is exact. Pairs of like sizes are worked on together.
    """
    out = np.zeros(len(a))
    sizes = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    some = [i for i in np.argsort(sizes, kind="stable").tolist() if min(len(a[i]), len(b[i])) > 2 and np.ptp(a[i][:, 1]) and np.ptp(b[i][:, 1])]
    while some:
        n = 1
        while n < len(some) and (n + 1) * int(sizes[some[n]]) ** 2 <= HELD:
            n += 1
        part, some = some[:n], some[n:]
        out[part] = _common_areas(_padded([np.asarray(a[i], float) for i in part]), _padded([np.asarray(b[i], float) for i in part]))
    return out


def intersection_area(a: np.ndarray, b: np.ndarray) -> float:
    return float(common_areas([np.asarray(a, float).reshape(-1, 2)], [np.asarray(b, float).reshape(-1, 2)])[0])


def polygon_area(ring: np.ndarray) -> float:
    return intersection_area(ring, ring)


def flat(ring: str) -> Column:
    """A ring as one array x, y, x, y, ..., as tasks in Python take it fastest."""
    return F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))


@F.pandas_udf(DoubleType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    rings = lambda s: [np.zeros((0, 2)) if x is None else x.reshape(-1, 2) for x in s]
    return pd.Series(common_areas(rings(a), rings(b)))


def with_common_area(pairs: DataFrame, a: str = "ring_a", b: str = "ring_b", out: str = "inter") -> DataFrame:
    """Exact common area of two columns of flat rings; only pairs whose boxes overlap should come here."""
    return pairs.withColumn(out, _common(F.col(a), F.col(b)))
