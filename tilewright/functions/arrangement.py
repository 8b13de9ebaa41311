"""Rings that cross or touch themselves: the plane cut by a ring's edges, and the largest simple part of what the ring encloses.

Edges are cut where they meet. Faces left of the pieces are walked, each piece followed by the next one clockwise around its end. A face is inside if the ring winds around it in the
direction of the ring's signed area; inside faces with a common piece are one part. Pieces that the ring follows both ways bound nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points nearer than this are one.
GRAIN = 1e-7


def cleaned(ring: np.ndarray) -> np.ndarray:
    """The ring without points equal to the one before, and not closed."""
    ring = np.asarray(ring, float).reshape(-1, 2)
    if len(ring):
        ring = ring[(ring != np.roll(ring, 1, axis=0)).any(1)] if len(ring) > 1 else ring
    return ring


def signed_area(ring: np.ndarray) -> float:
    x, y = ring.T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _meetings(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges and places on them, from 0 to 1, at which they meet others; neighbours meet at their common point, which is not told."""
    n = len(ring)
    a, b = ring, np.roll(ring, -1, axis=0)
    d = b - a
    i, j = np.triu_indices(n, 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    near = ((low[i] <= high[j]) & (low[j] <= high[i])).all(1)
    i, j = i[near], j[near]
    off = a[j] - a[i]
    cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (off[:, 0] * d[j, 1] - off[:, 1] * d[j, 0]) / cross
        u = (off[:, 0] * d[i, 1] - off[:, 1] * d[i, 0]) / cross
    eps = 1e-12
    hit = (cross != 0) & (t >= -eps) & (t <= 1 + eps) & (u >= -eps) & (u <= 1 + eps)
    edge, place = [i[hit], j[hit]], [t[hit], u[hit]]
    line = (cross == 0) & (off[:, 0] * d[i, 1] == off[:, 1] * d[i, 0])
    for p, q in ((i[line], j[line]), (j[line], i[line])):  # ends of q on p
        for end in (a[q], b[q]):
            s = ((end - a[p]) * d[p]).sum(1) / (d[p] ** 2).sum(1)
            on = (s >= 0) & (s <= 1)
            edge.append(p[on])
            place.append(s[on])
    return np.concatenate(edge), np.clip(np.concatenate(place), 0, 1)


def is_simple(ring: np.ndarray) -> bool:
    """Whether edges meet at common ends of neighbours only."""
    ring = cleaned(ring)
    n = len(ring)
    if n < 3 or len(np.unique(ring, axis=0)) < n:
        return False
    _, place = _meetings(ring)
    inner = ((place > 1e-9) & (place < 1 - 1e-9)).any()
    return not inner and len(place) == 2 * n  # two for each point


def _winding(ring: np.ndarray, p: np.ndarray) -> int:
    y0, y1 = ring[:, 1], np.roll(ring[:, 1], -1)
    x0, x1 = ring[:, 0], np.roll(ring[:, 0], -1)
    side = (x1 - x0) * (p[1] - y0) - (p[0] - x0) * (y1 - y0)
    return int(((y0 <= p[1]) & (y1 > p[1]) & (side > 0)).sum() - ((y0 > p[1]) & (y1 <= p[1]) & (side < 0)).sum())


def _walks(points: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[list[int]]:
    """Directed pieces in cycles: each is followed by the first one clockwise, around its end, from where it came."""
    angle = np.arctan2(points[v, 1] - points[u, 1], points[v, 0] - points[u, 0])
    leaving: dict[int, list[int]] = {}
    for e in np.lexsort((angle, u)).tolist():
        leaving.setdefault(int(u[e]), []).append(e)
    back = np.arctan2(points[u, 1] - points[v, 1], points[u, 0] - points[v, 0])
    after = np.empty(len(u), int)
    for e in range(len(u)):
        out = leaving[int(v[e])]
        k = int(np.searchsorted(angle[out], back[e] - 1e-12)) - 1  # the greatest angle below; around, the last
        after[e] = out[k]
    seen, cycles = np.zeros(len(u), bool), []
    for e in range(len(u)):
        cycle = []
        while not seen[e]:
            seen[e] = True
            cycle.append(e)
            e = int(after[e])
        if cycle:
            cycles.append(cycle)
    return cycles


def largest_part(ring: np.ndarray) -> tuple[np.ndarray, float, int]:
    """The outer border and area of the largest part that a ring encloses, and the number of parts. A simple ring is its own; without an inside it is no points and 0."""
    ring = cleaned(ring)
    if is_simple(ring):
        return ring, abs(signed_area(ring)), 1
    none = (np.zeros((0, 2)), 0.0, 0)
    if len(ring) < 3:
        return none
    edge, place = _meetings(ring)
    n = len(ring)
    edge, place = np.concatenate((edge, np.arange(n))), np.concatenate((place, np.zeros(n)))
    order = np.lexsort((place, edge))
    edge, place = edge[order], place[order]
    at = ring[edge] + place[:, None] * (np.roll(ring, -1, axis=0) - ring)[edge]
    _, first, which = np.unique(np.round(at / GRAIN).astype(np.int64), axis=0, return_index=True, return_inverse=True)
    points, which = at[first], which.ravel()
    pairs = np.stack((which, np.roll(which, -1)), 1)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    forth = pairs[:, 0] < pairs[:, 1]
    pieces, inverse = np.unique(np.sort(pairs, 1), axis=0, return_inverse=True)
    net = np.bincount(inverse.ravel(), np.where(forth, 1, -1), minlength=len(pieces))
    pieces = pieces[net != 0]
    if not len(pieces):
        return none
    m = len(pieces)
    u, v = np.concatenate((pieces[:, 0], pieces[:, 1])), np.concatenate((pieces[:, 1], pieces[:, 0]))  # piece e and its reverse e + m
    faces = _walks(points, u, v)
    area = np.array([signed_area(points[u[f]]) for f in faces])
    face_of = np.empty(2 * m, int)
    for k, f in enumerate(faces):
        face_of[f] = k
    turn = 1 if signed_area(ring) >= 0 else -1
    inside = np.zeros(len(faces), bool)
    for k, f in enumerate(faces):
        if area[k] > 0:
            p, q = points[u[f]], points[v[f]]
            long = int(((q - p) ** 2).sum(1).argmax())
            step = q[long] - p[long]
            inside[k] = turn * _winding(ring, (p[long] + q[long]) / 2 + 1e-6 * np.array([-step[1], step[0]])) > 0
    # what lies in a face without touching it is no part of it
    for k in np.flatnonzero(area < 0):
        corner = points[u[faces[k][0]]]
        holders = [g for g in np.flatnonzero(inside) if area[g] > -area[k] and not (face_of[np.isin(u, u[faces[g]])] == k).any() and _winding(points[u[faces[g]]], corner)]
        if holders:
            area[min(holders, key=lambda g: area[g])] += area[k]
    part = np.arange(len(faces))
    left, right = face_of[:m], face_of[m:]
    for a, b in zip(left, right, strict=True):
        if inside[a] and inside[b]:
            while part[a] != a:
                a = part[a]
            while part[b] != b:
                b = part[b]
            part[max(a, b)] = min(a, b)
    while (part[part] != part).any():
        part = part[part]
    if not inside.any():
        return none
    sizes = np.bincount(part[inside], area[inside], minlength=len(faces))
    best = int(sizes.argmax())
    mine = np.where(inside, part, -1) == best
    border = mine[face_of] & ~mine[np.concatenate((right, left))]
    bu, bv = u[border], v[border]
    cycles = [points[bu[c]] for c in _walks(points, bu, bv)]
    outer = max(cycles, key=signed_area)
    return outer, float(sizes[best]), len(np.unique(part[inside]))


def convex(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which of some rings turn one way at every point and go round once, so that they are simple, and the areas of all as if they were."""
    flat = np.concatenate(rings) if len(rings) else np.zeros((0, 2))
    return _convex(flat.reshape(-1, 2), np.array([len(r) for r in rings], np.int64))


def _convex(points: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of rings one after another, with n points each."""
    good, area = np.zeros(len(n), bool), np.zeros(len(n))
    some = np.flatnonzero(n > 2)
    if not len(some):
        return good, area
    p = points[np.repeat(n > 2, n)]
    first = np.cumsum(n[some]) - n[some]
    after = np.arange(1, len(p) + 1)
    after[first + n[some] - 1] = first
    d = p[after] - p
    turn = np.arctan2(d[:, 0] * d[after, 1] - d[:, 1] * d[after, 0], (d * d[after]).sum(1))
    total = np.add.reduceat(turn, first)
    one_way = (np.minimum.reduceat(turn, first) > 0) | (np.maximum.reduceat(turn, first) < 0)
    good[some] = one_way & (np.abs(np.abs(total) - 2 * np.pi) < 1e-6)
    area[some] = np.abs(np.add.reduceat(p[:, 0] * p[after, 1] - p[after, 0] * p[:, 1], first)) / 2
    return good, area


#: Outlines that a task remembers; small cells have the same one at many places.
KNOWN = 1 << 14


def fixed(points: np.ndarray, n: np.ndarray, known: dict[bytes, tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rings one after another, n points each: their largest parts likewise, how many points those have, and their areas. Each outline is cut once, and `known` from then on."""
    good, area = _convex(points, n)
    first = np.cumsum(n) - n
    count, cut = n.copy(), []
    area[n == 0] = 0.0
    rest = np.flatnonzero(~good & (n > 0))
    for size in np.unique(n[rest]).tolist():
        rows = rest[n[rest] == size]
        shapes = points[first[rows][:, None] + np.arange(size)]
        at = shapes[:, :1].copy()
        shapes = np.ascontiguousarray((shapes - at).reshape(len(rows), -1))
        _, one, which = np.unique(shapes.view(f"V{shapes.itemsize * shapes.shape[1]}").ravel(), return_index=True, return_inverse=True)
        order = np.argsort(which, kind="stable")
        for k, own in zip(one.tolist(), np.split(rows[order], np.cumsum(np.bincount(which))[:-1]), strict=True):
            key = shapes[k].tobytes()
            if key not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known[key] = largest_part(shapes[k].reshape(-1, 2))[:2]
            part, whole = known[key]
            count[own], area[own] = len(part), whole
            cut.append((own, part))
    out = np.empty((count.sum(), 2))
    start = np.cumsum(count) - count
    kept = good | (n == 0)
    out[np.repeat(kept, count)] = points[np.repeat(kept, n)]
    for own, part in cut:
        out[start[own][:, None] + np.arange(len(part))] = part + points[first[own]][:, None]
    return out, count, area


def repaired(cells: DataFrame, ring: str = "contour", out: str = "outline", area: str = "area") -> DataFrame:
    """Add the outer border of the largest part of a ring of points (x, y), flat, and its area."""

    @F.arrow_udf("struct<ring:array<double>,area:double>")
    def parts(rings: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, tuple[np.ndarray, float]] = {}
        for lists in rings:
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            points, count, sizes = fixed(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2), n, known)
            ends = pa.array(np.concatenate(([0], np.cumsum(2 * count))), pa.int32())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(points.ravel())), pa.array(sizes)], ["ring", "area"])

    flat = F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    rows = cells.withColumn("_fixed", parts(flat))
    return rows.withColumns({out: F.col("_fixed.ring"), area: F.col("_fixed.area")}).drop("_fixed")
