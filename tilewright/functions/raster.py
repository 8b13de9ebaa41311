"""numpy kernels on the raw maps of one tile: from probabilities and distances to outlined, classified instances.

Components connect over the four sides. Borders are mirrored with the border pixel as axis. Nothing here needs an
image library; equality with one is meant in effect on shapes, not pixel for pixel.
"""

from __future__ import annotations

import numpy as np


def label(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 in the order in which a component is met row by row; 0 outside. Runs of pixels are joined, not pixels."""
    h, w = mask.shape
    wide = w + 2
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))).ravel())
    starts, ends = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    # the runs one row below that a run touches
    low, high = np.searchsorted(ends, starts + wide, "right"), np.searchsorted(starts, ends + wide, "left")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(starts)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(len(starts))
    while len(a):
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    names = np.unique(root, return_inverse=True)[1] + 1 if len(root) else root
    out = np.zeros(h * wide + 1, np.int32)
    out[starts] = names
    np.subtract.at(out, ends, names)
    return np.cumsum(out[:-1], dtype=np.int32).reshape(h, wide)[:, 1:-1]


def without_small(labels: np.ndarray, least: int) -> np.ndarray:
    """Components of fewer pixels than `least` become 0; a mask is labelled first."""
    if labels.dtype == bool:
        labels = label(labels)
    keep = np.bincount(labels.ravel()) >= least
    return np.where(keep[labels], labels, 0)


def minmax(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    low, high = x.min(), x.max()
    return (x - low) / (high - low) if high > low else np.zeros_like(x)


def _along(x: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along an axis of the last two (1: x); leading axes number rasters."""
    r, at = len(k) // 2, x.ndim - 2 + axis
    pad = [(0, 0)] * x.ndim
    pad[at] = (r, r)
    n = x.shape[at]
    p = np.pad(x, pad, mode="reflect") if n > r else np.pad(x, pad, mode="edge")
    out = np.zeros_like(x, dtype=np.float64)
    for i, c in enumerate(k):
        out += c * (p[..., i : i + n] if axis == 1 else p[..., i : i + n, :])
    return out


def kernels(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Binomial weights of that odd size, and those of the first derivative."""
    smooth, slope = np.array([1.0]), np.array([1.0])
    for _ in range(size - 1):
        smooth = np.convolve(smooth, [1, 1])
    for _ in range(size - 2):
        slope = np.convolve(slope, [1, 1])
    return smooth, np.convolve(slope, [1, -1])[::-1]


def sobel(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """First derivative along an axis (1: x), smoothed across it, not normalised."""
    smooth, slope = kernels(size)
    return _along(_along(x.astype(np.float64), slope, axis), smooth, 1 - axis)


def gauss3(x: np.ndarray) -> np.ndarray:
    k = np.array([0.25, 0.5, 0.25])
    return _along(_along(x.astype(np.float64), k, 1), k, 0)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that does not reach the border becomes foreground."""
    outside = label(np.pad(~mask.astype(bool), 1, constant_values=True))
    return ~(outside == outside[0, 0])[1:-1, 1:-1]


#: A disc of five pixels across: single pixels above and below, else full rows.
DISC = np.array([[0, 0, 1, 0, 0], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [0, 0, 1, 0, 0]], bool)


def _morph(mask: np.ndarray, shape: np.ndarray, erode: bool) -> np.ndarray:
    r = shape.shape[0] // 2
    p = np.pad(mask, [(0, 0)] * (mask.ndim - 2) + [(r, r)] * 2, constant_values=erode)  # beyond the border nothing counts
    h, w = mask.shape[-2:]
    parts = [p[..., dy : dy + h, dx : dx + w] for dy, dx in zip(*np.nonzero(shape), strict=True)]
    return np.logical_and.reduce(parts) if erode else np.logical_or.reduce(parts)


def opening(mask: np.ndarray, shape: np.ndarray = DISC) -> np.ndarray:
    return _morph(_morph(mask.astype(bool), shape, True), shape[::-1, ::-1], False)


def _neighbours(at: np.ndarray, w: int, size: int) -> np.ndarray:
    """Of some pixels of a raster with a margin, given by place: where among them the ones above, left, right and below are, len(at) for none."""
    where = np.full(size, len(at))
    where[at] = np.arange(len(at))
    return where[at[:, None] + np.array([-w, -1, 1, w])]


def watershed(surface: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Flood from the markers within the mask: each pixel goes to the marker whose flood comes first.

    A part of the mask with one marker is that marker's. Elsewhere the level of a pixel is the least height at which a flood reaches it, found for all pixels at once by taking the
    lowest neighbour until nothing changes; on a plain, steps from its edge count. A pixel then follows its neighbour of least level and steps, up to a marker.
    """
    part = label(mask)
    held = np.where(mask, markers, 0)
    pairs = np.unique(part[held > 0].astype(np.int64) << 32 | held[held > 0])
    parts, names = (pairs >> 32).astype(np.int64), (pairs & 0xFFFFFFFF).astype(np.int32)
    owner = np.zeros(int(part.max(initial=0)) + 1, np.int32)
    owner[parts] = names
    many = np.bincount(parts, minlength=len(owner)) > 1
    out = np.where(held > 0, held, owner[part]).astype(np.int32)
    if not many.any():
        return out
    w = mask.shape[1] + 2
    wide = lambda x: np.pad(x, 1).ravel()
    at = np.flatnonzero(wide(many[part]))
    near = _neighbours(at, w, (mask.shape[0] + 2) * w)
    height, name = wide(surface.astype(np.float64))[at], wide(held)[at]
    free = np.flatnonzero(name == 0)

    def settled(value: np.ndarray, better) -> None:
        """Renew values until none changes; only those beside a change are looked at again."""
        active = free
        while len(active):
            new = better(active)
            less = new < value[active]
            changed = active[less]
            value[changed] = new[less]
            beside = np.zeros(len(at) + 1, bool)
            beside[near[changed]] = True
            beside[-1] = False
            active = np.flatnonzero(beside[:-1] & (name == 0))

    level = np.append(np.where(name > 0, height, np.inf), np.inf)
    settled(level, lambda i: np.maximum(height[i], level[near[i]].min(1)))
    steps = np.append(np.where(name > 0, 0.0, np.inf), np.inf)
    low = np.append(level[near].min(1), np.inf)
    settled(steps, lambda i: np.where(low[i] < level[i], 0.0, np.where(level[near[i]] == level[i][:, None], steps[near[i]], np.inf).min(1)) + 1)
    order = np.lexsort((steps[near[free]].ravel(), level[near[free]].ravel(), np.repeat(np.arange(len(free)), 4)))[::4]
    to = np.arange(len(at))
    to[free] = near[free].ravel()[order]
    while (to[to] != to).any():
        to = to[to]
    flat = wide(out)
    flat[at] = name[to]
    return flat.reshape(-1, w)[1:-1, 1:-1]


def segment(probability: np.ndarray, across: np.ndarray, down: np.ndarray, least: int, kernel: int) -> np.ndarray:
    """Instances of one tile from nucleus probability and distance maps across (x) and down (y)."""
    blob = without_small(label(probability >= 0.5), least) > 0
    edge = np.maximum(1 - minmax(sobel(minmax(across), kernel, 1)), 1 - minmax(sobel(minmax(down), kernel, 0)))
    energy = np.maximum(edge - (1 - blob), 0)
    surface = -gauss3((1 - energy) * blob)
    core = np.maximum(blob.astype(int) - (energy >= 0.4), 0) > 0
    markers = without_small(label(opening(fill_holes(core))), least)
    return watershed(surface, markers, blob)


_ROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]  # clockwise from the right
#: By the set of directions in which an equal pixel lies, and the one looked from: the first of them clockwise; 8 for none.
_TURN = np.array([[next((d for k in range(8) if around >> (d := (look + 1 + k) % 8) & 1), 8) for look in range(8)] for around in range(256)])


def outlines(labels: np.ndarray, least: int = 1) -> dict[int, np.ndarray]:
    """The outer border of each label's component that is met first, as (x, y), with only the points where the direction changes; all points of a border
    of one or two pixels, and none of one of fewer than `least`.

    Where a border goes from a pixel follows from which of its eight neighbours are alike and where it came from; that is looked up, and all borders of the raster are walked
    side by side, a step of each at a time.
    """
    h, w = labels.shape
    wide = w + 2
    p = np.pad(labels, 1).ravel()
    on = np.flatnonzero(p)
    if not len(on):
        return {}
    move = np.array([dy * wide + dx for dy, dx in _ROUND])
    around = np.zeros(len(p), np.int64)
    around[on] = ((p[on[:, None] + move] == p[on][:, None]) << np.arange(8)).sum(1)
    names, first = np.unique(p[on], return_index=True)
    start = on[first]
    leave = _TURN[around[start], 4]
    which = np.flatnonzero(leave < 8)
    here, d = start[which], leave[which]
    paths = [(which, here)]
    while len(which):
        here = here + move[d]
        d = _TURN[around[here], (d + 4) % 8]
        going = (here != start[which]) | (d != leave[which])
        which, here, d = which[going], here[going], d[going]
        paths.append((which, here))
    whose, place = np.concatenate([a for a, _ in paths]), np.concatenate([b for _, b in paths])
    order = np.argsort(whose, kind="stable")
    whose, place = whose[order], place[order]
    ends = np.searchsorted(whose, np.arange(len(names) + 1))
    out = {}
    for i, name in enumerate(names.tolist()):
        ring = place[ends[i] : ends[i + 1]] if leave[i] < 8 else start[i : i + 1]
        if len(ring) < least:
            continue
        ring = np.stack((ring % wide - 1, ring // wide - 1), 1).astype(float)
        before, after = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
        out[name] = ring[(before != after).any(1)] if len(ring) > 2 else ring
    return out


def outline(mask: np.ndarray) -> np.ndarray:
    """The outer border of the component of a mask that is met first."""
    return outlines(mask.astype(np.int32)).get(1, np.zeros((0, 2)))


def instances(labels: np.ndarray, classes: np.ndarray) -> list[dict]:
    """Contour, box (half open), centroid, class and score of each instance; without a contour or a class it is left out.

    The class is the most frequent one, the lower on ties; background only if nothing else occurs, and then the instance goes.
    The score's denominator counts background pixels as well. Contours do not see the last row and column.
    """
    y, x = np.nonzero(labels > 0)
    if not len(y):
        return []
    names, of = np.unique(labels[y, x], return_inverse=True)
    n = np.bincount(of)
    order = np.argsort(of, kind="stable")
    cut = np.concatenate(([0], np.cumsum(n)[:-1]))
    edge = lambda f, v: f.reduceat(v[order], cut)
    y0, y1, x0, x1 = edge(np.minimum, y), edge(np.maximum, y) + 1, edge(np.minimum, x), edge(np.maximum, x) + 1
    cy, cx = np.bincount(of, y) / n, np.bincount(of, x) / n
    cls = classes[y, x].astype(np.int64)
    width = int(cls.max()) + 1
    votes = np.bincount(of * width + cls, minlength=len(names) * width).reshape(len(names), width)
    real = votes.copy()
    real[:, 0] = 0
    # background is passed over for the next class, if there is one
    pick = real.argmax(1)
    rings = outlines(labels[:-1, :-1])
    out = []
    for i, k in enumerate(names.tolist()):
        ring = rings.get(k)
        if ring is None or len(ring) < 3 or not real[i, pick[i]]:
            continue
        out.append({"inst_id": k, "contour": ring, "box": (int(y0[i]), int(y1[i]), int(x0[i]), int(x1[i])), "centroid": (float(cx[i]), float(cy[i])), "cls": int(pick[i]), "prob": float(votes[i, pick[i]] / (n[i] + 1e-6))})
    return out
