"""Floods, borders, self-crossing rings and the spatial join against plain definitions."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import arrangement, raster
from tilewright.operators import dedup, segments


def flooded(surface, markers, mask):
    """Pixel by pixel, the lowest first, then the oldest."""
    h, w = surface.shape
    out = np.where(mask, markers, 0).astype(int)
    heap = [(surface[y, x], k, y, x) for k, (y, x) in enumerate(zip(*np.nonzero(out), strict=True))]
    heapq.heapify(heap)
    age = len(heap)
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for v, u in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= v < h and 0 <= u < w and mask[v, u] and not out[v, u]:
                out[v, u] = out[y, x]
                heapq.heappush(heap, (surface[v, u], age, v, u))
                age += 1
    return out


def traced(mask):
    """The outer border, step by step around its pixels."""
    steps = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    at = np.argwhere(mask)
    if not len(at):
        return []
    p = np.pad(mask, 1)
    start = here = tuple(at[0] + 1)
    path, look, first = [], 4, None
    while True:
        d = next((d for k in range(8) if p[here[0] + steps[d := (look + 1 + k) % 8][0], here[1] + steps[d][1]]), None)
        if d is None or (here, d) == first:
            break
        first = first or (here, d)
        path.append((here, d))
        here, look = (here[0] + steps[d][0], here[1] + steps[d][1]), (d + 4) % 8
    assert start == tuple(at[0] + 1)
    return [(float(x - 1), float(y - 1)) for i, ((y, x), d) in enumerate(path) if d != path[i - 1][1]] if len(path) > 2 else []


def test_watershed():
    rng = np.random.default_rng(0)
    for t in range(200):
        h, w = rng.integers(3, 30, 2)
        mask, surface, markers = rng.random((h, w)) < rng.choice([0.5, 0.75, 0.95, 1]), rng.normal(size=(h, w)), np.zeros((h, w), int)
        if t % 3 == 0:
            surface = raster.gauss3(surface)
        for k in range(rng.integers(0, 6)):
            y, x = rng.integers(0, h), rng.integers(0, w)
            markers[y : y + rng.integers(1, 3), x : x + rng.integers(1, 3)] = k + 1
        assert (raster.watershed(surface, markers, mask) == flooded(surface, markers, mask)).all()


def test_watershed_on_plains():
    """The same pixels are reached; the nearer marker gets them."""
    markers = np.zeros((1, 12), int)
    markers[0, 1], markers[0, 10] = 1, 2
    assert raster.watershed(np.zeros((1, 12)), markers, np.ones((1, 12), bool)).tolist() == [[1] * 6 + [2] * 6]
    rng = np.random.default_rng(1)
    for _ in range(50):
        mask, surface, markers = rng.random((15, 15)) < 0.8, rng.integers(0, 3, (15, 15)).astype(float), rng.integers(0, 3, (15, 15)) * (rng.random((15, 15)) < 0.05)
        got = raster.watershed(surface, markers, mask)
        assert ((got > 0) == (flooded(surface, markers, mask) > 0)).all() and (got[(markers > 0) & mask] == markers[(markers > 0) & mask]).all()


def test_outlines():
    rng = np.random.default_rng(2)
    for t in range(150):
        h, w = rng.integers(2, 25, 2)
        labels = raster.label(rng.random((h, w)) < 0.6) if t % 2 else rng.integers(0, 5, (h, w))
        got = raster.outlines(labels, 3)
        for k in np.unique(labels[labels > 0]).tolist():
            want = traced(labels == k)
            assert (got[k].tolist() if k in got else []) == [list(p) for p in want]


def test_instances():
    rng = np.random.default_rng(3)
    labels = raster.label(np.kron(rng.random((8, 8)) < 0.5, np.ones((4, 4))) > 0)
    classes = rng.integers(0, 4, labels.shape)
    got = {c["inst_id"]: c for c in raster.instances(labels, classes)}
    for k in range(1, labels.max() + 1):
        y, x = np.nonzero(labels == k)
        votes = np.bincount(classes[y, x], minlength=4)
        ring = traced((labels == k)[:-1, :-1])
        if len(ring) < 3 or not votes[1:].any():
            assert k not in got
            continue
        c = got[k]
        assert c["box"] == (y.min(), y.max() + 1, x.min(), x.max() + 1) and np.allclose(c["centroid"], (x.mean(), y.mean())) and c["contour"].tolist() == [list(p) for p in ring]
        assert c["cls"] == 1 + votes[1:].argmax() and np.isclose(c["prob"], votes[c["cls"]] / (len(y) + 1e-6))
    assert raster.instances(np.zeros((5, 5), int), np.zeros((5, 5), int)) == []


def sampled_area(ring, turn, n=300):
    """Area of the largest part on a fine raster: at least, with the places where edges meet cut out so that parts that touch there fall apart, and at most, without."""
    grid = (np.arange(n) + 0.5003) * 9 / n
    x, y = np.meshgrid(grid, grid)
    wind, near = np.zeros((n, n), int), np.zeros((n, n), bool)
    nxt = np.roll(ring, -1, axis=0)
    for (x0, y0), (x1, y1) in zip(ring, nxt, strict=True):
        side = (x1 - x0) * (y - y0) - (x - x0) * (y1 - y0)
        wind += ((y0 <= y) & (y1 > y) & (side > 0)).astype(int) - ((y0 > y) & (y1 <= y) & (side < 0))
    points = [*map(tuple, ring)]
    for i in range(len(ring)):
        for j in range(i):
            d, e, o = nxt[i] - ring[i], nxt[j] - ring[j], ring[j] - ring[i]
            cross = d[0] * e[1] - d[1] * e[0]
            if cross:
                t, u = (o[0] * e[1] - o[1] * e[0]) / cross, (o[0] * d[1] - o[1] * d[0]) / cross
                if 0 <= t <= 1 and 0 <= u <= 1:
                    points.append(tuple(ring[i] + t * d))
    for px, py in set(points):
        near |= (x - px) ** 2 + (y - py) ** 2 < 0.15**2
    size = lambda mask: np.bincount(raster.label(mask).ravel(), minlength=2)[1:].max() * (9 / n) ** 2
    return size((wind * turn > 0) & ~near), size(wind * turn > 0)


def test_largest_part_of_random_rings():
    rng = np.random.default_rng(4)
    crossing = 0
    for _ in range(120):
        ring = arrangement.cleaned(rng.integers(0, 9, (rng.integers(4, 9), 2)))
        if len(ring) < 3 or not arrangement.signed_area(ring):
            continue
        border, area, parts = arrangement.largest_part(ring)
        least, most = sampled_area(ring, 1 if arrangement.signed_area(ring) > 0 else -1)
        assert least - 0.1 <= area <= most + 0.1, ring.tolist()
        crossing += not arrangement.is_simple(ring)
        if parts == 1 and arrangement.is_simple(ring):
            assert border.tolist() == ring.tolist()
        assert abs(arrangement.signed_area(border)) >= area - 1e-9
    assert crossing > 60


def test_largest_part_of_known_rings():
    part = lambda *r: (lambda p: (p[0].tolist(), round(p[1], 9), p[2]))(arrangement.largest_part(np.array(r, float)))
    assert part((0, 0), (4, 3), (4, 0), (0, 1))[1:] == (4.5, 1)  # a bow-tie: the other lobe is wound the other way
    assert part((0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4))[1:] == (4, 2)  # two triangles that touch
    assert part((0, 0), (4, 0), (4, 4), (2, 4), (2, 8), (2, 4), (0, 4))[1:] == (16, 1)  # a spike
    assert part((0, 0), (10, 0), (10, 10), (0, 10), (0, 0), (3, 3), (3, 6), (6, 6), (6, 3), (3, 3))[1:] == (91, 1)  # a hole at the end of a bridge
    assert part((0, 0), (2, 0), (4, 0)) == ([], 0, 0) and part((0, 0), (1, 1)) == ([], 0, 0) and part() == ([], 0, 0)
    assert part((0, 0), (4, 0), (4, 4), (4, 4), (0, 4), (0, 0))[1:] == (16, 1)  # closed, and a point twice


def test_convex_rings():
    square, star, spiral = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float), np.array([(np.cos(a), np.sin(a)) for a in np.arange(5) * 4 * np.pi / 5]), np.array([(0, 0), (4, 0), (1, 1), (0, 4)], float)
    good, area = arrangement.convex([square, np.zeros((0, 2)), star, square[::-1], spiral, square[:2]])
    assert good.tolist() == [True, False, False, True, False, False] and area[0] == 4


def test_repaired_column(spark):
    rows = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 3.0), (4.0, 0.0), (0.0, 1.0)]), (2, [(10.0, 0.0), (14.0, 3.0), (14.0, 0.0), (10.0, 1.0)]), (3, []), (4, None), (5, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "id int, contour array<struct<x:double,y:double>>")
    got = {r.id: (r.area, len(r.outline)) for r in arrangement.repaired(rows).collect()}
    assert got == {1: (4.5, 6), 2: (4.5, 6), 3: (0.0, 0), 4: (0.0, 0), 5: (0.5, 6)}


def test_outlines_are_cut_once(monkeypatch):
    """Rings of a few shapes at many places, in several batches: each shape is cut once, and every place has its own part."""
    cuts, cut = [], arrangement.largest_part
    monkeypatch.setattr(arrangement, "largest_part", lambda r: (cuts.append(len(r)), cut(r))[1])
    shapes = [np.array(s, float) for s in ([(0, 0), (4, 3), (4, 0), (0, 1)], [(0, 0), (4, 1), (4, 0), (0, 3)], [(0, 0), (2, 0), (2, 2), (0, 2)], [(0, 0), (1, 1)], [], [(0, 0), (4, 0), (1, 1), (0, 4)])]
    rng, known = np.random.default_rng(4), {}
    for _ in range(3):
        rings = [shapes[k].reshape(-1, 2) + rng.integers(-50, 50, 2) for k in rng.integers(0, 6, 60)]
        points, count, area = arrangement.fixed(np.concatenate(rings), np.array([len(r) for r in rings]), known)
        for r, own, a in zip(rings, np.split(points, np.cumsum(count)[:-1]), area, strict=True):
            want = cut(r)
            assert sorted(map(tuple, own.round(6).tolist())) == sorted(map(tuple, want[0].round(6).tolist())) and a == pytest.approx(want[1])
    assert sorted(cuts) == [2, 4, 4, 4]


@pytest.mark.parametrize("leaf", [4, 256])
def test_box_pairs(spark, leaf):
    rng = np.random.default_rng(5)
    x, y = np.concatenate((rng.integers(-500, 3000, (500, 2)), rng.integers(100, 130, (300, 2)), np.full((20, 2), 64))).T
    size = np.concatenate((rng.integers(1, 90, (790, 2)), np.full((30, 2), 700)))
    rng.shuffle(size)
    rows = [(int(k % 3), k, float(x[k]), float(x[k] + size[k, 0]), float(y[k]), float(y[k] + size[k, 1]), float(size[k].prod())) for k in range(len(x))]
    cells = spark.createDataFrame(rows, "slide long, seq long, x0 double, x1 double, y0 double, y1 double, area double")
    got = sorted((r.slide_a, r.seq_a, r.seq_b, r.box_area) for r in dedup.box_pairs(cells, leaf).collect())
    want = []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            w, h = min(a[3], b[3]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[4], b[4])
            if a[0] == b[0] and w > 0 and h > 0 and w * h >= 0.01 * min(a[6], b[6]):
                want.append((a[0], a[1], b[1], w * h))
    assert got == sorted(want)
    assert dedup.box_pairs(cells.limit(0), leaf).count() == 0


def test_leaves_are_even(spark):
    """A hundred thousand boxes in one place and some that span all of it: leaves of like size, and few boxes in several."""
    n = 100_000
    rows = spark.range(n).select(F.lit(0).alias("slide"), F.col("id").alias("seq"), *[(F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(64_000)) / 1000).alias(c) for s, c in enumerate(("x0", "y0"))])
    rows = rows.withColumns({"x1": F.col("x0") + 0.05, "y1": F.col("y0") + 0.05, "area": F.lit(0.0025)})
    wide = spark.range(5).select(F.lit(0).alias("slide"), (F.col("id") + n).alias("seq"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(784.0).alias("x1"), F.lit(784.0).alias("y1"), F.lit(784.0 * 784).alias("area"))
    sizes = dedup.dealt(rows.unionByName(wide)).groupBy("leaf").count().toPandas()["count"]
    assert 300 < len(sizes) < 600 and sizes.max() < 2 * sizes.median() and sizes.sum() < 1.15 * n


def test_layout_of_leaves_stays_apart(spark):
    """What a box meets of its slide's layout is the cuts of a slab, not all leaves."""
    rows = spark.range(100_000).select(F.lit(0).alias("slide"), F.col("id").alias("seq"), *[F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(64_000)).alias(c) for s, c in enumerate(("x0", "y0"))])
    cut = dedup.leaves(rows)
    assert cut.select(F.max(F.length(F.to_json(F.struct(*cut.columns))))).first()[0] < 1500  # all of 390 leaves take over 10,000


def test_sweep_of_leaves(monkeypatch):
    """Boxes of several leaves at once, a few pairs at a time, in any order."""
    monkeypatch.setattr(dedup, "PAIRS", 7)
    rng = np.random.default_rng(8)
    x0, y0 = rng.integers(0, 40, (2, 200)).astype(float)
    x1, y1, leaf = x0 + rng.integers(1, 9, 200), y0 + rng.integers(1, 9, 200), np.sort(rng.integers(0, 5, 200))
    got = sorted(tuple(sorted(p)) for i, j in dedup._meeting(leaf, x0, x1, y0, y1) for p in zip(i.tolist(), j.tolist(), strict=True))
    meet = lambda i, j: leaf[i] == leaf[j] and x0[i] < x1[j] and x0[j] < x1[i] and y0[i] < y1[j] and y0[j] < y1[i]
    assert got == [(i, j) for i in range(200) for j in range(i + 1, 200) if meet(i, j)]


def test_basins_and_corners_of_any_raster(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=30).tolist(), (rng.integers(1, 4, 30) * (rng.random(30) < 0.15)).tolist(), (rng.random(30) < 0.8).tolist()) for k in range(40)]
    table = spark.createDataFrame(rows, "key long, surface array<double>, markers array<int>, inside array<boolean>")
    pixels = segments.basins(table, "key", 5, 6)
    shaped = lambda v: np.array(v).reshape(5, 6)
    want = {(k, y, x, int(v)) for k, s, m, i in rows for (y, x), v in np.ndenumerate(flooded(shaped(s), shaped(m), shaped(i))) if v}
    assert {tuple(map(int, r)) for r in pixels.collect()} == want
    got = {}
    for r in segments.corners(pixels, "key", 5, 6).orderBy("ordinal").collect():
        got.setdefault((r.key, r.label), []).append((float(r.x), float(r.y)))
    for k, s, m, i in rows:
        labels = flooded(shaped(s), shaped(m), shaped(i))
        for name in np.unique(labels[labels > 0]).tolist():
            assert got.get((k, name), []) == traced(labels == name)
    low = table.select("key", "surface", segments.minima(F.col("surface"), 5, 6, F.col("inside")).alias("m")).collect()
    for (_, s, _, i), r in zip(rows, low, strict=True):
        v = np.pad(np.where(shaped(i), shaped(s), np.inf), 1, constant_values=np.inf)
        lower = shaped(i) & (v[1:-1, 1:-1] < np.minimum.reduce([v[:-2, 1:-1], v[2:, 1:-1], v[1:-1, :-2], v[1:-1, 2:]]))
        assert shaped(r.m).tolist() == lower.tolist()
