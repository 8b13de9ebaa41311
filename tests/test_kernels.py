"""numpy kernels against plain definitions and constructed shapes."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.functions.geometry import intersection_area, polygon_area
from tilewright.functions.raster import DISC, fill_holes, gauss3, instances, label, opening, outline, segment, sobel, watershed, without_small
from tilewright.sources.maps import Discs


def flood(mask):
    out, k = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not out[y, x]:
            k += 1
            stack = [(y, x)]
            while stack:
                v, u = stack.pop()
                if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not out[v, u]:
                    out[v, u] = k
                    stack += [(v + 1, u), (v - 1, u), (v, u + 1), (v, u - 1)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**31))
def test_label(h, w, seed):
    mask = np.random.default_rng(seed).random((h, w)) < 0.6
    assert (label(mask) == flood(mask)).all()


def test_small_objects_and_holes():
    m = np.zeros((8, 8), bool)
    m[1:5, 1:5] = True
    m[2, 2] = False
    m[7, 7] = True
    assert fill_holes(m)[2, 2] and not fill_holes(m)[0, 0]
    assert not without_small(m, 2)[7, 7] and without_small(m, 2)[1, 1]
    ring = np.zeros((5, 5), bool)
    ring[0, :] = True  # touches the border: nothing to fill
    assert (fill_holes(ring) == ring).all()
    assert opening(np.pad(DISC, 2)).sum() == DISC.sum() and not opening(np.eye(7, dtype=bool)).any()


def test_filters():
    x = np.tile(np.arange(9.0), (9, 1))
    assert np.allclose(sobel(x, 3, 1)[:, 1:-1], 8) and np.allclose(sobel(x, 3, 0), 0)
    assert np.allclose(sobel(x.T, 5, 0)[2:-2], sobel(x, 5, 1)[:, 2:-2].T)
    assert np.allclose(gauss3(np.ones((4, 4))), 1)


def test_watershed():
    s = np.array([[0.0, 1, 5, 1, 0]])
    m = np.array([[1, 0, 0, 0, 2]])
    assert watershed(s, m, np.ones((1, 5), bool)).tolist() == [[1, 1, 1, 2, 2]]
    assert watershed(s, m, np.array([[1, 1, 0, 1, 1]], bool)).tolist() == [[1, 1, 0, 2, 2]]


def test_outline():
    m = np.zeros((6, 7), bool)
    m[1:4, 2:6] = True
    assert {tuple(p) for p in outline(m)} == {(2, 1), (5, 1), (5, 3), (2, 3)}
    assert len(outline(np.zeros((3, 3), bool))) == 0
    one = np.zeros((3, 3), bool)
    one[1, 1] = True
    assert outline(one).tolist() == [[1, 1]]


def test_instances():
    labels = np.zeros((12, 12), int)
    labels[2:6, 2:6] = 1
    labels[8:11, 2:5] = 2
    classes = np.zeros((12, 12), int)
    classes[2:4, 2:6] = 2
    classes[4:6, 2:6] = 1  # a tie between 1 and 2: the lower
    got = instances(labels, classes)
    assert [(c["inst_id"], c["cls"], c["box"], c["centroid"]) for c in got] == [(1, 1, (2, 6, 2, 6), (3.5, 3.5))]  # the second is background only
    assert abs(got[0]["prob"] - 0.5) < 1e-6
    classes[8:11, 2:5] = [[0, 0, 0], [0, 0, 0], [0, 3, 3]]  # background on top: the second class
    assert instances(labels, classes)[1]["cls"] == 3
    assert instances(np.ones((5, 5), int), np.ones((5, 5), int))  # no background at all


def test_discs_are_found_once():
    provider = Discs()
    for key in [("a", 0, 0), ("b", 3, 1)]:
        m = provider.predict([key])[0]
        labels = segment(m["np"], m["hv_h"], m["hv_v"], 10, 21)
        got = instances(labels, m["tp"])
        want = provider.places(key)
        assert len(got) == len(want)
        for x, y, _, cls in want:
            assert min(abs(c["centroid"][0] - x) + abs(c["centroid"][1] - y) + 9 * (c["cls"] != cls) for c in got) < 2


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**31))
def test_area_of_stars(seed):
    rng = np.random.default_rng(seed)

    def star():
        n = rng.integers(3, 9)
        a = np.sort(rng.random(n)) * 2 * np.pi
        r = rng.uniform(3, 12, n)
        return np.stack((15 + rng.uniform(-5, 5) + r * np.cos(a), 15 + rng.uniform(-5, 5) + r * np.sin(a)), 1)

    def inside(p, x, y):
        out = np.zeros(x.shape, bool)
        for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, axis=0), strict=True):
            if y0 != y1:
                out ^= ((y0 < y) != (y1 < y)) & (x < x0 + (y - y0) / (y1 - y0) * (x1 - x0))
        return out

    a, b = star(), star()
    x, y = np.meshgrid(np.arange(-5, 36, 0.1) + 0.05, np.arange(-5, 36, 0.1) + 0.05)
    assert abs(intersection_area(a, b) - (inside(a, x, y) & inside(b, x, y)).sum() * 0.01) < 2.5
    assert abs(intersection_area(a, b) - intersection_area(b, a)) < 1e-6


def test_area_cases():
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    assert polygon_area(square) == 16
    assert intersection_area(square, square + 2) == 4
    assert intersection_area(square, square + [4, 0]) == 0
    assert polygon_area(np.array([[0, 0], [1, 1], [2, 2]], float)) == 0
    bow = np.array([[0, 0], [4, 4], [4, 0], [0, 4]], float)
    assert abs(polygon_area(bow) - 8) < 1e-9
