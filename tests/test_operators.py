"""Operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from tilewright.functions import packed
from tilewright.functions.geometry import closed, shoelace
from tilewright.operators import assign, dedup, pyramid, tiling, tissue
from tilewright.operators.components import components
from tilewright.operators.project import offset, project

CELL = "slide long, seq long, icol long, irow long, y0 double, y1 double, x0 double, x1 double, cx double, cy double, area double"


def cells(spark, *boxes):
    """seq, icol, irow, y0, y1, x0, x1"""
    return spark.createDataFrame([(0, s, c, r, float(a), float(b), float(x), float(y), (x + y) / 2, (a + b) / 2, float((b - a) * (y - x))) for s, c, r, a, b, x, y in boxes], CELL)


def near(spark, *box):
    got = project(cells(spark, (1, 3, 2, *box))).first()
    return None if got.border_tiles is None else [(t.col, t.row) for t in got.border_tiles]


def test_flags_and_neighbours(spark):
    assert near(spark, 0, 9, 100, 110) == [(3, 1)]
    assert near(spark, 775, 784, 100, 110) == [(3, 3)]
    assert near(spark, 100, 110, 0, 9) == [(2, 2)]
    assert near(spark, 100, 110, 775, 784) == [(4, 2)]
    assert near(spark, 0, 9, 775, 784) == [(3, 1), (4, 1), (4, 2)]
    assert near(spark, 775, 784, 775, 784) == [(4, 2), (4, 3), (3, 3)]
    assert near(spark, 775, 784, 0, 9) == [(3, 3), (2, 3), (2, 2)]
    assert near(spark, 0, 9, 0, 9) == [(2, 2), (2, 1), (3, 1)]
    assert near(spark, 0, 784, 100, 200) is None  # opposite sides
    assert near(spark, 0, 784, 0, 50) is None  # three sides
    assert near(spark, 100, 110, 100, 110) is None
    got = project(cells(spark, (1, 0, 0, 64, 720, 64, 720), (2, 0, 0, 63, 80, 100, 120), (3, 0, 0, 0, 9, 5, 9))).orderBy("seq").collect()
    assert [(r.safe, r.touching) for r in got] == [(True, False), (False, False), (False, True)]
    assert (got[0].off_x, got[0].y0) == (-64, 0.0)


def test_offsets_and_rounding(spark):
    one = spark.range(3).select(offset(col("id")).alias("o"), offset(col("id"), edge_origin="pyramid").alias("p")).collect()
    assert [(r.o, r.p) for r in one] == [(-64, 0), (592, 592), (1248, 1248)]
    rows = project(cells(spark, *[(i, 0, 0, 100, 110, 64 + i, 65 + i) for i in range(3)])).orderBy("seq").collect()
    assert [r.cx for r in rows] == [0.0, 2.0, 2.0]  # 0.5, 1.5, 2.5 to even


def test_border_retention(spark):
    rows = project(cells(spark, (1, 0, 0, 100, 110, 775, 784), (2, 1, 0, 300, 310, 300, 310)))
    assert {r.seq for r in dedup.retain_border(rows).collect()} == {1, 2}  # the neighbour holds safe cells only
    assert {r.seq for r in dedup.retain_border(rows, all_tiles=True).collect()} == {2}
    rows = project(cells(spark, (1, 0, 0, 100, 110, 775, 784), (2, 1, 0, 300, 310, 20, 30), (3, 0, 0, 0, 784, 100, 200)))
    assert {r.seq for r in dedup.retain_border(rows).collect()} == {2}


def unique(spark, *boxes, **options):
    from tilewright.plans.chain import unique_cells

    return sorted(r.seq for r in unique_cells(cells(spark, *boxes), **options).collect())


def test_overlaps(spark):
    a, b, c = (1, 0, 0, 100, 120, 100, 120), (2, 0, 0, 100, 130, 115, 140), (3, 0, 0, 100, 120, 135, 155)
    assert unique(spark, a, b, c) == [2]  # a chain keeps the largest
    assert unique(spark, a, (2, 0, 0, 100, 120, 120, 140)) == [1, 2]  # a shared edge
    assert unique(spark, (1, 0, 0, 30, 50, 100, 120), (2, 0, 0, 45, 65, 110, 130)) == [1]  # equal areas: least seq
    assert unique(spark, (1, 0, 0, 50, 70, 100, 120), (2, 0, 0, 66, 86, 110, 130)) == [2]  # equal areas: the safe one
    assert unique(spark, (1, 0, 0, 100, 110, 100, 110), (2, 0, 0, 109, 119, 109, 119)) == [1]  # 1 of 100: at the threshold
    assert unique(spark, (1, 0, 0, 100, 110, 100, 110), (2, 0, 0, 109, 119, 109, 119), threshold=0.02) == [1, 2]
    assert unique(spark, (1, 0, 0, 100, 110, 100, 110), (2, 0, 0, 98, 112, 98, 112)) == [1]  # one centroid: the first
    assert unique(spark) == []
    with pytest.raises(ValueError):
        unique(spark, a, threshold=0)
    with pytest.raises(ValueError):
        unique(spark, a, threshold=1.5)


def test_result_does_not_depend_on_partitions(spark):
    import random

    rng = random.Random(1)
    boxes = [(i, rng.randrange(2), rng.randrange(2), (y := rng.randrange(700)), y + rng.randrange(8, 40), (x := rng.randrange(700)), x + rng.randrange(8, 40)) for i in range(300)]
    first = unique(spark, *boxes)
    rng.shuffle(boxes)
    assert unique(spark, *boxes, leaf=8) == first


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_components(spark, monkeypatch, held):
    """With rounds alone, and with the rest joined by one task."""
    import random

    from tilewright.operators import components as module

    monkeypatch.setattr(module, "HELD", held)

    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_are_put_aside(spark, monkeypatch):
    """Components that are done take no part in further rounds."""
    from tilewright.operators import components as module

    sizes, write = [], module.checkpointed
    monkeypatch.setattr(module, "HELD", 50)
    monkeypatch.setattr(module, "checkpointed", lambda df: (out := write(df), sizes.append(out.count()))[0])
    edges = [(10_000 + i, i) for i in range(0, 5000, 5)] + [(20_000 + i, 20_001 + i) for i in range(200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(60)).collect()}
    assert got == {n: i for i in range(0, 5000, 5) for n in (i, 10_000 + i)} | {20_000 + i: 20_000 for i in range(201)}
    assert sizes[0] >= 1000 and max(sizes[3:]) < 300


def test_assign(spark):
    tiles = spark.createDataFrame([(0, 1, 0, 0), (0, 2, 1, 0), (0, 3, 0, 0), (0, 4, 5, 5)], "slide long, tile_seq long, col long, row long")
    rows = project(cells(spark, (1, 0, 0, 164, 174, 164, 174), (2, 0, 0, 0, 10, 0, 10), (3, 0, 0, 170, 190, 300, 320)))
    got = assign.number(assign.assign(tiles, rows)).orderBy("tile_seq", "cell_id").collect()
    assert [(r.tile_seq, r.seq, r.cell_id) for r in got] == [(1, 1, 0), (2, 3, 0), (3, 1, 0), (4, None, None)]  # repeated tile, empty tile, negative tile
    assert got[1].x0 == 300 - 64 - 224
    lists = assign.collected(assign.number(assign.assign(tiles, rows)), ("slide", "tile_seq"), ("seq",)).orderBy("tile_seq").collect()
    assert [len(r.cells) for r in lists] == [1, 1, 1, 0]


def test_resolution(spark):
    rows = spark.createDataFrame([(0.3, None, None), (None, 0.5, None), (None, 20000.0, "inch"), (None, 20000.0, "cm"), (None, 20000.0, "pixel"), (None, None, None)], "m double, x double, u string")
    assert [r[0] for r in rows.select(pyramid.mpp(col("m"), col("x"), col("u"))).collect()] == [0.3, 0.5, 1.27, 0.5, None, None]
    one = lambda m, t: spark.createDataFrame([(m,)], "m double").select(*pyramid.nearest_level(col("m"), F.lit(5), t)).first()
    assert one(0.25, 0.5)[::2] == (3, "ok")
    assert one(0.25, 0.75)[::2] == (2, "mpp_not_available")  # a tie: the coarser level, off by a third
    assert one(None, 0.25)[::2] == (4, "ok")
    assert one(0.25, 0.1)[2] == "mpp_not_available"


def test_nearest_level_of_any_resolution(spark):
    """Every level tried, with resolutions that are exact ties, tiny, huge, negative or no numbers, and pyramids of any height."""
    import math

    base = [0.25 * 2.0**k * f for k in range(-20, 8) for f in (0.7, 1.0, 4 / 3, 1.5, 1.9999999)] + [0.0, -0.3, -1e-20, 1e-300, 5e-324, 1e300, float("inf"), float("nan"), None]
    rows = [(i, b, n) for i, (b, n) in enumerate((b, n) for b in base for n in (1, 2, 18))]
    table = spark.createDataFrame(rows, "i int, m double, n int")
    for target in (0.5, 8.0):
        level, mpp, status = pyramid.nearest_level(col("m"), col("n"), target)
        for r in table.select("m", "n", level.alias("level"), mpp.alias("mpp"), status.alias("status")).collect():
            at = [(0.25 if r.m is None else r.m) * 2.0 ** (r.n - 1 - i) for i in range(r.n)]
            off = [abs(x - target) for x in at]
            best = 0 if math.isnan(at[0]) else off.index(min(off))
            assert r.level == best and (r.mpp == at[best] or math.isnan(at[best])) and r.status == ("ok" if off[best] / target <= 0.2 else "mpp_not_available"), r


def test_levels_are_not_tried_one_by_one(spark):
    """A pyramid of very many levels costs no more than one of few."""
    import time

    level, _, _ = pyramid.nearest_level(col("id") * 0.001 + 0.1, F.lit(900), 8.0)
    start = time.time()
    spark.range(60_000).select(F.sum(level)).collect()
    assert time.time() - start < 10


def test_tiling(spark):
    t = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 2, 0), (0, 2, 0)], "slide long, col long, row long")
    assert sorted((r.col, r.row) for r in tiling.retile(t, 224, 656, 16, 17).collect()) == [(0, 0), (1, 0)]
    assert tiling.retile(t, 224, 224, 16, 16).count() == 4  # equal sizes: unchanged
    assert {(r.col, r.row) for r in tiling.retile(t, 224, 656, 16, 17, cover="full").collect()} == {(0, 0), (1, 0), (2, 0)} - {(2, 0)} | {(2, 0)}
    assert tiling.first_tiles(t, None).count() == 4 and tiling.first_tiles(t, 2).count() == 2
    assert tiling.random_tiles(t, 2, 1).collect() == tiling.random_tiles(t.repartition(3), 2, 1).collect()
    g = spark.createDataFrame([(1, 10, 5)], "slide long, width int, height int")
    assert tiling.grid(g, 4).count() == 6
    p = spark.createDataFrame([([1, 2, 3, 4],)], "v array<int>").select(tiling.pad(col("v"), 2, 2, 3)).first()[0]
    assert p == [1, 2, 0, 3, 4, 0, 0, 0, 0]


def test_packed(spark):
    v = spark.createDataFrame([([3.0, 3.0],), ([0.0, 2.0],)], "v array<double>")
    assert [r[0] for r in v.select(packed.minmax(col("v"))).collect()] == [[0, 0], [0, 1]]
    assert v.select(packed.arg_max(col("v"))).first()[0] == 0
    assert v.select(packed.softmax(col("v"))).first()[0] == [0.5, 0.5]


def test_otsu_constant(spark):
    rows = spark.createDataFrame([(1, 7)] * 4 + [(2, 1), (2, 1), (2, 9), (2, 9)], "vec_id long, q int")
    assert {r.vec_id: r.threshold for r in tissue.otsu(rows).collect()} == {1: 7, 2: 1}


def test_rings(spark):
    at = lambda *p: [(float(x), float(y)) for x, y in p]
    rows = spark.createDataFrame([(at((0, 0), (4, 0), (4, 3)),), (at((0, 0), (2, 2)),), ([],), (at((0, 0), (2, 0), (0, 0)),)], "r array<struct<x:double,y:double>>")
    got = rows.select(F.size(closed(col("r"))), shoelace(col("r"))).collect()
    assert [tuple(r) for r in got] == [(4, 6.0), (3, 0.0), (0, 0.0), (3, 0.0)]
