"""Slide files to documents."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright import models
from tilewright.__main__ import main, parser
from tilewright.operators import tiling, tissue
from tilewright.sources import documents, maps


def slide(path, side=1200, dark=True):
    px = np.full((side, side, 3), 240, np.uint8)
    if dark:
        px[224:900, 224:900] = (120, 60, 140)
    np.save(path, px)


def test_command(spark, tmp_path):
    slide(tmp_path / "a.npy")
    slide(tmp_path / "b.npy", dark=False)
    (tmp_path / "c.npy").write_bytes(b"no slide")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert main(["extract", "--slides", str(tmp_path / "*.npy"), "-e", str(tmp_path / "out")]) == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    status = {x.split(",")[0]: x.split(",")[2] for x in (tmp_path / "out" / "status.csv").read_text().splitlines()}
    assert status["a.npy"] == "ok" and status["c.npy"] == "failed"
    doc = json.loads((tmp_path / "out" / "a.npy" / "cell_masks.json").read_text())
    tiles = doc["cell_masks"]
    assert doc["model_name"] == "segmentor_20x" and len(tiles) >= 9 and any(t["masks"] for t in tiles)
    assert {c["cell_type"] for t in tiles for c in t["masks"]} <= set(models.CELL_CLASSES.values()) - {"Background"}
    assert not (tmp_path / "out" / "c.npy").exists()
    assert "n_tiles: null" in (tmp_path / "out" / "config.yaml").read_text()
    assert "ERROR c.npy: open failed" in (tmp_path / "out" / "run.log").read_text()


def known_discs(path, side, mpp, radius):
    """A slide with dark discs on tissue in the middle of an empty background; the discs' centres in pixels of its finest level."""
    rng = np.random.default_rng(int(side + 100 * mpp))
    px = np.full((side, side, 3), 240, np.uint8)
    low, high = side // 5, side - side // 6
    px[low:high, low:high] = (200, 150, 180)
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    disc, centres = x * x + y * y <= radius * radius, []
    step = 4 * radius
    for cy in range(low + step, high - step, step):
        for cx in range(low + step, high - step, step):
            if rng.random() < 0.5:
                cy_, cx_ = cy + int(rng.integers(-radius // 2, radius // 2 + 1)), cx + int(rng.integers(-radius // 2, radius // 2 + 1))
                px[cy_ - radius : cy_ + radius + 1, cx_ - radius : cx_ + radius + 1][disc] = (90, 60, 140)
                centres.append((cx_, cy_))
    np.save(path, px)
    (path.parent / f"{path.name}.json").write_text(json.dumps({"openslide.mpp-x": mpp}))
    return centres


def dark_discs(mpp, tile):
    """A model that reads pixels: what is dark is a cell. Local, so that tasks get it by value."""

    class Dark:
        name, overlap, classes, reads = "dark", 64, {0: "none", 1: "cell"}, True

        def __init__(self, mpp, tile):
            self.mpp, self.tile = mpp, tile

        def transform(self, pixels):
            return pixels.astype(np.float32) / 255

        def predict(self, keys, pixels):
            from tilewright.functions import raster

            assert pixels.shape == (len(keys), self.tile, self.tile, 3) and pixels.max() <= 1
            out = []
            for px in pixels:
                mask = (px[..., 0] > 0.2) & (px[..., 0] < 0.55)
                labels = raster.label(mask)
                n = np.maximum(np.bincount(labels.ravel()), 1)
                y, x = np.mgrid[: self.tile, : self.tile]
                cx, cy = (np.bincount(labels.ravel(), c.ravel()) / n for c in (x, y))
                r = np.sqrt(n / np.pi)
                out.append({"np": mask * 0.95, "tp": mask.astype(int), "hv_h": (x - cx[labels]) / r[labels] * mask, "hv_v": (y - cy[labels]) / r[labels] * mask})
            return out

    return Dark(mpp, tile)


@pytest.mark.parametrize(("mpp", "tile", "window"), [(0.5, 224, 784), (0.5, 448, 512), (0.25, 448, 784)])
def test_known_discs(spark, tmp_path, mpp, tile, window):
    """Each disc is found once, at its place, whatever the sizes of tiles and windows and the slide's resolution."""
    from tilewright.plans.extract import extract

    side = int(1500 * 0.5 / mpp)
    centres = known_discs(tmp_path / "d.npy", side, mpp, int(5 * 0.5 / mpp))
    docs, status = extract(spark, [str(tmp_path / "*.npy")], None, [dark_discs(0.25, window), dark_discs(0.5, window)], tile=tile, maps_at=str(tmp_path / "maps"))
    assert [(r.slide, r.status) for r in status.collect()] == [("d.npy", "ok")]
    doc = documents.of_tiles(docs).first()
    assert doc.inference_mpp == mpp and {(t.width, t.height) for t in doc.cell_masks} == {(tile, tile)}
    levels = int(np.ceil(np.log2(side))) + 1
    assert {t.level for t in doc.cell_masks} == {levels - 1 - (1 if mpp == 0.25 else 0)}
    tiles = {(int(t.x), int(t.y)) for t in doc.cell_masks}
    found = [(t.x * tile + c.centroid[0], t.y * tile + c.centroid[1]) for t in doc.cell_masks for c in t.masks]
    assert all(0 <= v < tile for t in doc.cell_masks for c in t.masks for v in c.centroid)
    scale = mpp / 0.5
    want = [(x * scale, y * scale) for x, y in centres if (int(x * scale // tile), int(y * scale // tile)) in tiles]
    assert len(want) > 50 and len(found) == len(want)
    left = np.array(found)
    for x, y in want:
        assert np.abs(left - (x, y)).max(1).min() <= 1
    assert maps.stored_maps(spark, str(tmp_path / "maps")).count() > 1


def test_resolutions_that_are_not_there(spark, tmp_path):
    from tilewright.plans.extract import extract

    for name, mpp in (("far", 1.0), ("half", 0.5)):
        slide(tmp_path / f"{name}.npy")
        (tmp_path / f"{name}.npy.json").write_text(json.dumps({"openslide.mpp-x": mpp}))
    _, status = extract(spark, [str(tmp_path / "*.npy")], None, [maps.Discs(784, 6, 0.25, 64), maps.Discs(784, 6, 0.5, 64)])
    assert {r.slide: r.status for r in status.collect()} == {"far.npy": "mpp_not_available", "half.npy": "ok"}
    with pytest.raises(ValueError, match="two models"):
        extract(spark, [str(tmp_path / "*.npy")], None, [maps.Discs(784, 6, 0.5, 64), maps.Discs(784, 1, 0.5, 64)])


def test_spill_goes_on(spark, tmp_path):
    """Only windows without maps are predicted; the maps of both runs are those of one."""
    windows = spark.createDataFrame([("a", i, 0) for i in range(5)], "slide_id string, icol int, irow int")
    at, provider = str(tmp_path / "maps"), maps.Discs(32, 1)
    assert maps.spill(windows.where("icol < 2"), provider, at).count() == 2
    before = {p.name for p in (tmp_path / "maps").rglob("part-*")}
    every = maps.spill(windows, provider, at)
    assert sorted((r.icol, sum(r.tp)) for r in every.collect()) == sorted((r.icol, sum(r.tp)) for r in maps.predict(windows, provider).collect())
    assert before < {p.name for p in (tmp_path / "maps").rglob("part-*")}
    # maps of another model, of other windows or of a slide that changed are never read
    one = maps.spill(windows, maps.Discs(32, 2), at)
    assert sorted((r.icol, sum(r.tp)) for r in one.collect()) == sorted((r.icol, sum(r.tp)) for r in maps.predict(windows, maps.Discs(32, 2)).collect())
    assert maps.spill(windows.where("icol = 3"), provider, at).count() == 1
    aged = windows.withColumns({"path": F.lit("/a"), "size": F.lit(3).cast("long"), "changed": F.lit(1).cast("long")})
    maps.spill(aged, provider, at), maps.spill(aged.withColumn("changed", F.lit(2).cast("long")), provider, at)
    keys = {p.name for p in (tmp_path / "maps").glob("map_key=*")}
    assert len(keys) == 4
    assert maps.sweep(spark, at, windows, provider) == 1 and len({p.name for p in (tmp_path / "maps").glob("map_key=*")}) == 3
    assert maps.sweep(spark, at) == 3 and not (tmp_path / "maps").exists() and maps.sweep(spark, at) == 0


def test_failed_windows_are_tried_again(spark, tmp_path):
    class Moody(maps.Discs):
        def predict(self, keys, pixels=None):
            if any(k[0] == "b" for k in keys) and not (tmp_path / "calm").exists():
                raise ValueError("not today")
            return super().predict(keys, pixels)

    windows = spark.createDataFrame([(s, i, 0) for s in "ab" for i in range(3)], "slide_id string, icol int, irow int")
    provider, at = Moody(32, 1), str(tmp_path / "maps")
    first = maps.spill(windows, provider, at).collect()
    assert sorted((r.slide_id, r.stage, r.error) for r in first) == sorted([("a", None, None)] * 3 + [("b", "predict", "ValueError: not today")] * 3, key=lambda x: x[0])
    assert [(r.slide_id, r.stage, r.status) for r in maps.failures(maps.spill(windows, provider, at)).collect()] == [("b", "predict", "failed")]
    (tmp_path / "calm").touch()
    assert maps.spill(windows, provider, at).where("error IS NULL").count() == 6 and not list((tmp_path / "maps").glob("*failed*"))


def test_nothing_is_lost_or_doubled(spark, tmp_path):
    """A path given twice counts once; files of one name in two folders are two slides; a second run leaves the first one's documents alone."""
    from tilewright.plans.extract import extract

    for folder in "xy":
        (tmp_path / folder).mkdir()
        slide(tmp_path / folder / "a.npy", side=1100 if folder == "x" else 1200)
    slide(tmp_path / "x" / "b.npy")
    model, out = maps.Discs(784, 6, 0.5, 64), tmp_path / "out"
    once, _ = extract(spark, [str(tmp_path / "x" / "a.npy")], str(out), model, n_tiles=6)
    first = (out / "a.npy" / "cell_masks.json").read_text()
    twice, status = extract(spark, [str(tmp_path / "x" / "a.npy"), str(tmp_path / "x" / "a*.npy")], None, model, n_tiles=6)
    size = lambda d: (d.count(), d.agg(F.sum(F.size("masks"))).first()[0])
    assert size(once) == size(twice) and once.count() == once.select("x", "y").distinct().count() and status.count() == 1
    extract(spark, [str(tmp_path / "x" / "b.npy")], str(out), model, n_tiles=6)
    assert sorted(p.name for p in out.iterdir()) == ["a.npy", "b.npy"] and (out / "a.npy" / "cell_masks.json").read_text() == first
    both, status = extract(spark, [str(tmp_path / "[xy]" / "a.npy")], None, model, n_tiles=6)
    names = {r.path.split("/")[-2]: r.slide for r in status.collect()}
    assert len(set(names.values())) == 2 and all(n.startswith("a.npy-") for n in names.values())
    assert size(both.where(F.col("slide") == names["x"])) == size(once)


def test_slides_that_come(spark, tmp_path):
    """A second start works on the new slides only; a broken one is a status."""
    from tilewright.streaming.slides import extract_new

    (tmp_path / "in").mkdir()
    slide(tmp_path / "in" / "a.npy", side=1000)
    start = lambda: extract_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), maps.Discs(784, 6, 0.5, 64), str(tmp_path / "ck"), "*.npy", n_tiles=4).awaitTermination()
    start()
    first = (tmp_path / "out" / "a.npy" / "cell_masks.json").stat().st_mtime_ns
    slide(tmp_path / "in" / "b.npy", side=1000)
    (tmp_path / "in" / "c.npy").write_bytes(b"nothing")
    (tmp_path / "in" / "d.txt").write_bytes(b"no slide, and not asked for")
    start()
    status = spark.read.parquet(str(tmp_path / "out" / "_status"))
    assert sorted((r.slide, r.status, r.batch) for r in status.collect()) == [("a.npy", "ok", 0), ("b.npy", "ok", 1), ("c.npy", "failed", 1)]
    assert (tmp_path / "out" / "a.npy" / "cell_masks.json").stat().st_mtime_ns == first
    assert documents.read_tiles(spark, str(tmp_path / "out" / "*.npy")).groupBy("file").count().count() == 2


def test_one_slide_fails_the_others_finish(spark, tmp_path):
    """Whatever fails, opening, thumbnail, windows, transform, model or the step to cells, is one status row of its slide."""
    from tilewright.plans.extract import extract

    for name in ("good", "cut", "late", "odd", "model", "shape", "klass"):
        slide(tmp_path / f"{name}.npy")
    whole = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "none.npy").write_bytes(b"no slide")

    class Late:
        """Thumbnails can be read, windows of one slide can not."""

        def open(self, path):
            from tilewright.sources.slides import Raw

            self.slide, self.path = Raw().open(path), path
            self.width, self.height, self.properties = self.slide.width, self.slide.height, self.slide.properties
            return self

        def read(self, level, col, row, tile, overlap):
            if "late" in self.path and overlap:
                raise OSError("gone")
            return self.slide.read(level, col, row, tile, overlap)

    import sys
    import types

    module = types.ModuleType("decoders_of_a_test")
    module.Late = Late
    sys.modules["decoders_of_a_test"] = module

    def pick(name):
        return Late()

    class Fussy(maps.Discs):
        reads = True

        def transform(self, pixels):
            return pixels

        def predict(self, keys, pixels=None):
            if any("model" in k[0] for k in keys):
                raise RuntimeError("out of order")
            out = super().predict(keys)
            for k, m in zip(keys, out, strict=True):
                if "shape" in k[0]:
                    m["np"] = m["np"][:5]
                if "klass" in k[0]:
                    m["tp"] = m["tp"] + 90 * (m["tp"] > 0)
            return out

    from unittest import mock

    with mock.patch("tilewright.plans.extract.load_decoder", pick), mock.patch("tilewright.sources.maps.load_decoder", pick):
        docs, status = extract(spark, [str(tmp_path / "*.npy")], str(tmp_path / "out"), Fussy(784, 6, 0.5, 64), batch=4, n_tiles=6)
        got = {r.slide.removesuffix(".npy"): (r.stage, r.status) for r in status.collect()}
    want = {"good": ("document", "ok"), "odd": ("document", "ok"), "none": ("open", "failed"), "cut": ("tissue", "failed"), "model": ("predict", "failed"), "shape": ("detect", "failed"), "klass": ("detect", "failed")}
    assert {k: got[k] for k in want} == want and got["late"][1] == "failed"
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["good.npy", "odd.npy"]
    assert status.where("slide = 'model.npy'").first().message == "RuntimeError: out of order"


def test_reading_goes_on_while_the_model_works():
    import time

    order = []

    def work(i):
        time.sleep(0.02)
        order.append(i)
        if i == 7:
            raise ValueError("seven")
        return i * i

    start = time.perf_counter()
    got = []
    with pytest.raises(ValueError, match="seven"):
        for i, r in maps.ahead(iter(range(20)), work):
            time.sleep(0.02)
            got.append((i, r))
    assert got == [(i, i * i) for i in range(7)] and order == list(range(len(order))) and len(order) <= 11
    assert time.perf_counter() - start < 0.02 * 2 * 7 + 0.06
    assert list(maps.ahead([], work)) == [] and list(maps.ahead([1, 2], work, 0)) == [(1, 1), (2, 4)]


def test_models(spark):
    one = models.STANDARD["segmentor_40x"]
    assert (one.mpp, one.train_size, one.tile, one.overlap, one.scale) == (0.25, 448, 784, 64, 1.75) and len(one.classes) == 15
    models.register(one, maps.Discs.of)
    made = models.provider("segmentor_40x")
    assert (made.name, made.mpp, made.classes[1]) == ("segmentor_40x", 0.25, "Cancer cell")
    models.register(one, lambda d: maps.Discs(512, 6, d.mpp, d.overlap, d.name, d.classes))
    for bad in (lambda: models.provider("segmentor_40x"), lambda: models.provider("other"), lambda: models.Descriptor("x", 0.3, 1), lambda: models.Descriptor("x", 0.5, 1, 100, 50), lambda: models.Descriptor("x", 0.5, 1, classes={1: "a"})):
        with pytest.raises(ValueError):
            bad()
    rows = models.table(spark, models.STANDARD.values())
    assert rows.count() == 30 and rows.where("cls = 13 AND train_size = 224").first().cell_type == "Mitotic Figures"


def test_slide_source(spark, tmp_path):
    from tilewright.sources.slides import Raw, SlideSource

    px = np.random.default_rng(0).integers(0, 255, (70, 50, 3)).astype(np.uint8)
    np.save(tmp_path / "s.npy", px)
    spark.dataSource.register(SlideSource)
    rows = spark.read.format("slides").options(tile=16, overlap=2).load(str(tmp_path / "s.npy")).collect()
    assert len(rows) == 5 * 4
    for r in rows:
        part = px[max(0, r.row * 16 - 2) : r.row * 16 + 18, max(0, r.col * 16 - 2) : r.col * 16 + 18]
        assert (r.height, r.width) == part.shape[:2] and bytes(r.pixels) == part.tobytes()
    rows = spark.read.format("slides").options(tile=16, level=1).load(str(tmp_path / "s.npy")).collect()
    assert len(rows) == 3 * 2 and all(r.level == 1 for r in rows)
    h, w, data = Raw().open(f"file://{tmp_path}/s.npy").read(2, 0, 0, 100, 0)
    assert (h, w) == (17, 12) and (np.frombuffer(data, np.uint8).reshape(h, w, 3) == px[:68, :48].reshape(17, 4, 12, 4, 3).mean((1, 3)).astype(np.uint8)).all()


def test_parser():
    with pytest.raises(SystemExit):
        parser().parse_args(["extract"])
    a = parser().parse_args(["extract", "--slides", "x", "y", "-e", "o"])
    assert (a.slides, a.tile_size, a.n_tiles, a.n_workers, a.batch_size, a.verbose) == (["x", "y"], 224, None, 4, 8, 0)


def test_guards(spark):
    with pytest.raises(ValueError):
        tiling.check(spark.createDataFrame([(1.5, 2.0)], "col double, row double"))
    rows = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [1], ["a", "b"]), (3, [], [])], "id int, n array<int>, s array<string>")
    got = [(r.id, r.ok, r.n, r.s) for r in documents.from_lists(rows, ("n", "s")).orderBy("id", "position").collect()]
    assert got == [(1, True, 1, "a"), (1, True, 2, "b"), (2, False, None, None), (3, True, None, None)]


def test_thumbnail(spark):
    px = spark.createDataFrame([("s", y, x, float(y), 0.0, 0.0) for y in range(5) for x in range(4)], "slide_id string, y long, x long, r double, g double, b double")
    got = {(r.y, r.x): r.r for r in tissue.thumbnail(px, 2).collect()}
    assert got == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 2.5, (1, 1): 2.5, (2, 0): 4.0, (2, 1): 4.0}


def test_maps_by_key(spark, tmp_path):
    windows = spark.createDataFrame([("a", 0, 0), ("a", 1, 0)], "slide_id string, icol int, irow int")
    maps.predict(windows.where("icol = 0"), maps.Discs(32, 1)).write.parquet(str(tmp_path / "maps"))
    again = spark.read.parquet(str(tmp_path / "maps"))
    assert again.select(F.size("np")).first()[0] == 32 * 32
    assert [(r.slide_id, r.status) for r in maps.unmatched(windows, again).collect()] == [("a", "missing_maps")]
