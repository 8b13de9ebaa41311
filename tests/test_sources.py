"""Documents, files, slides, providers and streams."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from tilewright.plans.chain import detect_tissue, run
from tilewright.plans.extract import planned
from tilewright.sources import documents, files, maps
from tilewright.sources.slides import Auto, Raw, SlideSource, Tiff, halved
from tilewright.streaming.slides import watch


def test_document_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("s", 1, 3, 0, 0, 224, 112, 0, "Round", 0.5, [[1.0, 2.0], [3.0, 2.0], [3.0, 4.0]], [2.0, 3.0]), ("s", 2, 3, 1, 0, 224, 112, None, None, None, None, None)],
        "slide string, tile_seq long, level int, x int, y int, width int, height int, cell_id int, cell_type string, confidence double, coordinates array<array<double>>, centroid array<double>",
    )
    docs = documents.nest(rows, "m", 0.5)
    tiles = documents.tile_rows(rows, "m", 0.5)
    documents.write(tiles, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["s"]
    text = (tmp_path / "out" / "s" / "cell_masks.json").read_text()
    raw = json.loads(text)
    assert [len(t["masks"]) for t in raw["cell_masks"]] == [1, 0]
    assert '"cell_id":0.0' in text and '"level":3.0' in text  # floating on the wire
    again = documents.read(spark, str(tmp_path / "out" / "*")).drop("file")
    assert again.select("model_name", "inference_mpp", "cell_masks").collect() == docs.select("model_name", "inference_mpp", "cell_masks").collect()
    cells = documents.cells_of(again).orderBy("tile_seq").collect()
    assert [(c.tile_seq, c.width, c.cell_id) for c in cells] == [(1, 224, 0.0), (2, 224, None)]
    lines = documents.read_tiles(spark, str(tmp_path / "out" / "*")).orderBy("x")
    assert lines.drop("file").collect() == documents.tiles_of(again).drop("tile_seq").orderBy("x").collect()


def test_documents_are_replaced_slide_by_slide(spark, tmp_path):
    """Other slides of the folder stay, a failed job leaves nothing, and slides are streamed."""
    def some(slide, tiles, cells=1):
        rows = spark.range(tiles).select(F.lit(slide).alias("slide"), F.lit("m").alias("model_name"), F.lit(0.5).alias("inference_mpp"), (F.col("id") + 1).alias("tile_seq"), F.lit(1).alias("level"), F.col("id").alias("x"), F.lit(0).alias("y"), F.lit(224).alias("width"), F.lit(224).alias("height"))
        cell = F.struct(F.lit(0.0).alias("cell_id"), F.lit("Round").alias("cell_type"), F.lit(0.5).alias("confidence"), F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("coordinates"), F.array(F.lit(1.0), F.lit(2.0)).alias("centroid"))
        return rows.withColumn("masks", F.array_repeat(cell, cells))

    out = tmp_path / "out"
    documents.write(some("a", 3).union(some("b", 2)), str(out))
    documents.write(some("b", 5000, 20).repartition(7), f"file://{out}")
    assert sorted(p.name for p in out.iterdir()) == ["a", "b"]
    n = {s: json.loads((out / s / "cell_masks.json").read_text()) for s in "ab"}
    assert len(n["a"]["cell_masks"]) == 3 and [t["x"] for t in n["b"]["cell_masks"]] == list(range(5000)) and {len(t["masks"]) for t in n["b"]["cell_masks"]} == {20}
    broken = some("b", 10).withColumn("masks", F.when(F.col("x") == 7, F.raise_error(F.lit("broken")).cast(dict(some("b", 1).dtypes)["masks"])).otherwise(F.col("masks")))
    with pytest.raises(Exception, match="broken"):
        documents.write(broken, str(out))
    assert sorted(p.name for p in out.iterdir()) == ["a", "b"] and len(json.loads((out / "b" / "cell_masks.json").read_text())["cell_masks"]) == 5000
    spark.dataSource.register(documents.DocumentSink)
    apart = spark.createDataFrame([("a", "{", "x"), ("b", "{", "x"), ("a", "{", "x")], documents.LINES)
    for rows in (apart.coalesce(1), apart.repartition(3)):
        with pytest.raises(Exception):  # noqa: B017
            rows.write.format("slide_documents").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == ["a", "b"] and len(json.loads((out / "a" / "cell_masks.json").read_text())["cell_masks"]) == 3


def test_urls_and_paths(spark, tmp_path):
    rows = spark.createDataFrame([("http://a.b/c",), ("s3://bucket/x",), ("/a/b",), ("http:///x",), ("a.b",), (None,), ("",)], "u string")
    assert [r[0] for r in rows.select(files.is_url(col("u"))).collect()] == [True, True, False, False, False, False, False]
    for n in ("b.tif", "a.tif"):
        (tmp_path / n).write_bytes(n.encode())
    got = [r.path.split("/")[-1] for r in files.collect_paths(spark, [str(tmp_path / "*.tif"), "s3://b/k", str(tmp_path / "a.*"), str(tmp_path / "none*")]).collect()]
    assert got == ["a.tif", "b.tif", "k", "a.tif"]
    one = files.hashes(spark, str(tmp_path), "a.tif").first()
    assert one.sha256 == hashlib.sha256(b"a.tif").hexdigest()
    files.write_settings(str(tmp_path / "run.yaml"), {"a": 1, "_b": 2, "c": None, "d": True})
    assert (tmp_path / "run.yaml").read_text() == "a: 1\nc: null\nd: true\n"


def test_slide_source(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 255, (300, 260, 3), dtype=np.uint8)
    np.save(tmp_path / "s.npy", pixels)
    spark.dataSource.register(SlideSource)
    rows = spark.read.format("slides").option("tile", 128).load(str(tmp_path / "s.npy")).collect()
    assert len(rows) == 9
    one = next(r for r in rows if (r.col, r.row) == (2, 2))
    assert (one.height, one.width) == (300 - 256, 260 - 256)
    assert (np.frombuffer(one.pixels, np.uint8).reshape(one.height, one.width, 3) == pixels[256:, 256:]).all()


def test_run(spark, tmp_path):
    windows = spark.createDataFrame([("a", 1, 1), ("b", 0, 1)], "slide_id string, icol int, irow int")
    tiles = spark.createDataFrame([(s, i + 1, i % 4, i // 4) for s in "abc" for i in range(16)], "slide_id string, tile_seq long, col long, row long")
    docs, status = run(windows, tiles, maps.Discs(overlap=8))
    assert {r.slide_id: r.status for r in status.collect()} == {"a": "ok", "b": "ok", "c": "ok"}
    counts = {r.slide: r.n for r in docs.groupBy("slide").agg(F.sum(F.size("masks")).alias("n")).collect()}
    assert counts["c"] == 0 and counts["a"] > 0  # a slide without cells has a document
    with pytest.raises(ValueError):
        maps.detect(maps.predict(windows, maps.Discs()), maps.CLASSES, 0.3)


def test_levels_and_tissue(spark):
    slides = spark.createDataFrame([("a", {"openslide.mpp-x": "0.25"}, 4096, 2048), ("b", {"tiff.XResolution": "100", "tiff.ResolutionUnit": "cm"}, 100, 100)], "slide_id string, properties map<string,string>, width long, height long")
    got = {r.slide_id: (r.target_mpp, r.down_window, r.down_base, r.factor, r.fits) for r in planned(slides, (0.25, 0.5)).collect()}
    assert got["a"] == (0.25, 0, 1, 32, "ok") and got["b"][0] is None and got["b"][4] == "mpp_not_available"
    px = [("s", y, x, *((40, 30, 60) if y < 4 and x < 4 else (240, 240, 240))) for y in range(9) for x in range(8)]
    rows = detect_tissue(spark.createDataFrame(px, "slide_id string, y long, x long, r int, g int, b int"), 4, 9, 8)
    assert [(r.col, r.row) for r in rows.collect()] == [(0, 0)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"xy")
    work = lambda d: d.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("ok").alias("status"))
    for n in (1, 2):
        watch(spark, str(tmp_path / "in"), work, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (tmp_path / "in" / "b.bin").write_bytes(b"z")


def packed_runs(data):
    out, i = bytearray(), 0
    while i < len(data):
        j = i
        while j + 1 < len(data) and j - i < 127 and data[j + 1] == data[i]:
            j += 1
        out += bytes([257 - (j - i + 1), data[i]]) if j > i else bytes([0, data[i]])
        i = j + 1
    return bytes(out)


def write_tiff(path, images, tile=64, compression=8, big=False, order="<", predictor=1, resolution=None, below=False):
    """A tiled file of some images, the largest first; `below`: the others hang on the first."""
    f, word, n = bytearray(), 8 if big else 4, "Q" if big else "I"
    f += (b"II" if order == "<" else b"MM") + struct.pack(order + "H", 43 if big else 42)
    f += struct.pack(order + "HHQ", 8, 0, 0) if big else struct.pack(order + "I", 0)
    link = len(f) - word

    def tags_of(image):
        offsets, counts = [], []
        for y in range(0, image.shape[0], tile):
            for x in range(0, image.shape[1], tile):
                t, part = np.zeros((tile, tile, 3), np.uint8), image[y : y + tile, x : x + tile]
                t[: part.shape[0], : part.shape[1]] = part
                if predictor == 2:
                    t = np.diff(t, axis=1, prepend=np.zeros((tile, 1, 3), np.uint8)).astype(np.uint8)
                data = {1: bytes, 7: bytes, 8: zlib.compress, 32773: packed_runs}[compression](t.tobytes())
                offsets.append(len(f))
                counts.append(len(data))
                f.extend(data)
        tags = [(256, 4, [image.shape[1]]), (257, 4, [image.shape[0]]), (258, 3, [8, 8, 8]), (259, 3, [compression]), (270, 2, b"A scanner|MPP = 0.25|x\0"), (277, 3, [3]), (284, 3, [1]), (317, 3, [predictor])]
        tags += [(322, 3, [tile]), (323, 3, [tile]), (324, 16 if big else 4, offsets), (325, 4, counts)]
        return tags + ([(282, 5, [resolution]), (296, 3, [3])] if resolution else [])

    def directory(tags):
        entries = []
        for tag, kind, values in sorted(tags):
            data = values if kind == 2 else b"".join(struct.pack(order + "II", int(v * 1000), 1000) if kind == 5 else struct.pack(order + {3: "H", 4: "I", 16: "Q"}[kind], v) for v in values)
            own = data.ljust(word, b"\0")
            if len(data) > word:
                own = struct.pack(order + n, len(f))
                f.extend(data)
            entries.append(struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, len(values)) + own)
        at = len(f)
        f.extend(struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries) + bytes(word))
        return at, len(f) - word

    first = tags_of(images[0])
    if below:
        first.append((330, 16 if big else 4, [directory(tags_of(i))[0] for i in images[1:]]))
    for tags in [first, *([] if below else map(tags_of, images[1:]))]:
        at, after = directory(tags)
        f[link : link + word] = struct.pack(order + n, at)
        link = after
    path.write_bytes(f)


@pytest.mark.parametrize("how", [{}, {"big": True}, {"order": ">"}, {"compression": 1}, {"compression": 32773}, {"predictor": 2}, {"below": True, "big": True}, {"order": ">", "big": True, "predictor": 2}], ids=str)
def test_tiff(tmp_path, how):
    px = np.random.default_rng(0).integers(0, 40, (517, 700, 3)).cumsum(1).astype(np.uint8)
    levels = [px, halved(px[:516], 1), halved(px[:516], 2)]
    np.save(tmp_path / "x.npy", px)
    write_tiff(tmp_path / "x.tif", levels, resolution=20000, **how)
    raw, t = Raw().open(str(tmp_path / "x.npy")), Auto().open(f"file:{tmp_path}/x.tif")
    assert (t.width, t.height, [x.down for x in t.levels]) == (700, 517, [0, 1, 2])
    assert t.properties == {"openslide.mpp-x": "0.25", "tiff.XResolution": "20000.0", "tiff.ResolutionUnit": "cm"}
    for place in [(0, 0, 0, 100, 0), (0, 1, 2, 100, 16), (1, 0, 0, 64, 8), (1, 3, 3, 64, 8), (2, 0, 0, 200, 0), (0, 20, 0, 64, 0)]:
        assert t.read(*place) == raw.read(*place)
    h, w, data = t.read(3, 0, 0, 100, 0)  # halved from the coarsest stored level
    assert (h, w) == (64, 87) and (np.frombuffer(data, np.uint8).reshape(h, w, 3) == halved(levels[2][:128, :174], 1)).all()


def test_a_window_costs_its_own_tiles(tmp_path):
    px = np.random.default_rng(1).integers(0, 255, (4096, 4096, 3)).astype(np.uint8)
    write_tiff(tmp_path / "x.tif", [px, halved(px, 2)], tile=128, compression=1)
    t = Tiff().open(str(tmp_path / "x.tif"))
    assert t.bytes_read < 1000  # directories, not the lists of tiles
    for place, tiles in (((0, 5, 7, 128, 0), 1), ((0, 5, 7, 128, 1), 9), ((2, 1, 1, 128, 0), 1), ((3, 0, 0, 128, 0), 4)):
        before = t.bytes_read
        t.read(*place)
        assert t.bytes_read - before <= tiles * (128 * 128 * 3 + 8)


def test_slides_that_are_none(tmp_path):
    px = np.zeros((100, 100, 3), np.uint8)
    write_tiff(tmp_path / "j.tif", [px], compression=7)
    with pytest.raises(ValueError, match="no codec"):
        Tiff().open(str(tmp_path / "j.tif")).read(0, 0, 0, 64, 0)
    write_tiff(tmp_path / "x.tif", [px], compression=1)
    whole = (tmp_path / "x.tif").read_bytes()
    (tmp_path / "cut.tif").write_bytes(whole[:200])
    (tmp_path / "flat.tif").write_bytes(whole.replace(struct.pack("<HHI", 324, 4, 4), struct.pack("<HHI", 273, 4, 4)))
    (tmp_path / "text.txt").write_bytes(b"nothing at all")
    for name in ("cut.tif", "flat.tif", "text.txt"):
        with pytest.raises(ValueError):
            Auto().open(str(tmp_path / name))


def test_tiff_as_a_data_source(spark, tmp_path):
    px = np.random.default_rng(2).integers(0, 255, (300, 260, 3)).astype(np.uint8)
    write_tiff(tmp_path / "x.tif", [px, halved(px, 1)])
    spark.dataSource.register(SlideSource)
    rows = spark.read.format("slides").options(tile=64, level=1, parts=3).load(str(tmp_path / "x.tif")).collect()
    assert sorted((r.col, r.row) for r in rows) == sorted((c, r) for c in range(3) for r in range(3))
    assert all(bytes(r.pixels) == halved(px, 1)[r.row * 64 : r.row * 64 + 64, r.col * 64 : r.col * 64 + 64].tobytes() for r in rows)
