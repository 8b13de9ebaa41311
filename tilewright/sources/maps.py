"""Raw maps of windows: an interface for models, a synthetic one, and the step from maps to cells.

A provider has name, mpp, tile (its window), overlap (the margin within it), classes (number to name, 0 background) and predict(keys, pixels) -> maps, one dict a window with np
(nucleus probability), tp (class), hv_h and hv_v (distances across and down), each (tile, tile). keys are (slide_id, icol, irow). If its
`reads` is true, pixels are what its transform makes of the windows' bytes, (windows, tile, tile, 3), else None.

What a decoder, a transform, a model or the step to cells raises belongs to one slide: its windows become rows that name the stage and the error, and the other slides of the task go on.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packed import DEVIATION, MEAN
from ..functions.raster import instances, segment
from ..operators.pyramid import PARAMETERS
from ..schema import DETECTIONS, RAW_MAPS
from .shared import stored
from .slides import load_decoder, window

DECODER = "tilewright.sources.slides:Auto"

#: Classes of the synthetic provider.
CLASSES = {0: "Background", 1: "Round", 2: "Long", 3: "Small", 4: "Large"}
KEYS = ["slide_id", "icol", "irow"]
RAW_COLUMNS = [c.split()[0] for c in RAW_MAPS.split(", ")]
#: Put before a key: its windows that failed in the last run.
FAILED = "failed-"


class Provider(Protocol):
    name: str
    mpp: float
    tile: int
    overlap: int
    classes: dict[int, str]
    reads: bool

    def transform(self, pixels: np.ndarray) -> np.ndarray: ...

    def predict(self, keys: Sequence[tuple], pixels: np.ndarray | None) -> list[dict[str, np.ndarray]]: ...


def normalised(pixels: np.ndarray) -> np.ndarray:
    """The usual transform: bytes to floats around 0, channel by channel."""
    return (pixels.astype(np.float32) / 255 - np.array(MEAN, np.float32)) / np.array(DEVIATION, np.float32)


class Discs:
    """Maps with discs at places that follow from the window's key: for tests and trial runs."""

    reads = False

    def __init__(self, tile: int = 128, discs: int = 6, mpp: float = 0.25, overlap: int = 0, name: str = "discs", classes: dict[int, str] | None = None):
        self.tile, self.discs, self.mpp, self.overlap, self.name, self.classes = tile, discs, mpp, overlap, name, classes or CLASSES

    @classmethod
    def of(cls, descriptor) -> Discs:
        return cls(descriptor.tile, 6, descriptor.mpp, descriptor.overlap, descriptor.name, descriptor.classes)

    def transform(self, pixels: np.ndarray) -> np.ndarray:
        return pixels

    def places(self, key: tuple) -> list[tuple[int, int, int, int]]:
        """x, y, radius and class; centres lie in cells of a grid, so discs don't touch. Whole-number arithmetic, so that SQL can say the same."""
        slide, icol, irow = key
        side = int(np.ceil(np.sqrt(self.discs)))
        step = self.tile // side
        out = []
        for i in range(self.discs):
            h = (sum(map(ord, str(slide))) * 7919 + int(icol) * 104_729 + int(irow) * 1_299_709 + i * 15_485_863) % 2_147_483_647
            r = 5 + h % max(1, min(8, step // 2 - 7))
            free = max(1, step - 2 * r - 4)
            out.append((i % side * step + r + 2 + h // 256 % free, i // side * step + r + 2 + h // 65536 % free, r, 1 + h // 16 % (len(self.classes) - 1)))
        return out

    def predict(self, keys: Sequence[tuple], pixels: np.ndarray | None = None) -> list[dict[str, np.ndarray]]:
        out = []
        y, x = np.mgrid[: self.tile, : self.tile]
        for key in keys:
            maps = {k: np.zeros((self.tile, self.tile), np.float32) for k in ("np", "tp", "hv_h", "hv_v")}
            for cx, cy, r, cls in self.places(key):
                on = (x - cx) ** 2 + (y - cy) ** 2 <= r * r
                maps["np"][on], maps["tp"][on] = 0.95, cls
                maps["hv_h"][on], maps["hv_v"][on] = ((x - cx) / r)[on], ((y - cy) / r)[on]
            out.append(maps)
        return out


def identity(provider: Provider) -> str:
    """What tells a provider's maps from another's: its own `identity` where it has one, else its class, its state and the geometry of its windows."""
    own = getattr(provider, "identity", None)
    state = own if own is not None else hashlib.sha256(cloudpickle.dumps(provider)).hexdigest()
    return f"{provider.name}/{provider.mpp}/{provider.tile}/{provider.overlap}/{state}"


def keyed(windows: DataFrame, provider: Provider, decoder: str) -> DataFrame:
    """Windows with `map_key`: a hash of the model, the windows' geometry, the decoder and the slide's path and, where windows have them, its size and time of change."""
    about = [F.col(c).cast("string") for c in ("path", "level", "size", "changed") if c in windows.columns]
    return windows.withColumn("map_key", F.sha2(F.concat_ws("|", F.lit(identity(provider)), F.lit(decoder), F.col("slide_id").cast("string"), *[F.coalesce(c, F.lit("")) for c in about]), 256))


def stored_maps(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Maps that were predicted before and written by spill(): all, or those of some keys."""
    rows = spark.read.schema(f"{RAW_MAPS}, map_key string").parquet(path)
    return (rows if keys is None else rows.join(F.broadcast(keys), "map_key", "left_semi")).drop("map_key")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def spill(windows: DataFrame, provider: Provider, path: str, decoder: str = DECODER, **options) -> DataFrame:
    """The maps of the windows: those that are under path, and the rest predicted and added there. A run that broke off goes on where it was:
    files appear whole or not at all, in a folder for each key of model, geometry and slide, and a window belongs to its maps by key. Maps of another model, or
    of a slide that changed since, are under other keys and are not read. Windows that failed are not kept: a later run tries them again."""
    spark = windows.sparkSession
    windows = keyed(windows, provider, decoder)
    keys = stored(windows.select("map_key").distinct(), "map-keys")  # one a slide
    rest = windows
    if _exists(spark, path):
        _delete(spark, path, keys.select(F.concat(F.lit(FAILED), "map_key").alias("map_key")))
        rest = windows.join(stored_maps(spark, path, keys).select(KEYS).distinct(), KEYS, "left_anti")
    made = predict(rest, provider, decoder=decoder, keep=("map_key",), **options)
    made = made.withColumn("map_key", F.when(F.col("error").isNull(), F.col("map_key")).otherwise(F.concat(F.lit(FAILED), "map_key")))
    made.write.partitionBy("map_key").mode("append").parquet(path)
    every = keys.union(keys.select(F.concat(F.lit(FAILED), "map_key")))
    return stored_maps(spark, path, every).join(windows.select(KEYS).distinct(), KEYS, "left_semi").select(*RAW_COLUMNS)


def _delete(spark: SparkSession, path: str, keys: DataFrame) -> int:
    """Delete the folders of keys that are there; their number. Their names come to the driver, one a slide at most."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [(f.getPath().getName().removeprefix("map_key="),) for f in system.listStatus(top) if f.isDirectory()]
    gone = spark.createDataFrame(there, "map_key string").join(keys, "map_key", "left_semi").collect() if there else []
    for r in gone:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(top, f"map_key={r.map_key}"), True)
    return len(gone)


def sweep(spark: SparkSession, path: str, windows: DataFrame | None = None, provider: Provider | None = None, decoder: str = DECODER) -> int:
    """Delete maps under path: those of these windows, once what was made of them is written; without windows all. The number of keys that went."""
    if not _exists(spark, path):
        return 0
    if windows is None:
        top = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = top.getFileSystem(spark._jsc.hadoopConfiguration())
        n = len([f for f in system.listStatus(top) if f.isDirectory()])
        system.delete(top, True)
        return n
    keys = keyed(windows, provider, decoder).select("map_key").distinct()
    return _delete(spark, path, keys.union(keys.select(F.concat(F.lit(FAILED), "map_key"))))


def unmatched(windows: DataFrame, maps_: DataFrame) -> DataFrame:
    """Status rows of windows whose maps are missing: maps belong to windows by key, never by position."""
    lost = windows.select(KEYS).distinct().join(maps_.select(KEYS).distinct(), KEYS, "left_anti")
    return lost.groupBy("slide_id").agg(F.concat(F.count("*").cast("string"), F.lit(" windows without maps")).alias("message")).select("slide_id", F.lit("predict").alias("stage"), F.lit("missing_maps").alias("status"), "message")


def failures(rows: DataFrame) -> DataFrame:
    """One status row for each slide that has a row with an error: that of the first window, row by row."""
    first = F.min(F.struct("irow", "icol", "stage", "error"))
    bad = rows.where("error IS NOT NULL").groupBy("slide_id").agg(first.alias("e"))
    return bad.select("slide_id", F.col("e.stage").alias("stage"), F.lit("failed").alias("status"), F.col("e.error").alias("message"))


def told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:300]


def ahead(items: Iterable, work: Callable, depth: int = 2) -> Iterator[tuple]:
    """(item, work(item)) in order, with the next `depth` items worked on in a thread meanwhile. What `work` raises is raised when its turn comes; nothing is started after the reader stops."""
    with ThreadPoolExecutor(1) as pool:
        waiting: deque = deque()
        items = iter(items)
        try:
            for item in items:
                waiting.append((item, pool.submit(work, item)))
                if len(waiting) > depth:
                    done, future = waiting.popleft()
                    yield done, future.result()
            while waiting:
                done, future = waiting.popleft()
                yield done, future.result()
        finally:
            for _, future in waiting:
                future.cancel()


def predict(windows: DataFrame, provider: Provider, batch: int = 16, decoder: str = DECODER, keep: tuple[str, ...] = (), depth: int = 2) -> DataFrame:
    """Raw maps of the windows (slide_id, icol, irow, and path and level if the provider reads pixels), with the columns `keep`; a task opens each of its slides once, and
    reads the next `depth` batches while the model is at work. Windows of a slide that cannot be read or predicted are rows with stage and error."""
    side, core = provider.tile, provider.tile - 2 * provider.overlap
    columns = [*KEYS, *keep]

    def read(part: pd.DataFrame, held: dict) -> tuple[np.ndarray | None, list[str | None]]:
        """The windows' pixels, and for each what went wrong."""
        errors: list[str | None] = [None] * len(part)
        if not provider.reads:
            return None, errors
        raw = np.zeros((len(part), side, side, 3), np.uint8)
        for i, t in enumerate(part.itertuples(index=False)):
            try:
                if t.path != held.get("path"):
                    held.clear()
                    held |= {"path": t.path, "slide": None}
                    held["slide"] = load_decoder(decoder).open(t.path.removeprefix("file:"))
                if held["slide"] is None:
                    raise ValueError("the slide could not be opened")
                raw[i] = window(held["slide"], t.level, t.icol, t.irow, core, provider.overlap)
            except Exception as e:  # whatever a decoder raises belongs to this slide
                errors[i] = told(e)
        return raw, errors

    def maps_of(part: pd.DataFrame, raw: np.ndarray | None) -> list[dict[str, np.ndarray]]:
        pixels = provider.transform(raw) if provider.reads else None
        made = provider.predict(list(part[KEYS].itertuples(index=False, name=None)), pixels)
        if len(made) != len(part):
            raise ValueError(f"{len(made)} maps of {len(part)} windows")
        return made

    def rows_of(part: pd.DataFrame, raw: np.ndarray | None) -> pd.DataFrame:
        """The maps of a batch; if it fails, of its slides one by one."""
        try:
            made = maps_of(part, raw)
        except Exception as e:  # whatever a model raises belongs to a slide
            slides = part["slide_id"].to_numpy()
            if len(set(slides)) == 1:
                return part[columns].assign(h=side, w=side, np=None, tp=None, hv_h=None, hv_v=None, stage="predict", error=told(e))
            return pd.concat([rows_of(part[slides == s], None if raw is None else raw[slides == s]) for s in dict.fromkeys(slides)])
        return part[columns].assign(
            h=side, w=side, np=[m["np"].ravel() for m in made], tp=[m["tp"].astype(np.int16).ravel() for m in made], hv_h=[m["hv_h"].ravel() for m in made], hv_v=[m["hv_v"].ravel() for m in made], stage=None, error=None
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        parts = (frame.iloc[a : a + batch] for frame in frames for a in range(0, len(frame), batch))
        for part, (raw, errors) in ahead(parts, lambda p: read(p, held), depth if provider.reads else 0):
            bad = np.array([e is not None for e in errors])
            if bad.any():
                yield part[bad][columns].assign(h=side, w=side, np=None, tp=None, hv_h=None, hv_v=None, stage="read", error=[e for e in errors if e is not None])
            if not bad.all():
                yield rows_of(part[~bad], None if raw is None else raw[~bad])

    kinds = dict(windows.dtypes)
    schema = ", ".join(["slide_id string, icol int, irow int", *[f"{c} {kinds[c]}" for c in keep], RAW_MAPS.split("irow int, ")[1]])
    return windows.select(*columns, *(["path", "level"] if provider.reads else [])).mapInPandas(run, schema)


def detect(maps: DataFrame, classes: dict[int, str], mpp: float) -> DataFrame:
    """Cells of every window in window coordinates, seq left null for the caller to set by its own order, and one row more a window, without a cell, that says that it was worked on or what
    went wrong."""
    if mpp not in PARAMETERS:
        raise ValueError(f"no parameters for {mpp} microns a pixel")
    least, kernel = PARAMETERS[mpp]
    names = [c.split()[0] for c in DETECTIONS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for t in frame.itertuples(index=False):
                key, stage, error = (t.slide_id, t.icol, t.irow), t.stage, t.error
                if error is None:
                    try:
                        m = {k: np.asarray(getattr(t, k), float).reshape(t.h, t.w) for k in ("np", "tp", "hv_h", "hv_v")}
                        for c in instances(segment(m["np"], m["hv_h"], m["hv_v"], least, kernel), m["tp"]):
                            (y0, y1, x0, x1), (cx, cy) = c["box"], c["centroid"]
                            points = [{"x": float(x), "y": float(y)} for x, y in c["contour"]]
                            rows.append((*key, c["inst_id"], None, points, y0, y1, x0, x1, cx, cy, classes[c["cls"]], c["prob"], None, None))
                    except Exception as e:  # maps of the wrong shape, unknown classes
                        stage, error = "detect", told(e)
                rows.append((*key, *[None] * 11, stage, error))
            yield pd.DataFrame(rows, columns=names).astype({"inst_id": "Int32", "seq": "Int64"})

    return maps.mapInPandas(run, DETECTIONS)


def cells_of(rows: DataFrame) -> DataFrame:
    """The cells among what detect() gives."""
    return rows.where("inst_id IS NOT NULL").drop("stage", "error")


def numbered(cells: DataFrame) -> DataFrame:
    """Give seq by (slide, row, column, instance): window, not arrival, decides it."""
    return cells.withColumn("seq", ((F.col("irow").cast("long") * 1_000_000 + F.col("icol")) * 1_000_000 + F.col("inst_id")))
