"""Nested JSON documents of a slide's tiles and cells: write, read, flatten.

On the wire every number is a floating one, cell ids are counted from 0 in each tile, and boxes are not kept. Rings are written as they are; closing
them is left to the reader.

Tables have one row a tile (`tile_rows`), so no row holds a whole slide. The sink streams a slide's tiles into one file, EXPORT/<slide>/cell_masks.json: a first
line with the model, a line a tile, a last line. The file is plain JSON, and `read_tiles` reads it line by line.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..schema import DOCUMENT, TILE
from .files import file_system

LEVEL = ("level", "x", "y", "width", "height")
FILE = "cell_masks.json"
#: What the sink takes: rows of a slide side by side and in order.
LINES = "slide string, head string, line string"


def tile_rows(rows: DataFrame, model: str | Column, mpp: float | Column, slide: str = "slide") -> DataFrame:
    """From one row a cell (level, x, y, width, height, cell_id, cell_type, confidence, coordinates, centroid; cell_id null: a tile without cells) to one row a
    tile: slide, model_name, inference_mpp, tile_seq, level and place, masks in the order of cell_id."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    d = lambda c: F.col(c).cast("double").alias(c)
    mask = F.struct(d("cell_id"), "cell_type", d("confidence"), "coordinates", "centroid")
    rows = rows.withColumns({"model_name": lit(model), "inference_mpp": lit(mpp).cast("double")})
    masks = F.array_sort(F.collect_list(F.when(F.col("cell_id").isNotNull(), mask))).alias("masks")
    return rows.groupBy(slide, "model_name", "inference_mpp", "tile_seq", *LEVEL).agg(masks)


def of_tiles(tiles: DataFrame, slide: str = "slide") -> DataFrame:
    """One row a slide with its document, tiles in the order of tile_seq: for slides that fit into a row."""
    tile = F.struct(*[F.col(c).cast("double").alias(c) for c in LEVEL], "masks")
    each = F.array_sort(F.collect_list(F.struct("tile_seq", tile.alias("tile"))))
    return tiles.groupBy(slide, "model_name", "inference_mpp").agg(F.transform(each, lambda t: t["tile"]).alias("cell_masks"))


def nest(rows: DataFrame, model: str, mpp: float, slide: str = "slide") -> DataFrame:
    """From one row a cell, as for tile_rows, to one row a slide with its document."""
    return of_tiles(tile_rows(rows, model, float(mpp), slide), slide)


def to_text(docs: DataFrame, slide: str = "slide") -> DataFrame:
    return docs.select(slide, F.to_json(F.struct("model_name", "inference_mpp", "cell_masks"), {"ignoreNullFields": "false"}).alias("value"))


@dataclass
class Written(WriterCommitMessage):
    """Slides that a task wrote, and where their files are until the commit."""

    files: dict[str, str] = field(default_factory=dict)


class DocumentWriter(DataSourceWriter):
    """A task streams its slides into files of its own under a folder of the job; the commit moves each to its slide's folder and replaces what was there, and no other slide's. A
    file is there whole or not at all; if the job fails, or a task is run again, what was written on the way goes with the job's folder."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.job = posixpath.join(self.path, f"_writing-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Written:
        out, slide, stream, closed = Written(), None, None, set()
        files, job = file_system(self.job)
        for row in iterator:
            if row.slide != slide:
                self._end(stream)
                if row.slide in closed:
                    raise ValueError(f"rows of {row.slide} do not lie side by side")
                closed.add(row.slide)
                files.create_dir(job, recursive=True)
                slide, out.files[row.slide] = row.slide, posixpath.join(job, uuid.uuid4().hex)
                stream = files.open_output_stream(out.files[slide])
                stream.write(row.head.encode())
                first = True
            stream.write(("\n" if first else ",\n").encode() + row.line.encode())
            first = False
        self._end(stream)
        return out

    @staticmethod
    def _end(stream) -> None:
        if stream is not None:
            stream.write(b"\n]}\n")
            stream.close()

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = file_system(self.job)
        moves = [(slide, at) for m in messages if m for slide, at in m.files.items()]
        if len({s for s, _ in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("rows of one slide were in several tasks")
        for slide, at in moves:
            folder = posixpath.join(file_system(self.path)[1], slide)
            files.create_dir(folder, recursive=True)
            target = posixpath.join(folder, FILE)
            if files.type_name != "local" and files.get_file_info(target).is_file:
                files.delete_file(target)
            files.move(at, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, job = file_system(self.job)
        if files.get_file_info(job).type.name == "Directory":
            files.delete_dir(job)


class DocumentSink(DataSource):
    """df.write.format("slide_documents").mode("append").save(path), from rows of LINES; `write` makes them."""

    @classmethod
    def name(cls) -> str:
        return "slide_documents"

    def schema(self) -> str:
        return LINES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options)


def write(tiles: DataFrame, path: str, slide: str = "slide") -> None:
    """One file a slide from rows of tiles; slides that have no rows stay as they are. A slide is written by one task, tile by tile."""
    tiles.sparkSession.dataSource.register(DocumentSink)
    tile = F.to_json(F.struct(*[F.col(c).cast("double").alias(c) for c in LEVEL], "masks"), {"ignoreNullFields": "false"})
    model = F.to_json(F.struct("model_name", "inference_mpp"), {"ignoreNullFields": "false"})
    head = F.concat(F.expr("substring(m, 1, length(m) - 1)"), F.lit(',"cell_masks":['))
    rows = tiles.select(F.col(slide).alias("slide"), model.alias("m"), "tile_seq", tile.alias("line")).select("slide", head.alias("head"), "tile_seq", "line")
    rows = rows.repartition("slide").sortWithinPartitions("slide", "tile_seq")
    rows.select("slide", "head", "line").write.format("slide_documents").mode("append").save(path)


def parse(text: DataFrame, column: str = "value") -> DataFrame:
    return text.withColumn("d", F.from_json(column, DOCUMENT)).select("*", "d.*").drop("d", column)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents under a path, whole files, with the file each came from."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """One row a tile of the files that `write` made, read line by line: file, model_name, inference_mpp, level and place, masks. Files of one line, as others may write them, go through `read`."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    heads = lines.where(F.col("value").startswith('{"model_name"')).select(F.col("file").alias("of"), F.from_json(F.concat("value", F.lit("]}")), "model_name string, inference_mpp double").alias("h"))
    tiles = lines.where(F.col("value").startswith('{"level"')).select("file", F.from_json(F.regexp_replace("value", ",$", ""), TILE).alias("t"))
    rows = tiles.join(heads, F.col("file") == F.col("of"))
    return rows.select("file", "h.*", *[F.col(f"t.{c}").cast("int").alias(c) for c in LEVEL], F.col("t.masks").alias("masks"))


def tiles_of(docs: DataFrame, *keep: str) -> DataFrame:
    """One row a tile; its whole numbers as such again."""
    rows = docs.select(*keep, "model_name", "inference_mpp", F.posexplode_outer("cell_masks").alias("tile_seq", "t"))
    return rows.select(*keep, "model_name", "inference_mpp", (F.col("tile_seq") + 1).alias("tile_seq"), *[F.col(f"t.{c}").cast("int").alias(c) for c in LEVEL], F.col("t.masks").alias("masks"))


def cells_of(docs: DataFrame, *keep: str) -> DataFrame:
    """One row a cell; a tile without cells has one row with nulls."""
    return tiles_of(docs, *keep).select("*", F.explode_outer("masks").alias("m")).select("*", "m.*").drop("m", "masks")


def from_lists(rows: DataFrame, lists: tuple[str, ...]) -> DataFrame:
    """Rows with equally long lists side by side to one row an element; ok is false, and the elements null, where lengths differ."""
    same = F.lit(True)
    for name in lists[1:]:
        same &= F.size(name) == F.size(lists[0])
    kept = [c for c in rows.columns if c not in lists]
    zipped = rows.withColumn("ok", F.coalesce(same, F.lit(False))).select(*kept, "ok", F.posexplode_outer(F.when(F.col("ok"), F.arrays_zip(*lists))).alias("position", "z"))
    return zipped.select(*kept, "ok", "position", *[F.col(f"z.{c}").alias(c) for c in lists])
