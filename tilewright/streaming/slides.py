"""New slides as they come: a file stream whose batches run through a function, one status row a slide.

A slide is complete when its file is there, so no watermark is needed. The engine restarts from the checkpoint; a batch that is run again
overwrites its own output, and documents are replaced slide by slide, so nothing is doubled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.extract import extract_paths


def watch(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, glob: str = "*", files: int = 16, once: bool = True) -> StreamingQuery:
    """Run `work` on (path, modificationTime, length) of new files, at most `files` a batch, and write its rows under out/batch=N."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.select("path", "modificationTime", "length").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def extract_new(spark: SparkSession, folder: str, export_dir: str, provider, checkpoint: str, glob: str = "*", files: int = 16, once: bool = True, **options) -> StreamingQuery:
    """Documents of the slides in a folder, those that are there and those that come: EXPORT/NAME/cell_masks.json, and their statuses under EXPORT/_status. Options as for extract_paths();
    with maps_at, a batch that broke off goes on from the maps it had."""

    def work(rows: DataFrame) -> DataFrame:
        paths = rows.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("changed"))
        return extract_paths(paths, export_dir, provider, **options)[1]

    return watch(spark, folder, work, f"{export_dir}/_status", checkpoint, glob, files, once)
