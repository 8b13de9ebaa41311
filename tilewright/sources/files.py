"""Paths, urls and files as tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or url, and the path in it."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), re.sub("^file:(//)?", "", path)
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def is_url(text: Column) -> Column:
    """Whether text has a scheme and a host part; false for null."""
    return F.coalesce(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def suffix_number(name: Column) -> Column:
    """The number at the end of a file's name, before its extension; null without one. Files that count upwards sort by it, not by their text."""
    digits = F.regexp_extract(name, r"([0-9]+)(\.[^./]*)?$", 1)
    return F.when(digits != "", digits.cast("decimal(38,0)"))


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, size and time of change of the files that match, without their content; through the file system that Spark knows, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(hadoop) or []
    return spark.createDataFrame(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found), "path string, size long, changed long")


def collect_paths(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    """(arg, path, size, changed): urls as they are, patterns expanded and sorted, in the order of the arguments; repeats stay, no match is no row. Size and time of
    change are null for urls."""
    out = spark.createDataFrame([], "arg int, path string, size long, changed long")
    for i, p in enumerate(patterns):
        url = bool(re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", p))
        rows = spark.createDataFrame([(i, p, None, None)], "arg int, path string, size long, changed long") if url else list_files(spark, p).select(F.lit(i).alias("arg"), "path", "size", "changed")
        out = out.union(rows)
    return out.orderBy("arg", "path")


def hashes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """name, size and SHA-256 of files."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_settings(path: str, settings: dict, command: str = "") -> None:
    """The settings of a run as YAML lines, without those whose name starts with an underscore. Run by the driver."""
    with open(path, "w", encoding="utf-8") as f:
        for k, v in settings.items():
            if not k.startswith("_"):
                f.write(f"{k}: {'null' if v is None else str(v).lower() if isinstance(v, bool) else v}\n")
        if command:
            f.write(f"command: {command}\n")
