"""Tables, shared storage and skew-safe ranking used by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.shared import checkpointed, discard, shared_dir, stored  # noqa: F401
from .text import released

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes that go to a Python worker at once. Texts are handled in slices of a megabyte, so larger batches would only take memory.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH where it is larger."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(c for c in spark.conf.get(key) if c.isdigit())) > BATCH:  # a session's value is in plain bytes
        spark.conf.set(key, f"{BATCH}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name)
        out.append(name)
    return out


def plain(column: str) -> str:
    """A column's name as it is, whatever signs are in it."""
    return "`" + column.replace("`", "``") + "`"


class Blocks:
    """A bounded part of a query set at a time: each is sent to executors on its own, and a task that goes through them holds one."""

    def __init__(self, spark: SparkSession):
        self.context, self.sent = spark.sparkContext, []

    def add(self, value) -> None:
        self.sent.append(self.context.broadcast(value))

    def __len__(self) -> int:
        return len(self.sent)

    def __iter__(self) -> Iterator:
        for one in self.sent:
            yield one.value
            if len(self.sent) > 1:
                one.__dict__.pop("_value", None)  # read again when its turn comes again

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "context": None}


def place(df: DataFrame, name: str) -> int:
    """Where a column is; a name in another case will do if there is none in this one."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]], added: StructType, in_place: bool = False) -> DataFrame:
    """df with columns made in tasks: `run` gives batches of df's rows, or slices of them, each with an array for every added field.

    Columns of an added name, whatever its case, are replaced (in_place: where they were, else by columns at the end); others stay. Inside, columns have names by place, so any signs may be in theirs.
    """
    gone = {f.name.lower() for f in added}
    kept = [i for i, f in enumerate(df.schema) if f.name.lower() not in gone]
    fields = [*[df.schema[i] for i in kept], *added]
    inner = [f"c{i}" for i in range(len(fields))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, arrays in run(batches):
            yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in kept], *arrays], inner)

    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = rows.mapInArrow(released(task), StructType([StructField(n, f.dataType) for n, f in zip(inner, fields, strict=True)]))
    if in_place:
        at = [*kept, *[place(df, f.name) for f in added]]
        order = sorted(range(len(fields)), key=at.__getitem__)
        out, fields = out.select(*[inner[i] for i in order]), [fields[i] for i in order]
    return out.toDF(*[f.name for f in fields])


def seeded(seed: int, *columns: str) -> Column:
    """A hash that orders rows as if at random but always alike."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


#: Rows of a bucket that are numbered together, about.
BUCKET = 1 << 16


def ranked(df: DataFrame, keys: list[str], order: list[str], seed: int, name: str, buckets: int | None = None) -> DataFrame:
    """Number the rows of each key from 1 in a seeded order, in column `name`.

    A key's rows are dealt over hash buckets, as many as the number of all rows asks for; a rank is the rank within the bucket plus the counts of the
    buckets before it, so no task holds a whole key however many rows it has. Rows equal in all of `order`
    take neighbouring numbers. df is read three times: store it first.
    """
    buckets = buckets or max(16, -(-df.count() // BUCKET))
    h, b, n, ahead, own, at, *right = fresh(df, "hash", "bucket", "n", "before", "within", "at", *[f"key{i}" for i in range(len(keys))])
    rows = df.withColumn(h, seeded(seed, *order)).withColumn(b, F.pmod(F.col(h), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(*keys, b).agg(F.count("*").alias(n))
    before = counts.withColumn(ahead, F.sum(n).over(Window.partitionBy(*keys).orderBy(b)) - F.col(n))
    within = rows.withColumn(own, F.row_number().over(Window.partitionBy(*keys, b).orderBy(h, *order)))
    before = before.select(*[F.col(k).alias(r) for k, r in zip(keys, right, strict=True)], F.col(b).alias(at), ahead)
    on = F.col(b) == F.col(at)
    for k, r in zip(keys, right, strict=True):
        on &= F.col(k).eqNullSafe(F.col(r))
    return within.join(before, on, "left").withColumn(name, F.col(ahead) + F.col(own)).drop(h, b, own, ahead, at, *right)
