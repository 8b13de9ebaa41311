"""Token counts by an exact length histogram.

Documents are counted by encoded length: one row a distinct length. Suffix sums over it answer, for every context
limit, how many documents are longer, and how many tokens stay when each document is cut at the limit; totals and quantiles
come from the same rows. The suffix sums are taken within bands of lengths and over the bands, so no task holds all lengths.

Null and empty texts have length 0 and count. Repeated rows count each. Ties are one row. A column of the name of the output is replaced, others stay. An empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import mapped, place, stored, table
from .tokens import encoder

BAND = 1024


def lengths(docs: DataFrame, text: str = "text", out: str = "length", tokenizer: str | None = None) -> DataFrame:
    """Add the number of tokens of the whole text."""
    at = place(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(at)
            yield batch, [pa.array([len(encode(texts[i].as_py())) // 4 for i in range(len(texts))], pa.int64())]

    return mapped(docs, run, StructType([StructField(out, LongType())]))


def histogram(docs: DataFrame, length: str = "length", band: int = BAND) -> DataFrame:
    """Per distinct length: documents and tokens of it; documents and tokens of it or longer; tokens kept when every document
    is cut at it; the share of documents at most so long. The counts by length are stored first, as two sums are taken of them."""
    rows = stored(docs.groupBy(F.col(length).cast("long").alias("length")).agg(F.count("*").alias("documents")).where("length IS NOT NULL"), "lengths")
    rows = rows.withColumn("tokens", F.col("documents") * F.col("length")).withColumn("_band", F.floor(F.col("length") / band))
    within = Window.partitionBy("_band").orderBy(F.desc("length"))
    over = Window.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_band").agg(F.sum("documents").alias("_d"), F.sum("tokens").alias("_t"))
    everyone = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(F.sum(c).over(over), F.lit(0))
    longer = sums.select(F.col("_band").alias("_b"), zero("_d").alias("_d"), zero("_t").alias("_t"), F.sum("_d").over(everyone).alias("_all"), F.sum("_t").over(everyone).alias("_every"))
    out = rows.join(longer, F.col("_band") == F.col("_b"))
    out = out.withColumns({"documents_from": F.sum("documents").over(within) + F.col("_d"), "tokens_from": F.sum("tokens").over(within) + F.col("_t")})
    kept = F.col("_every") - F.col("tokens_from") + F.col("documents_from") * F.col("length")
    share = (F.col("_all") - F.col("documents_from") + F.col("documents")) / F.col("_all")
    return out.select("length", "documents", "tokens", "documents_from", "tokens_from", kept.alias("tokens_cut"), share.alias("share"))


def quantile(rows: DataFrame, q: float) -> DataFrame:
    """The least length that the share q of documents does not exceed."""
    return rows.where(F.col("share") >= q).agg(F.min("length").alias("length"))


def cut_total(rows: DataFrame, limit: int) -> DataFrame:
    """Tokens kept when every document is cut at any limit: from the next length at or above it, or all."""
    at = rows.where(F.col("length") >= limit).agg(F.min_by(F.struct("tokens_from", "documents_from"), "length").alias("x"))
    total = rows.agg(F.sum("tokens").alias("total"))
    return at.join(F.broadcast(total)).select(F.coalesce(F.col("total") - F.col("x.tokens_from") + F.col("x.documents_from") * limit, "total", F.lit(0)).alias("tokens"))


def query(spark, sf_dir):
    return histogram(lengths(table(spark, sf_dir, "documents").select("text")))
