"""Approximate nearest neighbours by a hash-prefix forest.

Each of many trees gives a vector a long hash string: the signs of random projections after centring. A tree is
the sorted array of these strings; the forest is stored in parts of bounded size, each with its own sorted arrays. A query descends every
tree to its longest matching prefix; then all trees ascend together, one bit at a time, until the rows that share so long a prefix with the
query, counted over trees and parts, reach a wanted number. Those are ranked by their exact distance.

How many rows must be visited for a recall depends on the data: vectors without any structure need a large share of
all rows (`share`), clustered ones few (`least`). Queries are taken in blocks of bounded size against all rows.

Vectors that are null, all zero, or hold null or non-finite components take no part; neither do rows without an id. Only vectors
of one length have a distance: each length has a forest of its own. A query's own id is never its neighbour, however often it is repeated; a repeated id asks once, with
its shortest, then least vector. Equal distances go to the smaller id. Queries with fewer candidates than k get them all. Columns of other names are not looked at. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Blocks, stored, table

TREES, BITS = 128, 24
#: Queries of a block, and of those that a task takes at once; rows of a part.
QUERIES, SOME, CHUNK = 8192, 1024, 4096
RESULT = "query_id long, id long, score double"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, as doubles."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def _matrix(batch: pa.RecordBatch, i: int) -> np.ndarray:
    column = batch.column(i)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _mean(rows: DataFrame, d: int) -> np.ndarray:
    """The mean of all vectors; one sum a task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d)
        for batch in batches:
            x = _matrix(batch, 0)
            n, total = n + len(x), total + x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "s"])

    parts = rows.select("v").mapInArrow(run, "n long, s array<double>").collect()
    return np.sum([p["s"] for p in parts], axis=0) / max(1, sum(p["n"] for p in parts)) if parts else np.zeros(d)


class Hashes:
    """Projections of the forest; the strings of all trees as integers of BITS bits, first bit highest."""

    def __init__(self, mean: np.ndarray, seed: int, trees: int = TREES, bits: int = BITS):
        self.mean, self.trees, self.bits = mean, trees, bits
        self.planes = np.random.default_rng(seed).normal(size=(len(mean), trees * bits)).astype(np.float32)
        self.weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        signs = (x - self.mean).astype(np.float32) @ self.planes > 0
        return signs.reshape(len(x), self.trees, self.bits) @ self.weights


def index(rows: DataFrame, d: int, seed: int = 42) -> tuple[DataFrame, Hashes]:
    """The stored forest of vectors of length d: a row for each part, with ids, vectors, and for every tree the sorted strings and whose they are."""
    hashes = Hashes(_mean(rows, d), seed)
    mean = hashes.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Hashes(mean, seed)
        ids, x = np.zeros(0, np.int64), np.zeros((0, d))

        def part(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            strings = np.concatenate([own(x[a : a + 2048]) for a in range(0, len(x), 2048)]).T.astype("<i4")
            order = np.argsort(strings, axis=1, kind="stable").astype("<u2")
            blobs = (ids.astype("<i8"), x.astype("<f8"), np.take_along_axis(strings, order.astype(np.int64), 1), order)
            return pa.RecordBatch.from_arrays([pa.array([len(ids)]), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], ["n", "ids", "v", "strings", "owner"])

        for batch in batches:
            if len(batch):
                ids, x = np.concatenate((ids, batch.column(0).to_numpy())), np.concatenate((x, _matrix(batch, 1)))
            while len(ids) >= CHUNK:
                yield part(ids[:CHUNK], x[:CHUNK])
                ids, x = ids[CHUNK:], x[CHUNK:]
        if len(ids):
            yield part(ids, x)

    return stored(rows.mapInArrow(run, "n long, ids binary, v binary, strings binary, owner binary"), "forest"), hashes


def _parts(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors, sorted strings and owners of each part."""
    for batch in batches:
        for i, n in enumerate(batch.column(0).to_pylist()):
            blob = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: E731, B023
            yield blob(1, "<i8"), blob(2, "<f8").reshape(n, d), blob(3, "<i4").reshape(-1, n), blob(4, "<u2").reshape(-1, n)


def _range(sorted_: np.ndarray, q: np.ndarray, drop: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings lie that agree with q but for its last `drop` bits."""
    low = (q >> drop) << drop
    return np.searchsorted(sorted_, low, "left"), np.searchsorted(sorted_, low + (1 << np.asarray(drop)), "left")


def _search(rows: DataFrame, asked: DataFrame, d: int, k: int, share: float, least: int, seed: int) -> DataFrame:
    """RESULT rows, with each query's k nearest of every part among them, of vectors of length d. The forest is read twice, whatever the number of queries: each part meets the blocks of queries in turn."""
    spark = rows.sparkSession
    forest, hashes = index(rows, d, seed)
    wanted = max(least, int(share * (forest.agg(F.sum("n")).first()[0] or 0)))
    count = max(1, -(-asked.count() // QUERIES))
    sent, sizes = Blocks(spark), []
    for block in range(count):
        # about QUERIES rows by a hash of the id: a bounded part of the query set
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(count)) == block).orderBy("id").toArrow()
        v = got["v"].combine_chunks().flatten().to_numpy().reshape(len(got), -1) if len(got) else np.zeros((0, d))
        sent.add((got["id"].to_numpy(), v, hashes(v).astype(np.int64)))
        sizes.append(len(got))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, strings, _ in _parts(batches, d):
            for block, (_, _, qh) in enumerate(sent):
                seen = np.zeros((len(qh), BITS + 1), np.int64)
                for t, s in enumerate(strings):
                    for drop in range(BITS + 1):
                        a, b = _range(s, qh[:, t], drop)
                        seen[:, BITS - drop] += b - a
                        if drop and (b - a == len(s)).all():
                            seen[:, : BITS - drop] += len(s)
                            break
                q, level = np.nonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block)), pa.array(q), pa.array(level), pa.array(seen[q, level])], ["block", "q", "level", "n"])

    sums = forest.mapInArrow(counts, "block long, q long, level long, n long").groupBy("block", "q", "level").agg(F.sum("n").alias("n")).where(F.col("n") >= wanted)
    levels = stored(sums.groupBy("block", "q").agg(F.max("level").alias("level")), "levels")
    stops = Blocks(spark)
    for block, size in enumerate(sizes):
        got = levels.where(F.col("block") == block).toArrow()
        level = np.zeros(size, np.int64)  # without enough anywhere, up to the roots
        level[got["q"].to_numpy()] = got["level"].to_numpy()
        stops.add(level)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, x, strings, owner in _parts(batches, d):
            for (qid, qv, qh), stop in zip(sent, stops, strict=True):
                drop = BITS - stop
                for q in range(0, len(qid), SOME):
                    some = slice(q, q + SOME)
                    may = np.zeros((len(qid[some]), len(own)), bool)
                    for t, s in enumerate(strings):
                        a, b = _range(s, qh[some, t], drop[some])
                        n = b - a
                        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                        may[np.repeat(np.arange(len(n)), n), owner[t, flat]] = True
                    out = []
                    for i, (id_, one) in enumerate(zip(qid[some], qv[some], strict=True)):
                        at = np.flatnonzero(may[i] & (own != id_))
                        if not len(at):
                            continue
                        score = np.sqrt(((x[at] - one) ** 2).sum(1))
                        if len(at) > k:
                            edge = np.partition(score, k - 1)[k - 1]
                            near = np.flatnonzero(score <= edge)
                            at, score = at[near], score[near]
                        best = np.lexsort((own[at], score))[:k]
                        out.append((np.full(len(best), id_), own[at[best]], score[best]))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "id", "score"])

    return forest.mapInArrow(nearest, RESULT)


def search(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, share: float = 0.4, least: int = 2000, seed: int = 42) -> DataFrame:
    """(query_id, rank, key, score): the k nearest found of each row for which `queries` holds (a condition on the column id)."""
    rows = usable(vectors, key, vector)
    asked = rows.where(queries).groupBy("id").agg(F.min(F.struct(F.size("v").alias("d"), "v")).alias("q")).select("id", "q.d", "q.v")
    found = vectors.sparkSession.createDataFrame([], RESULT)
    for d, in asked.select("d").distinct().orderBy("d").collect():  # nearly always one length
        found = found.union(_search(rows.where(F.size("v") == d), asked.where(F.col("d") == d), d, k, share, least, seed))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def query(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
