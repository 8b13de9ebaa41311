"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Node features are what its bytes and words look like, and the same of the lines before
and after it; edges weigh the change of label from line to line. The field is fitted on a bounded sample of labelled
documents. Only documents have labels, so every line takes its document's: edges are fitted on pairs of equal labels alone, and learn how much a
line's neighbours say about it. A document's score is the mean of its lines' forward-backward
marginals, weighted by length.

Null and empty texts are one empty line and get the score that the field gives to that. Texts of any length are scored whole, with all
their lines. Without any labels every score is one half. Repeated rows are scored alike; labels that are null or
neither 0 nor 1 are ignored. Ties do not arise. A column of the name of the output, whatever its case, is replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import mapped, place, stored, table
from .text import lists, released, slices, word_hashes, words

#: Labelled documents that the field is fitted on, and lines of them in all, at most.
SAMPLE, LINES = 6000, 150_000
_CLASS = np.zeros(256, np.uint8)  # 0: other symbols
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", ".,;:?!", "|", "\n"), 1):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = 8
CLASSES, OWN = 9, 20


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some whole texts: features (lines, OWN), weights (lines) and the first line of each text."""
    rows = len(offsets) - 1
    cuts = np.flatnonzero(data == 10)
    starts = np.concatenate((offsets[:-1], cuts + 1))
    order = np.argsort(starts, kind="stable")  # a text's start comes before its own line breaks
    row = np.concatenate((np.arange(rows), np.searchsorted(offsets, cuts, "right") - 1))[order]
    starts = starts[order]
    # equal starts happen at empty texts and at breaks that end a text: keep rows together
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    first = np.searchsorted(row, np.arange(rows + 1))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]
    size = (ends - starts).astype(np.float64)
    x = np.zeros((len(starts), OWN))
    kind = _CLASS[data]
    for k in range(CLASSES):
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == k, dtype=np.int32, out=sums[1:])
        x[:, k] = (sums[ends] - sums[starts]) / np.maximum(size, 1)
    ws, we, _ = words(data, offsets)
    h = word_hashes(data, ws, we)
    line = np.searchsorted(starts, ws, "right") - 1 if len(ws) else ws
    n = np.bincount(line, minlength=len(starts)).astype(np.float64) if len(ws) else np.zeros(len(starts))
    for k, lag in ((9, 1), (10, 2), (11, 5)):
        if len(h) > lag:
            same = (h[lag:] == h[:-lag]) & (line[lag:] == line[:-lag])
            x[:, k] = np.bincount(line[lag:][same], minlength=len(starts)) / np.maximum(n, 1)
    x[:, 12] = np.log1p(size) / 5
    x[:, 13] = np.log1p(n) / 4
    x[:, 14] = size / np.maximum(n, 1) / 10
    some = size > 0
    x[some, 15] = _CLASS[data[ends[some] - 1]] == 5
    x[some, 16] = _CLASS[data[starts[some]]] == 2
    x[:, 17] = ~some
    lh = word_hashes(data, starts, ends)
    order = np.lexsort((lh, row))
    again = np.zeros(len(starts))
    again[order[1:]] = (lh[order][1:] == lh[order][:-1]) & (row[order][1:] == row[order][:-1])
    x[:, 18] = again * some
    x[:, 19] = np.log1p(np.diff(first))[row] / 5
    return x, size + 1, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after in the same text, edge flags and a constant."""
    n = len(x)
    out = np.zeros((n, 3 * OWN + 3))
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[first[:-1]] = True
    tail[first[1:] - 1] = True
    out[:, :OWN] = x
    out[1:, OWN : 2 * OWN] = x[:-1]
    out[head, OWN : 2 * OWN] = 0
    out[:-1, 2 * OWN : 3 * OWN] = x[1:]
    out[tail, 2 * OWN : 3 * OWN] = 0
    out[:, -3], out[:, -2], out[:, -1] = head, tail, 1
    return out


def forward_backward(score: np.ndarray, first: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label 1 per line, summed pair marginals (texts, 2, 2) and log partition per text.

    All texts go through the chain side by side, the ones with more lines first, so that at each step those with
    lines left are a leading part.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    at, left = first[:-1][order], n[order]
    steps = int(left[0]) if len(left) else 0
    active = np.searchsorted(-left, -np.arange(steps), "left")  # texts with more than t lines
    node = np.exp(np.clip(np.stack((np.zeros(len(score)), score), 1), -30, 30))
    move = np.exp(np.clip(edge, -30, 30))
    ahead, back = np.empty((len(score), 2)), np.ones((len(score), 2))
    log_z = np.zeros(len(n))
    for t in range(steps):
        k = active[t]
        i = at[:k] + t
        a = node[i] if t == 0 else node[i] * (ahead[i - 1] @ move)
        z = a.sum(1, keepdims=True)
        ahead[i] = a / z
        log_z[:k] += np.log(z[:, 0])
    pairs = np.zeros((len(n), 2, 2))
    for t in range(steps - 1, 0, -1):
        k = active[t]
        i = at[:k] + t
        b = node[i] * back[i]
        joint = ahead[i - 1][:, :, None] * move * b[:, None, :]
        pairs[:k] += joint / joint.sum((1, 2), keepdims=True)
        b = b @ move.T
        back[i - 1] = b / b.sum(1, keepdims=True)
    both = ahead * back
    inverse = np.argsort(order)
    return both[:, 1] / both.sum(1), pairs[inverse], log_z[inverse]


class Field:
    """Weights of a fitted chain."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, edge: np.ndarray):
        self.mean, self.scale, self.weight, self.edge = mean, scale, weight, edge

    @classmethod
    def fit(cls, x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 200, rate: float = 0.05, decay: float = 1e-3) -> Field:
        """Maximise the mean log-likelihood per document (a document's own divided by its lines) by Adam."""
        full = with_neighbours(x, first)
        mean, scale = full.mean(0), full.std(0)
        mean[-1], scale[scale < 1e-9] = 0, 1
        full = (full - mean) / scale
        n = np.diff(first)
        row = np.repeat(np.arange(len(n)), n)
        y, share = label[row].astype(float), 1 / n[row] / len(n)
        seen = np.zeros((len(n), 2, 2))
        seen[np.arange(len(n)), label.astype(int), label.astype(int)] = n - 1
        p = np.zeros(full.shape[1] + 4)
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, rounds + 1):
            w, edge = p[:-4], p[-4:].reshape(2, 2)
            good, pairs, _ = forward_backward(full @ w, first, edge)
            g = np.concatenate((full.T @ ((y - good) * share), ((seen - pairs) / n[:, None, None] / len(n)).sum(0).ravel())) - decay * p
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        return cls(mean, scale, p[:-4].copy(), p[-4:].reshape(2, 2).copy())

    @classmethod
    def blank(cls) -> Field:
        d = 3 * OWN + 3
        return cls(np.zeros(d), np.ones(d), np.zeros(d), np.zeros((2, 2)))

    def lines(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The marginal of good of each line."""
        return forward_backward((with_neighbours(x, first) - self.mean) / self.scale @ self.weight, first, self.edge)[0]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, weight, first = line_features(data, offsets)
        good = self.lines(x, first) * weight
        return np.clip(np.add.reduceat(good, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, lines: int = LINES) -> Field:
    """Fit on at most `sample` labelled documents, chosen by a hash of the key; of these, in that order, each that still fits into `lines` lines together. Where
    not one does, the shortest is taken whole, so there is a fit wherever there is a label. The line features of those come to the driver."""
    chosen = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).where("_key IS NOT NULL AND _label IN (0, 1)")
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key", "_label").limit(sample)
    rows = docs.select(F.col(key).alias("_of"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_of") == F.col("_key")).select("_key", "_text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                x, _, first = line_features(data, offsets)
                flat = [x[i:j].astype(np.float32).ravel() for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), lists(flat, pa.float32()), batch.column(2).slice(a, b - a)], ["id", "n", "x", "label"])

    made = stored(rows.mapInArrow(released(run), f"id {labels.schema[key].dataType.simpleString()}, n long, x array<float>, label int"), "lines")
    made = made.withColumn("at", F.xxhash64("id", "n", "label"))
    sizes = made.groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").limit(sample).toPandas()  # numbers of lines alone
    taken, total = [], 0
    for at, n in zip(sizes["at"].tolist(), sizes["n"].tolist(), strict=True):
        if total + n <= lines:
            taken.append((at,))
            total += n
    if taken:
        got = made.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "at long")), "at").orderBy("at", "x").limit(sample).toArrow()
    else:
        got = made.orderBy("n", "at", "x").limit(1).toArrow()
    if not len(got):
        return Field.blank()
    n = np.array([len(v) // OWN for v in got["x"]])
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, OWN).astype(float)
    return Field.fit(x, np.concatenate(([0], np.cumsum(n))), got["label"].to_numpy())


def score(docs: DataFrame, field: Field, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score, from 0 to 1."""
    at = place(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            got = [field.score(data, offsets) for _, _, data, offsets in slices(batch.column(at))]
            yield batch, [pa.array(np.concatenate(got) if got else np.zeros(0))]

    return mapped(docs, run, StructType([StructField(out, DoubleType())]))


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def query(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    field = fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    rows = score(docs, field).drop("text")
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
