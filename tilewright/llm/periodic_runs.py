"""Periodic runs of words by the runs theorem.

A run is a stretch of words with least period q that is repeated `times` times or more, holds `least` words or more and that no neighbouring word extends. The root of every
run is, at some place of it, the longest Lyndon word under one of the two orders of the words, and that word ends before the next smaller value of the
inverse suffix array (next greater one for the other order). So two candidates a word are extended to both sides by queries for common
prefixes: range minima, from a sparse table, over the array of longest common prefixes of the words and of the words read backwards.

Texts are worked on in slices of about a megabyte (a longer text comes alone): their words are put behind each other with marks between them that
occur once, so all steps are numpy operations on a slice, and no step needs another row. A slice takes some 100 bytes a word, and 8 more for each doubling of
its words. Words are compared as they are, without hashes.

Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows are worked on one by one. Texts of any length are taken whole. Empty tables give empty
results. Columns of the names of the outputs, whatever their case, are replaced; others stay. Ties of the longest run go to the least start, then the least period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import mapped, place, plain, table
from .text import slices

LEAST, TIMES = 6, 4
#: Rounds of jumps before the few places left descend a table.
JUMPS = 16
RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


def suffix_array(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks of suffixes by their first 1, 2, 4, ... symbols; equal symbols share ranks. By doubling: only groups of suffixes that
    are still alike are sorted again. Two suffixes must differ before either ends."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    slot, at, value, k, levels = np.arange(n), order, key[order], 1, []
    while True:
        first = np.ones(len(at), bool)
        first[1:] = value[1:] != value[:-1]
        rank[at] = slot[np.flatnonzero(first)[np.cumsum(first) - 1]]
        levels.append(rank.astype(np.int32))
        alone = first.copy()
        alone[:-1] &= first[1:]
        slot, at = slot[~alone], at[~alone]
        if not len(at):
            return order, levels
        value = rank[at] * (n + 1) + rank[at + k]
        by = np.argsort(value, kind="stable")
        at, value, k = at[by], value[by], 2 * k
        order[slot] = at


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in order; 0 for the first."""
    a, b = order[:-1].copy(), order[1:].copy()
    start = a.copy()
    for i in reversed(range(len(levels))):
        step = (levels[i][a] == levels[i][b]).astype(np.int64) << i
        a += step
        b += step
    return np.concatenate(([0], a - start)).astype(np.int32)


def sparse_minima(x: np.ndarray) -> list[np.ndarray]:
    """Minima of x over 1, 2, 4, ... elements from each place."""
    out = [x]
    while 2 << len(out) - 1 <= len(x):
        half, last = 1 << len(out) - 1, out[-1]
        out.append(np.minimum(last[:-half], last[half:]))
    return out


class Prefixes:
    """Common prefixes of any two suffixes."""

    def __init__(self, order: np.ndarray, levels: list[np.ndarray]):
        self.rank, self.minima = levels[-1], sparse_minima(common_prefixes(order, levels))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.rank[a], self.rank[b]).astype(np.int64) + 1, np.maximum(self.rank[a], self.rank[b]).astype(np.int64) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1  # the greatest power of two within
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            on = level == k
            t = self.minima[k]
            out[on] = np.minimum(t[low[on]], t[high[on] - (1 << k)])
        return out


def next_below(x: np.ndarray) -> np.ndarray:
    """The next place with a smaller value, where all values differ; len(x) if there is none. Places first jump along others' answers; the few that need many jumps descend a table of minima."""
    n = len(x)
    wide = np.append(x, x.min() - 1 if n else 0)
    out = np.minimum(np.arange(1, n + 2), n)
    left = np.arange(n)
    for _ in range(JUMPS):
        left = left[wide[out[left]] > wide[left]]
        if not len(left):
            return out[:n]
        out[left] = out[out[left]]
    left = left[wide[out[left]] > wide[left]]
    if len(left):
        minima, at = sparse_minima(wide), out[left]
        for k in reversed(range(len(minima))):
            t = minima[k]
            fits = at < len(t)
            fits[fits] = t[at[fits]] > wide[left[fits]]
            at = at + (fits.astype(np.int64) << k)
        out[left] = at
    return out[:n]


def runs(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of every run of some texts, each an array of the numbers of its words (from 0; equal words have equal ones), by text, start and
    period. Any order of the numbers will do."""
    if times < 2:
        raise ValueError("a run holds its period twice at least")
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    none = (np.zeros(0, np.int64),) * 4
    if not total:
        return none
    # a mark before the first text and after every text; a text's words come after its mark in order, and before the next text's
    words = np.concatenate(texts).astype(np.int64)
    wide, n, m = int(words.max()) + 2, total + len(texts) + 1, len(texts)
    text = np.repeat(np.arange(m), sizes)
    place = np.arange(total) + text + 1
    marks = np.concatenate(([0], np.cumsum(sizes + 1)))
    key = np.empty(n, np.int64)
    key[place] = (text + 1) * wide + words + 1
    key[marks] = np.arange(m + 1) * wide
    ahead = suffix_array(key)
    rank = ahead[1][-1].astype(np.int64)
    i = np.concatenate((place, place))
    j = np.concatenate((next_below(rank)[place], next_below(-rank)[place]))
    end = marks[text + 1]
    inside = j < np.concatenate((end, end))  # a longest Lyndon word that reaches the mark is no root
    i, j = i[inside], j[inside]
    near = (key[i] == key[j]) | (key[i - 1] == key[j - 1])  # else neither side can be extended
    i, j = i[near], j[near]
    if not len(i):
        return none
    right = Prefixes(*ahead)(i, j)
    del ahead
    left = Prefixes(*suffix_array(key[::-1].copy()))(n - i, n - j)
    start, length, period = i - left, j - i + left + right, j - i
    good = length >= np.maximum(least, times * period)
    start, length, period = start[good], length[good], period[good]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (period[1:] != period[:-1])
    start, length, period = start[first], length[first], period[first]
    of = np.searchsorted(marks, start, "right") - 1
    return of, start - marks[of] - 1, length, period


def numbered(rows: list[list[bytes]]) -> list[np.ndarray]:
    """Words as numbers that tell them apart."""
    seen: dict[bytes, int] = {}
    return [np.fromiter((seen.setdefault(w, len(seen)) for w in row), np.int64, len(row)) for row in rows]


def find(docs: DataFrame, text: str = "text", found: str = "runs", collapsed: str = "collapsed", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Add the runs of each text, (start, length, period) in words by start and period, and its words without those that a run repeats, joined by one space: all
    that a run contains after its first period."""
    at = place(docs, text)
    schema = StructType([StructField(found, ArrayType(RUN, False)), StructField(collapsed, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(at)):
                rows = [data[p:q].tobytes().split() for p, q in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                of, *parts = runs(numbered(rows), least, times)
                bounds = np.searchsorted(of, np.arange(len(rows) + 1))
                out = []
                for k, row in enumerate(rows):
                    s, e = bounds[k], bounds[k + 1]
                    if s < e:
                        edge = np.zeros(len(row) + 1, np.int64)
                        np.add.at(edge, parts[0][s:e] + parts[2][s:e], 1)
                        np.add.at(edge, parts[0][s:e] + parts[1][s:e], -1)
                        row = [row[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    out.append(b" ".join(row))
                each = pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in parts], ["start", "length", "period"])
                yield batch.slice(a, b - a), [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each), pa.array(out, pa.binary()).view(pa.string())]

    return mapped(docs, run, schema)


def with_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts of the query: where the crc32 h of the key as text is a multiple of 10, the words from one that h chooses on repeat a stretch whose length h chooses as well.
    A text without words, or whose key is null, stays."""
    h = F.crc32(F.col(plain(key)).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.get(w, i.cast("int"))
        new = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i >= a, at(a + (i - a) % p)).otherwise(at(i)))
        return F.when(n > 0, F.concat_ws(" ", new)).otherwise("")

    words = F.filter(F.split(F.col(plain(text)), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    once = F.element_at(F.transform(F.array(words), repeated), 1)
    return docs.withColumn(text, F.when(F.coalesce(h % 10 == 0, F.lit(False)) & F.col(plain(text)).isNotNull(), once).otherwise(F.col(plain(text))))


def query(spark, sf_dir):
    rows = find(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    text = lambda c: c.cast("string")
    every = F.concat_ws("", F.transform("runs", lambda r: F.concat(text(r["start"]), F.lit(","), text(r["length"]), F.lit(","), text(r["period"]), F.lit("\n"))))
    rows = rows.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(every.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
