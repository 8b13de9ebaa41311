"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Documents are encoded and cut into pieces of at most `capacity` tokens. Only how many pieces there are of each
length decides the packing, so a chromosome is a multiset of bins: how often each bin pattern (length, times) occurs.
Crossover injects whole well-filled bins of one parent into the other, takes away bins that then hold too many
pieces of a length, and puts displaced pieces back by best fit, longest first. Islands evolve in Spark tasks from packings in
random orders, and pass their elites round between epochs; each breeds, and elites migrate, at least once before the search may stop
at the least possible number of bins. What an island holds is bounded by the capacity (lengths and patterns), whatever the number
of documents. Pieces then find their places by their rank within their length.

Null and empty texts are documents of one token, the separator. Repeated rows are packed as documents of their
own. An empty table gives an empty result. Longer documents are cut; their last piece may be shorter. Pieces of one length, ties for a
place, take their places in the order of a seeded hash of their keys, so reruns agree. Columns sequence_id and offset of the input are replaced.
"""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fresh, mapped, plain, ranked, stored, table
from .text import released
from .tokens import encoder

CAPACITY = 2048
Pattern = tuple[tuple[int, int], ...]
Bins = dict[Pattern, int]
END = (0).to_bytes(4, "little")


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32."""
    kind = docs.schema[key].dataType.simpleString()
    path = tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            row, piece, start, length, crc = [], [], [], [], []
            for i in range(len(texts)):
                ids = encode(texts[i].as_py()) + END
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            cols = [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(released(run), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


class Open:
    """Bins by free space, with a bit set of the spaces that occur."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, pattern: Pattern, n: int, free: int) -> None:
        if n:
            self.by[free].append((pattern, n))
            self.mask |= 1 << free

    def best_fit(self, length: int, count: int) -> None:
        """Place `count` pieces one after another, each into the fullest bin that has room."""
        while count:
            room = self.mask >> length
            if not room:
                each = self.capacity // length
                whole, rest = divmod(count, each)
                self.put(((length, each),), whole, self.capacity - each * length)
                if rest:
                    self.put(((length, rest),), 1, self.capacity - rest * length)
                return
            free = length + (room & -room).bit_length() - 1
            pattern, n = self.by[free].pop()
            if not self.by[free]:
                self.mask &= ~(1 << free)
            each = free // length
            bins = min(n, count // each)
            if bins:
                self.put((*pattern, (length, each)), bins, free - each * length)
                self.put(pattern, n - bins, free)
                count -= bins * each
            else:
                self.put((*pattern, (length, count)), 1, free - count * length)
                self.put(pattern, n - 1, free)
                count = 0

    def bins(self) -> Bins:
        out: Bins = {}
        for entries in self.by:
            for pattern, n in entries:
                joined: dict[int, int] = {}
                for length, times in pattern:
                    joined[length] = joined.get(length, 0) + times
                key = tuple(sorted(joined.items(), reverse=True))
                out[key] = out.get(key, 0) + n
        return out


def filled(pattern: Pattern) -> int:
    return sum(length * times for length, times in pattern)


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones."""
    return -sum(bins.values()), sum(n * (filled(p) / capacity) ** 2 for p, n in bins.items())


def packed(counts: dict[int, int], capacity: int, order: list[int] | None = None) -> Bins:
    space = Open(capacity)
    for length in order or sorted(counts, reverse=True):
        space.best_fit(length, counts[length])
    return space.bins()


def crossover(one: Bins, other: Bins, counts: dict[int, int], capacity: int, rng: random.Random) -> Bins:
    """Inject well-filled bins of `other` into `one`, remove what is then twice there, best-fit what is displaced."""
    left, space = dict(counts), Open(capacity)
    limit = capacity * rng.uniform(0.97, 1.0)

    def take(pattern: Pattern, n: int) -> None:
        n = min([n, *(left[length] // times for length, times in pattern)])
        if n > 0:
            for length, times in pattern:
                left[length] -= n * times
            space.put(pattern, n, capacity - filled(pattern))

    for pattern, n in other.items():
        if filled(pattern) >= limit and rng.random() < 0.5:
            take(pattern, rng.randint(1, n))
    for pattern in sorted(one, key=lambda p: (-filled(p), rng.random())):
        take(pattern, one[pattern])
    for length in sorted((k for k, n in left.items() if n), reverse=True):
        space.best_fit(length, left[length])
    return space.bins()


def evolve(counts: dict[int, int], capacity: int, elites: list[Bins], seed: int, population: int, generations: int, least: int) -> list[Bins]:
    """One island's epoch: the two best chromosomes. An island without elites starts from packings of all pieces, longest first, and in random orders, the more at
    random the later; one generation at least is bred."""
    rng = random.Random(seed)
    herd = list(elites)
    best = lambda: sorted(herd, key=lambda b: fitness(b, capacity), reverse=True)
    while len(herd) < population:
        spread = 0.5 * len(herd) / population
        herd.append(packed(counts, capacity, sorted(counts, key=lambda k: -k * rng.uniform(1 - spread, 1 + spread))))
    for _ in range(generations):
        herd = best()[:population]
        pick = lambda: herd[min(rng.randrange(len(herd)), rng.randrange(len(herd)))]
        herd += [crossover(pick(), pick(), counts, capacity, rng) for _ in range(population // 2)]
        if -max(fitness(b, capacity)[0] for b in herd) <= least:
            break
    return best()[:2]


def plan(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, islands: int = 6, epochs: int = 3, population: int = 8, generations: int = 4, seed: int = 42) -> Bins:
    """The best packing of the length counts that the islands find."""
    if not counts:
        return {}
    least = max(1, -(-sum(k * n for k, n in counts.items()) // capacity))
    elites: list[list[Bins]] = [[] for _ in range(islands)]
    best: Bins = {}
    for epoch in range(max(2, epochs)):
        sent = [[list(b.items()) for b in e] for e in elites]

        def run(batches, epoch=epoch, sent=sent):
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    came = [{tuple(map(tuple, p)): n for p, n in b} for b in sent[i]]
                    out = evolve(counts, capacity, came, seed + 1000 * epoch + i, population, generations, least)
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([json.dumps([list(b.items()) for b in out])])], ["id", "elites"])

        rows = spark.range(0, islands, 1, islands).mapInArrow(run, "id long, elites string").collect()
        found = {r["id"]: [{tuple(map(tuple, p)): n for p, n in b} for b in json.loads(r["elites"])] for r in rows}
        best = max([*(b for e in found.values() for b in e), *([best] if best else [])], key=lambda b: fitness(b, capacity))
        if epoch and sum(best.values()) <= least:
            break
        elites = [[*found[i], found[(i - 1) % islands][0]] for i in range(islands)]  # migration round the ring
    return best


def slots(bins: Bins) -> np.ndarray:
    """Rows (length, first rank, bins, first sequence, offset), by length and rank: ranks go over the bins, then over the times."""
    rows, used, sequence = [], {}, 0
    for pattern in sorted(bins, key=lambda p: (-filled(p), p)):
        n, at = bins[pattern], 0
        for length, times in pattern:
            first = used.get(length, 0)
            rows.append((length, first, n, sequence, at))
            used[length] = first + n * times
            at += length * times
        sequence += n
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(items: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece"), length: str = "length", seed: int = 42, **options) -> DataFrame:
    """Add sequence_id and offset to items, which have a length from 1 to capacity. items is read several times: store it first."""
    spark = items.sparkSession
    items = items.drop(*[c for c in items.columns if c.lower() in ("sequence_id", "offset")])
    counts = {r[0]: r[1] for r in items.groupBy(F.col(length).cast("long")).count().collect()}  # at most `capacity` rows
    where = slots(plan(spark, counts, capacity, seed=seed, **options))
    table_ = spark.sparkContext.broadcast(where)
    size, rank = fresh(items, "size", "rank")
    rows = ranked(items.withColumn(size, F.col(length).cast("long")), [size], list(key), seed, rank)
    last = len(items.columns)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        t = table_.value
        keys = (t[:, 0] << 44) + t[:, 1]
        for batch in batches:
            size = batch.column(last).to_numpy(zero_copy_only=False)
            rank = batch.column(last + 1).to_numpy(zero_copy_only=False) - 1
            at = np.searchsorted(keys, (size << 44) + rank, "right") - 1
            k = rank - t[at, 1]
            yield batch, [pa.array(t[at, 3] + k % t[at, 2]), pa.array(t[at, 4] + k // t[at, 2] * size)]

    out = mapped(rows.select(*[F.col(plain(c)) for c in items.columns], size, rank), placed, StructType([StructField(c, LongType()) for c in ("sequence_id", "offset")]))
    return out.drop(size, rank)


def query(spark, sf_dir):
    return pack(stored(pieces(table(spark, sf_dir, "documents")), "pieces"))
