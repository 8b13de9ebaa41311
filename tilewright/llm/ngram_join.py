"""Jaccard self-join on word shingles by a count-vector R-tree, and the groups of documents it links.

A document's set holds the 64-bit hashes of its distinct shingles. Hashed into groups, the set becomes a point of
group counts; the sum of coordinate minima of two points bounds the sets' overlap from above, and the same holds for
the upper corners of two boxes of an R-tree, which so rules out whole subtrees. What survives is verified on the sets.

In many dimensions unrelated points are about equally far apart and boxes prune little, so points are routed first:
two sets that are similar enough share an element among their first ones in any common order (as many as may differ,
and one). That element is one more coordinate of the tree, as is the set's size; routing by it deals the tree over tasks without
losing a pair. Elements that very many sets have come last in the order.

Steps: (1) equal sets become one node. (2) Nodes meet as points in groups by their few least elements; only those that the bound leaves a
partner there go on. (3) They meet again with their sets, each node in its largest group; the pairs that a tree over the group proposes are verified
at once, and pairs that are joined already are passed over, so a group gives one root to each node and never a list of its pairs.
Then the same over all groups, with two nodes for each component that meets there. Groups that are too large are cut into chunks, and if that gave
links they meet once more, cut otherwise. (4) The routes that still lead to several components go through the tree; every pair
of different components that passes the bound is verified. Steps 2 and 3 only make step 4 small; that alone finds all links.

Null texts and texts without words have an empty set, link with nothing and are their own component. Fewer words than
the width make one shingle. Rows that repeat an id count as documents of their own. A null id is never the least. Columns of other
names than key and text are not looked at. An empty table gives an empty result. Equal 64-bit hashes count as equal shingles, and equal sums of a set's
hashes as equal sets. Links within a component are not counted: components are the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..operators.components import components
from .common import discard, fresh, mapped, place, plain, small_batches, stored, table
from .text import U64, lists, mix, released, shingle_sets, slices

STAR = 4
BLOOM_BITS = 1 << 25
#: An element is frequent from this share of all elements on: so at most so many are.
FREQUENT = 1 << 18
WINDOW = 1 << 20
LEAF, FAN = 32, 16
#: Members of one route that meet in one task; more are dealt into blocks. Bytes of points that a task holds, if routes allow.
BLOCK, HELD = 8192, 16 << 20
#: Nodes, and elements of their sets, of a group that meet in one task; larger groups are cut.
CHUNK, ELEMENTS = 4096, 1 << 21
#: Groups of sets with fewer elements than the second number. Powers of two, so that finer counts add up to coarser ones.
CLASSES = ((256, 256), (512, 1024), (1024, 8192), (4096, 1 << 62))


# ---------------------------------------------------------------- sets


def _frequent(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Elements with at least 1/FREQUENT of all elements (and 32), found by counting within windows: at most FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            x = np.sort(np.concatenate(kept)) if kept else np.zeros(0, U64)
            at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
            n = np.diff(np.append(at, len(x)))
            some = n >= max(2, len(x) // (2 * FREQUENT))
            tok = pa.array(np.append(x[at[some]].view(np.int64), 0), mask=np.append(np.zeros(some.sum(), bool), True))
            return pa.RecordBatch.from_arrays([tok, pa.array(np.append(n[some], len(x)))], ["tok", "n"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                kept += (got := shingle_sets(data, offsets, width))
                size += sum(map(len, got))
                if size >= WINDOW:
                    yield counted()
                    kept, size = [], 0
        yield counted()

    counts = docs.select(text).mapInArrow(released(run), "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n"))
    counts = stored(counts, "frequent")
    total = counts.where("tok IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.where("tok IS NOT NULL").where(F.col("n") >= max(32, -(-total // FREQUENT))).select("tok").toArrow()
    return np.sort(rows["tok"].to_numpy().astype(np.int64).view(U64)) if len(rows) else np.zeros(0, U64)


def dimensions(n: int) -> int:
    """Groups for a set of n elements."""
    return next(d for d, most in CLASSES if n < most)


def point(x: np.ndarray, d: int) -> bytes:
    """Counts of the elements by group: one byte each where that suffices, else two (65,535 at most for sets of over 2 ** 27 elements)."""
    counts = np.bincount(((x >> U64(20)) & U64(d - 1)).astype(np.int64), minlength=d)
    return np.minimum(counts, 65535).astype(np.uint8 if counts.max(initial=0) < 256 else np.uint16).tobytes()


def points(vecs: list[bytes], sizes: np.ndarray, d: int) -> np.ndarray:
    """Points of sets of these sizes, as rows of d counts; finer ones are added up."""
    own = np.array([dimensions(int(n)) for n in sizes], np.int64)
    wide = np.array([len(v) for v in vecs], np.int64) > own
    out = np.empty((len(vecs), d), np.uint16)
    for f in np.unique(own):
        for w in (False, True):
            at = np.flatnonzero((own == f) & (wide == w))
            if len(at):
                x = np.frombuffer(b"".join([vecs[i] for i in at]), np.uint16 if w else np.uint8).reshape(len(at), f // d, d)
                out[at] = x[:, 0] if f == d else np.minimum(x.sum(1, dtype=np.int64), 65535)
    return out.astype(np.uint8) if out.max(initial=0) < 256 else out


def _inside(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def signature(x: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(x).sum(dtype=U64) ^ U64(len(x))], U64)).view(np.int64)[0])


def _nodes(docs: DataFrame, key: str, text: str, width: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """Per document: key, n, sig, its first elements in the common order (route), the least ones (star), counts (vec)."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                routes, stars, vecs, sigs = [], [], [], []
                flat = np.concatenate(sets) if sets else np.zeros(0, U64)
                late = _inside(often, flat)
                at = 0
                for x in sets:
                    n = len(x)
                    # at least ceil(n * num / den) elements are common, so one is among the first n - that + 1
                    first = n - -(-n * num // den) + 1 if n else 0
                    last = late[at : at + n]
                    at += n
                    routes.append(np.concatenate((x[~last], x[last]))[:first])
                    stars.append(x[:STAR])
                    vecs.append(point(x, dimensions(n)))
                    sigs.append(signature(x) if n else None)
                cols = [batch.column(0).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(sigs, pa.int64()), lists(routes, pa.int64()), lists(stars, pa.int64()), pa.array(vecs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "n", "sig", "route", "star", "vec"])

    return docs.select(key, text).mapInArrow(released(run), f"key {kind}, n long, sig long, route array<long>, star array<long>, vec binary")


class Bloom:
    """Which of two hashes of a long may be in a table: a bit set of fixed size, made from one part per task of eight."""

    def __init__(self, column: DataFrame):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(BLOOM_BITS // 8, np.uint8)
            for batch in batches:
                for p in Bloom.places(batch.column(0).to_numpy(zero_copy_only=False).view(U64)):
                    np.bitwise_or.at(bits, p >> 3, np.left_shift(np.uint8(1), (p & 7).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for row in column.coalesce(8).mapInArrow(part, "bits binary").toLocalIterator():
            bits |= np.frombuffer(row[0], np.uint8)
        self.bits = column.sparkSession.sparkContext.broadcast(bits)

    @staticmethod
    def places(x: np.ndarray) -> Iterator[np.ndarray]:
        for salt in (1, 2):
            with np.errstate(over="ignore"):
                yield (mix(x + U64(salt)) % U64(BLOOM_BITS)).astype(np.int64)

    @staticmethod
    def has(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for p in Bloom.places(x):
            out &= bits[p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1
        return out


def _sets(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(sig, elements) of the documents whose key's hash is in `wanted`, and of some others."""
    bits = Bloom(wanted).bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = Bloom.has(bits.value, batch.column(0).to_numpy(zero_copy_only=False).view(U64))
            for _, _, data, offsets in slices(batch.column(1).filter(pa.array(may))):
                sets = [x for x in shingle_sets(data, offsets, width) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([signature(x) for x in sets], pa.int64()), lists(sets, pa.int64())], ["sig", "elements"])

    return docs.select(F.xxhash64(key), F.col(text)).mapInArrow(released(run), "sig long, elements array<long>")


# ---------------------------------------------------------------- tree


class Points:
    """Points of one dimension, sorted by route and size, under a packed R-tree."""

    def __init__(self, route: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, own: np.ndarray, vec: np.ndarray):
        self.order = np.lexsort((n, route))
        self.route, self.n, self.comp, self.side, self.own, self.vec = (x[self.order] for x in (route, n, comp, side, own, vec))
        #: Levels from the leaves up: lowest and highest route, size and component, and the highest count of each group.
        self.levels: list[tuple[np.ndarray, ...]] = []
        low = high = self.route
        few, many, one, last, top, step = self.n, self.n, self.comp, self.comp, self.vec, LEAF
        while len(low) > 1 or not self.levels:
            at = np.arange(0, len(low), step)
            low, few, one = (np.minimum.reduceat(x, at) for x in (low, few, one))
            high, many, last = (np.maximum.reduceat(x, at) for x in (high, many, last))
            top = np.maximum.reduceat(top, at, axis=0)
            self.levels.append((low, high, few, many, one, last, top))
            step = FAN

    def _bound(self, top: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, chunk = np.empty(len(i), np.int64), max(1, (1 << 22) // top.shape[1])
        for a in range(0, len(i), chunk):
            out[a : a + chunk] = np.minimum(top[i[a : a + chunk]], top[j[a : a + chunk]]).sum(1, dtype=np.int64)
        return out

    def pairs(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places i < j of one route, of two components and two sides (of one, where that is -1), whose bound allows the similarity, and the bound."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            low, high, few, many, one, last, top = self.levels[level]
            keep = (low[i] <= high[j]) & (low[j] <= high[i]) & (many[j] * den >= few[i] * num) & (many[i] * den >= few[j] * num)
            keep &= (one[i] != last[j]) | (one[j] != last[i])  # not all of one component
            i, j = i[keep], j[keep]
            # overlap >= num / (num + den) of both sizes together
            keep = self._bound(top, i, j) * (num + den) >= num * (few[i] + few[j])
            i, j = i[keep], j[keep]
            step = LEAF if level == 0 else FAN
            size = len(self.route) if level == 0 else len(self.levels[level - 1][0])
            most = max(1, (1 << 20) // (step * step))
            for a in range(0, len(i), most):
                grid = np.arange(step)
                x = (i[a : a + most, None, None] * step + grid[None, :, None] + np.zeros(step, np.int64)).ravel()
                y = (j[a : a + most, None, None] * step + grid[None, None, :] + np.zeros((step, 1), np.int64)).ravel()
                keep = (x < size) & (y < size) & ((x < y) if level == 0 else (x <= y))
                x, y = x[keep], y[keep]
                if level:
                    stack.append((level - 1, x, y))
                    continue
                keep = (self.route[x] == self.route[y]) & (self.comp[x] != self.comp[y]) & (self.own[x] | self.own[y])
                keep &= (self.side[x] < 0) | (self.side[x] != self.side[y])
                x, y = x[keep], y[keep]
                keep = (self.n[x] * den >= self.n[y] * num) & (self.n[y] * den >= self.n[x] * num)
                x, y = x[keep], y[keep]
                bound = self._bound(self.vec, x, y)
                keep = bound * (num + den) >= num * (self.n[x] + self.n[y])
                if keep.any():
                    yield x[keep], y[keep], bound[keep]


def trees(route: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, vec: list[bytes], num: int, den: int) -> Iterator[tuple[np.ndarray, Points]]:
    """A tree for each class of sizes, and the rows that it is made of. Larger sets that may pair with a class come along, counted as coarsely."""
    for (d, high), low in zip(CLASSES, [0, *(c[1] for c in CLASSES)], strict=False):
        here = np.flatnonzero((n >= low) & (n * num <= high * den))
        if len(here) > 1 and (n[here] < high).any():
            yield here, Points(route[here], n[here], comp[here], side[here], n[here] < high, points([vec[i] for i in here], n[here], d))


def whole_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], weight: Callable[[pa.RecordBatch], int], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by the columns `by`: as few groups as come to a weight of `most`, but one at least."""
    held, size = [], 0
    for batch in batches:
        if size >= most:
            same = np.logical_and.reduce([batch[c].to_numpy() == held[-1][c][-1].as_py() for c in by])
            if not same.all():
                cut = int(np.argmin(same))
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += weight(batch)
    if held:
        yield pa.Table.from_batches(held)


def _trees(batches: Iterator[pa.RecordBatch], group: str, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, Points]]:
    """Of members (tok, group, side, sig, n, comp, vec) sorted by tok and group: signatures and elements of the tree's rows, and the trees of whole groups."""
    small = (part.slice(a, 1024) for part in batches for a in range(0, len(part), 1024))
    for rows in whole_groups(small, ("tok", group), lambda b: b["vec"].nbytes, HELD):
        tok, cut, side, n, comp, node = (rows[c].to_numpy() for c in ("tok", group, "side", "n", "comp", "sig"))
        route = mix(tok.view(U64)) ^ cut.astype(U64)
        for here, tree in trees(route, n, comp, side, rows["vec"].to_pylist(), num, den):
            at = here[tree.order]
            yield node[at], tok[at], tree


def _close(members: DataFrame, num: int, den: int) -> DataFrame:
    """The members (tok, sig) that the bound leaves a partner in their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, tok, tree in _trees(batches, "chunk", num, den):
            may = np.zeros(len(node), bool)
            for x, y, _ in tree.pairs(num, den):
                may[x] = may[y] = True
            yield pa.RecordBatch.from_arrays([pa.array(tok[may]), pa.array(node[may])], ["tok", "sig"])

    dealt = members.select("tok", "chunk", F.lit(-1).alias("side"), "sig", "n", "comp", "vec").repartition("tok", "chunk").sortWithinPartitions("tok", "chunk")
    return dealt.mapInArrow(released(run), "tok long, sig long").distinct()


def _candidates(members: DataFrame, num: int, den: int) -> DataFrame:
    """From members (tok, block, side, sig, n, comp, vec) to the pairs (a, b) to verify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, _, tree in _trees(batches, "block", num, den):
            for x, y, _ in tree.pairs(num, den):
                pair = np.unique(np.sort(np.stack((node[x], node[y])), 0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    dealt = members.select("tok", "block", "side", "sig", "n", "comp", "vec").repartition("tok", "block").sortWithinPartitions("tok", "block")
    return dealt.mapInArrow(released(run), "a long, b long").distinct()


# ---------------------------------------------------------------- groups


class Forest:
    """Which rows are joined, and how many."""

    def __init__(self, label: np.ndarray):
        self.root = np.unique(label, return_inverse=True)[1].astype(np.int64)  # rows of one label are joined

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        up = list(range(int(self.root.max()) + 1))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for a, b in zip(self.root[x].tolist(), self.root[y].tolist(), strict=True):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
        self.root = np.array([top(i) for i in range(len(up))], np.int64)[self.root]


def merged(sets: list[np.ndarray], comp: np.ndarray, num: int, den: int) -> np.ndarray:
    """Numbers of the groups that verified links and equal components make of the sets. Pairs of one group are not verified; those of a node are tried
    best bound first, and no more than 16 pairs a set, which bounds the work on sets that are nearly similar (they are met again in step 4)."""
    n = np.array([len(x) for x in sets], np.int64)
    forest, left = Forest(comp), 16 * len(sets)
    none = np.zeros(len(sets), np.int64)
    for here, tree in trees(none, n, comp, none - 1, [point(x, dimensions(len(x))) for x in sets], num, den):
        for x, y, bound in tree.pairs(num, den):
            x, y = here[tree.order[x]], here[tree.order[y]]
            order = np.argsort(n[x] + n[y] - 2 * bound, kind="stable")
            x, y = x[order], y[order]
            while left > 0:
                apart = forest.root[x] != forest.root[y]
                x, y = x[apart], y[apart]
                if not len(x):
                    break
                now = np.unique(x, return_index=True)[1][:left]
                left -= len(now)
                yes = [i for i in now.tolist() if _inside(sets[y[i]], sets[x[i]]).sum() * (num + den) >= num * (n[x[i]] + n[y[i]])]
                forest.join(x[yes], y[yes])
                rest = np.ones(len(x), bool)
                rest[now] = False
                x, y = x[rest], y[rest]
    return forest.root


def _met(members: DataFrame, elements: DataFrame, num: int, den: int) -> DataFrame:
    """From members (tok, chunk, sig, comp), each tok and chunk a group, to the links (tok, a, b) of components, one fewer than those joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (part.slice(a, 256) for part in batches for a in range(0, len(part), 256))
        for rows in whole_groups(small, ("tok", "chunk"), lambda b: b["elements"].nbytes, HELD):
            tok, chunk, comp = (rows[c].to_numpy() for c in ("tok", "chunk", "comp"))
            flat = rows["elements"].combine_chunks()
            ends, flat = flat.offsets.to_numpy(), flat.values.to_numpy().view(U64)
            edge = np.flatnonzero(np.concatenate(([True], (tok[1:] != tok[:-1]) | (chunk[1:] != chunk[:-1]))))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(tok)], strict=True):
                own = comp[a:b]
                if (own == own[0]).all():
                    continue
                root = merged([flat[ends[i] : ends[i + 1]] for i in range(a, b)], own, num, den)
                least = np.full(int(root.max()) + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, root, own)
                pair = np.unique(np.stack((own, least[root])), axis=1)
                pair = pair[:, pair[0] != pair[1]]
                if pair.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(pair.shape[1], tok[a])), pa.array(pair[0]), pa.array(pair[1])], ["tok", "a", "b"])

    full = members.join(elements, "sig").select("tok", "chunk", "comp", "elements")
    return full.repartition("tok", "chunk").sortWithinPartitions("tok", "chunk").mapInArrow(released(run), "tok long, a long, b long")


# ---------------------------------------------------------------- join


def _components(docs: DataFrame, key: str, text: str, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(key, n, sig) per document, and (sig, comp) of every set that is not alone."""
    small_batches(docs.sparkSession)
    sets = stored(_nodes(docs, key, text, width, num, den, _frequent(docs, text, width)), "sets")
    rows = stored(sets.select("key", "n", "sig"), "signatures")
    nodes = sets.where("n > 0").groupBy("sig").agg(F.xxhash64(F.min("key")).alias("h"), *[F.first(c).alias(c) for c in ("n", "route", "star", "vec")])
    nodes = stored(nodes, "nodes")
    discard(sets)

    def elements(sigs: DataFrame) -> DataFrame:
        found = _sets(docs, key, text, width, nodes.join(sigs, "sig", "left_semi").select("h"))
        return stored(found.dropDuplicates(["sig"]), "elements")

    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / ELEMENTS))

    def cut(members: DataFrame, salt: int) -> DataFrame:
        """Add the chunk to members (tok, sig, n, comp, new) of groups with several components, one of them new there; column `chunks` says how many there are."""
        size = members.groupBy("tok").agg(chunks.alias("chunks"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("new").alias("new")).where("low <> high AND new")
        return members.drop("new").join(size.select("tok", "chunks"), "tok").withColumn("chunk", F.pmod(F.xxhash64(F.lit(salt), "sig"), F.col("chunks")))

    star = nodes.select("sig", "n", F.explode("star").alias("tok"))
    shared = star.groupBy("tok").agg(F.count("*").alias("size")).where("size > 1").select("tok")
    star = stored(star.join(shared, "tok"), "star")
    met = cut(star.withColumns({"comp": F.col("sig"), "new": F.lit(True)}), 0).join(nodes.select("sig", "vec"), "sig")
    close = stored(_close(met, num, den).join(nodes.select("sig", "n"), "sig"), "close")
    full = elements(close.select("sig"))
    sizes = close.groupBy("tok").agg(F.count("*").alias("size"))
    most = close.join(sizes, "tok").groupBy("sig").agg(F.max_by("tok", F.struct("size", "tok")).alias("own"))
    star = stored(close.join(most, "sig").select("sig", "n", "tok", (F.col("tok") != F.col("own")).alias("new")), "star")
    first = _met(cut(star.where("NOT new").select("sig", "n", "tok", F.col("sig").alias("comp"), F.lit(True).alias("new")), 0), full, num, den)
    groups = stored(first.select(F.col("a").alias("node"), F.col("b").alias("root")), "groups")  # stars already
    cuts = star.where("NOT new").groupBy("tok").agg((chunks > 1).alias("cut"))
    star = star.join(cuts, "tok", "left").select("sig", "n", "tok", (F.col("new") | F.coalesce("cut", F.lit(False))).alias("new"))
    every = groups.union(groups.select(F.col("root").alias("node"), "root")).distinct()
    named = lambda d: d.join(every.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("root", "sig")).drop("root")

    def joined(links: DataFrame) -> None:
        """Take in further links between components."""
        nonlocal every
        over = components(links).select(F.col("node").alias("root"), F.col("root").alias("over"))
        alone = over.join(every.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("node"), F.col("over").alias("root"))
        every = stored(every.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root")).union(alone), "groups")

    salt, again = 1, star
    while True:
        two = [F.min_by(F.struct("sig", "n"), F.xxhash64(F.lit(2 * salt + i), "sig")) for i in (0, 1)]
        few = named(again).groupBy("tok", "comp").agg(F.array_distinct(F.array(*two)).alias("s"), F.max("new").alias("new"))
        met = stored(cut(few.select("tok", "comp", "new", F.explode("s").alias("s")).select("tok", "comp", "new", "s.sig", "s.n"), salt), "met")
        links = stored(_met(met, full, num, den), "links")
        if links.isEmpty():
            break
        joined(links)
        cuts = met.where("chunks > 1").select("tok").distinct()
        if cuts.isEmpty():
            break
        again = star.join(links.select("tok").distinct().join(cuts, "tok"), "tok").withColumn("new", F.lit(True))
        salt += 1
    discard(full)

    # routes that lead to several components
    own = stored(named(nodes.select("sig", "n", "route")), "named")
    routes = own.select("comp", F.explode("route").alias("tok")).groupBy("tok").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    routes = stored(routes.where("low <> high").select("tok"), "routes")
    bits = Bloom(routes).bits

    def open_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            row = batch.column(3).value_parent_indices().to_numpy(zero_copy_only=False)
            may = Bloom.has(bits.value, tok.view(U64))
            kept = pa.array(row[may])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(kept) for i in range(3)), pa.array(tok[may])], ["sig", "n", "comp", "tok"])

    members = own.select("sig", "n", "comp", "route").mapInArrow(released(open_routes), "sig long, n long, comp long, tok long").join(routes, "tok")
    members = stored(members, "routed")
    discard(own)
    # routes with the same members lead to the same pairs: one of them is enough
    alike = members.groupBy("tok").agg(*[F.bit_xor(F.xxhash64(F.lit(i), "sig")).alias(f"x{i}") for i in (1, 2)], F.count("*").alias("size"))
    members = members.join(alike.groupBy("x1", "x2", "size").agg(F.min("tok").alias("tok")).select("tok", "size"), "tok")
    # A route with very many members is dealt into blocks; each two blocks meet once, and a block's own members where it meets itself. Large
    # components have blocks of their own, and blocks that hold one and the same component do not meet.
    few = members.where(F.col("size") <= BLOCK).select("tok", F.lit(0).cast("long").alias("block"), F.lit(-1).alias("side"), "sig", "n", "comp")
    many = members.where(F.col("size") > BLOCK)
    large = many.groupBy("tok", "comp").agg(F.count("*").alias("held"))
    spread = F.when(F.col("held") > BLOCK // 2, F.xxhash64("comp", F.pmod(F.xxhash64("sig"), F.ceil(F.col("held") / BLOCK)))).otherwise(F.pmod(F.xxhash64("comp"), F.ceil(F.col("size") / BLOCK)))
    many = stored(many.join(large, ["tok", "comp"]).select("tok", spread.alias("mine"), "sig", "n", "comp"), "blocks")
    summary = many.groupBy("tok", "mine").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    other = summary.select("tok", *[F.col(c).alias(f"{c}_") for c in ("mine", "low", "high")])
    meet = summary.join(other, "tok").where("mine <= mine_ AND NOT (low = high AND low_ = high_ AND low = low_)").select("tok", "mine", "mine_", F.xxhash64("mine", "mine_").alias("block"))
    sides = F.when(F.col("mine") == F.col("mine_"), F.array(F.struct(F.col("mine").alias("mine"), F.lit(-1).alias("side")))).otherwise(F.array(F.struct(F.col("mine").alias("mine"), F.lit(0).alias("side")), F.struct(F.col("mine_").alias("mine"), F.lit(1).alias("side"))))
    meet = meet.select("tok", "block", F.explode(sides).alias("s")).select("tok", "block", "s.mine", "s.side")
    members = few.union(many.join(meet, ["tok", "mine"]).select("tok", "block", "side", "sig", "n", "comp"))
    # of them the blocks with several components, and of these the members with another component's of a size near theirs
    band = F.floor(F.log("n") / F.log(F.lit(den / num)) + 1e-9).cast("int")
    members = stored(members.withColumn("band", band), "members")
    near = members.select("tok", "block", "comp", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    near = near.groupBy("tok", "block", "band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("tok", "block", "band")
    open_ = members.join(near, ["tok", "block", "band"]).join(nodes.select("sig", "vec"), "sig")
    pairs = stored(_candidates(open_, num, den), "pairs")
    discard(members)
    if not pairs.isEmpty():
        full = elements(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct())
        one = pairs.join(full.select(F.col("sig").alias("a"), F.col("elements").alias("x")), "a")
        both = one.join(full.select(F.col("sig").alias("b"), F.col("elements").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        links = both.where(common * (num + den) >= num * (F.size("x") + F.size("y"))).select("a", "b")
        of = lambda c: every.select(F.col("node").alias(c), F.col("root").alias(f"{c}_"))
        links = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"))
        joined(stored(links.distinct(), "links"))
        discard(full)
    return rows, every.select(F.col("node").alias("sig"), F.col("root").alias("comp"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """(key, n_shingles, component_id) per document; similarity as a fraction. component_id is the least key of the group."""
    rows, every = _components(docs.select(key, text), key, text, width, *similarity)
    per = rows.where("n > 0").groupBy("sig").agg(F.min("key").alias("key")).join(every, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    first = per.groupBy("comp").agg(F.min("key").alias("component_id"))
    out = rows.join(per.join(first, "comp").select("sig", "component_id"), "sig", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """The documents without near duplicates: of each group one row, that of the least key (null comes last), then of the least signature of its text; rows
    with an empty set stay. Whether a row goes depends on its key and text together: rows that repeat a key with unlike texts are told apart.

    Most rows are alone in their group and pass a bit set of the keys that are not, without a shuffle of their texts.
    """
    rows, every = _components(docs.select(key, text), key, text, width, *similarity)
    rows = rows.where("n > 0").groupBy("sig", "key").agg(F.count("*").alias("n"))
    named = stored(rows.join(every, "sig", "left").withColumn("comp", F.coalesce("comp", "sig")), "named")
    order = F.struct(F.col("key").isNull(), "key", "sig")
    groups = named.groupBy("comp").agg(F.sum("n").alias("rows"), F.min_by(F.struct("key", "sig"), order).alias("stays")).where("rows > 1")
    may, sig, row_key, row_sig, stays = fresh(docs, "may", "sig", "row_key", "row_sig", "stays")
    stay = F.col("stays.sig").eqNullSafe(F.col("sig")) & F.col("stays.key").eqNullSafe(F.col("key"))
    found = stored(named.join(groups, "comp").select(F.col("key").alias(row_key), F.col("sig").alias(row_sig), stay.alias(stays)), "suspects")
    bits = Bloom(found.select(F.xxhash64(row_key))).bits

    at, last = place(docs, text), len(docs.columns)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            here = Bloom.has(bits.value, batch.column(last).to_numpy(zero_copy_only=False).view(U64))
            some = np.flatnonzero(here)
            own = batch.column(at).take(pa.array(some))
            sigs = np.zeros(len(batch), np.int64)
            for a, _, data, offsets in slices(own):
                for i, x in enumerate(shingle_sets(data, offsets, width), a):
                    sigs[some[i]], here[some[i]] = (signature(x), True) if len(x) else (0, False)
            yield batch, [pa.array(here), pa.array(sigs)]

    rows = mapped(docs.withColumn(may, F.xxhash64(key)), marked, StructType([StructField(may, BooleanType()), StructField(sig, LongType())]))
    rest = rows.where(F.col(may)).join(found, F.col(key).eqNullSafe(F.col(row_key)) & (F.col(sig) == F.col(row_sig)), "left")
    alone, once = rest.where(F.col(stays).isNull()), rest.where(F.col(stays)).dropDuplicates([key, sig])
    own = [F.col(plain(c)) for c in rows.columns]
    return rows.where(~F.col(may)).union(alone.select(own)).union(once.select(own)).select([F.col(plain(c)) for c in docs.columns])


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
listed AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END s FROM split),
shingles AS (SELECT DISTINCT doc_id, unnest(s) s FROM listed),
sizes AS (SELECT doc_id, count(s) n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
common AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT a, a FROM ways UNION SELECT node, b FROM reach JOIN ways ON other = a),
least AS (SELECT node, min(other) root FROM reach GROUP BY node)
SELECT doc_id, n n_shingles, coalesce(root, doc_id) component_id FROM sizes LEFT JOIN least ON node = doc_id"""
