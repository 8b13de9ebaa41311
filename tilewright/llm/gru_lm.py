"""Gated recurrent language model of whole documents, beside a smoothed unigram base.

Tokens are lower-cased words and one end per document. Their counts over all training documents give the base and
the model's classes: the most frequent words are cut into classes of about equal mass, with a softmax within the class; all
other words fall into classes by how they end, within which their counts decide. The network predicts the class,
then the word; it is trained by back-propagation truncated to windows, in numpy, on all tokens of every training
document in order, with the state carried from window to window, each Spark task on its own documents, and parameters are averaged
between rounds. Scoring runs whole documents
side by side and carries the state from window to window.

Words with at least 1/HEAD of all tokens, so at most HEAD, are sent to every task; the counts of rarer ones are joined
by their hash. 64-bit hashes stand for words.

Null and empty texts are one end token. Repeated rows count and are scored as documents of their own; a null key is a
training document. Without training documents every score is that of the smoothed base. Texts of any length are scored whole. Words that occur equally often come in the order of their hashes, so
reruns have the same classes. Columns other than key and text are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .quality_crf import fold
from .text import _LOWER, U64, lists, released, slices, word_hashes, words

HEAD = 1 << 23
#: Words with a softmax of their own, in so many classes; classes of the rest.
WORDS, GROUPS, MOST, ENDINGS, HIDDEN = 1024, 24, 128, 40, 16
#: The unit that starts a document and clears the state.
START = WORDS + ENDINGS
#: Steps of back-propagation; documents side by side; tokens that a task holds at a time.
WINDOW, BATCH, POOL = 32, 256, 1 << 22
END = U64(0xE0D0F0A0)


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and end row, bounds of the rows' tokens, their hashes, and codes of their endings."""
    for a, b, data, offsets in slices(column):
        starts, ends, row = words(data, offsets)
        h = word_hashes(data, starts, ends)
        low = _LOWER[data]
        last = ends - 1
        mark = (low[last] < 128) & ~((low[last] >= 97) & (low[last] <= 122)) if len(last) else np.zeros(0, bool)
        last = np.where(mark & (last > starts), last - 1, last)
        before = np.where(last > starts, low[np.maximum(last - 1, 0)].astype(np.int32) if len(last) else 0, 0)
        form = (low[last].astype(np.int32) if len(last) else before) * 256 + before
        n = np.bincount(row, minlength=b - a) if len(row) else np.zeros(b - a, np.int64)
        bounds = np.concatenate(([0], np.cumsum(n + 1)))
        place = np.arange(len(h)) + row  # each earlier row adds its end
        hashes, forms = np.full(bounds[-1], END, U64), np.zeros(bounds[-1], np.int32)
        hashes[place], forms[place] = h, form
        yield a, b, bounds, hashes, forms


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, form, c) of every distinct token; counted in windows before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h = np.concatenate([x[0] for x in held])
            order = np.argsort(h)
            h, form = h[order], np.concatenate([x[1] for x in held])[order]
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(form[at]), pa.array(np.diff(np.append(at, len(h))))], ["h", "form", "c"])

        for batch in batches:
            for _, _, _, h, form in tokens(batch.column(0)):
                held.append((h, form))
                size += len(h)
                if size >= 1 << 22:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return docs.select(text).mapInArrow(released(run), "h long, form int, c long").groupBy("h").agg(F.min("form").alias("form"), F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """What every task knows about words. Arrays are sorted by hash."""

    total: int
    distinct: int
    least: int
    hashes: np.ndarray  # of the head
    counts: np.ndarray
    unit: np.ndarray  # of each head word: its own number, or WORDS + its class of endings
    ending: np.ndarray  # class of endings by form
    mass: np.ndarray  # tokens and distinct words, and one, of each class of endings
    group: np.ndarray  # class of each of the frequent words
    start: np.ndarray  # first word of each class
    prior: np.ndarray  # of the classes, natural log
    first: np.ndarray  # of each of the frequent words within its class

    @property
    def groups(self) -> int:
        return len(self.start) - 1

    def look_up(self, h: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0 outside the head) and units."""
        c, unit = np.zeros(len(h), np.int64), WORDS + self.ending[form].astype(np.int32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            c[known], unit[known] = self.counts[at[known]], self.unit[at[known]]
        return c, unit


def lexicon(table_: DataFrame, head: int = HEAD) -> Lexicon:
    """From stored counts; at most `head` words and the totals of 65,536 endings come to the driver."""
    total, distinct = table_.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = max(1, -(-total // head))
    got = table_.where(F.col("c") >= least).select("h", "form", "c").toArrow()
    h, form, c = got["h"].to_numpy().view(U64), got["form"].to_numpy(), got["c"].to_numpy()
    order = np.argsort(h)
    h, form, c = h[order], form[order], c[order]
    top = np.lexsort((h, -c))[:WORDS]  # the frequent ones, by count
    # classes of about equal mass, of at most MOST words
    group, start, share, held = np.zeros(len(top), np.int32), [0], c[top].sum() / GROUPS, 0
    for i, x in enumerate(c[top].tolist()):
        if i > start[-1] and (held + x / 2 > share or i - start[-1] >= MOST):
            start.append(i)
            held = 0
        held += x
        group[i] = len(start) - 1
    start.append(len(top))
    if len(top) == 0:
        start = [0]
    by = table_.groupBy("form").agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()
    mass, kinds = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    mass[by["form"].to_numpy()], kinds[by["form"].to_numpy()] = by["c"].to_numpy(), by["n"].to_numpy()
    np.subtract.at(mass, form[top], c[top])
    np.subtract.at(kinds, form[top], 1)
    ending = np.minimum((np.cumsum(mass) - mass / 2) * ENDINGS / max(1, mass.sum()), ENDINGS - 1).astype(np.int32)
    unit = WORDS + ending[form].astype(np.int32)
    unit[top] = np.arange(len(top))
    sums = np.zeros((ENDINGS, 2))
    np.add.at(sums, ending, np.stack((mass, kinds), 1).astype(float))
    in_group = np.array([c[top][a:b].sum() for a, b in zip(start[:-1], start[1:], strict=True)], float)
    prior = np.log(np.concatenate((in_group, sums[:, 0] + 1)) / (total + ENDINGS))
    first = np.log(c[top] / in_group[group]) if len(top) else np.zeros(0)
    return Lexicon(total, distinct, least, h, c, unit, ending, sums.sum(1) + 1, group, np.array(start), prior, first)


# ---------------------------------------------------------------- network


class Gru:
    """Parameters by name. Inputs are units, so the input matrix is a table of rows."""

    def __init__(self, lex: Lexicon, seed: int = 42, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        units, classes = START + 1, lex.groups + ENDINGS
        small = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
        self.p = {"x": small(units, 3 * hidden), "h": small(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "c": small(hidden, classes), "cb": lex.prior.astype(np.float32), "w": small(WORDS, hidden), "wb": np.zeros(WORDS, np.float32)}
        self.p["wb"][: len(lex.first)] = lex.first
        self.lex, self.hidden = lex, hidden
        self.of = np.concatenate((lex.group, np.zeros(WORDS - len(lex.group), np.int32), lex.groups + np.arange(ENDINGS, dtype=np.int32))).astype(np.int32)

    def scaled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the inputs with the bias, and the state's matrices of gates and candidate; gates are halved, as a sigmoid is a tanh of the half."""
        d, p = self.hidden, self.p
        rows = p["x"] + p["b"]
        rows[:, : 2 * d] *= 0.5
        return rows, p["h"][:, : 2 * d] * rows.dtype.type(0.5), np.ascontiguousarray(p["h"][:, 2 * d :])

    def step(self, x: np.ndarray, h: np.ndarray, gates: np.ndarray, candidate: np.ndarray) -> tuple[np.ndarray, ...]:
        """x: scaled rows (b, 3 hidden). Gates z and r side by side, r * h, the candidate n and the new state."""
        d = self.hidden
        zr = h @ gates
        zr += x[:, : 2 * d]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        rh = zr[:, d:] * h
        n = rh @ candidate
        n += x[:, 2 * d :]
        np.tanh(n, out=n)
        new = n - h
        new *= zr[:, :d]
        new += h
        return zr, rh, n, new

    @staticmethod
    def _softmax(s: np.ndarray, calm: bool) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials, in place, and their sums; `calm`: too small to overflow as they are."""
        if not calm:
            s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        return s, s.sum(1)

    def _calm(self, weights: str, bias: str, axis: int) -> bool:
        """Whether no output can be beyond 60 in size: states are within -1 and 1."""
        return bool((np.abs(self.p[weights]).sum(axis) + np.abs(self.p[bias])).max(initial=0) < 60)

    def log_p(self, states: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Natural log of class and, for frequent words, word given class."""
        p, of = self.p, self.of[unit]
        s = states @ p["c"]
        s += p["cb"]
        calm = self._calm("c", "cb", 0)
        if not calm:
            s -= s.max(1, keepdims=True)
        out = s[np.arange(len(s)), of].astype(np.float64)
        out -= np.log(self._softmax(s, True)[1])
        calm = self._calm("w", "wb", 1)
        for g, at in self._by_group(unit, of):
            a, b = self.lex.start[g], self.lex.start[g + 1]
            s = states[at] @ p["w"][a:b].T
            s += p["wb"][a:b]
            if not calm:
                s -= s.max(1, keepdims=True)
            own = s[np.arange(len(at)), unit[at] - a].astype(np.float64)
            out[at] += own - np.log(self._softmax(s, True)[1])
        return out

    def _by_group(self, unit: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Classes of several frequent words, and where their words are."""
        at = np.flatnonzero(unit < WORDS)
        at = at[np.argsort(of[at], kind="stable")]
        edge = np.searchsorted(of[at], np.arange(self.lex.groups + 1))
        for g in range(self.lex.groups):
            if edge[g + 1] > edge[g] and self.lex.start[g + 1] - self.lex.start[g] > 1:
                yield g, at[edge[g] : edge[g + 1]]

    def window(self, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss, gradients and last state of (steps, batch) units. Gradients stop at the window's start, and like the state at the unit START."""
        p, d = self.p, self.hidden
        steps, size = inputs.shape
        rows, gates, candidate = self.scaled()
        xs = rows[inputs]
        alive = (inputs != START)[:, :, None].astype(xs.dtype)
        zr, rh, ns, before = np.empty((steps, size, 2 * d), xs.dtype), np.empty((steps, size, d), xs.dtype), np.empty((steps, size, d), xs.dtype), np.empty((steps, size, d), xs.dtype)
        states = np.empty((steps, size, d), xs.dtype)
        for t in range(steps):
            before[t] = h * alive[t]
            zr[t], rh[t], ns[t], h = self.step(xs[t], before[t], gates, candidate)
            states[t] = h
        on = np.flatnonzero(mask.reshape(-1))
        flat, unit = states.reshape(-1, d)[on], targets.reshape(-1)[on]
        of = self.of[unit]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        s = flat @ p["c"]
        s += p["cb"]
        e, total = self._softmax(s, self._calm("c", "cb", 0))
        e /= total[:, None]
        here = np.arange(len(e))
        loss = -float(np.log(e[here, of] + 1e-30).sum())
        e[here, of] -= 1
        g["c"], g["cb"] = flat.T @ e, e.sum(0)
        ds = e @ p["c"].T
        calm = self._calm("w", "wb", 1)
        for k, at in self._by_group(unit, of):
            a, b = self.lex.start[k], self.lex.start[k + 1]
            own = flat[at]
            s = own @ p["w"][a:b].T
            s += p["wb"][a:b]
            e, total = self._softmax(s, calm)
            e /= total[:, None]
            here = np.arange(len(at))
            loss -= float(np.log(e[here, unit[at] - a] + 1e-30).sum())
            e[here, unit[at] - a] -= 1
            g["w"][a:b], g["wb"][a:b] = e.T @ own, e.sum(0)
            ds[at] += e @ p["w"][a:b]
        every = np.zeros((steps * size, d), xs.dtype)
        every[on] = ds
        every = every.reshape(steps, size, d)
        z, r = zr[:, :, :d], zr[:, :, d:]
        by_n, stay = z * (1 - ns * ns), 1 - z
        by_z, by_r = (ns - before) * z * stay, before * r * (1 - r)
        dh = np.zeros((size, d), xs.dtype)
        dx = np.empty_like(xs)
        to_gates, to_candidate = np.ascontiguousarray(p["h"][:, : 2 * d].T), np.ascontiguousarray(p["h"][:, 2 * d :].T)
        for t in range(steps - 1, -1, -1):
            dh += every[t]
            dn = dh * by_n[t]
            drh = dn @ to_candidate
            dx[t, :, 2 * d :] = dn
            np.multiply(dh, by_z[t], out=dx[t, :, :d])
            np.multiply(drh, by_r[t], out=dx[t, :, d : 2 * d])
            dh *= stay[t]
            drh *= r[t]
            dh += drh
            dh += dx[t, :, : 2 * d] @ to_gates
            dh *= alive[t]
        dx = dx.reshape(-1, 3 * d)
        g["h"][:, : 2 * d] = before.reshape(-1, d).T @ dx[:, : 2 * d]
        g["h"][:, 2 * d :] = rh.reshape(-1, d).T @ dx[:, 2 * d :]
        g["b"] = dx.sum(0)
        ids = inputs.reshape(-1)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        edge = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        g["x"][ids[edge]] = np.add.reduceat(dx[order], edge)
        return loss, g, h

    def train(self, docs: list[np.ndarray], rate: float, seed: int) -> int:
        """One pass of Adam over whole documents of units, each after START: BATCH lanes side by side, a lane's documents one right
        after the other, the state carried from window to window and cleared where a document starts. Where fewer lanes are left than BATCH,
        steps are smaller. Returns the number of tokens."""
        rng = np.random.default_rng(seed)
        n = np.array([len(d) - 1 for d in docs], np.int64)
        lanes: list[list[int]] = [[] for _ in range(min(BATCH, len(docs)))]
        load = [(0, i) for i in range(len(lanes))]
        order = rng.permutation(len(docs))
        for i in order[np.argsort(-n[order], kind="stable")].tolist():  # the longest first, each to the lane with the least
            has, lane = load[0]
            lanes[lane].append(i)
            heapq.heapreplace(load, (has + int(n[i]), lane))
        sizes = np.array([sum(int(n[i]) for i in lane) for lane in lanes], np.int64)
        lanes = [lanes[i] for i in np.argsort(-sizes, kind="stable")]
        sizes = -np.sort(-sizes)
        steps = -(-int(sizes[0]) // WINDOW) * WINDOW if len(sizes) else 0
        inputs_, targets_ = np.full((2, len(lanes), steps), -1, np.int16)
        for row, lane in enumerate(lanes):
            mixed = [docs[i] for i in rng.permutation(lane)]
            inputs_[row, : sizes[row]], targets_[row, : sizes[row]] = np.concatenate([d[:-1] for d in mixed]), np.concatenate([d[1:] for d in mixed])
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = seen = 0
        h = np.zeros((len(lanes), self.hidden), np.float32)
        for t in range(0, steps, WINDOW):
            k = int(np.searchsorted(-sizes, -t, "left"))
            inputs, targets = inputs_[:k, t : t + WINDOW].T, targets_[:k, t : t + WINDOW].T
            mask = targets >= 0
            n = int(mask.sum())
            _, g, h = self.window(np.maximum(inputs, 0), np.maximum(targets, 0), mask, h[:k])
            seen += n
            step += 1
            pace = rate * min(1.0, k / len(lanes)) ** 0.5
            for k, x in g.items():
                x = x / n
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                self.p[k] -= (pace / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        return seen

    def score(self, bounds: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Natural log of units, and of frequent words within their class, summed by document: whole documents side by side, longest first,
        the state carried from window to window."""
        n = np.diff(bounds)
        order = np.argsort(-n, kind="stable")
        at, n = bounds[:-1][order], n[order]
        out, h = np.zeros(len(n)), np.zeros((len(n), self.hidden), np.float32)
        before = np.full(len(n), START, np.int32)
        table_, *matrices = self.scaled()
        for t in range(0, int(n[0]) if len(n) else 0, WINDOW):
            states, units, docs = [], [], []
            for s in range(t, t + WINDOW):
                k = int(np.searchsorted(-n, -s, "left"))
                if not k:
                    break
                h[:k] = self.step(table_[before[:k]], h[:k], *matrices)[-1]
                now = unit[at[:k] + s]
                states.append(h[:k].copy())
                units.append(now)
                docs.append(k)
                before[:k] = now
            x, u, k = np.concatenate(states), np.concatenate(units), np.array(docs)
            got = np.concatenate([self.log_p(x[a : a + 16384], u[a : a + 16384]) for a in range(0, len(x), 16384)])
            edge = np.concatenate(([0], np.cumsum(k)))
            for i in range(len(k)):
                out[: k[i]] += got[edge[i] : edge[i + 1]]
        back = np.empty(len(n))
        back[order] = out
        return back


# ---------------------------------------------------------------- Spark


def encoded(docs: DataFrame, lex, key: str, text: str, learn: Column) -> DataFrame:
    """Per document, tokenised once for training and scores: uid, key, learn, numbers of tokens and of known ones, sums of the logs of their counts and of those within their
    class of endings, hashes of words outside the head, and the units of all tokens after START, as 16-bit integers."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, uid = lex.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, bounds, h, form in tokens(batch.column(1)):
                n = np.diff(bounds)
                c, unit = own.look_up(h, form)
                add = lambda x: np.add.reduceat(x, bounds[:-1])
                known = c > 0
                logs = np.log10(c + 1.0)
                rest = unit >= WORDS
                inside = np.zeros(len(h))
                inside[rest] = logs[rest] - np.log10(own.mass[unit[rest] - WORDS])
                rare = np.flatnonzero(~known) if own.least > 1 else np.zeros(0, np.int64)
                at = np.searchsorted(rare, bounds)
                units = np.insert(unit.astype("<i2"), bounds[:-1], START)
                ends = (bounds + np.arange(len(bounds))).tolist()
                blobs = pa.array([units[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                cols = [pa.array(np.arange(uid, uid + b - a)), batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n), pa.array(add(known.astype(np.int64))), pa.array(add(logs)), pa.array(add(inside)), lists([h[rare[i:j]] for i, j in zip(at[:-1], at[1:], strict=True)], pa.int64()), blobs]
                uid += b - a
                yield pa.RecordBatch.from_arrays(cols, ["uid", "key", "learn", "n", "known", "logs", "inside", "rare", "units"])

    rows = docs.select(key, text, F.coalesce(learn, F.lit(False)).alias("learn"))
    return rows.mapInArrow(released(run), f"uid long, key {kind}, learn boolean, n long, known long, logs double, inside double, rare array<long>, units binary")


def _pack(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(v.astype("<f4").tobytes() for v in p.values())


def _unpack(blob: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at, flat = {}, 0, np.frombuffer(blob, "<f4")
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).copy()
        at += v.size
    return out


def fit(rows: DataFrame, lex: Lexicon, shared, rate: float = 0.01, rounds: int = 4, least: int = 4_000_000) -> Gru:
    """Train on all tokens of rows (units): each round every task goes once over its share of the documents from the common parameters, which are then
    averaged by tokens. Small corpora are gone over again until about `least` tokens were seen."""
    net = Gru(lex)
    if not lex.total:
        return net
    # a task's steps must suffice to learn: at least some hundred batches in all
    passes = min(40, max(1, -(-least // lex.total)))
    rounds = rounds if passes == 1 else min(12, rounds * passes)
    repeat = -(-passes * 4 // rounds) if passes > 1 else 1
    pieces = rounds if passes == 1 else 4
    for i in range(rounds):
        start = rows.sparkSession.sparkContext.broadcast(_pack(net.p))
        pace = rate * (1 - 0.8 * i / rounds)

        def run(batches: Iterator[pa.RecordBatch], start=start, pace=pace, i=i) -> Iterator[pa.RecordBatch]:
            own, got, size, seen = Gru(shared.value), [], 0, 0
            own.p = _unpack(start.value, own.p)

            def go() -> int:
                return sum(own.train(got, pace, 97 * i + r) for r in range(repeat))

            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    got.append(np.frombuffer(blob, "<i2"))
                    size += len(got[-1])
                    if size >= POOL:
                        seen += go()
                        got, size = [], 0
            seen += go() if got else 0
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([_pack(own.p)], pa.binary())], ["n", "p"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, sums = 0, None
            for batch in batches:
                for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if n:
                        x = np.frombuffer(blob, "<f4").astype(np.float64) * n
                        total, sums = total + n, x if sums is None else sums + x
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([(sums / total).astype("<f4").tobytes()], pa.binary())], ["n", "p"])

        own = rows.where(F.pmod(F.xxhash64("units"), F.lit(pieces)) == i % pieces)
        trained = own.mapInArrow(released(run), "n long, p binary").repartition(8).mapInArrow(average, "n long, p binary").collect()
        total = sum(r["n"] for r in trained)
        if total:
            net.p = _unpack(np.sum([np.frombuffer(r["p"], "<f4").astype(np.float64) * (r["n"] / total) for r in trained], axis=0).astype("<f4").tobytes(), net.p)
    return net


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", head: int = HEAD, **options) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) per document, learned from the rows where `train` holds."""
    context = docs.sparkSession.sparkContext
    seen = stored(counts(docs.where(train), text), "counts")
    lex = lexicon(seen, head)
    shared = context.broadcast(lex)
    rows = stored(encoded(docs, shared, key, text, train), "encoded")
    net = fit(rows.where("learn").select("units"), lex, shared, **options)
    weights = context.broadcast(_pack(net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Gru(shared.value)
        own.p = _unpack(weights.value, own.p)
        held: list[tuple] = []
        size = 0

        def scored() -> pa.RecordBatch:
            parts = [np.frombuffer(x, "<i2")[1:] for _, units in held for x in units]
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
            out = own.score(bounds, np.concatenate(parts).astype(np.int32)) / np.log(10)
            kept = pa.Table.from_batches([x for x, _ in held]).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*kept.columns, pa.array(out)], [*kept.schema.names, "model"])

        for batch in batches:
            if len(batch):
                held.append((batch.select(names), batch["units"].to_pylist()))
                size += sum(map(len, held[-1][1])) // 2
            if size >= 1 << 22:
                yield scored()
                held, size = [], 0
        if held:
            yield scored()

    names = ["uid", "key", "n", "known", "logs", "inside"]
    kind = docs.schema[key].dataType.simpleString()
    whole = rows.select(*names, "units").mapInArrow(released(run), f"uid long, key {kind}, n long, known long, logs double, inside double, model double")
    if lex.least > 1:  # the counts of words outside the head: the same term in both scores
        rare = rows.select("uid", F.explode("rare").alias("h")).join(seen.where(F.col("c") < lex.least).select("h", "c"), "h")
        more = rare.groupBy(F.col("uid").alias("_uid")).agg(F.count("*").alias("_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("_logs"))
        rows = whole.join(more, F.col("uid") == F.col("_uid"), "left")
    else:
        rows = whole.withColumns({"_known": F.lit(0), "_logs": F.lit(0.0)})
    plus = F.coalesce("_logs", F.lit(0.0))
    return rows.select(
        F.col("key").alias(key),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("logs") + plus - F.col("n") * math.log10(lex.total + lex.distinct + 1)).alias("base_score"),
        (F.col("model") + F.col("inside") + plus).alias("score"),
    )


def query(spark, sf_dir):
    held = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    rows = score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held)
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
