"""Chroma audio fingerprints, and alignment of recordings by them.

A recording's spectrum is summed into twelve pitch classes frame by frame; an integral image over these frames answers
box filters at once; the logarithms of the filters' two sides are compared, quantised to two bits in Gray code
and packed into one 32-bit integer a frame. Two recordings are aligned by the histogram of the offsets at which their integers'
leading bits agree; the bit errors over the overlap at the best offset say how alike they are.

Recordings are WAV bytes (16-bit PCM, any channels and rate). Null, broken, empty and too short ones have no items and align with nothing.
Silence gives items of its own kind. Long recordings are taken whole. Equal recordings get equal fingerprints;
rows that repeat an id are recordings of their own, and none is aligned with its own id. Ties go to the fewer
errors, the smaller id, then the smaller offset. An empty table gives an empty result. Columns other than key and audio are not read, whatever their names.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Blocks, stored, table
from .text import lists, released

#: Frame length and step in seconds; pitches from 110 Hz over four octaves; frames under a filter.
FRAME, STEP, LOW, OCTAVES, SPAN = 0.256, 0.064, 110.0, 4, 16
#: Leading bits that count as equal; most queries, and about most items of queries, in a block.
KEY_BITS, QUERIES, ITEMS = 20, 1024, 1 << 18
#: Recordings, or bytes of them, that a task aligns with a block before it takes the next.
TOGETHER, BYTES = 4096, 32 << 20
#: An alignment has at most this share of wrong bits over at least so many items (about two seconds).
RATE, OVERLAP = 0.25, 32
#: Recordings of more items are aligned with one query at a time.
LONG = 1 << 13
#: Sixteen filters by rule: kind, first pitch class, pitch classes, frames.
FILTERS = [(i % 6, (5 * i) % 12, 12 if i % 3 == 0 else 2 + i % 4, SPAN if i % 2 else SPAN // 2) for i in range(16)]
EDGES = np.array([-0.25, 0.0, 0.25])
GRAY = np.array([0, 1, 3, 2], np.uint32)


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1, and the rate; nothing if it can't be read."""
    if not data:
        return np.zeros(0), 1
    try:
        with wave.open(io.BytesIO(data)) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0), 1
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float64) / 32768
            n = w.getnchannels()
            return x[: len(x) // n * n].reshape(-1, n).mean(1), w.getframerate()
    except (wave.Error, EOFError, RuntimeError):
        return np.zeros(0), 1


def write_wav(x: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12): energy by pitch class, smoothed over frames and normalised."""
    size, step = int(FRAME * rate), int(STEP * rate)
    if size < 16 or len(x) < size:
        return np.zeros((0, 12))
    pitch = np.log2(np.maximum(np.fft.rfftfreq(size, 1 / rate), 1e-9) / LOW) * 12
    used = (pitch >= -0.5) & (pitch < 12 * OCTAVES - 0.5)
    to = np.zeros((used.sum(), 12))
    to[np.arange(used.sum()), np.round(pitch[used]).astype(int) % 12] = 1
    window = np.hanning(size)
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
    out = np.concatenate([np.abs(np.fft.rfft(frames[a : a + 256] * window, axis=1)[:, used]) ** 2 @ to for a in range(0, len(frames), 256)])
    soft = out.copy()
    soft[1:] += 0.5 * out[:-1]
    soft[:-1] += 0.5 * out[1:]
    norm = np.sqrt((soft**2).sum(1, keepdims=True))
    return np.where(norm > 1e-6, soft / np.maximum(norm, 1e-6), 0)


def items(frames: np.ndarray) -> np.ndarray:
    """A packed integer for each place where SPAN frames fit."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.tile(frames, (1, 2)).cumsum(0).cumsum(1)  # pitch classes go round
    at = np.arange(n)

    def box(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[at + t1, y1] - image[at + t0, y1] - image[at + t1, y0] + image[at + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        all_ = box(0, w, y, y + h)
        if kind == 0:  # later half against earlier
            one = box(w // 2, w, y, y + h)
        elif kind == 1:  # upper half against lower
            one = box(0, w, y + h // 2, y + h)
        elif kind == 2:  # opposite quarters
            one = box(0, w // 2, y, y + h // 2) + box(w // 2, w, y + h // 2, y + h)
        elif kind == 3:  # middle in time
            one = box(w // 4, w - w // 4, y, y + h)
        elif kind == 4:  # middle in pitch
            one = box(0, w, y + h // 3, y + h - h // 3)
        else:  # the box against all pitch classes
            one, all_ = all_, box(0, w, 0, 12)
        level = np.log1p(np.maximum(one, 0)) - np.log1p(np.maximum(all_ - one, 0))
        out = out << np.uint32(2) | GRAY[np.searchsorted(EDGES, level)]
    return out


def fingerprint(data: bytes | None) -> np.ndarray:
    return items(chroma(*read_wav(data)))


def align(a: np.ndarray, b: np.ndarray, bits: int = KEY_BITS, least: int = 1) -> tuple[int, int, int] | None:
    """Offset of b's items in a's time, overlap and bit errors; None if no leading bits agree anywhere.

    Every value's places in one are subtracted from its places in the other; of the offsets with at least `least` items of overlap,
    the one that occurs most wins.
    """
    drop = np.uint32(32 - bits)
    x, y = a >> drop, b >> drop
    order = np.argsort(x, kind="stable")
    low, high = np.searchsorted(x[order], y, "left"), np.searchsorted(x[order], y, "right")
    n = high - low
    if not n.sum():
        return None
    votes = np.zeros(len(a) + len(b), np.int64)
    most = max(1, (1 << 20) // max(1, len(a)))
    for s in range(0, len(b), most):  # bounded hits at a time
        m = n[s : s + most]
        flat = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[s : s + most], m)
        votes += np.bincount(order[flat] - np.repeat(np.arange(s, s + len(m)), m) + len(b), minlength=len(votes))
    at = np.arange(len(votes)) - len(b)
    votes[np.minimum(len(a) - np.maximum(0, at), len(b) - np.maximum(0, -at)) < least] = 0
    if not votes.any():
        return None
    offset = int(votes.argmax()) - len(b)
    i, j = max(0, offset), max(0, -offset)
    k = min(len(a) - i, len(b) - j)
    return offset, k, int(np.bitwise_count(a[i : i + k] ^ b[j : j + k]).sum())


class Block:
    """Recordings that others are aligned with, all at once; the results are those of align()."""

    def __init__(self, prints: list[np.ndarray]):
        self.prints, self.sizes = prints, np.array([len(v) for v in prints], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(prints) if prints else np.zeros(0, np.uint32)
        self.shape, self.few = None, None
        keys = self.flat >> np.uint32(32 - KEY_BITS)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.at, self.owner = order, np.repeat(np.arange(len(prints)), self.sizes)[order]

    def align(self, own: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of each of the recordings that own shares leading bits with, offset, overlap and bit errors."""
        size = len(own)
        if size > LONG:
            got = [(q, *x) for q, v in enumerate(self.prints) if (x := align(v, own, least=least))]
            return tuple(np.array(got, np.int64).reshape(-1, 4).T)
        y = own >> np.uint32(32 - KEY_BITS)
        low, high = np.searchsorted(self.keys, y, "left"), np.searchsorted(self.keys, y, "right")
        n = high - low
        cells = self.sizes + size
        first = np.cumsum(cells) - cells  # a recording's offsets from -size on
        ends, votes, s = np.cumsum(n), np.zeros(int(cells.sum()), np.int64), 0
        while s < size:  # bounded hits at a time
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + (1 << 20), "right")))
            m = n[s:e]
            hit = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[s:e], m)
            # the place in the flat items plus a size for each earlier recording is the cell of that place's offset from item 0
            votes += np.bincount(self.at[hit] + self.owner[hit] * size - np.repeat(np.arange(s, e), m) + size, minlength=len(votes))
            s = e
        if not len(votes):
            return (np.zeros(0, np.int64),) * 4
        if self.shape != (size, least):  # recordings are often of one length
            at = np.arange(len(votes)) - np.repeat(first, cells) - size
            self.shape, self.few = (size, least), np.minimum(np.repeat(self.sizes, cells) - np.maximum(0, at), size - np.maximum(0, -at)) < least
        votes[self.few] = 0
        most = np.maximum.reduceat(votes, first)
        place = np.flatnonzero(votes == np.repeat(np.maximum(most, 1), cells))
        of = np.searchsorted(first, place, "right") - 1
        one = np.flatnonzero(np.diff(of, prepend=-1))  # the smallest of each recording's most voted offsets
        met, offset = of[one], place[one] - first[of[one]] - size
        if not len(met):
            return (np.zeros(0, np.int64),) * 4
        i, j = np.maximum(0, offset), np.maximum(0, -offset)
        k = np.minimum(self.sizes[met] - i, size - j)
        before = np.cumsum(k) - k
        step = np.arange(k.sum()) - np.repeat(before, k)
        wrong = np.bitwise_count(self.flat[step + np.repeat(self.starts[met] + i, k)] ^ own[step + np.repeat(j, k)])
        return met, offset, k, np.add.reduceat(wrong, before, dtype=np.int64)


def several(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows or bytes, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows or sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def fingerprints(media: DataFrame, key: str, audio: str) -> DataFrame:
    """(id, items) of every recording; items as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(x).astype(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(got, pa.int64())], ["id", "items"])

    return media.select(F.col(key).cast("long"), audio).mapInArrow(released(run), "id long, items array<long>")


ALIGNED = "array<struct<query_class: bigint, query_id: bigint, offset: int, overlap: int, bit_errors: int>>"


def nearest_query(prints: DataFrame, queries: Column, rate: float = RATE, overlap: int = OVERLAP) -> DataFrame:
    """For every recording (id, items) all query recordings that it aligns with at a rate of bit errors of at most `rate` over at
    least `overlap` items, and the one of the lowest rate among them; one value whose leading bits both have is enough for a pair to be tried.

    Equal queries are one class, named by a 64-bit hash of its items: `query_class` is that of a recording whose items a query has, and
    `alignments` has an entry for each class with another id than the recording's, its query_id the least such id; pairs() gives them query by query.
    Queries go to every task in blocks of at most about QUERIES, and of about ITEMS items; a task takes the blocks in turn for TOGETHER recordings at a time, so one step of the plan meets
    them all, and equal recordings among these are aligned once. query_id, offset, overlap and bit_errors are those of the best, null where there is none.
    """
    asked = prints.where(queries & (F.size("items") > 0)).groupBy("items").agg(F.slice(F.array_sort(F.collect_set("id")), 1, 2).alias("ids")).where(F.size("ids") > 0).withColumn("class", F.xxhash64("items"))
    number, total = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("items").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-number // QUERIES), -(-total // ITEMS))
    sent = Blocks(prints.sparkSession)
    for block in range(blocks):
        rows = asked.where(F.pmod(F.col("class"), F.lit(blocks)) == block).orderBy("ids", "class").toArrow()
        sent.add([(i, c, np.array(v, np.uint32)) for i, c, v in zip(rows["ids"].to_pylist(), rows["class"].to_pylist(), rows["items"].to_pylist(), strict=True)])
    kind = pa.list_(pa.struct([("query_class", pa.int64()), ("query_id", pa.int64()), ("offset", pa.int32()), ("overlap", pa.int32()), ("bit_errors", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in several(batches, TOGETHER, BYTES):
            ends, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy().astype(np.uint32)
            ids, owns = batch.column(0).to_pylist(), [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            named: list[int | None] = [None] * len(ids)
            results: list[list[dict]] = [[] for _ in ids]
            for queries_ in sent:
                block = Block([v for _, _, v in queries_])
                classes = {v.tobytes(): c for _, c, v in queries_}
                done: dict[bytes, list] = {}
                for i, (id_, own) in enumerate(zip(ids, owns, strict=True)):
                    key = own.tobytes()
                    if key not in done:
                        met, offset, k, wrong = block.align(own, overlap)
                        good = wrong <= rate * 32 * k
                        done[key] = list(zip(*(x[good].tolist() for x in (met, offset, k, wrong)), strict=True))
                    named[i] = classes.get(key, named[i])
                    for q, o, k, e in done[key]:
                        its, class_, _ = queries_[q]
                        other = next((x for x in its if x != id_), None)
                        if other is not None:
                            results[i].append({"query_class": class_, "query_id": other, "offset": o, "overlap": k, "bit_errors": e})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(named, pa.int64()), pa.array(results, kind)], ["id", "items", "query_class", "alignments"])

    out = prints.select("id", "items").mapInArrow(run, f"id long, items array<long>, query_class long, alignments {ALIGNED}")
    ranked = F.transform("alignments", lambda x: F.struct((x["bit_errors"] / x["overlap"]).alias("r"), *[x[c].alias(c) for c in ("query_id", "offset", "overlap", "bit_errors")]))
    best = out.withColumn("_best", F.array_min(ranked))
    return best.select("id", "items", *[F.col(f"_best.{c}").alias(c) for c in ("query_id", "offset", "overlap", "bit_errors")], "query_class", "alignments")


def pairs(found: DataFrame, queries: Column) -> DataFrame:
    """(query_id, id, offset, overlap, bit_errors) of every query and recording that align, from what nearest_query() gave."""
    members = found.where(queries & F.col("query_class").isNotNull()).select(F.col("query_class").alias("_class"), F.col("id").alias("query_id")).distinct()
    rows = found.select("id", F.explode("alignments").alias("_a")).select("id", F.col("_a.query_class").alias("_of"), "_a.offset", "_a.overlap", "_a.bit_errors")
    return rows.join(members, F.col("_of") == F.col("_class")).where(~F.col("query_id").eqNullSafe(F.col("id"))).select("query_id", "id", "offset", "overlap", "bit_errors")


def tones(vectors: DataFrame, key: str, vector: str, rate: int = 4000, note: float = 0.125) -> DataFrame:
    """(id, audio): a recording for each vector, as the tables have none: each component is a note whose pitch follows its value."""

    def one(v: list | None) -> bytes | None:
        if not v:
            return None
        x = np.nan_to_num(np.array([0.0 if c is None else c for c in v]), posinf=0, neginf=0)
        pitch = LOW * 2 ** (np.clip(np.round(x * 60 + 24), 0, 47) / 12)
        phase = np.cumsum(np.repeat(pitch, int(rate * note))) * (2 * np.pi / rate)
        return write_wav(0.6 * np.sin(phase) * np.repeat(x != 0, int(rate * note)), rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 64):  # a recording is far larger than its vector
                part = batch.slice(a, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([one(v) for v in part.column(1).to_pylist()], pa.binary())], ["id", "audio"])

    return vectors.select(F.col(key).cast("long"), vector).mapInArrow(released(run), "id long, audio binary")


def query(spark, sf_dir):
    media = tones(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = nearest_query(stored(fingerprints(media, "id", "audio"), "prints"), F.col("id") % 100 == 0)
    crc = F.crc32(F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).cast("binary"))
    return found.select(F.col("id").alias("vec_id"), F.size("items").cast("long").alias("n_items"), crc.alias("items_crc32"), "query_id", "offset", "overlap", "bit_errors", "query_class", "alignments")
