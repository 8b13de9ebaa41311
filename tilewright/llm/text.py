"""Words and their 64-bit hashes for whole Arrow columns at once, in numpy."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_SHINGLE = [pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1 for k in range(16)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public splitmix64 generator, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for j < n, kept for the next call."""
    if len(_powers.get("up", ())) < n:
        size = max(n, (1 << 20) + 1024)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                out = np.ones(size, U64)
                done = 1
                while done < size:  # doubling: base**(done + i) = base**done * base**i
                    step = U64(pow(base, done, 1 << 64))
                    take = min(done, size - done)
                    out[done : done + take] = out[:take] * step
                    done += take
                _powers[key] = out
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes (a longer row comes alone): first row, end row, bytes, offsets from 0."""
    data, offsets = buffers(column)
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, rows)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of true bytes; a row's edge ends a run."""
    size = len(inside)
    if not size:
        return (np.zeros(0, np.int64),) * 3
    first = np.ones(size, bool)
    first[1:] = ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < size)]
    first[edges] = True
    last = np.ones(size, bool)
    last[:-1] = ~inside[1:]
    last[edges - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    return runs(~_SPACE[data], offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z taken as a-z."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _power(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(_SHINGLE[7])
    return mix(h)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each row, the sorted distinct hashes of its runs of `width` words; a shorter row is one run."""
    starts, ends, row = words(data, offsets)
    rows = len(offsets) - 1
    h = word_hashes(data, starts, ends)
    bounds = np.searchsorted(row, np.arange(rows + 1))
    out: list[np.ndarray] = []
    runs = np.zeros(0, U64)
    if len(h) >= width:
        with np.errstate(over="ignore"):
            runs = np.zeros(len(h) - width + 1, U64)
            for k in range(width):
                runs += h[k : len(h) - width + 1 + k] * U64(_SHINGLE[k])
        runs = mix(runs)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(runs[a : b - width + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            with np.errstate(over="ignore"):
                one = sum((h[a + k] * U64(_SHINGLE[k]) for k in range(b - a)), U64(b - a))
            out.append(mix(np.array([one], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column of numpy arrays."""
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64) if flat.dtype == U64 else flat, kind))


def released(run: Callable) -> Callable:
    """A task function that gives free memory back to the system when its partition ends: workers stay for the next task,
    and what one kind of task held should not add to what the next one needs."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task
