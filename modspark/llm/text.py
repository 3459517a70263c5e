"""Vectorised words, hashes and shingles over Arrow text columns.

All functions work on the UTF-8 bytes of a run of texts at once: white space is ASCII
(`[\\x20\\x09-\\x0D]`), so bytes of longer code points never end a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled in one numpy step; a longer text makes a step of its own.
STEP = 1 << 18
#: Bytes of a long text that are hashed at a time: a step's arrays are some 30 times as large.
PIECE = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What parts words for token features: all ASCII but letters and digits.
PARTS = np.ones(256, bool)
PARTS[128:] = False
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    PARTS[ord(_a) : ord(_b) + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        full = np.full(max(n, STEP + 1), base, np.uint64)
        full[0] = 1
        held = np.cumprod(full, dtype=np.uint64)
        if n <= 8 * STEP:
            _powers[base] = held
    return held[:n]


def place_of(names: list[str], wanted: str) -> int:
    """Where a column stands: by its name, or by that without regard to case, as Spark finds it."""
    if wanted in names:
        return names.index(wanted)
    return [x.lower() for x in names].index(wanted.lower())


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty texts, and where each text begins (one more)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about STEP bytes: first text, end, their bytes, their places."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + STEP, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the place of each text's first word (one more)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~parts[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, wherever it stands; spans ascend and don't overlap much.

    Works through long texts, and long spans, PIECE bytes at a time.
    """
    if len(data) <= PIECE:
        return mix(_sums(data, starts, ends))
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        low = int(starts[i])
        j = int(np.searchsorted(ends, low + PIECE, "right"))
        if j > i:
            out[i:j] = _sums(data[low : int(ends[j - 1])], starts[i:j] - low, ends[i:j] - low)
        else:
            j, total, high = i + 1, 0, int(ends[i])
            for p in range(low, high, PIECE):
                part = data[p : min(p + PIECE, high)]
                total += int(_sums(part, np.array([0]), np.array([len(part)]))[0]) * pow(_BASE, p - low, 1 << 64)
            out[i] = total & _MASK
        i = j
    return mix(out)


def _seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) ^ np.uint64(salt)) | np.uint64(1)


def grams(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a text, and each text's first one (one more).

    A text of fewer words, but one at least, has one run of all its words; none for no word.
    """
    count = np.diff(first)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.zeros(len(first), np.int64)
    np.cumsum(runs, out=at[1:])
    text = np.repeat(np.arange(len(count)), runs)
    begin = first[:-1][text] + np.arange(at[-1]) - at[:-1][text]
    seeds = _seeds(size, 0x5E)
    out = np.zeros(at[-1], np.uint64)
    long_enough = np.repeat(count >= size, runs)
    b = begin[long_enough]
    total = np.zeros(len(b), np.uint64)
    for p in range(0, len(b), PIECE):
        q = slice(p, p + PIECE)
        for k in range(size):
            total[q] += word[b[q] + k] * seeds[k]
    out[long_enough] = total
    for t in np.flatnonzero((count > 0) & (count < size)):
        some = word[first[t] : first[t + 1]]
        out[at[t]] = (int(np.sum(some * seeds[: len(some)], dtype=np.uint64)) + 3 * int(seeds[len(some) - 1])) & _MASK
    return mix(out), at


def sorted_sets(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, ascending, and where they begin (one more)."""
    out, counts = [], np.zeros(len(at), np.int64)
    for t in range(len(at) - 1):
        x = np.sort(values[at[t] : at[t + 1]])
        if len(x) > 1:
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        out.append(x)
        counts[t + 1] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(counts)


def reduced(ufunc: np.ufunc, values: np.ndarray, at: np.ndarray, empty, kind: type | None = None) -> np.ndarray:
    """ufunc over each text's values, as numbers of a kind; `empty` where there are none."""
    out = np.full(len(at) - 1, empty, kind or values.dtype)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = ufunc.reduceat(values, at[:-1][some], dtype=kind)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def binaries(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column: the bytes of each text's values."""
    wide = flat.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * wide).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())]).cast(pa.binary())
