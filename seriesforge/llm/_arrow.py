"""Arrow batch helpers shared by the text operators.

Everything works on the UTF-8 buffer of an Arrow string column, cut into
chunks of a few MB so that the 8-byte-per-character numpy arrays of a chunk
stay small next to an executor's memory. A text is never cut: one that is
longer than the limit forms a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20



#: Caches (of functools) that a worker keeps from task to task, by the name of their operator.
KEPT: dict[str, Callable] = {}


def forget(but: str | None = None) -> None:
    """Empties the caches of all operators but one."""
    full = [cache for name, cache in KEPT.items() if name != but and cache.cache_info().currsize]
    for cache in full:
        cache.cache_clear()
    if full:
        give_back()


def give_back() -> None:
    """Gives memory that is free again back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run: Callable, keeps: str | None = None) -> Callable:
    """The function of batches, which leaves little behind, as a worker lives on with the next task.

    It begins without what other operators keep, and at its end gives free memory back.
    """

    def wrapped(batches):
        forget(keeps)
        yield from run(batches)
        give_back()

    return wrapped


#: Word separators of the contracts: space and U+0009 to U+000D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, 1 << 16)
_INV = _powers(_BASE_INV, 1 << 16)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        _POW, _INV = _powers(_BASE, n), _powers(_BASE_INV, n)
    return _POW, _INV


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int, lower: bool = False) -> np.ndarray:
    """A random 64-bit value for each byte; separators give 0."""
    table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        table[0x41:0x5B] = table[0x61:0x7B]
    table[SPACE] = 0
    return table


PLAIN, LOWER = byte_table(11), byte_table(11, lower=True)


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    buf, offs = string_buffer(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and each row's offset into them."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = SPACE[buf]
    edge = np.zeros(n + 1, dtype=bool)  # a row begins here
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = PLAIN) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    n = len(buf)
    power, inverse = _power_tables(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(table[buf] * power[:n], out=total[1:])
    out = (total[ends] - total[starts]) * inverse[starts]
    return mix64(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(h: np.ndarray, k: int, multiplier: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """A hash of each run of k hashes, by its first; the last k - 1 places are left out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    m = np.uint64(multiplier)
    out = h[:n].copy()
    for i in range(1, k):
        out *= m
        out += h[i : i + n]
    return mix64(out)


def gram_rows(word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in word numbers) where a run of k words lies within a row, and those rows."""
    counts = np.maximum(np.diff(word_offs) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return np.arange(len(rows)) - np.repeat(first, counts) + word_offs[:-1][rows], rows


def ints(col: pa.Array) -> np.ndarray:
    return col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
