"""Small numpy helpers that run inside Spark tasks, over Arrow string columns.

All of them look at whole texts as UTF-8 bytes. Null counts as the empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text looked at together; a longer text is looked at alone, whole.
CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xD6E8FEB86659FD93


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Bytes of words: all but ASCII white space; and ASCII letters, digits and all non-ASCII.
NOT_SPACE = ~table(b" \t\n\v\f\r")
ALNUM = table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column, without copies of the bytes."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bytes) of runs of rows of at most `limit` bytes, or one longer row."""
    at, raw = utf8(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, at[lo : hi + 1] - at[lo], raw[at[lo] : at[hi]]
        lo = hi


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Gives memory that is no longer used back to the system, as a worker lives on and shares its machine with others."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_POWERS = {BASE: Powers(BASE), BASE2: Powers(BASE2)}


def prefix(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums of (byte + 1) * base**position, modulo 2**64; one more than there are bytes."""
    up, _ = _POWERS[base].get(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def prefix_of(x: np.ndarray, base: int = BASE) -> np.ndarray:
    """As prefix(), of 64-bit symbols."""
    up, _ = _POWERS[base].get(len(x) + 1)
    out = np.zeros(len(x) + 1, U64)
    np.cumsum(x * up[: len(x)], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Polynomial hashes of spans, equal for equal bytes wherever they stand."""
    _, down = _POWERS[base].get(len(pre))
    return (pre[end] - pre[start]) * down[start]


def rolling(pre: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Polynomial hashes of all windows of k bytes."""
    n = len(pre) - k
    if n <= 0 or not k:
        return np.zeros(0, U64)
    _, down = _POWERS[base].get(len(pre))
    out = pre[k:] - pre[:n]
    out *= down[:n]
    return out


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes of a kind; none crosses rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    m = kind[data]
    first = off[:-1][off[:-1] < off[1:]]
    s = m.copy()
    s[1:] &= ~m[:-1]
    s[first] = m[first]
    e = m.copy()
    e[:-1] &= ~m[1:]
    last = first[1:] - 1
    e[last] = m[last]
    start = np.flatnonzero(s)
    end = np.flatnonzero(e) + 1
    cut = np.searchsorted(start, off)
    return start, end, np.repeat(np.arange(len(off) - 1), np.diff(cut))


def word_hashes(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of each word, with A-Z lower-cased."""
    start, end, row = words(data, off, kind)
    return mix(spans(prefix(LOWER[data]), start, end)), start, end, row


#: Odd factors, one for each place in a shingle.
_PLACES = (np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) << U64(1)) | U64(1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes; runs that cross rows are the caller's to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * _PLACES[0]
    for i in range(1, k):
        out += h[i : n + i] * _PLACES[i]
    return mix(out)


def grams_of_rows(x: np.ndarray) -> np.ndarray:
    """Hashes of the last axis; the place on the axis before counts, so equal values in other bands differ."""
    out = np.zeros(x.shape[:-1], U64)
    for i in range(x.shape[-1]):
        out += mix(x[..., i].copy()) * _PLACES[i]
    return mix(out + np.arange(x.shape[-2], dtype=U64) * U64(BASE2))


def gram(h: np.ndarray) -> int:
    """The hash of one whole run of word hashes, of any length below 64."""
    return int(mix((h * _PLACES[: len(h)]).sum(keepdims=True, dtype=U64))[0])


def binary_rows(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
