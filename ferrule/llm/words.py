"""Whole texts of an Arrow batch as one byte buffer, with numpy word spans and word hashes.

Texts stay where Arrow put them: one uint8 buffer and an offset for each text. Words, hashes and
n-grams are arrays over that buffer, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of a word once A-Z are lower-case: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
#: Bytes of a token that white space ends: all but 0x20 and 0x09-0x0D.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[0x09:0x0E] = NONSPACE[0x20] = False

_BASES = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size, base = max(1 << 16, 1 << (n - 1).bit_length()), int(_BASES[which])
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U64(b))
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        have = _powers[which] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def prefix_hash(buf: np.ndarray, which: int = 0) -> np.ndarray:
    """len(buf) + 1 sums, from which span_hash() has the hash of any span."""
    p, _ = powers(len(buf) + 1, which)
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum((buf.astype(U64) + U64(1)) * p[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of buf[start:end], wherever in the buffer they lie."""
    _, inverse = powers(len(sums), which)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash of hashes in order."""
    out = np.full(parts[0].shape, U64(0x243F6A8885A308D3))
    for x in parts:
        out = mix(out * U64(0x9FB21C651E98DF25) + x)
    return out


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, one after another, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = (1 << 20) - 4096) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes, a longer text alone, so that arrays stay in the cache."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends (exclusive) and, for each text, its first word's number (len + 1); a text's end ends a word."""
    mask = inside[buf]
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    stop = mask.copy()
    stop[:-1] &= ~mask[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    begin[inner] = mask[inner]
    stop[inner - 1] = mask[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)
