"""Vectorised byte and word kernels over Arrow string columns (numpy only, no Spark)."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 19  # bytes of text handled at once; one longer text is handled alone
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256

#: Byte values with A-Z folded to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Masks of the first 0 to 8 bytes of a word.
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: True for bytes of a word: all but ASCII white space.
WORD_BYTES = ~_SPACE
#: True for digits, ASCII letters and every byte of a character beyond ASCII.
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[0x30:0x3A] = ALNUM_BYTES[0x41:0x5B] = ALNUM_BYTES[0x61:0x7B] = ALNUM_BYTES[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def pieces(column: pa.Array, limit: int = PIECE):
    """Yields (first row, bytes, offsets) for runs of rows of at most `limit` bytes, or one row.

    Nulls count as empty. Nothing is copied but the offsets.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    offs = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, raw[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop


def views(column, kind) -> list[np.ndarray]:
    """The values of a binary column as arrays of `kind`, without a copy where they are aligned."""
    out = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        off = np.frombuffer(chunk.buffers()[1], np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = chunk.buffers()[2]
        flat = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        out += [flat[a:b].view(kind) if a % np.dtype(kind).itemsize == 0 else np.frombuffer(flat[a:b].tobytes(), kind) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return out


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes for which `table` holds, and for each row its first word's index."""
    n = len(data)
    w = np.zeros(n + 2, bool)
    w[1:-1] = table[data]
    inner, before = w[1:-1], w[:-2].copy()
    at = offs[:-1][offs[:-1] < n]
    before[at] = False
    starts = np.flatnonzero(inner & ~before)
    after = w[2:].copy()
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inner & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, seed: int = 0) -> np.ndarray:
    """64 bits for each range of bytes, eight bytes a step through a finaliser: no power series in the
    bytes, so regular texts meet no more often than random ones. Another seed gives independent values."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data] if fold else data
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    size = ends - starts
    h = mix(size.astype(U64) * U64(BASE) + U64(seed * 0x632BE59BD9B4E019 + 1 & 2**64 - 1))
    long = np.flatnonzero(size > LONG_WORD)
    which = np.flatnonzero((size > 0) & (size <= LONG_WORD)) if len(long) else np.flatnonzero(size > 0)
    at, left = starts[which], size[which]
    while len(which):
        w = np.ascontiguousarray(eight[at]).view("<u8").ravel() & _HEAD[np.minimum(left, 8)]
        h[which] = mix((h[which] ^ w) * U64(0xD1342543DE82EF95) + U64(BASE))
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    for i in long.tolist():
        h[i] = int.from_bytes(blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """64 bits for every k values in a row of h, each step through the finaliser."""
    m = max(len(h) - k + 1, 0)
    s = np.full(m, k, U64)
    for i in range(k):
        s = mix((s ^ h[i : i + m]) * U64(0xD1342543DE82EF95) + U64(BASE))
    return s


def digest(raw) -> bytes:
    """16 bytes that stand for a byte string."""
    return blake2b(raw, digest_size=16).digest()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minima of v[i : i + w] for every i that has a whole window."""
    n = len(v)
    if n < w:
        return v[:0]
    pad = -n % w
    top = np.full(n + pad, np.iinfo(v.dtype).max, v.dtype)
    top[:n] = v
    grid = top.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def union_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open intervals; touching ones join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.ones(len(s), bool)
    first[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(first)
    return s[at], e[np.append(at[1:], len(s)) - 1]
